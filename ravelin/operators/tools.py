"""Tools: named column functions with an argument schema, dispatched inside a plan, and table functions whose rows follow from the tool that is called."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: str
    run: Callable[[Column], Column]


@dataclass
class Registry:
    tools: dict[str, Tool] = field(default_factory=dict)

    def tool(self, name: str, description: str, schema: str) -> Callable:
        """Register a function of the parsed arguments (a struct of ``schema``) to a column."""

        def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
            self.tools[name] = Tool(name, description, schema, f)
            return f

        return add

    def dispatch(self, name: Column, arguments: Column, otherwise: str = "no such tool") -> Column:
        """Result of the named tool on JSON arguments; arguments that don't fit give null."""
        out = F.lit(otherwise)
        for t in self.tools.values():
            out = F.when(name == t.name, t.run(F.from_json(arguments, t.schema)).cast("string")).otherwise(out)
        return out

    def run_all(self, steps: DataFrame, actions: str = "actions") -> DataFrame:
        """Every action of every step: id, place, tool, observation; actions are (tool, input) structs."""
        rows = steps.select("id", F.posexplode(actions).alias("place", "a"))
        return rows.select("id", "place", F.col("a.tool").alias("tool"), self.dispatch(F.col("a.tool"), F.col("a.input")).alias("observation"))


@dataclass(frozen=True)
class TableTool:
    """A tool of typed arguments, nested structs included, that gives rows: ``run`` takes the arguments as a dict and gives tuples of ``result``."""

    description: str
    arguments: str
    result: str
    run: Callable[[dict], Iterable[tuple]]


def misfit(want: DataType, have: DataType, at: str = "arguments") -> str | None:
    """What is wrong with arguments of a type, by the name of the field; None if nothing is."""
    if isinstance(have, NullType):
        return None
    if isinstance(want, StructType) and isinstance(have, StructType):
        fields = {f.name: f.dataType for f in have}
        unknown = next((n for n in fields if n not in want.names), None)
        if unknown is not None:
            return f"{at}.{unknown} is not an argument"
        missing = next((n for n in want.names if n not in fields), None)
        if missing is not None:
            return f"{at}.{missing} is missing"
        return next((m for f in want if (m := misfit(f.dataType, fields[f.name], f"{at}.{f.name}"))), None)
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return misfit(want.elementType, have.elementType, at + "[]")
    return None if want == have else f"{at} is {have.simpleString()}, not {want.simpleString()}"


def register_tables(spark: SparkSession, name: str, tools: dict[str, TableTool]) -> None:
    """A table function ``name(tool, arguments)`` for lateral joins. The tool's name is a constant; its rows have the result's columns, so the schema
    of a query depends on the tool it calls. Unknown tools and arguments that don't fit fail when the query is analyzed, and name the field.
    Null arguments give no rows. Fields are taken by name, in any order."""
    known = {k: (StructType.fromDDL(t.arguments), StructType.fromDDL(t.result), t.run) for k, t in tools.items()}

    class Call:
        @staticmethod
        def analyze(tool: AnalyzeArgument, arguments: AnalyzeArgument) -> AnalyzeResult:
            if not tool.isConstantExpression or tool.value not in known:
                raise ValueError(f"no such tool: {tool.value}; there are {', '.join(sorted(known))}")
            want, result, _ = known[tool.value]
            wrong = misfit(want, arguments.dataType)
            if wrong:
                raise ValueError(f"{tool.value}: {wrong}")
            return AnalyzeResult(result)

        def eval(self, tool, arguments):
            if arguments is not None:
                yield from known[tool][2](arguments.asDict(recursive=True))

    spark.udtf.register(name, F.udtf(Call))
