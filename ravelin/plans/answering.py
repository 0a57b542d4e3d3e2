"""Queries of answering over the given tables: claims, typed tools and rewriting with retries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ravelin.operators import claims, rag
from ravelin.operators.tools import TableTool, register_tables
from ravelin.plans.registry import query, table, tokens_sql
from ravelin.sources import sinks
from ravelin.streaming import batches

_CLAIM = f"list_sort(list_distinct({tokens_sql('claim')}))"


@query(rf"""with recursive c as (select id, side, {_CLAIM} as w from (select doc_id as id, 'a' as side, unnest(regexp_split_to_array(text, '[.!?\n]+')) as claim from documents union all select doc_id, 'b', unnest(regexp_split_to_array(replace(text, ' a', ' b'), '[.!?\n]+')) from documents)),
    g as (select id, side, w, count(*) as n from c where len(w) > 0 group by all),
    p as (select x.id, x.w as a, y.w as b, x.n as na, y.n as nb, len(list_intersect(x.w, y.w)) as m from g x join g y on x.id = y.id and x.side = 'a' and y.side = 'b' and 2 * len(x.w) >= len(y.w) and 2 * len(y.w) >= len(x.w)),
    e as (select id, a, b, na, nb, cast(m as double) / (len(a) + len(b) - m) as alike, cast(0 as bigint) as taken from p where 2 * m >= len(a) + len(b) - m),
    r as (select * from e union all select id, a, b, na - coalesce(sum(now) over (partition by id, a), 0), nb - coalesce(sum(now) over (partition by id, b), 0), alike, now from
        (select *, case when row_number() over (partition by id, a order by alike desc, b) = 1 and row_number() over (partition by id, b order by alike desc, a) = 1 then least(na, nb) else 0 end as now from r where na > 0 and nb > 0)),
    t as (select id, cast(sum(taken) as bigint) as tp from r group by id), s as (select id, cast(sum(n) filter (where side = 'a') as bigint) as made, cast(sum(n) filter (where side = 'b') as bigint) as wanted from g group by id)
    select d.doc_id as id, coalesce(tp, 0) as tp, coalesce(made, 0) - coalesce(tp, 0) as fp, coalesce(wanted, 0) - coalesce(tp, 0) as fn, round(case when coalesce(made, 0) + coalesce(wanted, 0) = 0 then 0.0 else 2.0 * coalesce(tp, 0) / (coalesce(made, 0) + coalesce(wanted, 0)) end, 6) as f1
    from documents d left join s on d.doc_id = s.id left join t on d.doc_id = t.id""")
def claim_correctness(spark, sf_dir):
    """Every document as an answer, held against itself with some words changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.replace("text", F.lit(" a"), F.lit(" b")).alias("reference"))
    return claims.correctness(d, sinks.scratch(spark))


def _stretch(given: dict) -> list[tuple]:
    words, part = (given["text"] or "").split(" "), given["part"]
    return [(k, w) for k, w in enumerate(words)][part["first"] :: part["step"]]


TABLES = {
    "stretch": TableTool("words of a text from a place on, each so many", "text string, part struct<first: int, step: int>", "place int, word string", _stretch),
    "size": TableTool("length of a text", "text string", "chars long", lambda given: [(len(given["text"] or ""),)]),
}


@query("""select item_id, cast(i as int) as place, w[i + 1] as word, cast(length(text) as bigint) as chars from (select item_id, text, w, unnest(range(item_id % 3, len(w), 4)) as i from (select item_id, coalesce(text, '') as text, string_split(coalesce(text, ''), ' ') as w from benchmark))""")
def table_tools(spark, sf_dir):
    """Two tools of different results called beside each row, one with a nested argument."""
    register_tables(spark, "ravelin_tool", TABLES)
    b = table(spark, sf_dir, "benchmark")
    return spark.sql(
        """select item_id, t.place, t.word, s.chars from {b},
        lateral ravelin_tool('stretch', named_struct('text', text, 'part', named_struct('first', cast(item_id % 3 as int), 'step', 4))) t,
        lateral ravelin_tool('size', named_struct('text', text)) s""",
        b=b,
    )


def _strict(prompts: list[str]) -> list[str]:
    """Answers in JSON, but fails on lengths divisible by 3 and leaves the title out on those divisible by 5."""
    if any(len(p) % 3 == 0 for p in prompts):
        raise ValueError("refused")
    return [json.dumps({"content": str(len(p))} if len(p) % 5 == 0 else {"title": p[:20].strip(), "content": str(len(p))}) for p in prompts]


def _plain(prompts: list[str]) -> list[str]:
    """Answers all, but not in JSON on lengths divisible by 7."""
    return ["I can't" if len(p) % 7 == 0 else json.dumps({"title": "", "content": str(len(p))}) for p in prompts]


@query("""select item_id, case when tries = 1 then trim(left(text, 20)) when n % 7 > 0 then '' end as title, case when tries = 1 or n % 7 > 0 then cast(n as varchar) end as content, case when tries = 2 and n % 7 = 0 then 'not a record' end as error, tries
    from (select *, length(text) as n, case when length(text) % 3 = 0 or length(text) % 5 = 0 then 2 else 1 end as tries from benchmark where text is not null)""")
def rewritten_records(spark, sf_dir):
    """Benchmark texts as records of title and content, by a model that fails for some, and a second one for those."""
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    got = rag.rewritten(b, "text", "title string, content string", sinks.scratch(spark), _strict, _plain, keys=("item_id",))
    return got.select("item_id", "parsed.title", "parsed.content", "error", "tries")


@query("""select event_type, count(*) as n, round(sum(value), 4) as total, (select count(*) from events) as n_rows, (select count(*) from events where event_type = 'error') as n_errors from events group by event_type""")
def stream_batches_once(spark, sf_dir):
    """Events as a stream whose batches are written once, beside the counters that were observed in the writes."""
    folder = sinks.scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern the path may be a file or a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    batches.write(stream, f"{folder}/out", f"{folder}/at", counters={"errors": (F.col("event_type") == "error").cast("int")}).awaitTermination()
    counted = batches.log(spark, f"{folder}/out").agg(F.sum(F.col("counted")["rows"]).alias("n_rows"), F.sum(F.col("counted")["errors"]).alias("n_errors"))
    by_type = batches.committed(spark, f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by_type.crossJoin(F.broadcast(counted))  # one row
