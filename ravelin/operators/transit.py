"""Timetables, itineraries and fares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import clock_label, direction, service_seconds, station


def board(times: DataFrame, now: int, before: int = 15 * 60, after: int = 60 * 60) -> DataFrame:
    """Of each direction the first train of the service day, those strictly within the band around ``now`` (seconds of the service day) and the last two, each once.

    ``times`` has arrival (HHmmss) and train, and may repeat them.
    """
    t = service_seconds(F.col("arrival"))
    rows = times.select(direction(F.col("train")).alias("direction"), "arrival", "train", t.alias("key"), (F.floor(t / 10000) * 3600 + F.floor(t / 100) % 100 * 60 + t % 100).cast("int").alias("seconds"))
    near = (F.col("seconds") > now - before) & (F.col("seconds") < now + after)
    # the ends of the day are sought among its seconds, which don't grow with the trains; only trains of those seconds are ranked
    asc = lambda *by: F.row_number().over(Window.partitionBy("direction").orderBy(*map(F.asc_nulls_last, by)))
    desc = lambda *by: F.row_number().over(Window.partitionBy("direction").orderBy(*map(F.desc_nulls_last, by)))
    ends = rows.select("direction", "key").distinct().withColumns({"a": asc("key"), "d": desc("key")}).where("a = 1 or d <= 2")
    ends = F.broadcast(ends.select(F.col("direction").alias("of"), F.col("key").alias("at")))  # three rows a direction at most
    edge = rows.join(ends, (F.col("direction") == F.col("of")) & F.col("key").eqNullSafe(F.col("at")), "left_semi").distinct()
    first, last = edge.withColumn("rank", asc("key", "train")).where("rank = 1"), edge.withColumn("rank", desc("key", "train")).where("rank <= 2")
    return rows.where(near).union(first.drop("rank")).union(last.drop("rank")).select("direction", "arrival", "train", clock_label(F.col("arrival")).alias("label")).distinct()


def modes(legs: Column) -> Column:
    return F.array_distinct(F.transform(legs, lambda x: x["mode"]))


def pick_itinerary(itineraries: Column) -> Column:
    """The first itinerary unless it takes a bus; then the cheapest one without, if there is any."""
    fare = lambda i: i["fare"]["regular"]["totalFare"]
    ordered = F.array_sort(itineraries, lambda a, b: F.when(fare(a) < fare(b), -1).when(fare(a) > fare(b), 1).otherwise(0))
    bus = lambda i: F.array_contains(modes(i["legs"]), "BUS")
    first = F.get(itineraries, F.lit(0))
    return F.when(bus(first), F.coalesce(F.get(F.filter(ordered, lambda i: ~bus(i)), F.lit(0)), first)).otherwise(first)


def named_legs(legs: DataFrame) -> DataFrame:
    """Subway legs name their stops with the suffix, and so do the legs beside them: (trip, n, mode, start, end)."""
    w = Window.partitionBy("trip").orderBy("n")
    sub = F.col("mode") == "SUBWAY"
    full = legs.withColumns({"s": F.when(sub, station(F.col("start"))).otherwise(F.col("start")), "e": F.when(sub, station(F.col("end"))).otherwise(F.col("end"))})
    before, after = F.lag(F.when(sub, F.col("e"))).over(w), F.lead(F.when(sub, F.col("s"))).over(w)
    return full.select("trip", "n", "mode", F.coalesce(F.when(~sub, before), "s").alias("start"), F.coalesce(F.when(~sub, after), "e").alias("end"))


def without_home_walks(legs: Column, home: str) -> Column:
    return F.filter(legs, lambda x: ~((x["mode"] == "WALK") & (x["end"]["name"] == home)))


def steps_from(steps: DataFrame, mark: str = "출구") -> DataFrame:
    """Steps of each leg from the first that names an exit; (leg, n, description)."""
    seen = F.max(F.col("description").contains(mark).cast("int")).over(Window.partitionBy("leg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("seen", seen).where("seen = 1").drop("seen")


def sentences(steps: Column) -> Column:
    """Numbered lines of an array of step texts; null steps are skipped."""
    return F.array_join(F.transform(F.filter(steps, lambda x: x.isNotNull()), lambda x, i: F.format_string("%d. %s", i + 1, x)), "\n")


def fares(table: DataFrame, ages: list[str]) -> DataFrame:
    """Rows of the fare table for the groups asked for; all rows if none is asked for."""
    return table.where(F.col("age").isin(ages)) if ages else table
