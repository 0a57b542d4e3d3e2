"""Column expressions shared by the operators that use no Python on the executors."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words, as a character class.
GAP = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, gap: str = GAP) -> Column:
    """Runs of characters outside ``gap``."""
    return F.array_remove(F.split(text, f"{gap}+", -1), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def windows(items: Column, k: int, make: Callable[..., Column], step: int = 1) -> Column:
    """make(k items) for every ``step``-th place where k items start, from the first; none for fewer items."""
    n = F.size(items) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step)), lambda i: make(*[F.get(items, i + o) for o in range(k)]))).otherwise(F.array())


def covered(places: Column, k: int) -> Column:
    """How many places lie in at least one of [p, p + k) for the ascending ``places``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(s: Column, p: Column) -> Column:
        end = p.cast("long") + k
        return F.struct((s["n"] + end - F.greatest(s["end"], p.cast("long"))).alias("n"), end.alias("end"))

    return F.aggregate(places, start, add)["n"]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints what ``op`` (a sum, a maximum) makes of those before it, 0 for the first.

    Arrays grow by copying, so blocks of about the square root of the length are scanned first, and then their totals.
    """

    def plain(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, lambda s, v: F.struct(op(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def blocked(x: Column) -> Column:
        each = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(x)))).cast("int")
        first = F.sequence(F.lit(1), F.size(x), each)
        blocks = F.transform(first, lambda i: plain(F.slice(x, i, each)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, plain(F.transform(b, lambda y: y["at"]))["out"], lambda y, off: F.transform(y["out"], lambda v: op(off, v)))))

    return F.when(F.size(values) > 0, let(values, blocked)).otherwise(F.array().cast("array<int>"))


#: Code points of the pieces that a text is cut into to take many parts out of it.
PIECE = 512


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text cut by pieces(), without a look at what lies before."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(cut, first + 1, last - first + 1), ""), start - first * PIECE + 1, end - start)
