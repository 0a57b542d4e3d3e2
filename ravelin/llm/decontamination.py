"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are lower-cased A-Z and cut at ASCII other than digits and letters. An item's windows
are its runs of ``n`` words, or its whole word sequence if it has fewer. A document's window
is looked up by hash in the set of the items' windows and a hit is verified word by word.

The set is part of the plan (a constant hash set) while it has at most ``SET_LIMIT`` windows. To
spare documents without benchmark text the hashing of every window, blocks are then looked up first:
any place where a window of w words occurs contains a whole block of k = (w + 1) // 2 words that
starts at a multiple of k in the document, so a document none of whose non-overlapping blocks is
a block of an item has no window either. Up to ``BROADCAST_LIMIT`` windows, their hashes are a
broadcast table that every window's hash meets as it is made, so only hits are shuffled. Beyond,
windows are shuffled by their hash. The results are the same.

Defined cases: a null or empty text has no words and no hits; a null or wordless item has no
window; items with the same window are all named; equal item ids count once; repeated rows of
a document get equal results; an empty benchmark or document table gives no hits or no rows;
other columns are not read. A row without doc_id is treated as any other.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm._native import let, lower_ascii, windows, words

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Windows, or blocks of them, that a constant set may hold: some 10 MB of text in the plan.
SET_LIMIT = 100_000
#: Windows whose hashes are broadcast as a table: below 200 MB of memory an executor.
BROADCAST_LIMIT = 2_000_000


def _words(text: Column) -> Column:
    return words(lower_ascii(F.coalesce(text, F.lit(""))), GAP)


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items: w (size), gram (words joined by a space), items (their ids as strings)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("x")).where(F.size("x") > 0)
    long = F.filter(windows(F.col("x"), n, lambda *w: F.concat_ws(" ", *w)), lambda g: g.isNotNull())
    grams = F.when(F.size("x") < n, F.array(F.array_join("x", " "))).otherwise(long)
    found = items.select("item", F.least(F.size("x"), F.lit(n)).alias("w"), F.explode(F.array_distinct(grams)).alias("gram"))
    return found.groupBy("w", "gram").agg(F.collect_set("item").alias("items"))


def _joined(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


class TestSet:
    """The windows of a benchmark, ready to be looked up."""

    def __init__(self, benchmark: DataFrame, n: int, item_col: str, item_text_col: str, limit: int = SET_LIMIT):
        self.grams = item_windows(benchmark, n, item_col, item_text_col)
        g, k = F.split("gram", " "), F.floor((F.col("w") + 1) / 2).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(g) - k), lambda i: F.xxhash64(F.array_join(F.slice(g, i + 1, k), " ")))
        held = self.grams.select("w", "gram", F.xxhash64("gram").alias("h"), blocks.alias("b")).limit(limit + 1).collect()
        self.small = len(held) <= limit
        self.known: dict[int, dict[str, int]] = defaultdict(dict)
        self.blocks: dict[int, set[int]] = defaultdict(set)
        for r in held if self.small else []:
            self.known[r.w][r.gram] = r.h
            self.blocks[r.w].update(r.b)
        self.sizes = sorted(self.known) if self.small else sorted(r.w for r in self.grams.select("w").distinct().collect())  # n at most

    @staticmethod
    def block(w: int) -> int:
        return (w + 1) // 2

    def places(self, x: Column) -> Column:
        """Where words x hold a window of a small set by its hash: array of (w, at, gram)."""
        none = F.array().cast("array<struct<w:int,at:int,gram:string>>")
        return F.concat(none, *[self._of_size(x, w, none) for w in self.sizes])

    def _of_size(self, x: Column, w: int, none: Column) -> Column:
        known, blocks = list(self.known[w].values()), list(self.blocks[w])

        def place(g: Column, i: Column) -> Column:
            return F.when(F.xxhash64(g).isin(known), F.struct(F.lit(w).alias("w"), i.alias("at"), g.alias("gram")))

        every = F.filter(F.transform(windows(x, w, _joined), place), lambda p: p.isNotNull())
        if len(blocks) > SET_LIMIT:  # too many to be a part of the plan
            return every
        maybe = F.exists(windows(x, self.block(w), _joined, self.block(w)), lambda g: F.xxhash64(g).isin(blocks))
        return F.when(maybe, every).otherwise(none)

    def joined(self, texts: DataFrame, most: int) -> DataFrame:
        """(sha, at, end, gram) of the windows of (sha, x) rows whose hash is one of a large set's; equal texts give theirs once.

        Only places and hashes leave a text's row; the words of a window are joined where its hash is found.
        """
        hashes = self.grams.select(F.col("w").alias("of"), F.xxhash64("gram").alias("known")).distinct()
        few = hashes.limit(most + 1).count() <= most

        def of_size(x: Column, w: int) -> Column:
            return F.transform(windows(x, w, lambda *g: F.xxhash64(_joined(*g))), lambda h, i: F.struct(F.lit(w).alias("w"), i.alias("at"), h.alias("h")))

        none = F.array().cast("array<struct<w:int,at:int,h:bigint>>")
        p = F.col("p")
        rows = texts.select("sha", "x", F.explode(F.concat(none, *[of_size(F.col("x"), w) for w in self.sizes])).alias("p"))
        gram = F.array_join(F.slice("x", p["at"] + 1, p["w"]), " ").alias("gram")
        if few:
            found = rows.join(F.broadcast(hashes), (p["h"] == F.col("known")) & (p["w"] == F.col("of"))).select("sha", p["at"].alias("at"), (p["at"] + p["w"]).alias("end"), gram)
        else:  # the words go along, so that no text is read twice or shuffled whole with each of its windows
            found = rows.select("sha", p["at"].alias("at"), (p["at"] + p["w"]).alias("end"), p["w"].alias("w"), p["h"].alias("h"), gram)
            found = found.join(hashes, (F.col("h") == F.col("known")) & (F.col("w") == F.col("of"))).select("sha", "at", "end", "gram")
        return found.distinct()


def judge(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = SET_LIMIT, most: int = BROADCAST_LIMIT) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated (a twentieth of the words hit).

    One scan; only narrow rows are shuffled: one a document and one a window found.
    """
    tests = TestSet(benchmark, n, item_col, item_text_col, limit)
    known = tests.grams.select(F.col("gram").alias("known"), "items")
    found = [
        F.array_sort(F.collect_set(F.when(F.col("known").isNotNull(), F.struct("at", "end")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ]
    if tests.small:
        rows = docs.select(F.col(id_col).alias("doc_id"), let(_words(F.col(text_col)), lambda x: F.struct(F.size(x).cast("long").alias("n_words"), tests.places(x).alias("p"))).alias("r"))
        rows = rows.select("doc_id", "r.n_words", "r.p", F.monotonically_increasing_id().alias("row"))
        rows = rows.select("row", "doc_id", "n_words", F.explode_outer("p").alias("p"))
        cand = rows.select("row", "doc_id", "n_words", "p.at", (F.col("p.at") + F.col("p.w")).alias("end"), "p.gram")
        per = cand.join(F.broadcast(known), F.col("gram") == F.col("known"), "left").groupBy("row", "doc_id", "n_words").agg(*found)
    else:
        # a text's hits depend on nothing else, so rows meet them by its digest
        text = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"), _words(F.col(text_col)).alias("x"))
        hits = tests.joined(text.select("sha", "x"), most).join(known, F.col("gram") == F.col("known")).groupBy(F.col("sha").alias("of")).agg(*found)
        per = text.select("doc_id", "sha", F.size("x").cast("long").alias("n_words")).join(hits, F.col("sha") == F.col("of"), "left")
        none = F.array().cast("array<struct<at:int,end:int>>")
        per = per.select("doc_id", "n_words", F.coalesce("places", none).alias("places"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = _union(F.col("places"))
    return per.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _union(places: Column) -> Column:
    """Number of places inside ascending [at, end) ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(s: Column, p: Column) -> Column:
        at, end = p["at"].cast("long"), p["end"].cast("long")
        return F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(s["end"], at))).alias("n"), F.greatest(s["end"], end).alias("end"))

    return F.aggregate(places, start, add)["n"]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = SET_LIMIT, most: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged; each row is judged by its text.

    While the set is a constant, this is one projection that verifies hits against the windows' words.
    """
    tests = TestSet(benchmark, n, item_col, item_text_col, limit)
    if tests.small:

        def clean(x: Column) -> Column:
            true = F.filter(tests.places(x), lambda p: p["gram"].isin([g for w in tests.sizes for g in tests.known[w]]))
            ends = F.array_sort(F.transform(true, lambda p: F.struct(p["at"].alias("at"), (p["at"] + p["w"]).alias("end"))))
            return let(_union(ends), lambda hit: (hit == 0) | (20 * hit < F.size(x)))

        return docs.where(let(_words(F.col(text_col)), clean))
    key = "__text_sha"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    dirty = judge(keyed, benchmark, n, key, text_col, item_col, item_text_col, limit, most).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(dirty, key, "left_anti").drop(key)
