"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns. Beyond them every long mixed token of letters and digits
is a candidate: its hash is counted over the whole corpus by distinct repositories and distinct
owners. A candidate that several owners hold is a widely copied example; one that a single owner
holds, in however many repositories, looks like a live credential and adds a span of kind ``live``.
The owner is a column of the table (``source``); a repository is a document of an owner unless
a column is named. Counts are sums of partial counts by (hash, owner), so a hash held by a third
of all rows meets its total as one row an owner and task.

Everything is DataFrame functions. Match places come from the lengths of the pieces between
matches (Java splits text at exactly the matches it would find), so no marker enters the text.

Defined cases: a null text is an empty one; a null owner is an owner of its own; equal rows get
equal results; an empty table gives an empty one; columns not named are not read; texts are
scanned whole. A document with spans of equal start lists them in the order of ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm._native import let, part, pieces, scan
from ravelin.llm._store import saved, shared_dir

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is as long as asked is the same match as any run of which shorter ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A candidate beyond the base patterns: 20 or more token characters.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
#: Most distinct owners of a credential that looks live. Repositories set no limit: by default they are documents, and an owner may copy a page any number of times.
LIVE_OWNERS = 1


NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<(start, kind, end, value)> of the matches of a pattern, leftmost and non-overlapping; code points."""

    def place(between: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, v: F.struct(F.char_length(p).alias("gap"), F.char_length(v).alias("n"), v.alias("value")))

        def spans(x: Column) -> Column:
            begin = scan(F.transform(x, lambda y: y["gap"] + y["n"]), lambda a, b: a + b)
            return F.zip_with(x, begin, lambda y, at: F.struct((at + y["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + y["gap"] + y["n"]).alias("end"), y["value"].alias("value")))

        out = let(steps, spans)
        return F.filter(out, lambda x: keep(x["value"])) if keep else out

    both = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: place(p, v)))
    return F.when(F.regexp_like(text, F.lit(pattern)), both).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind."""
    value = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 12
    # most documents hold no keyword, which plain substring search tells faster than the pattern
    low = F.lower(text)
    likely = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    assign = F.when(likely, _spans(text, ASSIGN, 0, value)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, 2)))


def _mixed(v: Column) -> Column:
    """Letters of both cases and digits in one token, as generated credentials have."""
    return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")


def _apart(base: Column, more: Column) -> Column:
    """The candidates that overlap no base span, by one pass over both in order.

    Candidates don't overlap each other, so one overlaps a base span that starts before it if the farthest end so far
    lies beyond its start, and one that starts later only if that is next to it.
    """

    def free(s: Column) -> Column:
        def judged(far: Column) -> Column:
            def of(x: Column, i: Column) -> Column:
                nxt = F.get(s, i + 1)
                ok = (x["kind"] == 3) & (F.get(far, i) <= x["start"]) & F.coalesce((nxt["kind"] == 3) | (nxt["start"] >= x["end"]), F.lit(True))
                return F.struct(ok.alias("ok"), x.alias("x"))

            return F.transform(F.filter(F.transform(s, of), lambda y: y["ok"]), lambda y: y["x"])

        return let(scan(F.transform(s, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.greatest), judged)

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.array_sort(F.concat(base, more)), free))


def _found(text: Column) -> Column:
    """Struct of a text's base spans and of the candidates apart from them."""

    def both(base: Column) -> Column:
        return F.struct(base.alias("base"), let(_spans(text, TOKEN, 3, _mixed), lambda more: _apart(base, more)).alias("more"))

    return let(base_spans(text), both)


def _owned(docs: DataFrame, owner_col: str, repository_col: str | None, id_col: str) -> list[Column]:
    repository = F.col(repository_col) if repository_col else F.col(id_col)
    return [F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(owner_col).isNull().alias("nobody"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository")]


def _secret(span: Column) -> Column:
    """The credential of a span: what an assignment assigns, else the whole."""
    return F.when(span["kind"] == 0, F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repositories and live of candidates (hash, owner, nobody, repository)."""
    by_owner = candidates.select("hash", "owner", "nobody", "repository").distinct().groupBy("hash", "owner", "nobody").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return counts.withColumn("live", F.col("owners") <= LIVE_OWNERS)


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied (spans of live-looking and of other credentials); no values.

    One scan of the texts writes the spans; the corpus-wide counts and the result come from those.
    """
    scanned = docs.select(F.col(id_col).alias("doc_id"), *_owned(docs, owner_col, repository_col, id_col), _found(F.coalesce(F.col(text_col), F.lit(""))).alias("f"))
    scanned = saved(scanned.select("doc_id", "owner", "nobody", "repository", "f.*"), shared_dir(docs.sparkSession), "spans")
    rows = scanned.select("*", F.monotonically_increasing_id().alias("row"))
    cand = rows.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "owner", "nobody", "repository", F.explode(F.concat("base", "more")).alias("c"))
    cand = cand.select("row", "owner", "nobody", "repository", F.sha2(_secret(F.col("c")), 256).alias("hash"), "c")
    judged = cand.join(ownership(cand).select("hash", "live"), "hash")
    per = judged.groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.when(F.col("live") & (F.col("c.kind") == 3), F.col("c"))).alias("added"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live") & (F.col("c.kind") < 3)).alias("n_copied"),
    )
    both = rows.join(per, F.col("row") == F.col("of"), "left")
    both = both.select("*", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(NONE)))).alias("spans_"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans_")).alias("spans"), zero("n_live"), zero("n_copied"),
    )


def _redacted(text: Column, spans: Column, mask: str) -> Column:
    """The text with its ascending spans replaced; one that begins inside an earlier one only moves its end."""

    def masked(s: Column) -> Column:
        def joined(far: Column) -> Column:
            def cut(c: Column) -> Column:
                held = F.transform(s, lambda x, i: F.when(x["start"] >= F.get(far, i), F.concat(part(c, F.get(far, i), x["start"]), F.lit(mask))))
                end = F.greatest(F.get(far, F.size(s) - 1), F.get(s, F.size(s) - 1)["end"])
                return F.concat(F.array_join(held, ""), part(c, end, F.char_length(text)))

            return let(pieces(text), cut)

        return let(scan(F.transform(s, lambda x: x["end"]), F.greatest), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, masked))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every base span and live-looking candidate in the text replaced by ``mask``; null texts stay null.

    One scan of the texts writes them with their spans. Texts without a bare candidate are redacted as they are read
    again; only the others meet the corpus-wide counts, by text. The counts are those of report(): base spans
    and bare candidates together, by the credential.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for x in ("base", "more", "sha", "owner", "nobody", "repository", "added"):
        while x in taken:
            x += "_"
        taken.add(x)
        names.append(x)
    base, more, sha, owner, nobody, repository, added = names
    text = F.col(text_col)
    held = [c.alias(n) for c, n in zip(_owned(docs, owner_col, repository_col, id_col), (owner, nobody, repository))]
    found = docs.select("*", *held, _found(F.coalesce(text, F.lit(""))).alias(base))
    found = found.select(*docs.columns, owner, nobody, repository, F.col(base)["base"].alias(base), F.col(base)["more"].alias(more))
    found = found.withColumn(sha, F.when(F.size(more) > 0, F.sha2(text, 256)))
    found = saved(found, shared_dir(docs.sparkSession), "redact")
    # base spans count as owners' occurrences, as in report(); only bare candidates add masks
    cand = found.where((F.size(base) > 0) | (F.size(more) > 0)).select(F.col(owner).alias("owner"), F.col(nobody).alias("nobody"), F.col(repository).alias("repository"), F.col(sha).alias("sha"), F.explode(F.concat(base, more)).alias("c"))
    cand = cand.withColumn("hash", F.sha2(_secret(F.col("c")), 256))
    # a text that very many rows repeat, and a credential that very many texts hold, come as one row each
    bare = cand.where(F.col("c.kind") == 3).select("hash", "sha", "c").distinct()
    live = bare.join(ownership(cand).where("live").select("hash"), "hash", "left_semi")
    per = live.groupBy(F.col("sha").alias("of")).agg(F.collect_list("c").alias(added))
    plain = found.where(F.size(more) == 0).withColumn(text_col, _redacted(text, F.col(base), mask))
    some = found.where(F.size(more) > 0)
    other = some.join(per, F.col(sha) == F.col("of"), "left").withColumn(text_col, _redacted(text, F.array_sort(F.concat(base, F.coalesce(added, F.array().cast(NONE)))), mask))
    return plain.select(*docs.columns).unionByName(other.select(*docs.columns))
