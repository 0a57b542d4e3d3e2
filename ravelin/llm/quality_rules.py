"""Quality rules: a table of thresholds compiled into one projection.

``MEASURES`` are expressions over a document's text, words and lines; a rule bounds one
measure from below or above. ``apply_rules`` computes every measure a rule or the caller
needs in one Spark projection of built-in functions, without a shuffle.

Defined cases: a null text is an empty one (no words, fails the base rule); a ratio of an
empty document is 0; texts of any length are measured whole; equal rows get equal results;
an empty table gives an empty one; input columns other than the two named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm._native import GAP, covered, let, windows, words

SYMBOLS = "[#*$%&|<>]"
#: Words that running text of the four languages can't do without.
STOP_WORDS = tuple("the of and to in is that for it as was with be by on are de la que el en y los del las un una les des et le du est dans pour der die und das den von zu mit ist im nicht".split())


@dataclass(frozen=True)
class Rule:
    measure: str
    least: float | None = None
    most: float | None = None


#: Added to the stop words of a text before they are divided by its words, so that a short text may have none.
STOP_PAD = 3
#: Beside the base rule: mean word length, symbols a word, share of stop words and share of repeated lines.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", most=0.25),
    Rule("padded_stop_word_share", least=0.03),
    Rule("dup_line_share", most=0.5),
)


def measures(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Struct of all measures of a text."""

    def repeated(w: Column) -> Column:
        # hashes tell at once that all windows differ; else the windows' own words decide
        return F.when(F.size(w) < 6, F.lit(0).cast("long")).otherwise(
            let(
                windows(w, 5, F.xxhash64),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(_repeated_places(w), lambda p: covered(p, 5))),
            )
        )

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*stop_words, *(v.capitalize() for v in stop_words)))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(GAP.replace("[", "[^", 1)))
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )


def _repeated_places(w: Column) -> Column:
    """Ascending places at which a five-word window starts that occurs twice or more."""
    keyed = F.array_sort(F.transform(windows(w, 5, lambda *x: F.concat_ws(" ", *x)), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def twice(s: Column) -> Column:
        n = F.size(s)
        same = lambda j, o: F.coalesce(F.get(s, j + o)["k"] == s[j]["k"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(j, -1) | same(j, 1))
        return F.array_sort(F.transform(hit, lambda j: s[j]["i"]))

    return let(keyed, twice)


def _ratios(n_words: Column, word_chars: Column, n_symbols: Column, n_stop_words: Column, n_dup_lines: Column, n_lines: Column) -> dict[str, Column]:
    """Every measure a rule may bound."""
    per = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return {
        "mean_word_chars": per(word_chars, n_words),
        "symbols_per_word": per(n_symbols, n_words),
        "padded_stop_word_share": per(n_stop_words + STOP_PAD, n_words),
        "dup_line_share": per(n_dup_lines, n_lines),
    }


def _verdict(ratios: dict[str, Column], rules: tuple[Rule, ...]) -> Column:
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok &= ratios[r.measure] >= r.least
        if r.most is not None:
            ok &= ratios[r.measure] <= r.most
    return ok


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and one column a rule (its measure)."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.coalesce(F.col(text_col), F.lit("")), stop_words).alias("m"))
    flat = m.select("doc_id", "m.w.*", "m.l.*", "m.n_symbols")
    c = {x: F.col(x) for x in flat.columns}
    ratios = _ratios(c["n_words"], c["word_chars"], c["n_symbols"], c["n_stop_words"], c["n_dup_lines"], c["n_lines"])
    failed = _base_failed(c["n_words"], c["n_repeat_words"])
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & _verdict(ratios, rules)).alias("kept"), *(ratios[r.measure].alias(f"rule_{r.measure}") for r in rules),
    )


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and ``rules``, columns unchanged."""

    def judge(m: Column) -> Column:
        w, x = m["w"], m["l"]
        ratios = _ratios(w["n_words"], w["word_chars"], m["n_symbols"], w["n_stop_words"], x["n_dup_lines"], x["n_lines"])
        return ~_base_failed(w["n_words"], w["n_repeat_words"]) & _verdict(ratios, rules)

    return docs.where(let(measures(F.coalesce(F.col(text_col), F.lit("")), stop_words), judge))
