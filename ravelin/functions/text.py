"""Column functions over text: cleaning, names, parsing. All of them are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What counts as white space beyond ASCII's.
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean_text(c: Column) -> Column:
    """Runs of white space of any script to one space, trimmed, then ``>`` deleted (edge spaces may come back)."""
    return F.replace(F.trim(F.regexp_replace(c, f"[{WHITE}]+", " ")), F.lit(">"), F.lit(""))


def word_characters(c: Column) -> Column:
    """Latin letters, digits, Hangul syllables, underscore and hyphen only."""
    return F.regexp_replace(c, "[^a-z가-힣A-Z0-9_-]", "")


def result_name(model: Column, length: int = 30) -> Column:
    """File name of a model's results; a short name ends with .json.json, as keys in evaluation files rely on."""
    return F.concat(F.lit("result_"), F.substring(F.concat(F.regexp_replace(model, "[^a-zA-Z0-9_.]", "_"), F.lit(".json")), 1, length - 7), F.lit(".json"))


def model_key(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("result_"), F.lit("")), F.lit(".json"), F.lit(""))


def safe_name(c: Column) -> Column:
    """Characters no file name may hold to ``_``, without the last extension."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), r"\.[^.]*$", "")


def nonblank_lines(c: Column) -> Column:
    """Tabs to spaces, lines without text dropped."""
    lines = F.split(F.replace(c, F.lit("\t"), F.lit(" ")), "\n", -1)
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")


def with_name(name: Column, content: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit("]\n"), content)


def metadata(map_: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(map_, F.lit(key)), F.lit(default))


def station(c: Column, drop: str = "경찰서", suffix: str = "역") -> Column:
    """A stop's name with its suffix exactly once."""
    c = F.replace(c, F.lit(drop), F.lit(""))
    return F.when(F.endswith(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix)))


def clock_label(c: Column) -> Column:
    """HHmmss to ``HH시 mm분``."""
    return F.concat(F.substring(c, 1, 2), F.lit("시 "), F.substring(c, 3, 2), F.lit("분"))


def html_text(c: Column) -> Column:
    """Text between tags, without scripts and styles; white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def _tool_step(c: Column) -> Column:
    """Struct (tool, input) of an agent's step, null if the text has none.

    Worked out by lines: a line counts by what stands before its colon, without digits and blanks. The tool is what
    follows the colon of the first ``Action`` line up to the first ``Action Input`` line after it; the input is the rest.
    """
    after = lambda x: F.substring(x, F.locate(":", x) + 1, F.char_length(x))

    def of(lines: Column) -> Column:
        keys = F.transform(lines, lambda x: F.when(F.contains(x, F.lit(":")), F.translate(F.substring_index(x, ":", 1), "0123456789 \t", "")))
        begin = F.coalesce(F.array_position(keys, "Action"), F.lit(0)).cast("int")
        rest = F.slice(keys, begin + 1, F.size(keys))
        more = F.coalesce(F.array_position(rest, "ActionInput"), F.lit(0)).cast("int")
        text = lambda first, n: after(F.array_join(F.slice(lines, first, n), "\n"))
        found = F.struct(text(begin, more).alias("tool"), text(begin + more, F.size(lines)).alias("input"))
        return F.when((begin > 0) & (more > 0), found)

    return F.transform(F.array(F.split(c, "\n", -1)), of)[0]


def action(c: Column) -> Column:
    """Tool name of an agent's step; null if the text has no step."""
    return F.nullif(F.trim(_tool_step(c)["tool"]), F.lit(""))


def action_input(c: Column) -> Column:
    """What the step gives to its tool, without quotes around it."""
    return F.when(action(c).isNotNull(), F.btrim(F.regexp_replace(_tool_step(c)["input"], r"^\s+|\s+$", ""), F.lit('"')))


def final_answer(c: Column) -> Column:
    """What follows the last ``Final Answer:``; null without one."""
    return F.when(c.contains("Final Answer:"), F.trim(F.substring_index(c, "Final Answer:", -1)))


def qa_pairs(c: Column) -> Column:
    """array of (question, answer) from text with ``[Q]:`` and ``[A]:`` marks."""
    both = [F.regexp_extract_all(c, F.lit(r"(?s)\[Q\]:\s*(.*?)\s*\[A\]:\s*(.*?)\s*(?=\[Q\]:|\z)"), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*both, lambda q, a: F.struct(q.alias("question"), a.alias("answer")))


def contains_any(c: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(k) for k in keywords], F.lit(False))


def contains_none(c: Column, parts: list[str]) -> Column:
    return ~contains_any(c, parts)


def display_label(model: Column, params: Column, special: dict[str, str] | None = None) -> Column:
    """First ``_`` segment capitalised, special names replaced, with the size in billions."""
    short = F.initcap(F.split(model, "_")[0])
    for k, v in (special or {}).items():
        short = F.when(model == k, v).otherwise(short)
    return F.format_string("%s (%sB)", short, params.cast("string"))


def fill(template: str, **values: Column) -> Column:
    """A prompt: each ``{name}`` of the template replaced by its column."""
    c = F.lit(template)
    for k, v in values.items():
        c = F.replace(c, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return c


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def day_code(ts: Column) -> Column:
    """8 on working days, 7 on Saturdays, 9 on Sundays."""
    return F.when(F.weekday(ts) < 5, "8").when(F.weekday(ts) == 5, "7").otherwise("9")


def service_seconds(hhmmss: Column) -> Column:
    """Sort key of a service day, which starts at 04:30."""
    t = hhmmss.cast("int")
    return F.when(t >= 43000, t).otherwise(t + 240000)


def direction(train: Column) -> Column:
    """Odd first digits go up, even ones down."""
    return F.when(F.substring(train, 1, 1).cast("int") % 2 == 1, "up").otherwise("down")


def stamped(prefix: str, ts: Column, ending: str = "") -> Column:
    """A name with a time in it; the time is a column, so the same rows give the same names."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(ending))


def alternatives(c: Column, word: str = " 또는 ") -> Column:
    """An array's values as one phrase."""
    return F.array_join(c, word)


def provider(model: Column, local: list[str], hosted: list[str]) -> Column:
    """Who serves a model: ``openai`` for names with gpt, ``local`` and ``openrouter`` by list, null for others."""
    return F.when(model.contains("gpt"), "openai").when(model.isin(local), "local").when(model.isin(hosted), "openrouter")
