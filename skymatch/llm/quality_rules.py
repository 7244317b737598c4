"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nulls, empties: a null or empty text has no words and fails the base rule. Repeated rows are judged alike, each on its own; other
columns pass through. A text's length isn't limited: windows are compared by 64-bit hashes inside the row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be by for from had has have he her his in is it not of on or she that the they this to was we were with you",
    "de": "auf aus das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von wir zu",
    "fr": "au aux ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une",
    "es": "al como con de del el en es la las lo los no para por que se su un una y",
}
_ALL_STOP_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})


@dataclass(frozen=True)
class Rule:
    """The text passes if low * bases[per] <= bases[count] <= high * bases[per]."""

    name: str
    count: str
    per: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are cross-multiplied, so no rule divides.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("exclamations", "n_exclaim", "n_words", None, 0.30),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
    Rule("alphabetic", "n_alpha", "word_chars", 0.60, None),
    Rule("stutter", "n_stutter", "n_words", None, 0.20),
    Rule("upper_case", "n_upper", "word_chars", None, 0.40),
)


def repeated_window_words(ws: Column, size: int = 8) -> Column:
    """Words that lie in a window of size (a power of two) words which occurs twice or more in the text."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rest = 1_000_000_000

    def windows(h: Column, span: int) -> Column:
        if span == size:
            return F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0)))
        return bind(F.zip_with(h, F.slice(h, span + 1, rest), lambda a, b: F.xxhash64(a, b)), lambda x: windows(x, 2 * span))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, rest), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def repeats(s: Column) -> Column:
        twins = F.zip_with(s, F.slice(s, 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return bind(F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull())))), covered)

    def count(h: Column) -> Column:
        located = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(located, repeats))

    return bind(bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: windows(h, 1)), count).cast("long")


def _kept_chars(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The counts that rules name."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_lines": bind(lines, lambda x: F.size(x)).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": _kept_chars(text, "#*$%&|<>"),
        "n_exclaim": _kept_chars(text, "!"),
        "n_alpha": _kept_chars(text, r"\p{L}"),
        "n_upper": _kept_chars(text, r"\p{Lu}"),
        "n_words": F.size("_ws").cast("long"),
        "n_stop_words": F.size(F.filter("_ws", lambda w: F.lower(w).isin(_ALL_STOP_WORDS))).cast("long"),
        "n_stutter": F.size(F.filter(F.zip_with("_ws", F.slice("_ws", 2, 1_000_000_000), lambda a, b: a == b), lambda x: x)).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_ws")),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where all rules hold."""
    out = F.lit(True)
    for r in rules:
        per = F.col(r.per).cast("double")
        if r.low is not None:
            out = out & (F.col(r.count) >= per * F.lit(r.low))
        if r.high is not None:
            out = out & (F.col(r.count) <= per * F.lit(r.high))
    return out


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measures, base_failed, failed_rules (names) and kept, a row for each row of df."""
    rows = df.select(*keep, F.col(text).alias("_text")).withColumn("_ws", words(F.col("_text")))
    rows = rows.select(*keep, *(c.alias(k) for k, c in measures(F.col("_text")).items()))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(~verdict((r,)), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return rows.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
