"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of anything but ASCII white space.  The measures are counted with built-in expressions over the word and
line arrays of a row; :data:`RULES` bounds their ratios, and :func:`compiled` turns the table into one Boolean column.

Null text has no words, so it fails the base rule.  Repeated rows give repeated results, an empty table an empty one.  A very
long text is measured whole, in one row.  :func:`measures` reads only the id and text columns; :func:`kept` carries all
columns through under their own names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"

#: Frequent short words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or that the their they this to was were which with you "
    "aber als auch auf aus bei das dass dem den der des die du ein eine einen er es für hat ich im ist mit nicht oder sich sie sind um und von war wie zu zum zur "
    "au aux avec ce ces cette dans de elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui se sur un une vous "
    "al como con de del el ella es esta este la las lo los más muy ni no o para pero por que se si sin su sus también un una y"
)


@dataclass(frozen=True)
class Rule:
    """``numerator`` over ``denominator`` must lie within the bounds; nothing over nothing counts as 0."""

    name: str
    numerator: str
    denominator: str
    low: float = 0.0
    high: float = float("inf")


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("shouted_words", "n_exclamations", "n_words", 0.0, 0.2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("__text"), F.lit(pattern)).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the long columns n_words, word_chars, n_symbols, n_stop_words, n_exclamations, n_lines, n_dup_lines, n_repeat_words."""
    return _measured(docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("__text")), [key])


def _measured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The measures of ``__text`` beside the columns to keep."""
    held = [F.col(f"`{c}`") for c in keep]
    words = F.split(F.btrim(F.col("__text"), F.lit(" \t\n\x0b\x0c\r")), WHITE)
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select(*held, "__text", words.alias("__w"), lines.alias("__l"))
    n = F.when(F.element_at("__w", 1) == "", 0).otherwise(F.size("__w"))
    # A window is known by the 64-bit hash of its three words: two different ones of a text of 20,000 words share it with a chance of 1e-11.
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.struct(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("at")))
    counted = split.select(
        *held,
        n.cast("long").alias("n_words"),
        F.when(n == 0, F.lit(0)).otherwise(F.length(F.array_join("__w", ""))).cast("long").alias("word_chars"),
        _count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS.split()))))).cast("long").alias("n_stop_words"),
        _count("!").alias("n_exclamations"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") < 4, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(F.sort_array(windows)).alias("__s"),
    )
    last = F.size("__s") - 1
    beside = F.filter(
        "__s",
        lambda x, i: ((i > 0) & (F.get("__s", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("__s", i + 1)["h"] == x["h"])),
    )
    plain = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_exclamations", "n_lines", "n_dup_lines"]
    found = counted.select(*held, *plain, F.sort_array(F.transform(beside, lambda x: x["at"])).alias("__p"))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.when(i == F.size("__p") - 1, 3).otherwise(F.least(F.lit(3), F.get("__p", i + 1) - p))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return found.select(*held, *plain, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one Boolean column over the measures."""

    def holds(r: Rule) -> Column:
        ratio = F.coalesce(F.try_divide(F.col(r.numerator), F.col(r.denominator)), F.lit(0.0))
        return (ratio >= r.low) & (ratio <= r.high)

    return reduce(lambda a, b: a & b, map(holds, rules))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of each document with ``base_failed`` and ``kept``."""
    return measures(docs, key, text).select("*", base_failed().alias("base_failed"), (~base_failed() & compiled(rules)).alias("kept"))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents, all columns, that no rule rejects."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # The row number keeps the optimizer from pushing the condition below the projections, where it would repeat the measures many times over.
    held = _measured(whole, ["__doc"]).select("__doc", (~base_failed() & compiled(rules)).alias("__kept"), F.monotonically_increasing_id().alias("__row"))
    return held.where(F.col("__kept") & (F.col("__row") >= 0)).select("__doc.*")
