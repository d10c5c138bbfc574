"""Column functions: categories, softmax, distances, number text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plurigrade.settings import CATEGORIES, EDGES


def or_null(x: Column) -> Column:
    """NaN as null: inside the engine a missing number is null."""
    return F.when(~F.isnan(x), x)


def category_index(score: Column) -> Column:
    """Index of the first category whose upper edge the score does not exceed; -1 if it is missing or above 1.  Negative scores are in category 0."""
    steps = reduce(lambda c, k: c.when(score <= EDGES[k], k), range(1, len(EDGES)), F.when(score.isNull() | F.isnan(score), -1).when(score <= EDGES[0], 0))
    return steps.otherwise(-1).cast("int")


def category_label(score: Column) -> Column:
    """Label of the right-closed bin on [0, 1], the lowest edge included; null if missing or outside."""
    index = category_index(score)
    return F.when((score >= 0) & (index >= 0), F.get(F.array(*map(F.lit, CATEGORIES)), index))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, the largest subtracted first."""
    raised = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def order_score(probabilities: Column) -> Column:
    """The probabilities weighted by evenly spaced values on [0, 1]."""
    top = F.size(probabilities) - 1
    return F.aggregate(F.transform(probabilities, lambda p, i: p * i / top), F.lit(0.0), lambda a, x: a + x)


def first_largest(values: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """``(value - low) / (high - low)``; null if the range is empty or anything is missing."""
    return F.try_divide(value - low, high - low)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def parsed_number(token: Column) -> Column:
    """A number token: sign, digits, one dot, exponent, nan or inf, and a carriage return at the end; anything else is null."""
    text = F.regexp_replace(token, "\r$", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")).when(
        F.lower(text).rlike(r"^[+-]?(nan|inf|infinity)$"), text.try_cast("double")
    )


def _shortest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: "" if pd.isna(v) else repr(float(v)))


def number_text(x: Column) -> Column:
    """Shortest text that reads back as the same double, with an exponent below 1e-4 and from 1e16 on; null and NaN are empty.

    For sinks only: the JVM's own text is not always the shortest, so this is an Arrow batch function.
    """
    return F.pandas_udf(_shortest, "string")(x)
