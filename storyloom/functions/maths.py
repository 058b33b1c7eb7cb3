"""Numeric functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the highlight steps and their colours, lowest first.
HIGHLIGHTS = [(0.2, "on_green"), (0.4, "on_cyan"), (0.6000000000000001, "on_blue"), (0.8, "on_magenta"), (1.0, "on_red")]
COLOR_KEY = [("green", "lowest"), ("cyan", "low"), ("blue", "middle"), ("magenta", "high"), ("red", "highest")]


def sigmoid(t: Column) -> Column:
    """Logistic function without overflow."""
    return F.when(t > 0, 1 / (1 + F.exp(-t))).otherwise(F.exp(t) / (1 + F.exp(t)))


def softplus_neg(t: Column) -> Column:
    """``-log(sigmoid(t))`` without overflow."""
    return F.log1p(F.exp(-F.abs(t))) + F.greatest(-t, F.lit(0.0))


def highlight(weight: Column) -> Column:
    """Colour of the first step that holds the weight; above all steps (and NaN) red."""
    out = None
    for bound, colour in HIGHLIGHTS:
        out = F.when(weight <= bound, colour) if out is None else out.when(weight <= bound, colour)
    return out.otherwise("on_red")


def dot(values: Column, weights: list[float]) -> Column:
    """Scalar product of an array column with fixed weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(values, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def ordinal_class(xw: Column, theta: list[float]) -> Column:
    """First k with ``xw < theta_k``, the last threshold standing for infinity; equal thresholds count once."""
    cuts = sorted(set(theta))[:-1]
    return sum((F.when(xw >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
