"""Tensor algebra on tables: one row per entry, one column per axis and a column v. Missing axes broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axes(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "v"]


def combine(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f entry by entry: an equi-join on the axes both have, an outer product where they share none."""
    shared = [c for c in axes(a) if c in axes(b)]
    left, right = a.withColumnRenamed("v", "__a"), b.withColumnRenamed("v", "__b")
    both = left.join(right, shared) if shared else left.crossJoin(right)
    out = list(dict.fromkeys([*axes(a), *axes(b)]))
    return both.select(*out, f(F.col("__a"), F.col("__b")).alias("v"))


def add(a, b):
    return combine(a, b, lambda x, y: x + y)


def sub(a, b):
    return combine(a, b, lambda x, y: x - y)


def mul(a, b):
    return combine(a, b, lambda x, y: x * y)


def div(a, b):
    return combine(a, b, lambda x, y: x / y)


def floordiv(a, b):
    return combine(a, b, lambda x, y: F.floor(x / y).cast("double"))


def mod(a, b):
    return combine(a, b, lambda x, y: x - y * F.floor(x / y))


def power(a, b):
    return combine(a, b, F.pow)


def less(a, b):
    return combine(a, b, lambda x, y: x < y)


def where(cond: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    both = combine(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return combine(cond, both, lambda c, s: F.when(c, s["x"]).otherwise(s["y"]))


def dot(a: DataFrame, b: DataFrame, over: list[str]) -> DataFrame:
    """Contraction over axes that both have."""
    product = mul(a, b)
    return product.groupBy(*[c for c in axes(product) if c not in over]).agg(F.sum("v").alias("v"))


REDUCTIONS = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg, "all": F.bool_and, "any": F.bool_or}


def reduce(a: DataFrame, how: str, over: list[str] | None = None) -> DataFrame:
    """A reduction over axes, all by default; ragged axes reduce over the entries that exist."""
    keep = [c for c in axes(a) if c not in (over or axes(a))]
    return a.groupBy(*keep).agg(REDUCTIONS[how]("v").alias("v"))


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.withColumn("v", f(F.col("v")))


FUNCTIONS = {"sqrt": F.sqrt, "arcsin": F.asin, "abs": F.abs, "neg": lambda x: -x, "stop_gradient": lambda x: x}


def clip(a: DataFrame, lo: float, hi: float) -> DataFrame:
    return apply(a, lambda v: F.greatest(F.lit(lo), F.least(v, F.lit(hi))))


def index(a: DataFrame, **at) -> DataFrame:
    """One index of an axis; the axis goes."""
    for axis, k in at.items():
        a = a.where(F.col(axis) == k).drop(axis)
    return a


def window(a: DataFrame, axis: str, start: int, stop: int) -> DataFrame:
    """A slice of an axis, renumbered from 0."""
    return a.where((F.col(axis) >= start) & (F.col(axis) < stop)).withColumn(axis, F.col(axis) - start)
