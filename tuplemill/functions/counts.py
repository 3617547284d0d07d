"""Column expressions over count maps and measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def add_maps(a: Column, b: Column) -> Column:
    """Key-wise sum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def add_until_full(acc: Column, more: Column, most: int) -> Column:
    """Adds the whole of ``more`` while ``acc`` has fewer than ``most`` keys."""
    return F.when(F.size(F.map_keys(acc)) < most, add_maps(acc, more)).otherwise(acc)


def cumulative(m: Column, width: int, start: int = 1) -> Column:
    """Running sums at windows ``start`` to ``start + width - 1``; keys beyond stay as they are.

    ``start`` is 1 for measures and 0 for the frequency filter.
    """
    last = start + width - 1
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<key:int,value:bigint>>").alias("runs"))

    def step(acc: Column, w: Column) -> Column:
        total = acc["total"] + F.coalesce(F.try_element_at(m, w), F.lit(0))
        return F.struct(total.alias("total"), F.concat(acc["runs"], F.array(F.struct(w.alias("key"), total.alias("value")))).alias("runs"))

    runs = F.aggregate(F.sequence(F.lit(start), F.lit(last)), zero, step, lambda acc: acc["runs"])
    return F.map_concat(F.map_from_entries(runs), F.map_filter(m, lambda k, _: ~k.between(start, last)))


def largest(m: Column, default: int = 0) -> Column:
    return F.coalesce(F.array_max(F.map_values(m)), F.lit(default))


def conditionals(m: Column, delta: float, n: Column) -> Column:
    """c / (delta + n) for each window in ascending order."""
    return F.transform(sorted_entries(m), lambda e: e["value"].cast("double") / (F.lit(float(delta)) + n))


def decayed(values: Column, alpha: float) -> Column:
    """Sum of alpha**i * v_i over the sum of alpha**i, i from 1 by position; 0 without values."""
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    parts = F.transform(values, lambda x, i: F.struct(x.alias("x"), F.pow(F.lit(float(alpha)), i + 1).alias("p")))
    step = lambda a, e: F.struct((a["v"] + e["p"] * e["x"]).alias("v"), (a["w"] + e["p"]).alias("w"))
    return F.aggregate(parts, zero, step, lambda a: F.when(a["w"] == 0, F.lit(0.0)).otherwise(a["v"] / a["w"]))


def weighted_average(weights: Column, values: Column) -> Column:
    checked = F.when(F.assert_true(F.size(weights) == F.size(values)).isNull(), F.zip_with(weights, values, lambda w, v: w * v))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(checked, F.lit(0.0), lambda a, x: a + x) / total


def windowed(m: Column, delta: float, n: Column, alpha: float) -> Column:
    values = conditionals(m, delta, n)
    return F.struct(values.alias("values"), decayed(values, alpha).alias("combined"))


def pmi(m: Column, nf: Column, ns: Column) -> Column:
    """ln(c / (nF + nS)) for each window in ascending order."""
    return F.transform(sorted_entries(m), lambda e: F.log(e["value"].cast("double") / (nf + ns)))


def top_entries(m: Column, n: int) -> Column:
    """Entries by falling count, ties by key."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(F.map_entries(m), order), 1, n)


def preferred(own: Column, other: Column) -> Column:
    """Heads that the other side hasn't; all if none is left."""
    alone = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(other), k))
    return F.when(F.size(F.map_keys(alone)) == 0, own).otherwise(alone)
