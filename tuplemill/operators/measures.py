"""From reduced counts to cumulative, undirected and conditional measures.

``pairs``: key, window, n (long form), or key and ``counts`` by window. ``tuples``: arg1, rel, arg2, n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplemill.functions import counts as C
from tuplemill.functions import tuples as T
from tuplemill.operators.extract import PAIR

MEASURE_WINDOW, MIN_DIRECTED, MIN_UNDIRECTED = 50, 5, 5
FILTER_WINDOW, FILTER_MIN = 10, 3
ALPHA, DELTA, INDEX_MIN = 0.9, 1000.0, 5
FLIPPED = ["sarg1", "srel", "sarg2", "farg1", "frel", "farg2"]


def as_maps(pairs: DataFrame) -> DataFrame:
    """One row for each key with ``counts`` map<window, n>; a key's windows are bounded by the window size."""
    return pairs.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct(F.col("window").cast("int"), F.col("n").cast("bigint")))).alias("counts"))


def as_rows(mapped: DataFrame) -> DataFrame:
    return mapped.select(*PAIR, F.explode("counts").alias("window", "n"))


def above_directed(mapped: DataFrame, more_than: int = MIN_DIRECTED) -> DataFrame:
    """The largest raw count, before cumulation, is above the bound."""
    return mapped.filter(C.largest(F.col("counts")) > more_than)


def cumulated(mapped: DataFrame, width: int = MEASURE_WINDOW) -> DataFrame:
    mapped = mapped.withColumn("counts", F.explode(F.array("counts")))  # what is filtered before stays before
    return mapped.withColumn("counts", F.explode(F.array(C.cumulative(F.col("counts"), width))))


def frequency_filter(mapped: DataFrame, width: int = FILTER_WINDOW, least: int = FILTER_MIN, strict: bool = True) -> DataFrame:
    """Keys of six sound fields whose largest cumulative count (windows 0 to ``width`` - 1) passes.

    ``strict``: above ``least``; else at least that.
    """
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    sound = mapped.filter(total > least if strict else total >= least)  # no sum of counts is above this one
    for c in PAIR:
        sound = sound.filter(T.starts_alphanumeric(F.col(c)))
    sound = sound.select(*PAIR, F.explode(F.array("counts")).alias("counts"))
    spread = sound.withColumn("counts", C.cumulative(F.col("counts"), width, start=0))
    top = C.largest(F.col("counts"))
    return spread.filter(top > least if strict else top >= least)


def undirected(mapped: DataFrame, least: int = MIN_UNDIRECTED) -> DataFrame:
    """Both directions of each unordered pair with their common ``biterm`` map.

    Without a reverse pair the flip comes with empty counts. A self pair has no reverse: it comes with a flip of
    empty counts too. One shuffle on the pair's unordered key; pairs whose largest biterm is below ``least`` go.
    """
    one, two = (F.struct(*(F.col(c).alias(c[1:]) for c in side)) for side in (PAIR[:3], PAIR[3:]))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    sided = mapped.select(F.least(one, two).alias("low"), F.greatest(one, two).alias("high"), (one <= two).alias("up"), "counts")
    grouped = sided.groupBy("low", "high").agg(F.first(F.when(F.col("up"), F.col("counts")), ignorenulls=True).alias("ab"), F.first(F.when(~F.col("up"), F.col("counts")), ignorenulls=True).alias("ba"))
    biterm = F.when(F.col("ab").isNull(), F.col("ba")).when(F.col("ba").isNull(), F.col("ab")).otherwise(C.add_maps(F.col("ab"), F.col("ba")))
    kept = grouped.withColumn("biterm", biterm).filter(C.largest(F.col("biterm")) >= least)
    sides = F.array(F.struct(F.col("low").alias("f"), F.col("high").alias("s"), F.coalesce("ab", empty).alias("counts")), F.struct(F.col("high").alias("f"), F.col("low").alias("s"), F.coalesce("ba", empty).alias("counts")))
    rows = kept.select(F.explode(sides).alias("r"), "biterm")
    names = [F.col(f"r.{side}.{c}").alias(f"{side}{c}") for side in "fs" for c in ("arg1", "rel", "arg2")]
    return rows.select(*names, "r.counts", "biterm")


def with_marginals(undirected_: DataFrame, tuples: DataFrame) -> DataFrame:
    """Adds ``f`` and ``s``, the sides' tuple counts (0 if unknown)."""
    unique = tuples.groupBy("arg1", "rel", "arg2").agg(F.max("n").alias("n"))
    out = undirected_
    for side in "fs":
        named = unique.select(*(F.col(c).alias(f"{side}{c}") for c in ("arg1", "rel", "arg2")), F.col("n").alias(side))
        out = out.join(named, [f"{side}{c}" for c in ("arg1", "rel", "arg2")], "left").withColumn(side, F.coalesce(side, F.lit(0)))
    return out.select(*PAIR, "counts", "biterm", "f", "s")


def measures(pairs: DataFrame, tuples: DataFrame, width: int = MEASURE_WINDOW, directed: int = MIN_DIRECTED, least: int = MIN_UNDIRECTED) -> DataFrame:
    return with_marginals(both_ways(pairs, width, directed, least), tuples)


def both_ways(pairs: DataFrame, width: int = MEASURE_WINDOW, directed: int = MIN_DIRECTED, least: int = MIN_UNDIRECTED) -> DataFrame:
    """``measures`` without the marginals."""
    mapped = pairs if "counts" in pairs.columns else as_maps(pairs)
    return undirected(cumulated(above_directed(mapped, directed), width), least)


def tuples_of(pairs: DataFrame) -> DataFrame:
    """The tuples of both sides, each once."""
    sides = F.array(*(F.struct(*(F.col(f"{side}{c}").alias(c) for c in ("arg1", "rel", "arg2"))) for side in "fs"))
    return pairs.select(F.explode(sides).alias("t")).select("t.*").distinct()


def with_affinities(measures_: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Conditionals of each side, undirected and directed: values by window and their decayed mean."""
    parts = {"first_undir": ("biterm", "f"), "first_dir": ("counts", "f"), "second_undir": ("biterm", "s"), "second_dir": ("counts", "s")}
    return measures_.withColumns({k: C.windowed(F.col(m), delta, F.col(n), alpha) for k, (m, n) in parts.items()})


def index(measures_: DataFrame, alpha: float = ALPHA, delta: float = DELTA, more_than: int | None = INDEX_MIN) -> DataFrame:
    """The searchable table: measures above the bound (none if ``more_than`` is None), with affinities and a stable id."""
    kept = measures_ if more_than is None else measures_.filter(C.largest(F.col("biterm")) > more_than)
    return with_affinities(kept, alpha, delta).withColumn("id", F.sha2(F.concat_ws("\t", *PAIR), 256))


def once_a_key(rows: DataFrame, **figures: Column) -> DataFrame:
    """One row for each key with the ``figures``, which are aggregates.

    A self pair comes twice from ``undirected``, as itself and as its flip of empty counts; any other key once.
    """
    return rows.groupBy(*PAIR).agg(*(c.alias(n) for n, c in figures.items()))


def totals(mapped: DataFrame) -> DataFrame:
    """(key, n) over all windows."""
    return mapped.select(*PAIR, F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))


def successors(pairs: DataFrame, top: int = 1) -> DataFrame:
    """For each first tuple the ``top`` tuples that follow it most often, over all windows."""
    if "counts" in pairs.columns:
        total = totals(pairs)
    else:
        total = pairs.groupBy(*PAIR).agg(F.sum("n").alias("n"))
    return top_successors(total, top)


def top_successors(total: DataFrame, top: int = 1) -> DataFrame:
    """``successors`` of (key, n), a row for each key."""
    order = Window.partitionBy(*PAIR[:3]).orderBy(F.desc("n"), *PAIR[3:])
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
