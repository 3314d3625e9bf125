"""Exact quantiles and median absolute deviations for groups of any size.

``percentile`` holds every distinct value of a group in one task, which is fine
for groups bounded by the calendar but not for an item that owns a third of
all rows. Here a histogram over order-keeping value buckets, combined map-side,
tells in which bucket each wanted rank lies; a second pass keeps only the rows
of those buckets and orders them. The bucket table is written out between the
passes, so the join that follows is planned by its real size.

A bucket is a fixed share of its value, so a narrow price range may put very
many distinct values into one. Such buckets are cut again into equal parts
between their least and greatest value (radix selection), for as long as a part
that holds a wanted rank has too many distinct values for one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketclime.functions.numbers import order_bucket
from marketclime.session import cut_lineage

VALUES_PER_TASK = 1 << 16  # distinct values that are ordered in one task
PARTS = 1 << 12  # of a bucket with more


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
    count_as: str = "n",
    values_per_task: int = VALUES_PER_TASK,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per ``keys``; null and NaN values are left out.

    Returns ``keys``, the number of values as ``count_as`` and one column per
    entry of ``probs`` (name to probability). ``weight`` names a column of
    repeat counts when ``df`` is already reduced.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).select(
        *keys,
        number.alias("_v"),
        order_bucket(number).alias("_bucket"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"),
    )

    def rank(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = F.lit(False)
    for p in probs.values():
        reaches = (F.col("_before") <= F.ceil(rank(p))) & (F.floor(rank(p)) < F.col("_before") + F.col("_size"))
        wanted = wanted | reaches
    wanted = wanted & (F.col("_size") > 0)

    # one row per occupied bucket: at most a few thousand per group
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    buckets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum("_w").alias("_size"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        .select("*", F.sum("_size").over(whole).alias("_total"), F.sum("_size").over(upto).alias("_upto"))
        .select("*", (F.col("_upto") - F.col("_size")).alias("_before"))
        .filter(wanted)
    )
    buckets = cut_lineage(buckets.select(*keys, "_bucket", "_size", "_least", "_most", "_total", "_before"), "quantile-buckets")
    # from here on _before, the count of smaller values, tells the buckets of a group apart
    cell = ["_total", "_before", "_least", "_most"]
    values = (
        _met(rows, buckets.drop("_size"), [*keys, "_bucket"])
        .groupBy(*keys, *cell, "_v")
        .agg(F.sum("_w").alias("_n"))
    )
    crowded = buckets.filter((F.col("_size") > values_per_task) & (F.col("_least") < F.col("_most")))
    if not crowded.isEmpty():
        values = _narrowed(values, keys, wanted, values_per_task)

    inside = Window.partitionBy(*keys, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select("*", (F.col("_before") + F.sum("_n").over(inside)).alias("_stop"))
    start, stop = F.col("_stop") - F.col("_n"), F.col("_stop")
    aggregates = [F.max("_total").alias(count_as)]
    for name, p in probs.items():
        low, high = F.floor(rank(p)), F.ceil(rank(p))
        at_low = F.max(F.when((start <= low) & (low < stop), F.col("_v")))
        at_high = F.max(F.when((start <= high) & (high < stop), F.col("_v")))
        share = F.max(rank(p) - low)
        aggregates.append((at_low + (at_high - at_low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggregates)


def _met(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the other columns of their cell; null keys meet, rows without a cell are left out."""
    aliases = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in aliases.items()]
    return rows.join(cells.withColumnsRenamed(aliases), same).drop(*aliases.values())


def _narrowed(values: DataFrame, keys: Sequence[str], wanted: Column, values_per_task: int) -> DataFrame:
    """The distinct values of ever smaller cells, until no cell has more than ``values_per_task``.

    ``values`` holds keys, ``_total``, the cell (``_before``, ``_least``,
    ``_most``), ``_v`` and its count ``_n``. Every step cuts a cell between its
    least and greatest value, which fall into the first and last part, so a
    cell of two values or more always shrinks. All tasks share the work: parts
    are counted by partial sums, and only their counts are ordered per cell.
    """
    while True:
        values = cut_lineage(values, "quantile-values")
        span = F.col("_most") - F.col("_least")
        place = F.floor((F.col("_v") - F.col("_least")) / span * PARTS)
        part = F.when(span > 0, F.least(place, F.lit(PARTS - 1))).otherwise(0).cast("int")
        upto = Window.partitionBy(*keys, "_was").orderBy("_part")
        parted = values.select(*keys, "_total", F.col("_before").alias("_was"), part.alias("_part"), "_v", "_n")
        cells = (
            parted.groupBy(*keys, "_total", "_was", "_part")
            .agg(F.sum("_n").alias("_size"), F.count("_v").alias("_distinct"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            .select("*", (F.col("_was") + F.sum("_size").over(upto) - F.col("_size")).alias("_before"))
            .filter(wanted)
        )
        cells = cut_lineage(cells, "quantile-cells")
        values = _met(parted.drop("_total"), cells.drop("_size", "_distinct"), [*keys, "_was", "_part"]).drop("_was", "_part")
        if cells.filter(F.col("_distinct") > values_per_task).isEmpty():
            return values


def exact_mad(
    df: DataFrame, keys: Sequence[str], value: str, min_values: int = 3, scale: float = 1.4826
) -> DataFrame:
    """Median and scaled median absolute deviation per ``keys``; smaller groups are left out.

    ``df`` is read once: its distinct values and their counts are written out,
    and both medians come from them.
    """
    keys = list(keys)
    rows = cut_lineage(df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_times")), "values")
    centre = exact_quantiles(rows, keys, "_x", {"median": 0.5}, weight="_times", count_as="values")
    centre = cut_lineage(centre.filter(F.col("values") >= min_values), "medians")
    deviations = rows.join(centre, keys).select(
        *keys, "values", "median", "_times", F.abs(F.col("_x") - F.col("median")).alias("_dev")
    )
    spread = exact_quantiles(deviations, [*keys, "values", "median"], "_dev", {"_mad": 0.5}, weight="_times")
    spread = spread.select(*keys, "values", "median", (F.col("_mad") * scale).alias("scale"))
    return cut_lineage(spread, "mad")
