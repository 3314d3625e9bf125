"""Quality flags for price rows. Rows are flagged, never dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketclime.operators.quantiles import exact_mad

PRICES = ("price_low", "price_mode", "price_high")
MAD_K = 6.0
LOCAL_MAD_K = 5.0
LOCAL_DAYS = 21


def with_order_ok(df: DataFrame) -> DataFrame:
    """``order_ok`` = 1 where low <= mode <= high, 0 where not, null where a price is missing."""
    low, mode, high = (F.col(c) for c in PRICES)
    known = low.isNotNull() & mode.isNotNull() & high.isNotNull()
    return df.withColumn("order_ok", F.when(known, ((low <= mode) & (mode <= high)).cast("int")))


def first_ordinals(df: DataFrame, keys: Sequence[str] = ("date", "item"), ordinal: str = "ordinal") -> DataFrame:
    """The ordinal of the first row of each key: a map-side combined minimum, so a hot key costs nothing extra."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))


def _renamed(columns: Sequence[str]) -> list[str]:
    return [f"_first_{c}" for c in columns]


def _firsts(df: DataFrame, keys: Sequence[str], ordinal: str) -> tuple[DataFrame, list[Column]]:
    """Key and ordinal of each key's first row under other names, and the condition that meets it."""
    columns = [*keys, ordinal]
    renamed = zip(columns, _renamed(columns), strict=True)
    firsts = first_ordinals(df, keys, ordinal).select(*[F.col(c).alias(n) for c, n in renamed])
    return firsts, [df[c].eqNullSafe(firsts[n]) for c, n in zip(columns, _renamed(columns), strict=True)]


def flag_duplicates(
    df: DataFrame, keys: Sequence[str] = ("date", "item"), ordinal: str = "ordinal"
) -> DataFrame:
    """``duplicate`` = 0 for the first listing of a key, 1 for the repeats.

    The first ordinals are joined back on key and ordinal together: a key that
    owns a third of the rows still spreads over all tasks by its ordinals, and
    an ordinal that another key or load uses too meets nothing. Null keys and
    ordinals are values like others.
    """
    firsts, same = _firsts(df, keys, ordinal)
    flagged = df.join(firsts.withColumn("duplicate", F.lit(0)), same, "left")
    return flagged.withColumn("duplicate", F.coalesce("duplicate", F.lit(1))).drop(*_renamed([*keys, ordinal]))


def first_row_distinct(
    df: DataFrame, keys: Sequence[str] = ("date", "item"), ordinal: str = "ordinal"
) -> DataFrame:
    """Keep the first row of each key, all columns; ordinals need only be unique within a key."""
    firsts, same = _firsts(df, keys, ordinal)
    return df.join(firsts, same, "left_semi")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys listed more than once, with row count and number of differing price/quantity records."""
    return (
        df.groupBy("date", "item", *PRICES, "quantity")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("ordinal"))
        .groupBy("date", "item")
        .agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("variants"),
            F.min("ordinal").alias("ordinal"),
        )
        .filter(F.col("rows") > 1)
    )


def duplicate_audit(df: DataFrame) -> DataFrame:
    """One row: repeated keys, extra rows, identical and conflicting keys."""
    return duplicate_keys(df).agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("extra_rows"),
        F.count_if(F.col("variants") == 1).alias("identical_keys"),
        F.count_if(F.col("variants") > 1).alias("conflicting_keys"),
    )


def conflicting_examples(df: DataFrame, n: int | None = None) -> DataFrame:
    """The listings of repeated keys that disagree on a price: date, item, ordinal, prices, quantity.

    Quantity alone is no conflict here. ``n`` keeps the first so many keys, in
    the order of their first row.
    """
    keys = (
        df.groupBy("date", "item", *PRICES)
        .agg(F.min("ordinal").alias("_first"))
        .groupBy("date", "item")
        .agg(F.count(F.lit(1)).alias("_prices"), F.min("_first").alias("_first"))
        .filter(F.col("_prices") > 1)
    )
    if n is not None:
        keys = keys.orderBy("_first").limit(n)
    keys = keys.select(F.col("date").alias("_date"), F.col("item").alias("_item"))
    same = [F.col("date").eqNullSafe(F.col("_date")), F.col("item").eqNullSafe(F.col("_item"))]
    return df.join(keys, same, "left_semi").select("date", "item", "ordinal", *PRICES, "quantity")


def column_order_audit(df: DataFrame) -> DataFrame:
    """How often each price position holds the largest, middle and smallest of three distinct prices.

    One pass with nine conditional counts; the three report rows are cut from
    the single result row.
    """
    positions = ["price_high", "price_mode", "price_low"]
    ranks = ["largest", "middle", "smallest"]
    high, mode, low = (F.col(c) for c in positions)
    ranked = df.filter((high != mode) & (mode != low) & (high != low))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(positions):
        others = [c for c in positions if c != name]
        above = sum(((F.col(o) > F.col(name)).cast("int") for o in others), F.lit(0))
        aggregates += [F.count_if(above == r).alias(f"p{i}r{r}") for r in range(3)]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("parsed_as"),
                *[F.try_divide(f"p{i}r{r}", "n").alias(ranks[r]) for r in range(3)],
                F.col("n").alias("ranked_rows"),
            )
            for i, name in enumerate(positions)
        ]
    )
    return ranked.agg(*aggregates).select(F.inline(rows))


def mad_thresholds(df: DataFrame) -> DataFrame:
    """Median and scaled MAD of the positive modal price per item.

    Duplicates and order violations count; items with fewer than three values
    or no spread get no threshold.
    """
    return exact_mad(df.filter(F.col("price_mode") > 0), ["item"], "price_mode").filter(F.col("scale") > 0)


def flag_outliers(df: DataFrame, thresholds: DataFrame | None = None, k: float = MAD_K) -> DataFrame:
    """``outlier`` = 1 where the modal price is more than ``k`` MAD from its item's median."""
    limits = (mad_thresholds(df) if thresholds is None else thresholds).select("item", "median", "scale")
    far = F.abs(F.col("price_mode") - F.col("median")) > k * F.col("scale")
    return (
        df.join(limits, "item", "left")
        .withColumn("outlier", F.coalesce(far, F.lit(False)).cast("int"))
        .drop("median", "scale")
    )


def local_thresholds(df: DataFrame, days: int = LOCAL_DAYS) -> DataFrame:
    """Median and scaled MAD of the first-listed positive modal price in a centred window of ``days`` days.

    One value per (item, date) enters, so a window holds at most ``days``
    values and an item's series is bounded by the calendar.
    """
    half = (days - 1) // 2
    series = (
        df.filter(F.col("price_mode") > 0)
        .groupBy("item", "date")
        .agg(F.min_by("price_mode", "ordinal").alias("value"))
        .withColumn("_day", F.unix_date("date"))
    )
    around = Window.partitionBy("item").orderBy("_day").rangeBetween(-half, half)

    def middle(values):
        n = F.size(values)
        low = F.element_at(values, F.floor((n + 1) / 2).cast("int"))
        high = F.element_at(values, F.floor(n / 2).cast("int") + 1)
        return (low + high) / 2

    return (
        series.withColumn("_values", F.sort_array(F.collect_list("value").over(around)))
        .withColumn("local_median", middle(F.col("_values")))
        .withColumn("_dev", F.sort_array(F.transform("_values", lambda v: F.abs(v - F.col("local_median")))))
        .withColumn("local_scale", middle(F.col("_dev")) * 1.4826)
        .filter((F.size("_values") >= 3) & (F.col("local_scale") > 0))
        .select("item", "date", "local_median", "local_scale")
    )


def flag_local_outliers(df: DataFrame, k: float = LOCAL_MAD_K, days: int = LOCAL_DAYS) -> DataFrame:
    """``outlier`` by the rolling rule: more than ``k`` local MAD from the local median."""
    far = F.abs(F.col("price_mode") - F.col("local_median")) > k * F.col("local_scale")
    return (
        df.join(local_thresholds(df, days), ["item", "date"], "left")
        .withColumn("outlier", F.coalesce(far, F.lit(False)).cast("int"))
        .drop("local_median", "local_scale")
    )


def missing_audit(df: DataFrame) -> DataFrame:
    """One row: rows, missing prices, zero prices, no quantity."""
    low, mode, high = (F.col(c) for c in PRICES)
    quantity = F.col("quantity")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(low.isNull() | mode.isNull() | high.isNull()).alias("missing_price"),
        F.count_if((low == 0) | (mode == 0) | (high == 0)).alias("zero_price"),
        F.count_if(quantity.isNull() | (quantity == 0)).alias("no_quantity"),
    )


def with_usable(df: DataFrame) -> DataFrame:
    """``usable`` = 1 where every check passes."""
    low, mode, high = (F.col(c) for c in PRICES)
    passes = (
        (F.col("order_ok") == 1)
        & (F.col("outlier") == 0)
        & (F.col("duplicate") == 0)
        & low.isNotNull()
        & high.isNotNull()
        & (mode > 0)
    )
    return df.withColumn("usable", F.coalesce(passes, F.lit(False)).cast("int"))


def apply_merges(df: DataFrame, merges: DataFrame) -> DataFrame:
    """Rename reviewed items; the listed name stays in ``item_raw``. Runs after all flags are set."""
    renames = merges.select(F.col("from_item").alias("item"), "to_item")
    return (
        df.join(renames, "item", "left")
        .withColumn("item_raw", F.col("item"))
        .withColumn("item", F.coalesce("to_item", "item"))
        .drop("to_item")
    )


def clean_prices(
    df: DataFrame, merges: DataFrame | None = None, k: float = MAD_K, rule: str = "global"
) -> DataFrame:
    """All flags on all rows: duplicate, outlier (``rule`` "global" or "local"), usable; then the merges."""
    flagged = flag_duplicates(df)
    flagged = flag_outliers(flagged, mad_thresholds(df), k) if rule == "global" else flag_local_outliers(flagged, k)
    flagged = with_usable(flagged)
    if merges is None:
        return flagged.withColumn("item_raw", F.col("item"))
    return apply_merges(flagged, merges)


def cleaning_summary(clean: DataFrame) -> DataFrame:
    """One row: rows written, outliers, duplicates, usable rows and their share."""
    return clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("outlier").alias("outliers"),
        F.sum("duplicate").alias("duplicates"),
        F.sum("usable").alias("usable"),
        F.avg("usable").alias("usable_share"),
    )
