"""Near-duplicate item names, judged by co-occurrence rather than by similarity alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.functions.text import fold_arabic, nfkc
from marketclime.session import cut_lineage

MAX_DISTANCE = 2
SAME_DAY_RATE = 0.05
SAME_DAY_GROUP = 10


def normalise_names(names: DataFrame, name: str = "item") -> DataFrame:
    """Add ``norm`` to a frame of distinct names; the only Python step, so never run it on raw rows."""
    return names.withColumn("norm", fold_arabic(nfkc()(F.col(name))))


def item_days(df: DataFrame) -> DataFrame:
    """One row per (item, date) with its first ordinal."""
    return df.groupBy("item", "date").agg(F.min("ordinal").alias("ordinal"))


def item_vocabulary(days: DataFrame) -> DataFrame:
    """One row per item: days listed, first ordinal, normalised name."""
    items = days.groupBy("item").agg(
        F.count(F.lit(1)).alias("days"), F.min("ordinal").alias("first_ordinal")
    )
    return normalise_names(items)


def _shorter(text: Column) -> Column:
    """All strings made by dropping one character."""
    n = F.length(text)
    dropped = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)),
    )
    return F.when(n > 0, dropped).otherwise(F.array().cast("array<string>"))


def deletion_keys(text: Column) -> Column:
    """The text and everything left after dropping up to two characters, as hashes.

    Two texts within edit distance 2 always share one of these; two texts that
    share one are never further apart than 4, so blocks stay small whatever
    words the vocabulary repeats.
    """
    once = _shorter(text)
    twice = F.flatten(F.transform(once, lambda t: _shorter(t)))
    return F.array_distinct(F.transform(F.concat(F.array(text), once, twice), lambda t: F.xxhash64(t)))


def near_names(norms: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs of distinct normalised names within ``max_distance`` (at most 2): norm_a < norm_b."""
    keys = norms.select("norm", F.explode(deletion_keys(F.col("norm"))).alias("_key"))
    left = keys.select(F.col("norm").alias("norm_a"), "_key")
    right = keys.select(F.col("norm").alias("norm_b"), "_key")
    if not 0 <= max_distance <= 2:
        raise ValueError("deletion keys are exact up to two edits")
    distance = F.levenshtein("norm_a", "norm_b", max_distance)
    return (
        left.join(right, "_key")
        .filter(F.col("norm_a") < F.col("norm_b"))
        .filter(distance >= 0)
        .select("norm_a", "norm_b", distance.alias("edit_distance"))
        .distinct()
    )


BLOCK_DAYS = 64


def day_bits(days: DataFrame) -> DataFrame:
    """One row per (item, block of 64 days): the days on which the item is listed as bits of a long. Rows without a date are left out."""
    number = F.unix_date("date")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(BLOCK_DAYS)))
    listed = days.filter(F.col("date").isNotNull())
    return listed.groupBy("item", F.floor(number / BLOCK_DAYS).cast("int").alias("block")).agg(F.bit_or(bit).alias("bits"))


def _calendars(bits: DataFrame) -> DataFrame:
    """One row per item: its blocks as a map, as long as the calendar at most."""
    return bits.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("calendar"))


def shared_days(pairs: DataFrame, days: DataFrame) -> DataFrame:
    """Days on which both items of a pair are listed; pairs without such a day give 0 or no row.

    Each side brings its calendar as bits, so a pair stays one row and days are
    counted by AND.
    """
    asked = pairs.select("item_a", "item_b")
    named = asked.select(F.explode(F.array("item_a", "item_b")).alias("item")).distinct()
    calendars = cut_lineage(_calendars(day_bits(days.join(named, "item", "left_semi"))), "calendars")
    one = calendars.select(F.col("item").alias("item_a"), F.col("calendar").alias("_a"))
    two = calendars.select(F.col("item").alias("item_b"), F.col("calendar").alias("_b"))
    both = F.map_zip_with("_a", "_b", lambda block, a, b: F.bit_count(a.bitwiseAND(b)))
    total = F.aggregate(F.map_values(both), F.lit(0).cast("long"), lambda sum_, n: sum_ + F.coalesce(n, F.lit(0)))
    return asked.join(one, "item_a").join(two, "item_b").select("item_a", "item_b", total.alias("shared_days"))


def near_duplicate_pairs(df: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Item pairs whose normalised names differ by one or two edits, with shared days and a verdict.

    ``item_a`` is the item listed on more days. Nothing is merged.
    """
    days = cut_lineage(item_days(df), "item-days")
    items = cut_lineage(item_vocabulary(days), "vocabulary")
    near = near_names(items.select("norm").distinct(), max_distance)
    one = items.select(
        F.col("norm").alias("norm_a"), F.struct((-F.col("days")).alias("d"), "first_ordinal", "item").alias("x")
    )
    two = items.select(
        F.col("norm").alias("norm_b"), F.struct((-F.col("days")).alias("d"), "first_ordinal", "item").alias("y")
    )
    pairs = cut_lineage(
        near.join(one, "norm_a")
        .join(two, "norm_b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "edit_distance")
        .select(
            F.col("a.item").alias("item_a"),
            F.col("b.item").alias("item_b"),
            "edit_distance",
            (-F.col("a.d")).alias("days_a"),
            (-F.col("b.d")).alias("days_b"),
        ),
        "name-pairs",
    )
    judged = pairs.join(shared_days(pairs, days), ["item_a", "item_b"], "left").withColumn(
        "shared_days", F.coalesce("shared_days", F.lit(0).cast("long"))
    )
    rate = F.col("shared_days") / F.least("days_a", "days_b")
    return judged.select(
        "item_a",
        "item_b",
        "edit_distance",
        "days_a",
        "days_b",
        "shared_days",
        F.round(rate, 3).alias("cooccurrence_rate"),
        F.when(rate > SAME_DAY_RATE, "DIFFERENT (co-occur)").otherwise("possible rename").alias("verdict"),
        F.lit("").alias("decision"),
    )


def exact_name_groups(df: DataFrame) -> DataFrame:
    """Items that differ only in spelling folds: one row per member with its group's verdict.

    ``max_shared_days`` is the largest number of days any two members share.
    Members meet once per block of 64 days and count shared days by AND.
    """
    days = cut_lineage(item_days(df), "item-days")
    items = cut_lineage(item_vocabulary(days), "vocabulary")
    groups = items.groupBy("norm").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    members = items.join(groups, "norm")
    listed = day_bits(days.join(members.select("item"), "item", "left_semi")).join(members.select("item", "norm"), "item")
    other = listed.select("norm", "block", F.col("item").alias("item_b"), F.col("bits").alias("bits_b"))
    in_block = F.bit_count(F.col("bits").bitwiseAND(F.col("bits_b")))
    together = (
        listed.join(other, ["norm", "block"])
        .filter((F.col("item") < F.col("item_b")) & (in_block > 0))
        .groupBy("norm", "item", "item_b")
        .agg(F.sum(in_block).alias("shared"))
        .groupBy("norm")
        .agg(F.max("shared").alias("max_shared_days"))
    )
    shared = F.coalesce("max_shared_days", F.lit(0).cast("long"))
    return members.join(together, "norm", "left").select(
        "norm",
        "item",
        "days",
        "members",
        shared.alias("max_shared_days"),
        F.when(shared > SAME_DAY_GROUP, "CO-OCCUR, different products")
        .otherwise("likely same, safe to merge")
        .alias("verdict"),
    )
