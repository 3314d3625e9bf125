"""Benchmark decontamination with column functions only: short test items inside long documents.

A document is far longer than an item, so Jaccard similarity says nothing;
containment of the item's shingles does. Items are partitioned by size, and each
keeps the minima of its shingle hashes (a bottom-k MinHash) in a number that
follows its size class: with a containment of at least ``share``, less than
that many shingles can be missing, so at least one of the minima occurs in the
document and no pair is lost. Documents meet the minima by an equi-join on the
hash; pairs found that way are verified by exact containment on the words.

The benchmark is the query set: its minima are written out first, so Spark
broadcasts them only below the session's threshold and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketclime.llm.columns import shielded
from marketclime.session import cut_lineage

WORDS = 5
SHARE = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased words; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(values: Column, n: int) -> Column:
    """Rows of ``n`` neighbours (w0, w1, ...), one per window."""
    size = F.greatest(F.size(values) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(values, k + 1, size).alias(f"w{k}") for k in range(n)])


def _shingle_rows(df: DataFrame, words: str, keep: list[str], n: int, hashed: bool) -> DataFrame:
    """``keep`` and one row per word window: its hash, and its words where not ``hashed``."""
    values = F.transform(words, lambda w: F.xxhash64(w)) if hashed else F.col(words)
    rows = df.select(*keep, values.alias("_values")).select(*keep, F.inline(_windows(F.col("_values"), n)))
    parts = [f"w{k}" for k in range(n)]
    if hashed:
        return rows.select(*keep, F.xxhash64(*parts).alias("shingle"))
    return rows.select(*keep, F.concat_ws(" ", *parts).alias("shingle"))


def item_minima(items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """item_id and shingle: the smallest shingle hashes of each item, their number by size class.

    The classes are powers of two; an item keeps as many minima as the largest
    size of its class needs, or all its shingles.
    """
    words = items.select("item_id", words_of(F.col("text")).alias("words"))
    hashes = F.array_sort(F.collect_set("shingle"))
    sets = _shingle_rows(words, "words", ["item_id"], n, True).groupBy("item_id").agg(hashes.alias("hashes"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hashes").cast("double"))))
    # 1e-9: a product that should be whole may come out a little less
    kept = (F.floor(largest * (1 - share) + 1e-9) + 1).cast("int")
    return sets.select("item_id", F.explode(F.slice("hashes", F.lit(1), kept)).alias("shingle"))


def find_leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, doc_hash, item_id, n_shingles, n_shared, containment of every leaked item.

    An item leaks into a document that holds at least ``share`` of its distinct
    ``n``-word shingles, words lower-cased and split at space and 0x09-0x0D. Items with
    fewer words have no shingles and match nothing; null and empty texts
    neither, nor do items with a null id. Rows equal in id and text count as one document (``doc_hash``
    tells rows of one id apart); null ids are kept. Repeated items with one id
    are one item with the shingles of both.
    """
    minima = cut_lineage(item_minima(items, n, share), "item-minima")
    named = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    words = named.select("doc_id", "doc_hash", words_of(F.col("text")).alias("words"))
    found = _shingle_rows(words, "words", ["doc_id", "doc_hash"], n, True).join(minima, "shingle")
    pairs = cut_lineage(found.select("doc_id", "doc_hash", "item_id").distinct(), "leak-candidates")

    item_words = items.select("item_id", words_of(F.col("text")).alias("words"))
    full = cut_lineage(_shingle_rows(item_words, "words", ["item_id"], n, False).distinct(), "item-shingles")
    sizes = full.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    wanted = pairs.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash")).distinct()
    same = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("doc_hash") == F.col("_hash")]
    suspects = named.join(wanted, same, "left_semi").select("doc_id", "doc_hash", words_of(F.col("text")).alias("words"))
    spoken = _shingle_rows(suspects, "words", ["doc_id", "doc_hash"], n, False)
    shared = (
        spoken.join(full, "shingle")
        .groupBy("doc_id", "doc_hash", "item_id")
        .agg(F.count_distinct("shingle").alias("n_shared"))
    )
    candidates = pairs.select(
        F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), F.col("item_id").alias("_item")
    )
    same_pair = [*same, F.col("item_id").eqNullSafe(F.col("_item"))]
    return (
        shared.join(candidates, same_pair, "left_semi")
        .join(sizes, "item_id")
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        .filter(F.col("n_shared") >= share * F.col("n_shingles") - 1e-9)
        .select("doc_id", "doc_hash", "item_id", "n_shingles", "n_shared", "containment")
    )


def drop_leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with its columns, whatever the names of those besides doc_id and text."""
    own = docs.select("doc_id", "text")
    leaks = cut_lineage(find_leaks(own, items.select("item_id", "text"), n, share).select("doc_id", "doc_hash").distinct(), "leaks")
    leaks = leaks.select(F.col("doc_id").alias("_leak_id"), F.col("doc_hash").alias("_leak_hash"))
    same = [F.col("doc_id").eqNullSafe(F.col("_leak_id")), F.xxhash64("text") == F.col("_leak_hash")]
    return shielded(docs, ("doc_id", "text"), lambda rows: rows.join(leaks, same, "left_anti"))
