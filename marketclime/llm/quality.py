"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Sources too small for a model of their own are judged by the next wider one:
their language's small sources together, the whole language, all documents.

Statistics come from one pass over whole texts (no shuffle). Outliers are found
by a minimum-covariance-determinant estimate: from a coordinate-wise robust
start, each concentration step keeps the three quarters of a group's documents
that lie nearest by Mahalanobis distance and estimates mean and covariance anew
from them. A step is one aggregation over all documents: sums per group and
fine bin of the distance, combined map-side, so a group of any size costs its
bins; the driver holds nothing. Matrices are inverted per group, on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.llm.columns import shielded
from marketclime.llm.textbytes import (
    SECOND_BASE,
    column_bytes,
    mix,
    slices,
    window_hashes,
    word_hashes,
    word_spans,
)
from marketclime.session import cut_lineage

BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_STATS = ("n_lines", "n_upper", "n_marks")
STATS = BASE_STATS + MORE_STATS

MIN_WORDS = 50  # fixed values: the base rules
MAX_REPEAT_PERCENT = 50

KEEP_SHARE = 0.75  # of a group, in every concentration step
STEPS = 5
MIN_GROUP = 100  # rows; smaller groups are judged by the next wider one
FLOOR = 0.08  # least standard deviation of a feature, for those that are zero almost everywhere
CUTOFF = 400.0  # squared Mahalanobis distance beyond which a document goes; set on labelled documents
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks")
BINS_PER_OCTAVE = 32

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
_mark = np.zeros(256, bool)
_mark[list(b"!?*#$%&|<>{}[]~^_=+\\/@;")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of texts laid end to end, one array per name of ``STATS``."""
    n = offsets.size - 1
    starts, ends, places = word_spans(data, offsets)
    inside = np.zeros(data.size + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a word may begin where another text's ended
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": np.diff(places),
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_symbol[data], offsets),
        "n_upper": _per_text((data >= 65) & (data <= 90), offsets),
        "n_marks": _per_text(_mark[data], offsets),
    }
    of_word = np.repeat(np.arange(n), out["n_words"])
    windows = window_hashes(word_hashes(data, starts, ends), 3)
    covered = np.zeros(starts.size, bool)
    if windows.size:
        whole = of_word[:-2] == of_word[2:]
        own = mix(windows + of_word[:-2].astype(np.uint64) * np.uint64(SECOND_BASE))[whole]
        _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        again = np.flatnonzero(whole)[counts[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(of_word[covered], minlength=n).astype(np.int64)
    raw = data.tobytes()
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        spoken = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i], dup[i] = len(spoken), len(spoken) - len(set(spoken))
    out["n_dup_lines"], out["n_lines"] = dup, lines
    return out


def with_stats(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the statistics of ``text``, named with ``prefix``; null text has no words. Columns of those names are replaced."""
    names = [prefix + s for s in STATS]
    keep = [i for i, c in enumerate(df.columns) if c not in names]
    schema = T.StructType([*(df.schema.fields[i] for i in keep), *(T.StructField(c, T.LongType()) for c in names)])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                stats = text_stats(*column_bytes(part.column(place)))
                columns = [*(part.column(i) for i in keep), *(pa.array(stats[s].astype(np.int64)) for s in STATS)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def features(prefix: str = "") -> list[Column]:
    """The transformed statistics of a document with words, in the order of ``FEATURES``."""

    def share(top: str, bottom: str, scale: float) -> Column:
        return F.asinh(F.coalesce(F.try_divide(F.col(prefix + top) * scale, F.col(prefix + bottom)), F.lit(0.0)))

    length = F.log(F.greatest(F.coalesce(F.try_divide(f"{prefix}word_chars", f"{prefix}n_words"), F.lit(1.0)), F.lit(1.0)))
    return [
        c.alias(f)
        for c, f in zip(
            [
                length * 2,
                share("n_symbols", "word_chars", 50.0),
                share("n_dup_lines", "n_lines", 2.0),
                share("n_repeat_words", "n_words", 3.0),
                share("n_upper", "word_chars", 5.0),
                share("n_marks", "word_chars", 20.0),
            ],
            FEATURES,
            strict=True,
        )
    ]


def _known(name: str) -> Column:
    return F.concat(F.lit("="), F.col(name).cast("string"))


def _named(df: DataFrame) -> DataFrame:
    """Add ``_lang`` and ``_source``. Null is a value of its own."""
    lang, source = F.coalesce(_known("lang"), F.lit("")), F.coalesce(_known("source"), F.lit(""))
    return df.withColumn("_lang", lang).withColumn("_source", source)


def source_groups(stats: DataFrame) -> DataFrame:
    """``_lang``, ``_source``, ``_group`` and ``_fits``: whose model judges a source, and which models its rows help to fit.

    A group has ``MIN_GROUP`` rows that pass the base rules, and the first of
    these that has is taken: the source, the small sources of its language, its
    language, all documents (however few they are). Rows of large sources are
    fitted for the wider groups too where some source needs those.
    """
    passes = F.count_if(~base_failed()).alias("_rows")
    counts = cut_lineage(_named(stats).groupBy("_lang", "_source").agg(passes), "source-rows")
    small = F.col("_rows") < MIN_GROUP
    langs = counts.groupBy("_lang").agg(
        F.sum("_rows").alias("_all"), F.sum(F.when(small, F.col("_rows")).otherwise(0)).alias("_rest"), F.max(small).alias("_small")
    )
    wide = F.col("_small") & (F.col("_rest") < MIN_GROUP)  # the small sources need more than themselves
    langs = cut_lineage(langs.select("*", wide.alias("_wide")), "language-rows")
    lone = F.col("_wide") & (F.col("_all") < MIN_GROUP)  # and more than their language
    everywhere = F.lit(not langs.filter(lone).isEmpty())
    whole, everything = F.concat_ws("\n", "_lang", F.lit("(all)")), F.lit("(all)")
    group = (
        F.when(~small, F.concat_ws("\n", "_lang", "_source"))
        .when(~F.col("_wide"), F.concat_ws("\n", "_lang", F.lit("(rest)")))
        .when(~lone, whole)
        .otherwise(everything)
    )
    fits = F.array(group, F.when(F.col("_wide") & ~lone, whole), F.when(everywhere, everything))
    placed = counts.join(langs, "_lang").select(
        "_lang", "_source", group.alias("_group"), F.array_distinct(F.array_compact(fits)).alias("_fits")
    )
    return cut_lineage(placed, "source-groups")


def _chi2_share(x: float, dof: int) -> float:
    """Share of a chi-squared distribution with an even ``dof`` below ``x``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float = KEEP_SHARE, dof: int = len(FEATURES)) -> float:
    """By how much the covariance of the nearest ``share`` of normal data falls short."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_share(middle, dof) < share else (low, middle)
    return share / _chi2_share(low, dof + 2)


MODEL = "_group string, _mean array<double>, _precision array<double>, _size long"


def _squared(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of ``FEATURES`` from ``_mean`` by ``_precision``."""
    d = len(FEATURES)
    gaps = [F.col(f) - F.col("_mean")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + gaps[i] * gaps[j] * F.col("_precision")[i * d + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _models(moments: DataFrame) -> DataFrame:
    """Mean and inverse covariance from ``_group``, ``_n``, ``_size``, first and second sums."""
    d, factor = len(FEATURES), consistency()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means, precisions = [], []
            for n, first, second in zip(frame["_n"], frame["_first"], frame["_second"], strict=True):
                mean = np.asarray(first, float) / n
                cov = (np.asarray(second, float).reshape(d, d) / n - np.outer(mean, mean)) * factor
                precisions.append(np.linalg.inv((cov + cov.T) / 2 + FLOOR**2 * np.eye(d)).ravel())
                means.append(mean)
            yield pd.DataFrame({"_group": frame["_group"], "_mean": means, "_precision": precisions, "_size": frame["_size"]})

    return cut_lineage(moments.mapInPandas(run, MODEL), "mcd")


def fit_outliers(stats: DataFrame, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """``source_groups`` and the robust model per group, from a written table of statistics.

    Only documents that pass the base rules are fitted; if there are none, there
    is no model.
    """
    d = len(FEATURES)
    passing = stats.filter(~base_failed())
    groups = source_groups(stats)
    rows = _named(passing.select("lang", "source", *features())).join(groups, ["_lang", "_source"])
    rows = cut_lineage(rows.select(F.explode("_fits").alias("_group"), *FEATURES), "features")

    quarters = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f) for f in FEATURES]
    start = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"), *quarters)

    def spread(f: str) -> Column:
        return F.greatest((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(FLOOR))

    diagonal = [F.lit(0.0) if i != j else 1 / (spread(f) * spread(f)) for i, f in enumerate(FEATURES) for j in range(d)]
    model = cut_lineage(
        start.select(
            "_group", F.array(*[F.col(f)[1] for f in FEATURES]).alias("_mean"), F.array(*diagonal).alias("_precision"), "_size"
        ),
        "mcd",
    )
    for _ in range(steps):
        placed = rows.join(model, "_group").withColumn(
            "_bin", F.floor(F.log2(_squared() + 2.0**-20) * BINS_PER_OCTAVE).cast("int")
        )
        sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
        products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
        bins = placed.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"), *sums, *products)
        upto = Window.partitionBy("_group").orderBy("_bin")
        near = bins.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).filter(F.col("_before") < KEEP_SHARE * F.col("_size"))
        kept = near.groupBy("_group").agg(
            F.sum("_n").alias("_n"), F.max("_size").alias("_size"),
            *[F.sum(c).alias(c) for c in near.columns if c[0] in "sp"],
        )
        second = F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
        first = F.array(*[F.col(f"s{i}") for i in range(d)])
        model = _models(kept.select("_group", "_n", "_size", first.alias("_first"), second.alias("_second")))
    return groups, model


def judge_quality(stats: DataFrame, groups: DataFrame, model: DataFrame, prefix: str = "") -> DataFrame:
    """Add base_failed, distance (squared; null only where no document at all passes the base rules) and kept to rows with statistics."""
    judged = _named(stats.select("*", *features(prefix))).join(groups, ["_lang", "_source"], "left").join(model, "_group", "left")
    judged = judged.withColumn("base_failed", base_failed(prefix))
    judged = judged.withColumn("distance", F.when(F.col("_mean").isNotNull(), _squared()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.withColumn("kept", kept).drop("_lang", "_source", "_group", "_fits", "_mean", "_precision", "_size", *FEATURES)


def document_quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, statistics, base_failed, distance, kept.

    Null text counts as empty and fails; null language or source is a group of
    its own; repeated rows stay. An empty table gives an empty result.
    """
    stats = cut_lineage(with_stats(docs.select("doc_id", "text", "lang", "source")).drop("text"), "stats")
    groups, model = fit_outliers(stats)
    return judge_quality(stats, groups, model).select("doc_id", *STATS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns, whatever the names of those besides text, lang and source."""
    own = with_stats(docs.select("text", "lang", "source")).drop("text")
    groups, model = fit_outliers(cut_lineage(own, "stats"))
    prefix = "_quality_"
    return shielded(
        docs, ("text", "lang", "source"), lambda rows: judge_quality(with_stats(rows, prefix=prefix), groups, model, prefix).filter("kept")
    )
