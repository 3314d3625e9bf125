"""Row positions for file-backed frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_ROWS = 1 << 40  # room for row positions within one file
_TASK_ROWS = (1 << 33) - 1  # monotonically_increasing_id counts the rows of a task in its low 33 bits


def _plain_path(path: Column) -> Column:
    """Local paths come with one or three slashes, depending on who reports them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _placed(df: DataFrame, position: Column, ordinal: str) -> DataFrame:
    """Add ``position`` within a file, moved up by the file's rank in path order."""
    files = sorted(df.inputFiles())
    if len(files) <= 1:
        return df.select("*", position.alias(ordinal))
    # an Arrow table becomes a relation of known size: broadcast below the threshold, so rows are not shuffled
    ranks = df.sparkSession.createDataFrame(pa.table({"_place_rank": pa.array(range(len(files)), pa.int64()), "_place_file": files}))
    ranks = ranks.withColumn("_place_file", _plain_path(F.col("_place_file")))
    placed = df.select("*", _plain_path(F.col("_metadata.file_path")).alias("_place_file"), position.alias("_place_at"))
    unknown = F.raise_error(F.concat(F.lit("file missing from the scan's list: "), F.col("_place_file"))).cast("long")
    return (
        placed.join(ranks, "_place_file", "left")
        .withColumn(ordinal, F.coalesce("_place_rank", unknown) * FILE_ROWS + F.col("_place_at"))
        .drop("_place_file", "_place_rank", "_place_at")
    )


def with_ordinal(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Add the input position of each row of a Parquet read as a unique long.

    Files count in path order, rows in file order, so "first row wins" rules
    do not depend on how the scan is split. Call it directly on a read. The
    file list is the scan's own metadata; no data is read for it.
    """
    return _placed(df, F.col("_metadata.row_index"), ordinal)


def with_line_ordinal(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``with_ordinal`` for formats of lines (CSV, text), which carry no row number.

    The position is the byte at which the row's part of the file starts plus
    the rows its task read before it. A row has at least one byte, and a task
    that goes on to a further part has no whole part behind it but the last of
    a file, so positions are unique and rise along a file of up to 2**40
    bytes. They have gaps and depend on the split; their order does not.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(_TASK_ROWS))
    return _placed(df, F.col("_metadata.file_block_start") + in_task, ordinal)
