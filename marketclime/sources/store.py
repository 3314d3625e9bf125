"""A table of loads: every load has a number, every row a position, and readers see whole versions only.

Layout below the root::

    data/written=<number>-<unique>/<partition>=<value>/part-*.parquet
    versions/<number>.json

A load writes its rows into a folder of its own and then names, in one version
file, which folders hold each partition from now on. The file is written beside
its place and renamed into it, which fails if the number is taken. So

* a reader follows one version file and never meets half a rewrite; folders of
  versions before stay;
* a batch that is replayed finds its (writer, batch) in a version file and
  changes nothing; one that was cut short before the rename leaves a folder that
  no version names, and its next try writes a new one;
* of two writers at once one fails, and may try again from the new state.

Rows carry ``load`` and ``ordinal`` = load * 2**40 + place, where places count
the rows of a load from 0 in the order of the caller's columns (file, then row,
say). Ordinals are unique over all loads, and a later load comes after.

Version files hold one entry per partition and load that is still read, never
rows, and are read by the driver through Hadoop's file system classes, so the
root may be any path that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketclime.operators.ingest import latest_by, new_rows
from marketclime.operators.quality import first_row_distinct
from marketclime.session import cut_lineage

PLACES = 1 << 40
_ROWS = (1 << 33) - 1  # monotonically_increasing_id counts rows of a partition in its low 33 bits


class LoadConflict(RuntimeError):
    """Another load took the number first."""


def with_places(rows: DataFrame, order: Sequence[str], place: str = "place") -> DataFrame:
    """Number rows from 0 by ``order``. One sort by ranges; offsets are running sums over one row per range.

    Rows equal in all of ``order`` are numbered in any order. Written to the
    shared folder, since numbers taken from a plan could change with a retry.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(
        sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))),
        "places",
    )
    sizes = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())  # one row per range
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    if not offsets:
        return marked.select(*rows.columns, F.lit(0).cast("long").alias(place))
    starts = rows.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return marked.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_at")).alias(place))


class LoadStore:
    """Rows by ``partition`` (a string or whole number column) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, partition: str = "month"):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ------------------------------------------------------------ versions

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> dict:
        """A version file's content, the latest by default; before any load an empty one with number -1."""
        known = self._versions()
        if not known:
            return {"number": -1, "writers": {}, "holds": {}, "schema": None}
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.root}/versions/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, head: dict, number: int, folder: str, holds: dict, schema: T.StructType, writer: str, batch: int) -> None:
        new = {
            "number": number,
            "folder": folder,
            "writers": head["writers"] | {writer: max(batch, head["writers"].get(writer, -1))},
            "holds": holds,
            "schema": json.loads(schema.json()),
            "load": {"writer": writer, "batch": batch},
        }
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        draft = self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        target = self._path(f"{self.root}/versions/{number:012d}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)  # never over an existing file
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise LoadConflict(f"load {number} of {self.root} was taken by another writer") from error
            raise

    def done(self, writer: str, batch: int) -> bool:
        """Whether the writer's batch, or a later one of its, is part of the table. Batches of a writer come in order."""
        return self.version()["writers"].get(writer, -1) >= batch

    # ------------------------------------------------------------ reading

    def read(self, number: int | None = None, partitions: Sequence | None = None) -> DataFrame | None:
        """The rows of a version, or only of the named partitions; None before the first load.

        Only folders that the version names are listed, so partitions are pruned
        before any file is opened.
        """
        head = self.version(number)
        if head["schema"] is None:
            return None
        return self._rows(head, None if partitions is None else {str(p) for p in partitions})

    def _rows(self, head: dict, wanted: set[str] | None) -> DataFrame:
        schema = T.StructType.fromJson(head["schema"])
        chosen = {p: loads for p, loads in head["holds"].items() if wanted is None or p in wanted}
        folders = [f"{self.root}/data/{folder}/{self.partition}={p}" for p, named in chosen.items() for folder in named]
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([f for f in schema if f.name != "load"])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/data").parquet(*folders)
        return rows.withColumn("load", F.shiftright("ordinal", 40)).select(*schema.names)

    def loads(self) -> list[dict]:
        """The load log: number, writer, batch and the partitions read from the load, in order of loads."""
        out = []
        for n in self._versions():
            v = self.version(n)
            out.append({"load": n, **v["load"], "partitions": sorted(p for p, named in v["holds"].items() if v["folder"] in named)})
        return out

    # ------------------------------------------------------------ writing

    def _write(self, head: dict, rows: DataFrame, number: int) -> tuple[str, list[str], T.StructType]:
        """Write ``rows`` (with load and ordinal) into a new folder; its name, its partitions and the table's schema."""
        schema = T.StructType([f for f in rows.schema if f.name not in (self.partition, "load")])
        schema = schema.add("load", "long").add(self.partition, rows.schema[self.partition].dataType)
        known = head["schema"] and T.StructType.fromJson(head["schema"])
        if known and {(f.name, f.dataType) for f in known} != {(f.name, f.dataType) for f in schema}:
            raise ValueError(f"columns differ from the table's: {sorted(set(known.names) ^ set(schema.names))}")
        folder = f"written={number:012d}-{uuid.uuid4().hex}"  # a try that is cut short leaves a folder that no version names
        path = f"{self.root}/data/{folder}"
        body = rows.drop("load").repartitionByRange(self.partition, "ordinal").sortWithinPartitions(self.partition, "ordinal")
        body.write.partitionBy(self.partition).parquet(path)
        names = []
        for s in self._fs.listStatus(self._path(path)):
            name = s.getPath().getName()
            if name.startswith(f"{self.partition}="):
                names.append(name.split("=", 1)[1])
        return folder, names, known or schema

    def _positioned(self, rows: DataFrame, order: Sequence[str], number: int) -> DataFrame:
        placed = with_places(rows, order, "_place").withColumn("load", F.lit(number).cast("long"))
        return placed.withColumn("ordinal", F.col("load") * PLACES + F.col("_place")).drop("_place")

    def append(
        self, rows: DataFrame, writer: str, batch: int, order: Sequence[str], select: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None
    ) -> int | None:
        """Add ``rows`` as a load; its number, or None if the writer's batch is there already or adds nothing.

        ``order`` names the columns that place rows within the load. ``select``
        is given the placed rows and the stored rows of their partitions (None
        if there are none) and returns the rows to store.
        """
        head = self.version()
        if head["writers"].get(writer, -1) >= batch:
            return None
        number = head["number"] + 1
        placed = cut_lineage(self._positioned(rows.drop("load", "ordinal"), order, number), "load")
        if select is not None:
            placed = cut_lineage(select(placed, self._touched(head, placed)), "load")
        folder, names, schema = self._write(head, placed, number)
        holds = head["holds"] | {p: [*head["holds"].get(p, []), folder] for p in names}
        self._commit(head, number, folder, holds, schema, writer, batch)
        return number if names else None

    def _touched(self, head: dict, placed: DataFrame) -> DataFrame | None:
        if head["schema"] is None:
            return None
        wanted = {str(r[0]) for r in placed.select(self.partition).distinct().collect()}  # partitions of one load
        return self._rows(head, wanted)

    def append_new(self, rows: DataFrame, writer: str, batch: int, order: Sequence[str], dedupe_batch: bool = True) -> int | None:
        """Add the rows whose (date, item) is not stored yet; repeats within the load are one row if ``dedupe_batch``."""

        def fresh(placed: DataFrame, stored: DataFrame | None) -> DataFrame:
            if stored is None:
                return first_row_distinct(placed) if dedupe_batch else placed
            return new_rows(placed, stored, dedupe_batch=dedupe_batch)

        return self.append(rows, writer, batch, order, fresh)

    def merge(
        self, rows: DataFrame, writer: str, batch: int, order: Sequence[str], keys: Sequence[str], priority: Callable[[], F.Column] | None = None
    ) -> int | None:
        """Put the best row per key in place of the stored ones; whole touched partitions become part of this load's version.

        The best row has the largest ``priority()``, then the latest load and
        place. Kept rows keep the load and ordinal they came with.
        """
        head = self.version()
        if head["writers"].get(writer, -1) >= batch:
            return None
        number = head["number"] + 1
        placed = cut_lineage(self._positioned(rows.drop("load", "ordinal"), order, number), "load")
        stored = self._touched(head, placed)
        every = placed if stored is None else stored.unionByName(placed)
        rank = [priority().alias("p")] if priority else []
        best = latest_by(every, keys, F.struct(*rank, F.col("ordinal").alias("o")))
        # the load a row came with is in its ordinal; merged rows lie in this load's folder
        folder, names, schema = self._write(head, cut_lineage(best, "merged"), number)
        self._commit(head, number, folder, head["holds"] | {p: [folder] for p in names}, schema, writer, batch)
        return number if names else None
