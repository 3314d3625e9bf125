"""Python data sources: JSON documents with a commit of their own, and gzip CSV months that are pruned by filters.

Paths are local, ``file:``, ``hdfs:`` or object-store URIs that pyarrow opens;
every executor must reach them.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pa_csv
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from marketclime.operators.quality import with_order_ok
from marketclime.sources.prices import OBSERVATION_FIELDS, coerce_prices


def opened(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and the path within it."""
    if re.match("file:/+", path):
        return pa_fs.LocalFileSystem(), "/" + re.sub("^file:/+", "", path)
    return pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path)


def _names(fs: pa_fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in fs.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True)) if f.type == pa_fs.FileType.File)


def _read_json(fs: pa_fs.FileSystem, path: str):
    with fs.open_input_stream(path) as stream:
        return json.loads(stream.read())


def _write(fs: pa_fs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as stream:
        stream.write(data)


# ---------------------------------------------------------------- documents


@dataclass
class Written(WriterCommitMessage):
    """A task's list of documents; the list itself stays in a file."""

    index: str
    documents: int


@dataclass
class IndexFile(InputPartition):
    path: str


class DocumentSource(DataSource):
    """One JSON file per key below ``path``; a write takes effect as a whole.

    ``data/<write>/<task>/<key>.json`` and, beside them, an index file per task;
    ``versions/<number>.json`` names the index files of a write. A reader
    follows the last version, so it sees the documents of one write, and those
    of the writes before stay until then and after. A task that is repeated
    writes into a folder of its own; what no version names is never read.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "key string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("documents are written as a whole: use mode overwrite")
        if schema.names != ["key", "document"]:
            raise ValueError("documents have the columns key and document")
        return DocumentWriter(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options["path"])


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.path)
        folder = f"{root}/data/{self.run}/{uuid.uuid4().hex}"
        fs.create_dir(folder)
        listed: dict[str, str] = {}
        for row in iterator:
            key, document = row
            if key is None or document is None:
                raise ValueError("a document needs a key and a text")
            if key in listed:
                raise ValueError(f"two documents of the key {key!r}")
            listed[key] = f"{folder}/{urllib.parse.quote(key, safe='')}.json"
            _write(fs, listed[key], document.encode())
        index = f"{folder}/index.list"
        _write(fs, index, json.dumps({k: p[len(root) + 1 :] for k, p in listed.items()}).encode())
        return Written(index[len(root) + 1 :], len(listed))

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/versions")
        number = len(_names(fs, f"{root}/versions"))
        draft = f"{root}/data/{self.run}/version.draft"
        fs.create_dir(f"{root}/data/{self.run}")
        version = {"indexes": [m.index for m in messages if m and m.documents], "documents": sum(m.documents for m in messages if m)}
        _write(fs, draft, json.dumps(version).encode())
        fs.move(draft, f"{root}/versions/{number:012d}.json")

    def abort(self, messages: list) -> None:
        """Nothing to undo: no version names what was written."""


class DocumentReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("key",):
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = opened(self.path)
        versions = _names(fs, f"{root}/versions")
        return [IndexFile(p) for p in _read_json(fs, versions[-1])["indexes"]] if versions else []

    def read(self, partition: IndexFile) -> Iterator[tuple]:
        if partition is None:
            return
        fs, root = opened(self.path)
        for key, path in _read_json(fs, f"{root}/{partition.path}").items():
            if self.keys is None or key in self.keys:
                with fs.open_input_stream(f"{root}/{path}") as stream:
                    yield key, stream.read().decode()


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DocumentSource, MonthSource):
        spark.dataSource.register(source)
    return spark


def write_documents(documents: DataFrame, path: str) -> None:
    """Write ``documents`` (key, document) as one file each, all or nothing; documents written there before are no longer read.

    A key that comes twice, or a null key or document, fails the write and
    leaves the old documents in place. Rows of a key meet in one task, so that
    repeats are seen.
    """
    _registered(documents.sparkSession)
    dealt = documents.select(F.col("key").cast("string"), F.col("document").cast("string")).repartition("key")
    dealt.write.format("documents").mode("overwrite").save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """key and document of the last write; filters on single keys open their files only."""
    return _registered(spark).read.format("documents").load(path)


# ---------------------------------------------------------------- months


@dataclass
class MonthFile(InputPartition):
    path: str
    month: str
    number: int


_MONTH = re.compile(r"(?:month=(\d{4}-\d{2})/[^/]*|(\d{4}-\d{2})[^/]*)\.csv(\.gz)?$")
MONTH_SCHEMA = ", ".join(f"{c} string" for c in OBSERVATION_FIELDS) + ", month string, file long, row long, path string"


class MonthSource(DataSource):
    """CSV months, gzip or plain, named by year and month (``2020-01.csv.gz`` or ``month=2020-01/*.csv.gz``); one task for each file.

    Columns are text as published; ``file`` and ``row`` give the place of a row
    over all files, in path order. Filters on ``month`` leave files unopened.
    """

    @classmethod
    def name(cls) -> str:
        return "price_months"

    def schema(self) -> str:
        return MONTH_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MonthReader(self.options["path"], schema)


_TESTS = {
    EqualTo: lambda month, value: month == value,
    In: lambda month, value: month in value,
    GreaterThan: lambda month, value: month > value,
    GreaterThanOrEqual: lambda month, value: month >= value,
    LessThan: lambda month, value: month < value,
    LessThanOrEqual: lambda month, value: month <= value,
}


class MonthReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("month",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = opened(self.path)
        files = sorted(f.path for f in fs.get_file_info(pa_fs.FileSelector(root, recursive=True)) if f.type == pa_fs.FileType.File)
        months = [(p, m[1] or m[2]) for p in files if (m := _MONTH.search(p))]
        return [MonthFile(p, m, i) for i, (p, m) in enumerate(months) if all(_TESTS[t](m, v) for t, v in self.tests)]

    def read(self, partition: MonthFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = opened(self.path)
        convert = pa_csv.ConvertOptions(
            column_types={c: pa.string() for c in OBSERVATION_FIELDS}, include_columns=list(OBSERVATION_FIELDS),
            include_missing_columns=True, strings_can_be_null=True, null_values=[""],
        )
        first = 0
        with fs.open_input_stream(partition.path, compression="gzip" if partition.path.endswith(".gz") else None) as stream:
            try:
                reader = pa_csv.open_csv(stream, convert_options=convert, parse_options=pa_csv.ParseOptions(newlines_in_values=True))
            except pa.ArrowInvalid as error:
                if "Empty CSV" in str(error):
                    return
                raise
            for batch in reader:
                n = batch.num_rows
                place = [pa.array([partition.month] * n, pa.string()), pa.array([partition.number] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())]
                columns = [*(batch.column(c).cast(pa.string()) for c in OBSERVATION_FIELDS), *place, pa.array([partition.path] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*OBSERVATION_FIELDS, "month", "file", "row", "path"])
                first += n


FILE_ROWS = 1 << 40  # room for row positions within one file


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """All month files below ``path``, typed, with ``order_ok``, ``month`` and an ordinal that follows path and row.

    A filter on ``month`` (comparison or list of values) opens only the months it names.
    """
    text = _registered(spark).read.format("price_months").load(path)
    ordinal = (F.col("file") * FILE_ROWS + F.col("row")).alias("ordinal")
    return with_order_ok(coerce_prices(text.select(*OBSERVATION_FIELDS, "month", ordinal)))
