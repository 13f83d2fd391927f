"""Payloads of outside services as a Spark data source: read by key, from kept files or from a live client.

    spark.dataSource.register(PayloadSource)
    spark.read.format("payloads").option("path", folder).load().where(F.col("key").isin(dois))

Kept files are dealt into buckets by key, so a filter on keys opens the buckets of these keys only, and each task reads
one bucket. With ``client`` ("module:function", which gets keys and gives key -> JSON text) the keys of the filter are
asked for in batches of the service's size; ``tasks`` says how many batches are under way at once, 1 by default.
"""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from screenlake.sources.works import BATCH

SCHEMA = "key string, direction string, ref_index int, payload string"
_ARROW = pa.schema([("key", pa.string()), ("direction", pa.string()), ("ref_index", pa.int32()), ("payload", pa.string())])


def keep(payloads: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes (key, payload, and direction and ref_index where there are any) for ``PayloadSource``. A bucket is one
    file; a key that many rows share is in one bucket."""
    for c, kind in (("direction", "string"), ("ref_index", "int")):
        if c not in payloads.columns:
            payloads = payloads.withColumn(c, F.lit(None).cast(kind))
    rows = payloads.where("key is not null").select(*_ARROW.names).withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % buckets).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "key", "direction", "ref_index").write.partitionBy("bucket").mode("overwrite").parquet(path)
    rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{path}_layout")


@dataclass
class Part(InputPartition):
    """Files of one bucket and the keys wanted of them (None: all), or batches of keys to ask for."""

    files: tuple[str, ...] = ()
    keys: tuple[str, ...] | None = None
    batches: tuple[tuple[str, ...], ...] = ()


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.client, self.kind = options.get("path"), options.get("client"), options.get("kind", "")
        self.tasks, self.keys = int(options.get("tasks", "1")), None
        if not self.path and not self.client:
            raise ValueError("option path or client is needed")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on the key; Spark keeps the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> list[Part]:
        keys = None if self.keys is None else sorted(k for k in self.keys if k is not None)
        if self.client:
            if keys is None:
                raise ValueError("a live client is only asked for given keys: filter on key")
            size = BATCH.get(self.kind, 50)
            batches = [tuple(keys[i : i + size]) for i in range(0, len(keys), size)]
            return [Part(batches=tuple(batches[t :: self.tasks])) for t in range(min(self.tasks, len(batches)))]
        fs, root = _folder(self.path)
        files: dict[int, list[str]] = {}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if (m := re.search(r"/bucket=(\d+)/[^/._][^/]*\.parquet$", info.path)) and info.size:
                files.setdefault(int(m[1]), []).append(info.path)
        if keys is None:
            return [Part(tuple(sorted(files[b]))) for b in sorted(files)]
        layout, name = _folder(f"{self.path}_layout")
        text = b"".join(layout.open_input_stream(i.path).read() for i in layout.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".json"))
        buckets = int(re.search(rb'"buckets":(\d+)', text)[1])
        wanted: dict[int, list[str]] = {}
        for k in keys:
            wanted.setdefault(zlib.crc32(k.encode()) % buckets, []).append(k)
        return [Part(tuple(sorted(files[b])), tuple(wanted[b])) for b in sorted(wanted) if b in files]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.batches:
            module, name = self.client.split(":")
            ask = getattr(importlib.import_module(module), name)
            for batch in partition.batches:
                answers = ask(list(batch))
                found = [k for k in batch if answers.get(k) is not None]
                if found:
                    none = [None] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(none, pa.string()), pa.array(none, pa.int32()), pa.array([answers[k] for k in found], pa.string())], schema=_ARROW)
            return
        fs, _ = _folder(self.path)
        wanted = None if partition.keys is None else pa.array(partition.keys, pa.string())
        for name in partition.files:
            with fs.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(columns=_ARROW.names):
                    if wanted is not None:
                        b = b.filter(pa.compute.is_in(b.column("key"), wanted))
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(c).cast(_ARROW.field(c).type) for c in _ARROW.names], schema=_ARROW)


class PayloadSource(DataSource):
    """Format ``payloads``; options path, client, kind, tasks."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))


def read(spark, path: str | None = None, keys: Iterable[str] | None = None, **options) -> DataFrame:
    """(key, direction, ref_index, payload) of kept files or a client, of ``keys`` only where they are given."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    found = spark.read.format("payloads").options(**({"path": path} if path else {}) | {k: str(v) for k, v in options.items()}).load()
    return found if keys is None else found.where(F.col("key").isin(*keys))
