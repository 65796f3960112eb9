"""What the corpus operators share: reading tables and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; the setting is made only where it is unset, in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="paddock-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Scratch tables go when the driver ends; a session that has stopped leaves them to the folder's owner."""
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it starts there, also after executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table with a column of row numbers, and the column's name: ids may be null or repeated, these are not."""
    column = "_row"
    while column in [c.lower() for c in df.columns]:
        column = f"_{column}"
    return written(df.withColumn(column, F.monotonically_increasing_id()), name, compression="zstd"), column


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay as they are."""
    return F.translate(text, UPPER, LOWER)


#: What a Python task holds as objects at a time, in bytes of text; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of the column."""
    for batch in batches:
        texts = batch.column(batch.schema.names.index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if texts.nbytes > limit else []
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


class Memo(dict):
    """Results of a pure function: those of the last ``limit`` to twice as many keys met; keys of over 64 letters are not kept."""

    def __init__(self, make: Callable[[Any], Any], limit: int):
        self.make, self.limit, self.before = make, limit, {}

    def __missing__(self, key: Any) -> Any:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if (len(key) if isinstance(key, str) else sum(map(len, key))) <= 64:
            self.put(key, value)
        return value

    def put(self, key: Any, value: Any) -> None:
        self.put_all({key: value})

    def put_all(self, results: dict[Any, Any]) -> None:
        if self and len(self) + len(results) > self.limit:
            self.before = dict(self)
            self.clear()
        self.update(results)


_HELD: dict[object, Any] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """An object that a worker process keeps between batches and tasks: the one that was asked for last, no other."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]
