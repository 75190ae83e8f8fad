"""Shared pieces of the training-data operators: tables, text keys, vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import find_package, shared_folder


#: Bytes of texts that go to a Python worker at once, but for a single longer text.
BATCH = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    find_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, so that a lost executor never makes an expensive stage run again, and lets later
    readers prune columns. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files that the table replaces
    hadoop_path, files = _folder(spark, path)
    files.deleteOnExit(hadoop_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        hadoop_path, files = _folder(table.sparkSession, table._folder)
        files.delete(hadoop_path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name.lower() in taken:
            name, k = f"_{stem}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_text(df: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with another text; n_chars, if there, is counted again. Other columns stay as they are."""
    (new,) = fresh(df, "new")
    df = df.withColumn(new, text)
    return df.select(*(F.col(new).alias(c) if c == "text" else F.length(F.coalesce(new, F.lit(""))).cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that together identify a text (null counts as empty)."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2")]


def trim() -> None:
    """Give freed memory back to the system: libraries keep what they had at their peak."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if release is not None:
        release(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise on uint64 (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _random_words(n: int, seed: int) -> np.ndarray:
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTES = _random_words(256, 11)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        tables = []
        for base in (_BASE, _INVERSE):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            tables.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _words(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text indexes of all words, and the prefix sums of the polynomial hash."""
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    change = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = change[0::2], change[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * _power_tables(len(data))[0][: len(data)], out=sums[1:])
    limits = np.cumsum([len(e) + 1 for e in encoded])
    return starts, ends, np.searchsorted(limits, starts, side="right"), sums


def _hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return splitmix((sums[ends] - sums[starts]) * _power_tables(1)[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the words' text indexes.

    A polynomial over the bytes with an odd base modulo 2**64: a prefix sum gives every word's hash
    at once, times the inverse power of where the word starts.
    """
    starts, ends, text, sums = _words([t.encode("utf-8", "surrogatepass") for t in texts])
    return _hashed(sums, starts, ends), text


def word_prefix_hashes(encoded: list[bytes], prefixes: tuple[int, ...]):
    """Hashes and text indexes of all words, then of the words' beginnings of each length in bytes that they exceed."""
    starts, ends, text, sums = _words(encoded)
    yield _hashed(sums, starts, ends), text
    for size in prefixes:
        own = ends - starts > size
        yield splitmix(_hashed(sums, starts[own], starts[own] + size)), text[own]


def by_size(texts, limit: int = 1 << 18):
    """Slices of a sequence of texts, each of about ``limit`` characters at most or of one text."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
