"""Shared helpers: where intermediate tables go, and how text batches become words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null doc_id where a key is needed; sorts first, as nulls do in Spark.
NULL_ID = -(2**63)


# --------------------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local master may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives lost executors. codec: of its files, if not the session's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._rill_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for t in tables:
        if path := getattr(t, "_rill_path", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def apart(docs: DataFrame, needed: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs) with the columns of docs. While f runs, columns that it does not need have names that no operator uses, so none can clash."""
    names = {c: c if c in needed else f"other {i}" for i, c in enumerate(docs.columns)}
    out = f(docs.toDF(*names.values()))
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --------------------------------------------------------------------------- text batches


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True for the bytes of the given inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Bytes that separate words of the pattern [^\x20\x09-\x0D]+.
SPACE = table_of((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, joined, and len + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and len + 1 offsets of each document's words. Words never cross documents."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def coded(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words. Words are apart by a byte at least, or at a document's border."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    d = words_array(data, starts, stops).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words_array(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    lengths = stops - starts
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    take = np.repeat((starts - off[:-1]).astype(np.int32), lengths)
    take += np.arange(off[-1], dtype=np.int32)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[take]))])


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


#: Longer words are hashed one by one.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes of all words at a time."""
    n = stops - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    masks = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
    out = mixed(n.astype(np.uint64), 7)
    live = np.arange(len(n))
    for k in range(0, LONG_WORD, 8):
        live = live[n[live] > k]
        if not len(live):
            return out
        out[live] = mixed(out[live] ^ (lanes[starts[live] + k] & masks[np.minimum(n[live] - k, 8)]))
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[int(starts[i]) : int(stops[i])])
    return out


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser); other seeds give other orders."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def windows_hash(items: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of length items, by doubling: few vector passes, whatever the length."""
    n = len(items) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, out, done = mixed(items, seed), 1, None, 0
        while True:
            if length & size:
                part = power[done : done + n]
                out = part.copy() if out is None else mixed(out * U64(0x9FB21C651E98DF25) + part, size)
                done += size
            if size * 2 > length:
                return out
            power = mixed(power[:-size] * U64(0xD6E8FEB86659FD93) + power[size:], size)
            size *= 2


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of rows: each row's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - start[group]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_batches(batches, limit: int = 4 << 20):
    """Record batches joined or split to about limit bytes each, so that vector passes stay within memory."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        n = max(1, -(-b.nbytes // limit))
        step = max(1, b.num_rows // n)
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            held.append(part)
            size += b.nbytes * part.num_rows // b.num_rows
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = None
    pa.default_memory_pool().release_unused()  # an idle worker keeps nothing
    trimmed()


def trimmed() -> None:
    """Gives freed memory back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def reusing() -> None:
    """Lets the C library keep freed arrays for the next ones, where it can: fresh memory costs a page fault for each 4 KB. trimmed() still gives it back."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-1, 64 << 20)  # M_TRIM_THRESHOLD
        option(-3, 32 << 20)  # M_MMAP_THRESHOLD


def frugal(run: Callable) -> Callable:
    """run, a function of batches, whose worker gives memory back when it has ended and its arrays are gone, so that idle workers keep little."""

    def ended(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trimmed()

    return ended


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "2m") -> None:
    """Lowers the rows and bytes of an Arrow batch, so that batches of whole texts stay within the memory of a worker and of the executor beside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def most_frequent(counts: DataFrame, key: str, n: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent keys, at most so many, ties at the limit left out. counts should be a written table: a histogram of the counts gives the least count first,
    so that no task sends more than its part of the result."""
    total, least = 0, None
    for value, keys in sorted(counts.groupBy(n).agg(F.count("*")).where(F.col(n) > 0).collect(), reverse=True):  # as many rows as distinct counts
        total += keys
        if total > most:
            break
        least = value
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col(n) >= least).select(key, n).toPandas()
    return rows[key].to_numpy(np.int64), rows[n].to_numpy(np.int64)
