"""What the corpus operators share: reading tables, cutting lineage, and word hashing on byte buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



BATCH_BYTES = 4 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another system's library
    _LIBC = None


def in_small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most BATCH_BYTES, whatever the number of rows (a longer text alone)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    in_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a table written in the shared checkpoint folder, so that lost executors cost no recomputation.

    Parquet, being compressed, takes a fraction of checkpoint()'s disk. The folder is the one of the session's
    spark.checkpoint.dir; one of this machine only where none is set and the master is local. What the plan of df
    has shuffled is of no more use, unless df is kept: the driver is told to collect its garbage, upon which Spark
    deletes such files.
    """
    spark = df.sparkSession
    in_small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    sc._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    for made in _SINCE:
        made.append(out)
    return out


_SINCE: list[list[DataFrame]] = []


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()), after which all other tables that cut() has written meanwhile are deleted."""
    _SINCE.append([])
    try:
        out = cut(make())
        release(*(df for df in _SINCE[-1] if df is not out))
    finally:
        _SINCE.pop()
    return out


def release(*tables: DataFrame) -> None:
    """Deletes those of the tables that cut() wrote; nothing will read them any more."""
    for df in tables:
        if not hasattr(df, "cut_path"):
            continue
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, taken: list[str]) -> str:
    """The name, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, name: str, most_rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are at most most_rows; else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if df.count() <= most_rows else df


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a longer text is a batch of its own).

    After the last one, memory that the worker holds but doesn't use goes back to the system: workers are used again.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def blas(what: str) -> list[Callable]:
    """get_num_threads or set_num_threads of each OpenBLAS that this process has loaded."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split(maxsplit=5)[5].strip() for line in f if "openblas" in line}
    except OSError:  # another system
        return []
    libs = [ctypes.CDLL(p) for p in sorted(paths)]
    names = [f"{a}openblas_{what}{b}" for a in ("", "scipy_") for b in ("", "64_")]
    return [getattr(lib, n) for lib in libs for n in names if hasattr(lib, n)]


def one_thread() -> None:
    """Products of matrices use the task's own thread only: Spark lets each worker take as many as the executor has
    cores, which on small matrices mostly wait for each other, spinning."""
    for put in blas("set_num_threads"):
        put(1)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and the n+1 offsets of the texts; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    """ASCII white space: space and \\t \\n \\v \\f \\r. Words are what lies between."""
    return (data == 32) | (data - np.uint8(9) < 5)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z made small."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 offsets of the documents in the word list.

    Words end where a document ends.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = ~is_space(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][(offsets[1:] > 0)] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets).astype(np.int64)


def joined_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of data with one space after each, and the n+1 offsets of the words in it."""
    size = stops - starts + 1
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(at[-1], 32, dtype=np.uint8)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[1:] - 1] = False
    out[inside] = data[~is_space(data)]
    return out, at


def word_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of data among the distinct words, and these; words are compared as bytes."""
    packed = data[~is_space(data)]
    at = np.concatenate(([0], np.cumsum(stops - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """XXH3 of every word, worked out once for each distinct one."""
    ids, distinct = word_ids(data, starts, stops)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))[ids]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(32)
    return h


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1


class Rolling:
    """Hashes of spans of a sequence of 64-bit symbols from prefix sums of symbol * M**index, all modulo 2**64.

    M is odd, so that M has an inverse and equal spans get equal hashes wherever they stand. Unequal spans may be
    made to collide; so these hashes only ever choose candidates, and what is found is compared or hashed otherwise.
    """

    def __init__(self, seed: int):
        self.m = _odd(seed)
        self.inverse = pow(self.m, -1, 1 << 64)
        self.table = np.random.default_rng(seed + 1).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            both = np.empty((2, max(n, 1 << 12)), dtype=np.uint64)
            both[:, 0] = 1
            both[0, 1:], both[1, 1:] = self.m, self.inverse
            self.powers, self.inverses = np.cumprod(both, axis=1, dtype=np.uint64)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """n+1 prefix sums; bytes are looked up in a table of random values first."""
        x = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        self._grow(len(x) + 1)
        out = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * self.powers[: len(x)], out=out[1:])
        return out

    def every(self, prefix: np.ndarray, g: int) -> np.ndarray:
        """Hashes of all spans of g symbols."""
        n = len(prefix) - g
        return mix((prefix[g:] - prefix[:n]) * self.inverses[:n])

    def spans(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the spans [a, b)."""
        return mix((prefix[b] - prefix[a]) * self.inverses[a])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least value in each window of w values: by doubling, the least of 1, 2, 4, ... and then of w as two that overlap."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])
