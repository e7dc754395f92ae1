"""What the corpus operators share: shared storage, Arrow block maps, word hashing.

Every operator takes DataFrames and returns a DataFrame.  Python code runs only
inside ``mapInArrow`` / ``applyInPandas`` over bounded blocks; nothing that grows
with the corpus is collected or broadcast without a checked bound.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Characters of text that a block of documents holds before it is worked off.
BLOCK_CHARS = 2_000_000
#: Entries a worker's word cache may hold before it is emptied.
CACHE_WORDS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where none is set (tests)."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="nullweave-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/nullweave/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _OPEN:
        _OPEN[-1].append(hadoop)
    return path


#: Tables of the `settled` results being made just now, innermost last.
_OPEN: list[list] = []


def settled(spark: SparkSession, name: str, make) -> DataFrame:
    """The result of make() as a table; the tables that it took to make it go at once."""
    path = new_table(spark, name)
    _OPEN.append([])
    try:
        df = make()
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        for table in _OPEN.pop():
            table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)
        trim()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` once to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the eager steps within go when their step ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows in an Arrow batch, for the eager steps within: rows that carry whole sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so extra or clashing ones do no harm."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches, text: str = "text", chars: int = BLOCK_CHARS):
    """Slices Arrow batches so that each slice holds about `chars` bytes of text at most (or one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        cut = np.cumsum(size.to_numpy(zero_copy_only=False)) // chars
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def trim() -> None:
    """Gives the memory that a task has freed back to the system: workers live on between tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A mapInArrow function that trims its worker when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


class Cache(dict):
    """A dict that computes what is missing; emptied (by `trim`) when it has grown too large."""

    def __init__(self, compute, limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self):
        if len(self) > self.limit:
            self.clear()


def hash_words() -> Cache:
    return Cache(xxhash.xxh64_intdigest)


def ascii_words(text: str | None, lower: bool) -> list[bytes]:
    """Runs of anything but space and \\t..\\r, as UTF-8 bytes; only A-Z are lower-cased if asked."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def windows(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """64-bit hashes of every run of k word hashes (empty if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m = multipliers(k, seed + k)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * m[j]
    return mix(out)


SAFE = re.compile(r"\W+")


def crc_mod(column: str, n: int):
    """crc32 of the decimal text of an id, modulo n (null where the id is null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
