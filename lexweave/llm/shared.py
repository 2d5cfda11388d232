"""What the operators of this package share: scratch tables, word hashing, connected components.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) after lower-casing A-Z. A word's
hash is 64 bits wide, so two different words of a corpus meet in one hash with a chance of about
n^2 / 2^65 for n different words.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that one round of array work takes: its 64-bit arrays stay near 8 MB each.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- scratch tables
_roots: dict[tuple[str, str], str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share (spark.checkpoint.dir), as a URI.

    It goes when the driver ends. A local session that sets no folder gets one under /tmp/checkpoints.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/checkpoints"
    key = root, context.applicationId
    if key not in _roots:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/lexweave-{context.applicationId}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        uri = files.makeQualified(path).toString()
        _roots[key] = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return _roots[key]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a file of a table of short rows, if it is known how many it has at most.
FILE_ROWS = 100_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation.

    rows: how many short rows df has at most. They are written to as few files as hold them, however many partitions the
    session's shuffles have, by as many tasks."""
    path = scratch_path(df.sparkSession, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df._scratch)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished writes; it learns of them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_heap(spark: SparkSession) -> None:
    """Lets executors collect garbage before a step that needs their memory for Python: a heap that a step has grown to its limit
    by short-lived rows goes back to the system, which JVM and workers share. One small task per core; it changes no result."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 2 * cores, 1, 2 * cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system; an idle worker's memory counts against its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows of an Arrow batch, as documents can be long; a smaller setting stays.

    For results that run after their function has returned: Spark reads the setting when they run, so it stays with the session."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def limited_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """The same bound for what runs inside; the session's setting comes back."""
    before = spark.conf.get(_BATCH)
    limit_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


# ---------------------------------------------------------------- words as arrays
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=U64) | U64(1)
_PRIME, _UNPRIME = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of an odd number and of its inverse; tables beyond three chunks aren't kept."""
    tables = _powers
    if len(tables[0]) < n:
        tables = []
        with np.errstate(over="ignore"):
            for base in (_PRIME, _UNPRIME):
                steps = np.full(n, base, U64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        if n <= 3 * CHUNK_BYTES:
            _powers[:] = tables
    return tables[0], tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about `size` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about two chunks that begin at white space, so that no word is cut."""
    i, n = 0, len(raw)
    while i < n:
        j = i + 2 * CHUNK_BYTES
        while j < n:
            gap = np.flatnonzero(_SPACE[raw[j : j + 4096]])
            if len(gap):
                j += int(gap[0])
                break
            j += 4096
        yield i, min(j, n)
        i = min(j, n)


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document in order, and where each document's words begin (one more entry than documents).

    Long input is taken in blocks, so arrays of bytes' hashes stay small however long a text is."""
    hashes, starts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    for i, j in _blocks(raw):
        h, s = _hash_block(raw[i:j], edge[i : j + 1])
        hashes.append(h)
        starts.append(s + i)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _hash_block(raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a run of bytes; edge: where documents begin or end."""
    n = len(raw)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[_LOWER[raw]] * up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64)), starts


# ---------------------------------------------------------------- connected components
def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node in links(a long, b long): root is the smallest node that links reach.

    Each round gives a node the smallest root of its neighbourhood and then lets roots jump to their own
    roots, so rounds grow with the logarithm of the longest chain. Rounds are written tables; nothing but
    a count comes to the driver. Minimum aggregates combine before the shuffle, so a node with very many
    links is no hot task. An empty input gives an empty result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = materialize(both.distinct(), f"{tag}-edges", 2 * links.count())
    rows = edges.count()
    state = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{tag}-0", rows)
    step = 0
    while True:
        step += 1
        near = edges.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # a root that sees a smaller root through any of its members hears of it, too
        low = state.join(near, "node").select("node", "root", F.least("root", "near").alias("near"))
        told = low.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("told"))
        hooked = low.join(told, "node", "left").select("node", F.col("root").alias("was"), F.least("near", F.coalesce("told", "near")).alias("mid"))
        jump = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = materialize(hooked.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), F.col("was")), f"{tag}-{step}", rows)
        changed = new.where("root <> was").limit(1).count()
        discard(state)
        scratch, state = new._scratch, new.select("node", "root")
        state._scratch = scratch
        if not changed:
            discard(edges)
            return state
