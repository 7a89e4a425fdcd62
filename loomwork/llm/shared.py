"""What several operators share: scratch tables, Arrow batches, word spans, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls 0x09 to 0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: UTF-8 bytes that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a local folder; on a
    cluster there is none that all could read, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[.*\])?$", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset: with master {master!r} it must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "loomwork-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows and bytes of a batch that goes to a Python worker: both sides hold it, for every task.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has them smaller."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def _give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside the next ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


#: Drops the shuffle files of a query when it ends; without this they stay until the driver's collector comes by.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def _root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/loomwork-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the tables that ``stored`` wrote since ``scratch`` was entered.
_written: ContextVar[list[str] | None] = ContextVar("loomwork-written", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage without keeping blocks on executors: a lost executor
    costs nothing that was written. The shuffle files of the write go when it
    ends; the table lives until ``discard``, the end of ``scratch`` or
    ``clear_stored``.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _written.get() is not None:
        _written.get().append(path)
    with _cleaned(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and nothing will read again; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_loomwork_path", None)
        if path is not None:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete on leaving what ``stored`` wrote since entering, but for the tables put into the yielded list."""
    own, kept = [], []
    token = _written.set(own)
    try:
        yield kept
    finally:
        _written.reset(token)
        stay = {df._loomwork_path for df in kept}
        for path in own:
            if path not in stay:
                _delete(spark, path)
        if _written.get() is not None:
            _written.get().extend(stay)


def clear_stored(spark: SparkSession) -> None:
    """Delete every table that ``stored`` wrote in this application."""
    _delete(spark, _root(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    held = held[offsets[0] : offsets[-1]]
    return held, offsets - offsets[0]


def in_steps(batches, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``step`` bytes."""
    for batch in batches:
        _, offsets = text_buffers(batch.column(column))
        first, rows = 0, batch.num_rows
        while first < rows:
            last = int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1
            last = min(max(last, first + 1), rows)
            yield batch.slice(first, last - first)
            first = last
    _give_back()


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every row the number of words before it.

    A word is a longest run of bytes other than separators inside one row, which
    for UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over characters.
    """
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SEPARATOR[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = word[0], False
    np.greater(word[1:], word[:-1], out=first[1:-1])
    last = np.empty(len(data) + 1, bool)
    last[0], last[-1] = False, word[-1]
    np.less(word[1:], word[:-1], out=last[1:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[word[cuts] & word[cuts - 1]]
    first[both] = last[both] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def content_key(*columns: str):
    """Two 64-bit hashes that tell rows apart by some columns, nulls included; the same on every run."""
    known = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*known), F.xxhash64(F.lit(1), *known)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components: ``(vertex long, root long)`` for every vertex of ``edges(a, b)``.

    Each round hangs every vertex below its smallest neighbour, follows that
    link twice, and contracts the edges; the number of edges falls by more than
    half in a round on all but adversarial inputs. Every round is written to
    the shared folder, minima are taken with partial aggregation, and nothing
    but the edge count reaches the driver. ``root`` is the smallest vertex.
    """
    with scratch(edges.sparkSession) as kept:
        kept.append(_hung(edges, name))
    return kept[0]


def _hung(edges: DataFrame, name: str) -> DataFrame:
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    hung: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("vertex"), F.least("a", "p").alias("parent"))
        parent = stored(parent, f"{name}-parent")
        for _ in range(2):
            up = parent.select(F.col("vertex").alias("parent"), F.col("parent").alias("grand"))
            parent = parent.join(up, "parent").select("vertex", F.col("grand").alias("parent"))
        parent = stored(parent, f"{name}-parent")
        hung.append(parent)
        left = parent.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        before, edges = edges, stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges")
        discard(before)
    if not hung:
        return stored(edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")), f"{name}-roots")
    # Compose from the last round back: a vertex's root is its parent's root, if the parent moved on.
    found = hung[-1].select("vertex", F.col("parent").alias("root"))
    for parent in reversed(hung[:-1]):
        later = found.select(F.col("vertex").alias("parent"), F.col("root").alias("later"))
        found = parent.join(later, "parent", "left").select("vertex", F.coalesce("later", "parent").alias("root"))
    return stored(found, f"{name}-roots")
