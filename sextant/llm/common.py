"""What the operators of this subpackage share: words, batches, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes to bytes: A-Z lower-cased, every other ASCII byte that is no digit or letter a space, all else kept.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text: runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def byte_words(texts: list[bytes], inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts in one array, what each starts at in the joined texts, the bytes of these, and where each text starts.

    A word is a longest run of bytes b of one text for which ``inside[b]``; a line feed, which must not be inside, joins the texts.
    """
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    mask = inside[joined]
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[mask])])
    return found, starts, joined, np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def text_of(column: pa.Array) -> list[str]:
    """The values of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task; one thing only."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def trimmed() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where its C library can."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20, uses: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a column of strings takes about ``size`` bytes in each; a longer row stands alone.

    What the worker has kept from tasks of other operators is let go first, unless it is what this task ``uses``.
    """
    if uses not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
    for batch in batches:
        values = batch.column(column)
        lengths = [0 if x is None else x for x in pc.binary_length(values).to_pylist()]
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: Bytes of an Arrow batch between Spark and its Python workers; both hold a few of them for each core.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches be cut at BATCH_BYTES rather than at 64 MB; a smaller setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, one of this machine, if all runs here."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def materialise(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast, about 32 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table already written, marked for a broadcast join if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with these values of doc_id, and the others, where they are few enough to broadcast; else all of them, and none.

    Only the first then need be shuffled to meet what is known of them.
    """
    ids = materialise(ids.distinct())
    if ids.count() > BROADCAST_ROWS:
        return docs, None
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select(*docs.columns), docs.join(F.broadcast(ids), "doc_id", "left_anti").select(*docs.columns)


def hash_share(rows: int, of: float) -> int:
    """How many of the 2**32 values of a hash to keep, so that of ``of`` rows ``rows`` are left almost surely, and few more."""
    return min(1 << 32, int((rows + 6 * rows**0.5 + 50) / max(1, of) * (1 << 32)))


_WORD_POWERS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[list[bytes]]) -> list[np.ndarray]:
    """A 64-bit number for each word of each text, the same for the same word everywhere."""
    return np.split(hashed_flat([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])[:-1])


def hashed_flat(flat: list[bytes]) -> np.ndarray:
    """hashed_words for one list of words."""
    h, index = hashed_coded(flat)
    return h[index]


def hashed_coded(flat: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the different words of a list, and which of them each word has."""
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return hashed_array(coded.dictionary), coded.indices.to_numpy()


def hashed_array(distinct: pa.Array) -> np.ndarray:
    """A 64-bit number for each value of an unsliced binary array of one value at least."""
    lengths = np.diff(np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1])
    buffer = np.frombuffer(distinct.buffers()[2], np.uint8)[: lengths.sum()].astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(buffer)) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(mixed(buffer + (place.astype(np.uint64) << np.uint64(9))) * _WORD_POWERS[place % 64], starts))


def components(edges: DataFrame) -> DataFrame:
    """The connected components of edges (a, b): each node once, with ``root``, the smallest node of its component.

    Alternating large and small stars: each round hangs a node's neighbours on the smallest of them, so the diameter halves, until
    every node hangs on its root. Minima are found by aggregation and joined back, so a node with very many neighbours is split.
    Each round is a written table; an empty table of edges has no components.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = tuple(state)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a < b").select("a", "b").distinct()
        edges = materialise(small)


def hubs(links: DataFrame) -> DataFrame:
    """Each node of links (a, b) as ``key`` with ``root``, itself or the one linked with it that has most links: nodes of one root are connected."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    ends = both.union(degree.select("a", F.col("a").alias("b"))).join(degree.withColumnRenamed("a", "b"), "b")
    return ends.groupBy(F.col("a").alias("key")).agg(F.max_by("b", F.struct("links", "b")).alias("root"))
