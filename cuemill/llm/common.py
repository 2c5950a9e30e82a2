"""What the corpus operators share: reading, batching, hashing and cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.session import bounded_batches  # noqa: F401  for the operators

#: Bytes of text that one step of a Python worker handles; bounds its memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 18
#: Bytes of its input for which a table gets a partition, where it is small.
PARTITION_BYTES = 16 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the operator of a cluster sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def useful_partitions(df: DataFrame) -> int:
    """Partitions that a table of df's size is worth: PARTITION_BYTES each, by the size of its files, and two for each core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1_000_000, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES)))


def cut_lineage(df: DataFrame, most: int | None = None) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir; only a single local JVM gets a folder of its own where none is set.

    most: partitions that the table is worth; more are merged, so that a small table isn't written as a crowd of tiny files. Its joins
    broadcast by sizes measured at run time: estimates, which take every binary for 100 bytes, decide none.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cuemill-"))
    conf, estimated, measured = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = conf.get(estimated), conf.get(measured, None)
    conf.set(measured, before[1] or before[0])
    conf.set(estimated, "-1")
    try:
        return (df if most is None else df.coalesce(most)).checkpoint()  # eager: planned and run within these settings
    finally:
        conf.set(estimated, before[0])
        conf.unset(measured) if before[1] is None else conf.set(measured, before[1])


def release() -> None:
    """Hands memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def released(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 16) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, a pass over Arrow batches, as one that releases memory as it goes: workers live on after a stage."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, out in enumerate(work(batches), 1):
            yield out
            out = None
            if k % every == 0:
                release()
        release()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece hold about `limit` bytes; a longer text stands alone, whole."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def crc_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit words over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_weights(seed: int = 11) -> np.ndarray:
    """A random odd 64-bit weight for every byte value."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


#: Spaces between words, as the contracts give them: x20 and x09 to x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = byte_weights(12)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _cuts(data: np.ndarray, offsets: np.ndarray, limit: int) -> list[int]:
    """Places, some `limit` bytes apart, at which no word is cut."""
    cuts, n = [0], len(data)
    while n - cuts[-1] > 2 * limit:
        at = cuts[-1] + limit
        row = offsets[np.searchsorted(offsets, at)]
        step = 0
        while at < row and step < 64:  # a blank within so many strides, else the row's end
            found = np.flatnonzero(BLANK[data[at : min(at + 4096, row)]])
            if len(found):
                row = at + found[0]
            at, step = at + 4096, step + 1
        if row >= n:
            break
        cuts.append(int(row))
    return [*cuts, n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased (A-Z) texts, each word's start and length, and the n + 1 offsets of each row's words.

    Long data is read in pieces, so that only what is kept for each word grows with it.
    """
    cuts = _cuts(data, offsets, limit)
    if len(cuts) == 2:
        return _word_hashes(data, offsets)
    found = []
    for a, b in zip(cuts, cuts[1:]):
        inner = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a
        h, starts, lengths, _ = _word_hashes(data[a:b], np.concatenate(([0], inner, [b - a])))
        found.append((h, starts + a, lengths))
    hashes, starts, lengths = (np.concatenate([f[j] for f in found]) for j in range(3))
    return hashes, starts, lengths, np.searchsorted(starts, offsets)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    inner = ~BLANK[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inner[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    # the next start or row end, less the blanks before it
    count = np.concatenate(([0], np.cumsum(inner)))
    stops = np.append(starts[1:], len(data))
    lengths = count[stops] - count[starts]
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max()), _BASE))))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))[: len(data)] if starts[0] == 0 else None
    if place is None:
        place = np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, stops - starts)))
    values = np.where(inner, _WORD[data] * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    hashes = mix64(np.add.reduceat(values, starts) + lengths.astype(np.uint64))
    return hashes, starts, lengths, np.searchsorted(starts, offsets)
