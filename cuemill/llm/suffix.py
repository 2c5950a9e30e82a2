"""Repeated-substring removal by merging shard Burrows-Wheeler transforms.

A byte-level merge needs one refinement of the interleave for each byte of common prefix, some 400 passes over the corpus. Here the
merged strings are made of larger symbols instead:

1. Anchors. Every string of `length` bytes has one canonical k-gram, that of the smallest hash (the leftmost of equal ones), a function
   of the string alone. Equal strings so share their anchor and their offset from it, and only suffixes at anchors need to be ordered.
2. Shard transforms. The context of an anchor, all windows of `length` bytes that it stands for, is a string of `SYMBOLS` symbols: the
   k-gram, hashed blocks to its right, hashed blocks to its left. A shard keeps each of its strings once, with a count, deals them to
   buckets by first symbol, and sends the Burrows-Wheeler transform of each bucket's strings (every suffix's preceding symbol).
3. Merge. Only transforms are read. Starting from the shards one after the other, each pass deals the suffixes, in the order of the
   interleave so far, to their preceding symbols by a stable counting sort, which orders them by one more symbol; where neighbours part
   for the first time, that pass is their common prefix. No suffix is sorted or compared again. Whole strings whose common prefix is
   `SYMBOLS` are repeats; those that share one symbol at least lie at the edges of possible ones.
   As many shards times as many buckets would make transforms of a few strings each, whose number grows with the square of the corpus. So
   a shard deals to `FAN` buckets at most; of a larger corpus, shards are merged bucket by bucket into as large ones that deal on, level by
   level, until buckets are fine enough to be judged; verdicts go back the same way.
4. Edges. Contexts that share their anchor but not all symbols are fetched, and their windows of `length` bytes compared by two
   independent 64-bit hashes, in bounded groups by anchor, or by window where an anchor is frequent.

No byte is compared with another: equality rests on 7 hashes of 64 bits for contexts and on 128 bits for windows.

Hot keys. A bucket of more than `HOT_ENTRIES` strings (a frequent anchor) is dealt anew by whole strings: transforms are inverted, their
strings spread over as many merges as the size asks for, and all of them count as edges, which the windows settle.

Defined results: a null text counts as empty; texts shorter than `length` keep all bytes; rows of equal text repeat one another;
matches never cross documents; columns other than the text pass through (own `repeats` and `kept` columns are replaced). Texts of any
length are read in pieces.

Passages counted in words are found in the same way: each word is written as a code of `CODE` bytes, so a number of words is a length.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import BLANK, SLICE_BYTES, bounded_batches, byte_weights, cut_lineage, mix64, read_table, release, released, shuffle_width, slices, text_bytes, useful_partitions

#: Anchors of a shard, and contexts that one step of the edge check holds; an anchor with more contexts goes by windows.
SHARD_ANCHORS, EDGE_CONTEXTS = 1 << 15, 2048
#: Symbols of a string, bytes of text for which there is a bucket of the merge, strings of a bucket from which it is split.
SYMBOLS, BUCKET_BYTES, HOT_ENTRIES = 7, 4 << 20, 1 << 16
#: Buckets that a shard deals its strings to at most.
FAN = 1024
#: Frequent anchors that are sent to all workers at most, 8 bytes each; there are at most one for every `EDGE_CONTEXTS` contexts.
BROADCAST_GRAMS = 1_000_000
#: Bytes of a word's code; passages are equal if their words are, whatever blanks part them.
CODE = 6
#: Words of more bytes are hashed on their own.
LONG_WORD = 1 << 14
_POSITION = np.uint64(28)
_WEIGHT, _OTHER_WEIGHT = byte_weights(2), byte_weights(3)
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        found = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (base, pow(base, -1, 2**64)))
        if n > 8 * SLICE_BYTES:
            return found
        _POWERS[base] = found
    return _POWERS[base]


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def unpacked(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


class Hashed:
    """Hashes of any stretch [a, b) of a byte array."""

    def __init__(self, data: np.ndarray, weight: np.ndarray = _WEIGHT, base: int = _BASE):
        up, self.down = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(weight[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def gram_size(length: int) -> int:
    return 64 if length >= 256 else 8


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: row, position, first and last start of the windows that it stands for; and the k-gram hashes."""
    k, starts = gram_size(length), len(data) - length + 1
    if starts < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    h, p, s = _WEIGHT[data], _BASE, 1
    while s < k:
        h = h[:-s] * np.uint64(p) + h[s:]
        p, s = p * p % 2**64, s * 2
    gram = mix64(h)
    low = (gram >> _POSITION << _POSITION) | np.arange(len(gram), dtype=np.uint64)
    wide, s = length - k + 1, 1
    while s * 2 <= wide:
        low, s = np.minimum(low[:-s], low[s:]), s * 2
    low = np.minimum(low[:starts], low[wide - s : wide - s + starts])
    at = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    begins, ends = offsets[:-1], offsets[1:]
    some = ends - begins >= length
    mark = np.zeros(len(data) + 1, np.int8)
    mark[begins[some]] = 1
    mark[ends[some] - length + 1] -= 1
    valid = np.cumsum(mark[:starts], dtype=np.int8).astype(bool)
    differs = np.ones(starts + 1, bool)
    differs[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(differs[:-1] & valid)
    hi = np.flatnonzero(differs[1:] & valid)
    return np.searchsorted(offsets, lo, "right") - 1, at[lo], lo, hi, gram


def pieces(part: pa.RecordBatch, overlap: int, limit: int = 2 * SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shift, bytes and offsets of the texts of a slice: one piece, or several that overlap of a text that is longer than the limit."""
    data, offsets = text_bytes(part.column("text"))
    if len(data) <= limit or part.num_rows > 1:
        yield 0, data, offsets
        return
    for at in range(0, max(1, len(data) - overlap), limit):
        cut = data[at : at + limit + overlap]
        yield at, cut, np.array([0, len(cut)])


def symbols(data: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """The symbols of anchored contexts [lo, hi + length): the k-gram, three blocks to the right, three to the left. None is 0; 1 is no block."""
    hashed, k = Hashed(data), gram_size(length)
    block = -(-(length - k + 1) // 3)
    out = np.ones((len(p), SYMBOLS), np.uint64)
    out[:, 0] = np.maximum(gram[p], np.uint64(2))
    for j in range(3):
        a = p + k + j * block
        b = np.minimum(a + block, hi + length)
        out[a < b, 1 + j] = np.maximum(hashed(a[a < b], b[a < b]), np.uint64(2))
        b = p - j * block
        a = np.maximum(b - block, lo)
        out[a < b, 4 + j] = np.maximum(hashed(a[a < b], b[a < b]), np.uint64(2))
    return out


def transform(strings: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of sorted strings of symbols above 0: the symbol before each suffix in the order of all suffixes.

    Empty suffixes stand first, by string; equal ones stand by string; 0 is what comes before a whole string.
    """
    m, width = strings.shape
    suffixes = np.zeros((m * (width + 1), width), np.uint64)
    before = np.zeros(m * (width + 1), np.uint64)
    for j in range(width + 1):  # suffixes by length, the empty one first
        suffixes[(width - j) * m : (width - j + 1) * m, : width - j] = strings[:, j:]
        if j:
            before[(width - j) * m : (width - j + 1) * m] = strings[:, j - 1]
    return before[np.lexsort(suffixes.T[::-1])]


def steps(bwt: np.ndarray, m: int) -> np.ndarray:
    """For each place of a transform of m strings the place of the suffix that is longer by the symbol there; -1 before a whole string."""
    order = np.argsort(bwt, kind="stable")
    out = np.empty(len(bwt), np.int64)
    out[order] = np.arange(len(bwt))  # the m zeros come first, as do the m empty suffixes
    out[bwt == 0] = -1
    return out


def inverted(bwt: np.ndarray, m: int, width: int = SYMBOLS) -> np.ndarray:
    """The strings of a transform, in order."""
    step, at = steps(bwt, m), np.arange(m)
    strings = np.zeros((m, width), np.uint64)
    for j in range(width - 1, -1, -1):
        strings[:, j] = bwt[at]
        at = step[at]
    return strings[np.argsort(at, kind="stable")]  # places of whole strings stand in the order of the strings


def counting_sort(code: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, by counting passes over 16 bits each."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    if len(code) and int(code.max()) >> 16:
        order = order[np.argsort((code[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge_transforms(runs: list[tuple[np.ndarray, int]], width: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms of sorted strings by refining their interleave.

    runs: transform and number of strings. Returns the order of all strings (indices into the runs' strings one after the other) and the
    number of leading symbols that each shares with the one before it.
    """
    bwt = np.concatenate([b for b, _ in runs])
    first = np.cumsum([0] + [len(b) for b, _ in runs])
    kind = np.int32 if len(bwt) < 1 << 31 else np.int64
    step = np.concatenate([np.where(s < 0, -1, s + a) for (b, m), a in zip(runs, first) for s in [steps(b, m)]]).astype(kind)
    whole = np.flatnonzero(bwt == 0)  # of each run in the order of its strings
    string = np.full(len(bwt), -1, np.int64)
    string[whole] = np.arange(len(whole))
    code = np.unique(bwt, return_inverse=True)[1].astype(kind)
    empty = np.concatenate([np.arange(a, a + m, dtype=kind) for (_, m), a in zip(runs, first)])
    z = np.concatenate((empty, np.setdiff1d(np.arange(len(bwt), dtype=kind), empty, assume_unique=True)))  # the interleave: by no symbol at all
    group = np.concatenate((np.zeros(len(empty), kind), np.ones(len(bwt) - len(empty), kind)))  # the interval of each place
    shared = np.full(len(bwt), -1, np.int64)
    shared[[0, len(empty)][: 1 + (len(bwt) > len(empty))]] = 0
    for depth in range(width):
        longer = step[z]
        some = longer >= 0
        longer, inside, symbol = longer[some], group[some], code[z[some]]
        order = counting_sort(symbol)
        longer, inside, symbol = longer[order], inside[order], symbol[order]
        new = np.ones(len(longer), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (inside[1:] != inside[:-1])
        z = np.concatenate((empty, longer))
        group = np.concatenate((np.zeros(len(empty), kind), np.cumsum(new, dtype=kind)))
        parted = np.flatnonzero(new) + len(empty)
        shared[parted[shared[parted] < 0]] = depth
    shared[shared < 0] = width
    # common prefixes of neighbouring whole strings: the least on the way from one to the next
    at = np.flatnonzero(string[z] >= 0)
    return string[z[at]], np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1)) if len(at) else at


#: What the merge says of an entry: alone, repeated whole, at an edge, repeated whole and the one that stands for its like at edges.
ALONE, REPEAT, EDGE, STANDS = 0, 1, 2, 3


def verdicts(order: np.ndarray, shared: np.ndarray, counts: np.ndarray, split: bool = False) -> np.ndarray:
    """What each string is, from the merged order, the common prefixes and how often each run has its strings.

    split: the first symbol may have other strings elsewhere, so all of them lie at edges.
    """
    n = len(order)
    lead = shared < SYMBOLS  # intervals of equal strings, and of those that share their first symbol
    same, kin = np.cumsum(lead) - 1, np.cumsum(shared < 1) - 1
    total = np.bincount(same, weights=counts[order])[same]
    several = np.ones(n, bool) if split else np.bincount(kin, weights=lead)[kin] > 1
    found = np.where(total > 1, REPEAT, ALONE)
    found[several & (total > 1) & lead] = STANDS
    found[several & (total == 1)] = EDGE
    out = np.empty(n, np.uint8)
    out[order] = found
    return out


def dealings(buckets: int) -> list[tuple[int, int]]:
    """For each level of the merge the number of finest buckets and how many of them its buckets span: FAN buckets of a level in one of the last."""
    levels = 1
    while FAN**levels < buckets:
        levels += 1
    fan = next(n for n in range(1, FAN + 1) if n**levels >= buckets)
    return [(fan**levels, fan ** (levels - 1 - level)) for level in range(levels)]


def bucket_of(symbol: np.ndarray, dealing: tuple[int, int]) -> np.ndarray:
    return ((symbol >> np.uint64(20)) % np.uint64(dealing[0]) // np.uint64(dealing[1])).astype(np.int64)


class Shard:
    """The distinct strings of a shard's anchors, sorted and dealt to buckets by first symbol, and where each anchor's string stands."""

    def __init__(self, strings: np.ndarray, dealing: tuple[int, int]):
        bucket = bucket_of(strings[:, 0], dealing)
        order = np.lexsort((*strings.T[::-1], bucket))
        new = np.ones(len(order), bool)
        new[1:] = (strings[order[1:]] != strings[order[:-1]]).any(1)
        self.entry = np.empty(len(order), np.int32)
        self.entry[order] = np.cumsum(new) - 1
        self.strings, self.bucket = strings[order[new]], bucket[order[new]]
        self.counts = np.bincount(self.entry, minlength=len(self.strings)).astype(np.int32)

    @classmethod
    def merged(cls, parts: list[tuple[np.ndarray, np.ndarray]], dealing: tuple[int, int]) -> Shard:
        """A shard of the strings of runs (transform and counts), in the order of their merge; its entries are those of the runs, one run after the other."""
        order, shared = merge_transforms([(b, len(c)) for b, c in parts])
        new = shared < SYMBOLS
        same = np.cumsum(new) - 1
        strings = np.concatenate([inverted(b, len(c)) for b, c in parts])[order[new]]
        bucket = bucket_of(strings[:, 0], dealing)
        dealt = np.argsort(bucket, kind="stable")
        rank = np.empty(len(dealt), np.int32)
        rank[dealt] = np.arange(len(dealt))
        self = cls.__new__(cls)
        self.entry = np.empty(len(order), np.int32)
        self.entry[order] = rank[same]
        self.strings, self.bucket = strings[dealt], bucket[dealt]
        self.counts = np.zeros(len(dealt), np.int64)
        np.add.at(self.counts, self.entry, np.concatenate([c for _, c in parts]))
        return self

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bucket, transform and counts."""
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            yield int(self.bucket[a]), transform(self.strings[a:b]), self.counts[a:b]


#: What a pass reads of a batch of documents (__id, __text, text): all of it, or what this makes of it.
View = Callable[[pa.RecordBatch], pa.RecordBatch]


#: What a shard sends: its runs (bucket >= 0, with their number of strings) and where their entries belong (bucket -1).
SENT = "shard string, bucket int, n int, payload binary"


def _shards(docs: DataFrame, length: int, dealing: tuple[int, int], view: View | None) -> DataFrame:
    """What the shards of documents send; their entries belong to places in texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, made, rows_before = 0, 0, 0
        home = uuid.uuid4().hex  # a task that merges partitions runs this once for each, so its number names no shard

        def flush() -> pa.RecordBatch:
            rows, p, lo, hi, strings = (np.concatenate([h[j] for h in held]) for j in range(5))
            shard = Shard(strings, dealing)
            keys, used = np.concatenate([h[5] for h in held]), np.unique(rows)
            places = {"doc": np.searchsorted(used, rows).astype(np.int32), "p": p.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "entry": shard.entry, "gram": strings[:, 0].view(np.int64), "keys": keys[used]}
            out = [(-1, 0, packed(places))] + [(b, len(c), packed((t, c))) for b, t, c in shard.runs()]
            return pa.RecordBatch.from_arrays([pa.array([f"{home}.{made}"] * len(out)), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary())))], names=["shard", "bucket", "n", "payload"])

        for part in slices(batches):
            part = view(part) if view else part
            keys = np.stack([part.column("__id").to_numpy(zero_copy_only=False), part.column("__text").to_numpy(zero_copy_only=False)], 1)
            for shift, data, offsets in pieces(part, length - 1):
                row, p, lo, hi, gram = anchors(data, offsets, length)
                if not len(p):
                    continue
                base = offsets[row] - shift
                held.append((row + rows_before, p - base, lo - base, hi - base, symbols(data, p, lo, hi, gram, length), keys))
                rows_before += len(keys)
                size += len(p)
                if size >= SHARD_ANCHORS:
                    yield flush()
                    held, size, made, rows_before = [], 0, made + 1, 0
        if size:
            yield flush()

    return docs.mapInArrow(released(run, 1), SENT)


def _gathered(runs: DataFrame, level: int, dealing: tuple[int, int]) -> DataFrame:
    """What larger shards send, each merged of runs of one bucket with SHARD_ANCHORS strings or so; their entries belong to entries of those runs."""
    sizes = runs.groupBy("bucket").agg(F.ceil(F.sum("n") / SHARD_ANCHORS).cast("int").alias("groups"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        shard = Shard.merged([unpacked(x) for x in frame["payload"]], dealing)
        home = f"{level}.{frame['bucket'].iloc[0]}.{frame['group'].iloc[0]}"
        belongs = {"shard": frame["shard"].tolist(), "bucket": frame["bucket"].tolist(), "n": frame["n"].tolist(), "entry": shard.entry}
        out = [(home, -1, 0, packed(belongs))] + [(home, b, len(c), packed((t, c))) for b, t, c in shard.runs()]
        release()
        return pd.DataFrame(out, columns=["shard", "bucket", "n", "payload"])

    grouped = runs.join(F.broadcast(sizes), "bucket").withColumn("group", F.pmod(F.xxhash64("shard"), F.col("groups")).cast("int"))
    return grouped.groupBy("bucket", "group").applyInPandas(run, SENT)


def _dealt_anew(runs: DataFrame) -> DataFrame:
    """Runs of split buckets (ways > 1) as runs by whole strings, with the places of their strings in the run that they come from."""
    schema = "shard string, bucket int, part int, split boolean, place binary, payload binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, bucket, n, ways, payload in zip(frame["shard"], frame["bucket"], frame["n"], frame["ways"], frame["payload"]):
                bwt, counts = unpacked(payload)
                strings = inverted(bwt, n)
                way = (mix64(strings @ (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(_OTHER_BASE))) % np.uint64(ways)).astype(np.int64)
                out = []
                for w in np.unique(way).tolist():
                    place = np.flatnonzero(way == w)
                    out.append((shard, bucket, w, True, place.astype(np.int32).tobytes(), packed((transform(strings[place]), counts[place]))))
                yield pd.DataFrame(out, columns=["shard", "bucket", "part", "split", "place", "payload"])

    return runs.mapInPandas(run, schema)


JUDGED = "shard string, bucket int, place binary, payload binary"


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [unpacked(x) for x in frame["payload"]]
    order, shared = merge_transforms([(b, len(c)) for b, c in parts])
    found = verdicts(order, shared, np.concatenate([c for _, c in parts]), bool(frame["split"].iloc[0]))
    cut = np.split(found, np.cumsum([len(c) for _, c in parts])[:-1])
    out = pd.DataFrame({"shard": frame["shard"], "bucket": frame["bucket"], "place": frame["place"], "payload": [v.tobytes() for v in cut]})
    release()
    return out


def _back(sent: DataFrame, judged: DataFrame) -> GroupedData:
    """Where the entries of each shard belong, with what was said of its runs."""
    belongs = sent.filter("bucket < 0").select("shard", "bucket", F.lit(None).cast("binary").alias("place"), "payload")
    return belongs.unionByName(judged).groupBy("shard")


def _heard(frame: pd.DataFrame) -> tuple[dict, np.ndarray, np.ndarray]:
    """Back in a shard: where its entries belong, what was said of each, and which is the first of its string."""
    frame = frame.sort_values("bucket", kind="stable")
    belongs = unpacked(frame["payload"].iloc[0])
    rest = frame.iloc[1:]
    parts = []
    for _, bucket in rest.groupby("bucket", sort=False):
        found = np.frombuffer(b"".join(bucket["payload"]), np.uint8)
        if bucket["place"].notna().all():
            found, mixed = np.empty_like(found), found
            found[np.frombuffer(b"".join(bucket["place"]), np.int32)] = mixed
        parts.append(found)
    of = np.concatenate(parts)[belongs["entry"]]
    once = np.zeros(len(of), bool)
    once[np.unique(belongs["entry"], return_index=True)[1]] = True
    return belongs, of, once


def _told(frame: pd.DataFrame) -> pd.DataFrame:
    """What a larger shard tells the shards that it was merged of; one of them stands for the like at edges."""
    belongs, of, once = _heard(frame)
    of[(of == STANDS) & ~once] = REPEAT
    cut = np.split(of, np.cumsum(belongs["n"])[:-1])
    return pd.DataFrame({"shard": belongs["shard"], "bucket": belongs["bucket"], "place": None, "payload": [v.tobytes() for v in cut]})


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated stretches of a shard's texts, and the edges to be settled by their windows."""
    places, of, once = _heard(frame)
    keep = of != ALONE
    ask = (of == EDGE) | ((of == STANDS) & once)
    keys = places["keys"][places["doc"]]
    out = {"__id": keys[:, 0], "__text": keys[:, 1], "gram": places["gram"], "p": places["p"], "lo": places["lo"], "hi": places["hi"], "whole": of != EDGE, "ask": ask}
    return pd.DataFrame({k: v[keep] for k, v in out.items()})


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that sorted or unsorted spans cover; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return list(zip(starts[new].tolist(), ends[last].tolist()))


def compressed(docs: DataFrame, text: str, view: View | None = None) -> DataFrame:
    """docs with the text as compressed bytes, for a shuffle."""
    schema = T.StructType([f if f.name != text else T.StructField(text, T.BinaryType()) for f in docs.schema.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches, text):
            part = view(part) if view else part
            small = pa.array([None if t is None else zip_(t.encode()) for t in part.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if n == text else c for n, c in zip(part.schema.names, part.columns)], names=part.schema.names)

    return docs.mapInArrow(released(run), schema)


def _asked(docs: DataFrame, asks: DataFrame, view: View | None) -> DataFrame:
    """Compressed texts with what is asked of them. Joined by shuffle, whatever the sizes: Python passes of one stage would add up in memory."""
    wanted = asks.groupBy("__id", "__text").agg(F.collect_list(F.struct("gram", "p", "lo", "hi", "whole")).alias("asks"))
    return compressed(docs.select("__id", "__text", "text"), "text", view).join(wanted.hint("merge"), ["__id", "__text"]).select("__id", "__text", "text", "asks")


def _cut_out(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked contexts, cut out of the texts."""
    unzip = zstandard.ZstdDecompressor().decompress
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        out, size = [], 0
        for i, x, text, asked in zip(*(batch.column(c) for c in ("__id", "__text", "text", "asks"))):
            raw = unzip(text.as_py())
            for a in asked.as_py():
                out.append((i.as_py(), x.as_py(), a["gram"], a["lo"], a["hi"], a["whole"], raw[a["lo"] : a["hi"] + length]))
                size += len(out[-1][-1])
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=CONTEXT)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=CONTEXT)


CONTEXT = ["__id", "__text", "gram", "lo", "hi", "whole", "bytes"]


def _contexts(docs: DataFrame, asks: DataFrame, length: int, view: View | None) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_out(batches, length)

    return _asked(docs, asks, view).mapInArrow(released(run), "__id long, __text long, gram long, lo int, hi int, whole boolean, bytes binary")


def _windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, row and start of all windows of the contexts."""
    column = table.column("bytes").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    count = hi - lo + 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + step
    return Hashed(data)(at, at + length), Hashed(data, _OTHER_WEIGHT, _OTHER_BASE)(at, at + length), row, lo[row] + step


def _edge_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the edges; contexts of an anchor stand together."""
    schema = "__id long, __text long, start int, stop int"

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        value, other, row, start = _windows(table, length)
        order = np.lexsort((other, value))
        same = (value[order[1:]] == value[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        again = np.zeros(len(value), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        again &= ~table.column("whole").to_numpy()[row]
        row, start = row[again], start[again]
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(cuts[1:], len(row)) - 1
        rows = row[cuts] if len(row) else row
        pick = pa.array(rows)
        first, last = (start[cuts], start[ends] + length) if len(row) else (row, row)
        return pa.RecordBatch.from_arrays([table.column("__id").take(pick).combine_chunks(), table.column("__text").take(pick).combine_chunks(), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["__id", "__text", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= EDGE_CONTEXTS:
                table = pa.Table.from_batches(held)
                gram = table.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # sorted: what stands before the last anchor is complete
                if cut:
                    yield settle(table.slice(0, cut).combine_chunks().to_batches())
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield settle(held)

    return contexts.mapInArrow(released(run), schema)


def _frequent_spans(docs: DataFrame, asks: DataFrame, length: int, view: View | None) -> DataFrame:
    """The same for anchors with many contexts: windows meet by their hashes, so no task holds an anchor's contexts together."""
    schema = "__id long, __text long, whole boolean, start int, window long, other long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_out(batches, length):
            table = pa.Table.from_batches([batch])
            value, other, row, start = _windows(table, length)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(table.column(c).take(pick).combine_chunks() for c in ("__id", "__text", "whole")), pa.array(start, pa.int32()), pa.array(value.view(np.int64)), pa.array(other.view(np.int64))], names=["__id", "__text", "whole", "start", "window", "other"])

    windows = _asked(docs, asks, view).mapInArrow(released(run), schema)
    again = windows.groupBy("window", "other").agg(F.count("*").alias("c")).filter("c > 1").select("window", "other")
    return windows.filter("not whole").join(again, ["window", "other"]).select("__id", "__text", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int, edge_limit: int = EDGE_CONTEXTS, hot: int = HOT_ENTRIES, view: View | None = None) -> DataFrame:
    """__id, __text and the repeated spans (start, stop) of docs (__id, __text, text), as the view shows them."""
    docs = docs.select("__id", "__text", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    most = useful_partitions(docs)
    first, *further = dealings(max(1, math.ceil(size / BUCKET_BYTES)))
    levels = [cut_lineage(_shards(docs, length, first, view), most)]
    for level, dealing in enumerate(further, 1):
        levels.append(cut_lineage(_gathered(levels[-1].filter("bucket >= 0"), level, dealing), most))
    runs = levels[-1].filter("bucket >= 0")
    ways = runs.groupBy("bucket").agg(F.ceil(F.sum("n") * 2 / hot).cast("int").alias("ways")).filter("ways > 2").collect()  # few: each has that many strings
    split = F.col("bucket").isin([r["bucket"] for r in ways])
    plain = runs.filter(~split).select("shard", "bucket", F.lit(0).alias("part"), F.lit(False).alias("split"), F.lit(None).cast("binary").alias("place"), "payload")
    if ways:
        known = docs.sparkSession.createDataFrame([(r["bucket"], r["ways"]) for r in ways], "bucket int, ways int")
        plain = plain.unionByName(_dealt_anew(runs.filter(split).join(known, "bucket").select("shard", "bucket", "n", "ways", "payload")))
    judged = plain.groupBy("bucket", "part").applyInPandas(_merge, JUDGED)
    for sent in levels[:0:-1]:
        judged = _back(sent, judged).applyInPandas(_told, JUDGED)
    found = cut_lineage(_back(levels[0], judged).applyInPandas(_settle, "__id long, __text long, gram long, p int, lo int, hi int, whole boolean, ask boolean"), most)
    whole = found.filter("whole").select("__id", "__text", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    asks = found.filter("ask").dropDuplicates(["__id", "__text", "p", "lo"]).drop("ask")
    many = cut_lineage(asks.groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") > edge_limit).select("gram"), most)
    if many.count() <= BROADCAST_GRAMS:  # else contexts meet them by shuffle, where a frequent anchor is a hot key
        many = F.broadcast(many)
    few = _contexts(docs, asks.join(many, "gram", "left_anti"), length, view).repartition(min(most, shuffle_width(docs.sparkSession)), "gram").sortWithinPartitions("gram")
    return whole.unionByName(_edge_spans(few, length)).unionByName(_frequent_spans(docs, asks.join(many, "gram", "left_semi"), length, view))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with the keys __id and __text of a document; spans depend on the text alone, so rows of equal keys share them."""
    return docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(0))).withColumn("__text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's start and stop, and the n + 1 offsets of each row's words."""
    inner = ~BLANK[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    begins, ends = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    first[begins], last[ends] = inner[begins], inner[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; long texts in pieces, words of more than LONG_WORD bytes on their own."""
    out = np.zeros(len(starts), np.uint64)
    short = stops - starts <= LONG_WORD
    some = np.flatnonzero(short)
    a = 0
    while a < len(some):
        base = starts[some[a]]
        b = max(a + 1, int(np.searchsorted(stops[some], base + 2 * SLICE_BYTES, "right")))
        pick = some[a:b]
        if stops[pick[-1]] - base > 8 * SLICE_BYTES:  # long words between
            pick = pick[:1]
            b = a + 1
        out[pick] = Hashed(data[base : stops[pick[-1]]])(starts[pick] - base, stops[pick] - base)
        a = b
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), seed=2)
    return out


def word_coded(part: pa.RecordBatch) -> pa.RecordBatch:
    """A view: each word of the text as `CODE` characters and nothing between them."""
    data, offsets = text_bytes(part.column("text"))
    starts, stops, at = word_bounds(data, offsets)
    value = word_values(data, starts, stops)
    code = (value[:, None] >> np.arange(0, 6 * CODE, 6, dtype=np.uint64) & np.uint64(63)).astype(np.uint8) + np.uint8(48)
    texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(at.astype(np.int64) * CODE), pa.py_buffer(np.ascontiguousarray(code)))
    return pa.RecordBatch.from_arrays([part.column("__id"), part.column("__text"), texts.cast(pa.string())], names=["__id", "__text", "text"])


def with_long_words(length: int, words: int) -> View:
    """A view: the documents that have `length` bytes in a row with `words` whole words at most.

    A window's edges can cut a word in one document and not in another, so two words more pass.
    """

    def view(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("text"))
        starts, stops, at = word_bounds(data, offsets)
        row = np.concatenate((np.arange(part.num_rows), np.repeat(np.arange(part.num_rows), np.diff(at))))
        first = np.concatenate((offsets[:-1], starts + 1))
        end = np.concatenate((at[:-1], np.arange(len(starts)) + 1)) + words + 2  # the word that the window must not hold whole
        stop = np.where(end < at[row + 1], np.append(stops, 0)[np.minimum(end, len(stops))], len(data) + length + 1)
        some = np.bincount(row[(stop > first + length) & (first + length <= offsets[row + 1])], minlength=part.num_rows) > 0
        return part.filter(pa.array(some))

    return view


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", edge_limit: int = EDGE_CONTEXTS, words: int | None = None) -> DataFrame:
    """docs with `repeats` (spans of removed bytes) and `kept` (the remaining bytes).

    With `words`, passages of more than so many words go too, from their first word to their last.
    """
    bounded_batches(docs.sparkSession)
    docs = keyed(docs.drop("repeats", "kept"), doc_id, text)
    plain_docs = docs.select("__id", "__text", F.coalesce(F.col(text), F.lit("")).alias("text"))
    if words is None:
        spans = repeated_spans(plain_docs, length, edge_limit).withColumn("unit", F.lit(1))
    else:  # what repeats over `length` bytes and has more words is found by its words
        spans = repeated_spans(plain_docs, (words + 1) * CODE, edge_limit, view=word_coded).withColumn("unit", F.lit(CODE))
        spans = spans.unionByName(repeated_spans(plain_docs, length, edge_limit, view=with_long_words(length, words)).withColumn("unit", F.lit(1)))
    by_doc = spans.groupBy("__id", "__text").agg(F.collect_list(F.struct("start", "stop", "unit")).alias("repeats"))
    texts = next(f for f in docs.schema.fields if f.name == text)
    joined = compressed(docs, text).join(by_doc.hint("merge"), ["__id", "__text"], "left").drop("__id", "__text")
    span_list = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]), False)
    passed = [texts if f.name == text else f for f in joined.schema.fields if f.name != "repeats"]
    schema = T.StructType([*passed, T.StructField("repeats", span_list, False), T.StructField("kept", T.BinaryType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, kept, plain = [], [], []
                for small, found in zip(part.column(text).to_pylist(), part.column("repeats")):
                    raw = np.frombuffer(b"" if small is None else unzip(small), np.uint8)
                    plain.append(None if small is None else raw.tobytes().decode())
                    if not found.is_valid or not len(found):
                        lists.append([])
                        kept.append(raw.tobytes())
                        continue
                    flat = found.values
                    start, stop, unit = (flat.field(c).to_numpy() for c in ("start", "stop", "unit"))
                    if (unit == CODE).any():
                        begin, end, _ = word_bounds(raw, np.array([0, len(raw)]))
                        start = np.where(unit == CODE, begin[np.minimum(-(-start // CODE), len(begin) - 1)], start)
                        stop = np.where(unit == CODE, end[np.minimum(stop // CODE, len(end)) - 1], stop)
                    runs = merged_spans(start, stop)
                    mask = np.ones(len(raw), bool)
                    for a, b in runs:
                        mask[a:b] = False
                    lists.append([{"start": a, "stop": b} for a, b in runs])
                    kept.append(raw[mask].tobytes())
                columns = [pa.array(plain, pa.string()) if f.name == text else part.column(f.name) for f in passed]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, kind), pa.array(kept, pa.binary())], names=[*(f.name for f in passed), "repeats", "kept"])

    return joined.mapInArrow(released(run), schema)


def removed_bytes() -> Column:
    return F.aggregate("repeats", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]).cast("long"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`n_bytes` counts the input; `text` is what is kept of it, for reading: a character that a cut splits shows as U+FFFD, only
    `kept_sha256` is of the exact bytes."""
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed_bytes().alias("n_removed"),
        F.size("repeats").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )
