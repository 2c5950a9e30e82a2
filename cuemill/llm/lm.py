"""LM scoring with a probabilistic suffix tree.

A text is scored as the byte string of its tokens (each followed by a space, the last by an end mark), so the model's probability is one of
the token sequence. All contexts of up to `DEPTH` bytes are counted over all training texts. A context that was seen `LEAST` times is
retained if its next-symbol distribution diverges from its suffix's by more than the description length of its own parameters, or if a
retained context extends it; the tree so grows with the corpus. Distributions are smoothed towards the suffix's (Witten-Bell), and each
symbol is scored by the longest suffix state of its context.

The tree is never gathered. It is cut at contexts of `ROOTS` bytes: what stands above them is bounded by 256 ** ROOTS distributions (checked)
and sent to all workers; every subtree below is built in the bucket of its root. Texts are packed into batches of about `BATCH_BYTES`;
a batch sends its distinct (context, symbol) codes, with training counts, to the buckets and gets their log-probabilities back, rounded
to 1 / `STEPS`. Words travel in the same way for the unigram base, as 64-bit hashes.

Defined results: a null or empty text is the end token alone; a null id hashes as empty text; repeated rows repeat; without training
texts all counts are 0; columns other than doc_id and text are not read. A text longer than a batch is a batch of its own, read in pieces.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.bpe import spread
from cuemill.llm.common import LOWER, bounded_batches, crc_bucket, cut_lineage, read_table, release, released, slices, text_bytes, word_hashes

DEPTH, ROOTS, LEAST = 6, 2, 50
END, SPACE, PIECE_BYTES, BATCH_BYTES = 10, 32, 1 << 20, 8 << 20
#: Log-probabilities travel as whole numbers of 1 / STEPS.
STEPS = 4096
END_HASH = np.uint64(0x5EED0E4D)


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def unpacked(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def squeezed(x: np.ndarray) -> bytes:
    """An array with the bytes of equal weight together, compressed: neighbours that differ little leave long runs."""
    turned = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return x.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(turned.tobytes())


def unsqueezed(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].decode().strip())
    turned = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(turned.reshape(kind.itemsize, -1).T).view(kind).ravel()


def rises(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


def token_stream(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as DEPTH end marks, its words with a space after each, an end mark in place of the last space; and the n + 1 offsets."""
    words = np.diff(at)
    cum = np.concatenate(([0], np.cumsum(lengths)))
    size = DEPTH + np.maximum(words, 1) + cum[at[1:]] - cum[at[:-1]]
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.full(ends[-1], SPACE, np.uint8)
    out[spread(ends[:-1], np.full(len(words), DEPTH))] = END
    out[ends[1:] - 1] = END
    row = np.repeat(np.arange(len(words)), words)
    to = ends[row] + DEPTH + cum[:-1] - cum[at[row]] + np.arange(len(row)) - at[row]
    out[spread(to, lengths)] = LOWER[data[spread(starts, lengths)]]
    return out, ends


def gram_codes(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each symbol that is scored: the DEPTH bytes before it, the last one in the highest place, and the symbol lowest."""
    n = len(stream) - DEPTH
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = stream[DEPTH:].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        code |= stream[DEPTH - j : DEPTH - j + n].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - j))
    scored = np.ones(n, bool)
    later = ends[1:-1]
    scored[spread(later - DEPTH, np.full(len(later), DEPTH))] = False
    return code[scored]


def coded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of all rows, and the row of each, some `limit` symbols at a time; a long row goes on from piece to piece."""
    cum = np.concatenate(([0], np.cumsum(lengths + 1)))
    rows = len(at) - 1
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(cum[at], cum[at[a]] + limit, "right")) - 1)
        b = min(b, rows, a + limit)
        if b > a + 1 or cum[at[b]] - cum[at[a]] <= 2 * limit:
            stream, ends = token_stream(data, starts[at[a] : at[b]], lengths[at[a] : at[b]], at[a : b + 1] - at[a])
            yield gram_codes(stream, ends), np.repeat(np.arange(a, b), np.diff(ends) - DEPTH)
        else:
            before, i = np.full(DEPTH, END, np.uint8), at[a]
            while i < at[b]:
                j = min(max(i + 1, int(np.searchsorted(cum, cum[i] + limit, "right")) - 1), at[b])
                stream, ends = token_stream(data, starts[i:j], lengths[i:j], np.array([0, j - i]))
                stream[:DEPTH] = before
                if j < at[b]:
                    stream[-1] = SPACE
                yield gram_codes(stream, ends), np.full(len(stream) - DEPTH, a)
                before, i = stream[-DEPTH:].copy(), j
        a = b


def shorter(code: np.ndarray, depth: int) -> np.ndarray:
    """Codes cut to a context of `depth` bytes."""
    return (code >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8) | (code & np.uint64(255))


def parent(code: np.ndarray) -> np.ndarray:
    """Cut codes without the oldest byte of their context."""
    return (code >> np.uint64(16)) << np.uint64(8) | (code & np.uint64(255))


def summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and their counts."""
    if not len(code):
        return code, count
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[cuts], np.add.reduceat(count, cuts)


def spread_bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def root_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a code's subtree: its root is the context of ROOTS + 1 bytes."""
    return spread_bucket(code >> np.uint64(8 * (DEPTH - ROOTS)), buckets)


def known_codes(pieces: Iterable[tuple[np.ndarray, np.ndarray]], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a batch in order, and their counts in training rows."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for code, row in pieces:
        label, distinct = pd.factorize(code)
        codes.append(distinct)
        counts.append(np.bincount(label[train[row]], minlength=len(distinct)))
        if len(codes) > 8:
            label, distinct = pd.factorize(np.concatenate(codes))
            codes, counts = [distinct], [np.bincount(label, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)]
    label, distinct = pd.factorize(np.concatenate(codes))
    count = np.bincount(label, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    order = np.argsort(distinct)
    return distinct[order], count[order]


class Looked:
    """Codes of a batch piece by piece, kept as places among the batch's distinct codes."""

    def __init__(self, pieces: Iterable[tuple[np.ndarray, np.ndarray]]):
        self.rows, self.labels, found = [], [], []
        for code, row in pieces:
            label, distinct = pd.factorize(code)
            self.labels.append(label.astype(np.int32))
            self.rows.append(row[:1] if len(row) and row[0] == row[-1] else row.astype(np.int32))  # a piece of a long row is all its
            found.append(distinct)
        label, distinct = pd.factorize(np.concatenate([np.zeros(0, np.uint64), *found]))
        order = np.argsort(distinct)
        self.code = distinct[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.places = np.split(place[label], np.cumsum([len(f) for f in found])[:-1]) if found else []

    def sums(self, value: np.ndarray, rows: int) -> np.ndarray:
        """The sum of the values of each row's codes; value: whole numbers by code."""
        total = np.zeros(rows)
        for row, label, place in zip(self.rows, self.labels, self.places):
            found = value[place][label]
            if len(row) == 1:
                total[row[0]] += found.sum(dtype=np.int64)
            else:
                total += np.bincount(row, weights=found, minlength=rows)
        return total


class Level:
    """The (context, symbol) pairs of one depth in order, with smoothed probabilities, and those of the longest retained suffix."""

    def __init__(self, code: np.ndarray, count: np.ndarray, up: Level | None):
        self.code = code
        if up is None:
            self.smooth = self.used = (count + 1.0) / (count.sum() + 256.0)
            self.retained = 1
            return
        place = np.searchsorted(up.code, parent(code))
        smooth, used = up.smooth[place], up.used[place]
        context = code >> np.uint64(8)
        cuts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(code) else np.zeros(0, np.int64)
        if not len(cuts):
            self.smooth, self.used, self.retained = smooth, used, 0
            return
        per = np.diff(np.append(cuts, len(code)))
        each = lambda x: np.repeat(np.add.reduceat(x, cuts), per)
        n, kinds = each(count), each((count > 0).astype(np.int64))
        enough = n >= LEAST
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = each(np.where(count > 0, count * np.log(count / n / smooth), 0.0))
        kept = enough & (gain > 0.5 * kinds * np.log(n + 1.0))
        self.smooth = np.where(enough, (count + kinds * smooth) / np.maximum(n + kinds, 1), smooth)
        self.used = np.where(kept, self.smooth, used)
        self.retained = int(kept[cuts].sum())


def above_roots(code: np.ndarray, count: np.ndarray) -> Level:
    """The tree down to contexts of ROOTS bytes, from the counts of (context of ROOTS bytes, symbol)."""
    level = None
    cut = [(code, count)]
    for _ in range(ROOTS):
        cut.append(summed(parent(cut[-1][0]), cut[-1][1]))
    for c, n in reversed(cut):
        level = Level(c, n, level)
    return level


def below_roots(code: np.ndarray, count: np.ndarray, level: Level) -> np.ndarray:
    """The probability of each of a bucket's distinct codes."""
    for depth in range(ROOTS + 1, DEPTH + 1):
        level = Level(*summed(shorter(code, depth), count), level)
    return level.used


def _packed_texts(docs: DataFrame) -> DataFrame:
    """Batches of rows (id, none, held, text): name, bytes, payload."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, made, held, size = uuid.uuid4().hex, 0, [], 0

        def flush() -> pa.RecordBatch:
            data, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids, none, back = (np.concatenate([h[j] for h in held]) for j in (2, 3, 4))
            payload = pickle.dumps((zstandard.ZstdCompressor(level=3).compress(data.tobytes()), n, ids, none, back))
            return pa.RecordBatch.from_arrays([pa.array([f"{home}.{made}"]), pa.array([len(data)], pa.int64()), pa.array([payload], pa.binary())], names=["batch", "bytes", "payload"])

        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            if held and size + len(data) > BATCH_BYTES:
                yield flush()
                held, size, made = [], 0, made + 1
            held.append((data, np.diff(offsets), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "none", "held"))))
            size += len(data)
        if held:
            yield flush()

    return docs.mapInArrow(released(run, 1), "batch string, bytes long, payload binary")


def _opened(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, n, ids, none, held = pickle.loads(payload)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return data, np.concatenate(([0], np.cumsum(n))), ids, none.astype(bool), held.astype(bool)


def _in_buckets(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order by bucket, and each bucket's stretch of it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, [(b, slice(int(cuts[b]), int(cuts[b + 1]))) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _gathered(batches: DataFrame, buckets: int) -> DataFrame:
    """Rows by kind: words and grams (of a batch and bucket), top (of a batch)."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for name, payload in zip(some.column("batch").to_pylist(), some.column("payload")):
                data, offsets, _, _, held = _opened(payload.as_buffer())
                hashes, starts, lengths, at = word_hashes(data, offsets)
                n = len(held)
                out = []
                back, word = pd.factorize(np.concatenate((hashes, np.full(n, END_HASH))))
                learned = np.bincount(back[np.concatenate((np.repeat(~held, np.diff(at)), ~held))], minlength=len(word))
                del back, hashes
                order = np.argsort(word)
                word, learned = word[order], learned[order]
                order, cuts = _in_buckets(spread_bucket(word, buckets), buckets)
                word, learned = word[order], learned[order].astype(np.int32)
                out += [("words", b, pickle.dumps((squeezed(rises(word[s])), squeezed(learned[s])))) for b, s in cuts]
                code, count = known_codes(coded(data, starts, lengths, at), ~held)
                out.append(("top", 0, packed(summed(shorter(code, ROOTS), count))))
                order, cuts = _in_buckets(root_bucket(code, buckets), buckets)
                code, count = code[order], count[order].astype(np.int32)
                out += [("grams", b, pickle.dumps((squeezed(rises(code[s])), squeezed(count[s])))) for b, s in cuts]
                kind, bucket, payloads = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array([name] * len(out)), pa.array(bucket, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "batch", "bucket", "payload"])

    return batches.select("batch", "payload").mapInArrow(released(run, 1), "kind string, batch string, bucket int, payload binary")


def _count_words(frame: pd.DataFrame) -> pd.DataFrame:
    """The training count of each batch's words, and the bucket's tokens and types."""
    parts = [(np.cumsum(unsqueezed(w), dtype=np.uint64), unsqueezed(c)) for w, c in map(pickle.loads, frame["payload"])]
    back, _ = pd.factorize(np.concatenate([w for w, _ in parts]))
    total = np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
    split = np.split(total[back], np.cumsum([len(w) for w, _ in parts])[:-1])
    out = pd.DataFrame({"kind": "counts", "batch": frame["batch"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "payload": [squeezed(s) for s in split], "tokens": 0, "types": 0})
    return pd.concat([out, pd.DataFrame({"kind": ["stat"], "batch": [""], "bucket": [0], "payload": [b""], "tokens": [int(total.sum())], "types": [int((total > 0).sum())]})])


def _sum_tops(frame: pd.DataFrame) -> pd.DataFrame:
    code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for x in frame["payload"]:
        c, n = unpacked(x)
        code, count = summed(np.concatenate((code, c)), np.concatenate((count, n)))
    return pd.DataFrame({"payload": [packed((code, count))]})


def _answers(top: Level):
    """The rounded log-probability of each batch's codes, from the subtrees of a bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts, counts = zip(*[(np.cumsum(unsqueezed(c), dtype=np.uint64), unsqueezed(n)) for c, n in map(pickle.loads, frame["payload"])])
        back, code = pd.factorize(np.concatenate(parts))
        count = np.bincount(back, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
        order = np.argsort(code)
        p = np.empty(len(code))
        p[order] = below_roots(code[order], count[order], top)
        steps = np.minimum(np.rint(-np.log10(p) * STEPS), 2**16 - 1).astype(np.uint16)[back]
        split = np.split(steps, np.cumsum([len(c) for c in parts])[:-1])
        out = pd.DataFrame({"kind": "answers", "batch": frame["batch"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "payload": [squeezed(s) for s in split]})
        del parts, counts, order, code, back, count, p, steps, split
        release()
        return out

    return run


def _scored(buckets: int, tokens: int, types: int):
    """A batch's scores, from its texts and what came back for its words and codes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        of = {k: f.sort_values("bucket")["payload"] for k, f in frame.groupby("kind")}
        data, offsets, ids, none, held = _opened(of["docs"].iloc[0])
        hashes, starts, lengths, at = word_hashes(data, offsets)
        rows = len(held)
        owner = np.concatenate((np.repeat(np.arange(rows), np.diff(at)), np.arange(rows)))
        back, word = pd.factorize(np.concatenate((hashes, np.full(rows, END_HASH))))
        order = np.argsort(word)
        order = order[_in_buckets(spread_bucket(word[order], buckets), buckets)[0]]
        counts = np.empty(len(word), np.int64)
        counts[order] = np.concatenate([unsqueezed(x) for x in of["counts"]])
        base = np.bincount(owner, weights=np.log10(counts + 1.0)[back], minlength=rows)
        known = np.bincount(owner, weights=(counts > 0)[back], minlength=rows).astype(np.int64)
        del owner, back, hashes, counts, word
        looked = Looked(coded(data, starts, lengths, at))
        order, _ = _in_buckets(root_bucket(looked.code, buckets), buckets)
        steps = np.empty(len(looked.code), np.uint16)
        steps[order] = np.concatenate([unsqueezed(x) for x in of["answers"]])
        total = looked.sums(steps, rows)
        n = np.diff(at) + 1
        out = {"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": np.full(rows, tokens), "base_score": base - n * math.log10(tokens + types + 1.0), "score": -total / STEPS}
        out["doc_id"][none] = pd.NA
        del data, looked, steps, order
        release()
        return pd.DataFrame(out)

    return run


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text); crc32(doc_id) mod 7 = 2 is held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), (crc_bucket("doc_id", 7) == 2).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    batches = cut_lineage(_packed_texts(keyed))
    size = batches.agg(F.sum("bytes")).first()[0]
    if size is None:
        return spark.createDataFrame([], schema)
    buckets = max(1, math.ceil(size / BATCH_BYTES))
    gathered = cut_lineage(_gathered(batches, buckets))
    counted = cut_lineage(gathered.filter("kind = 'words'").groupBy("bucket").applyInPandas(_count_words, "kind string, batch string, bucket int, payload binary, tokens long, types long"))
    tokens, types = counted.filter("kind = 'stat'").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tops = gathered.filter("kind = 'top'").groupBy(F.pmod(F.xxhash64("batch"), F.lit(max(1, math.ceil(math.sqrt(buckets))))).alias("part")).applyInPandas(_sum_tops, "payload binary")
    code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for r in tops.toLocalIterator():  # at most 256 ** (ROOTS + 1) pairs each
        c, n = unpacked(r["payload"])
        code, count = summed(np.concatenate((code, c)), np.concatenate((count, n)))
    answers = gathered.filter("kind = 'grams'").groupBy("bucket").applyInPandas(_answers(above_roots(code, count)), "kind string, batch string, bucket int, payload binary")
    texts = batches.select(F.lit("docs").alias("kind"), "batch", F.lit(-1).alias("bucket"), "payload")
    back = texts.unionByName(counted.filter("kind = 'counts'").select("kind", "batch", "bucket", "payload")).unionByName(answers)
    return back.groupBy("batch").applyInPandas(_scored(buckets, int(tokens), int(types)), schema)
