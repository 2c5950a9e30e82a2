"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a piece of a partition are laid out in one array of symbols. An index maps each adjacent pair to all
its positions; active ranks are applied in ascending order, each to all positions at once, and only the lists of the affected
neighbours change. Results of distinct segments are kept in a memo, bounded in bytes and dropped after each partition; token streams are
then gathered with numpy.

Defined results: null text counts as empty, empty text has no tokens, a special token's string in a text is that special token,
repeated rows give repeated results, columns other than the text pass through untouched.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.common import bounded_batches, read_table, released, slices

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of segments and tokens that a worker's memo holds before it starts anew; what a segment and its entries take besides its text.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 160
NO_RANK = np.int32(2**31 - 1)
#: Bytes of text of one encoding step (many words share the work of a rank), and bytes of distinct words that are merged at a time.
STEP_BYTES, MERGE_BYTES = 3 << 20, 2 << 20
#: Characters or tokens of a piece of a text that is longer than a step.
LONG_TEXT = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class PairIndexBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.first = [vocab[c] for c in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= rank or z in made:
                raise ValueError("ranks must ascend from parts to wholes, one merge for a token")
            made[z] = rank
            self.merges[x, y] = (rank, z)
        ranked = sorted((x << 32 | y, rank, z) for (x, y), (rank, z) in self.merges.items())
        self.codes = np.array([c for c, _, _ in ranked], np.int64)
        self.ranks = np.array([r for _, r, _ in ranked], np.int32)
        self.by_rank = sorted((rank, x, y, z) for (x, y), (rank, z) in self.merges.items())
        self.pattern = regex.compile(PRETOKEN)
        # a run of whitespace never loses its last space to a cut: cuts stand between two characters that no library calls blank
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
        self.blanks = [c for c in map(chr, range(0x3001)) if c != " " and (c.isspace() or regex.match(r"\s", c))]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {t: k for k, t in enumerate(self.special)}
        self.memo_bytes = 0
        self.pool = np.array([*self.special.values()], np.int32)
        self.run_at = np.arange(len(self.special))
        self.run_len = np.ones(len(self.special), np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NO_RANK)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row and n + 1 offsets, by the pair occurrence index over all of them."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([0, *map(len, words)])
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), ends
        symbol = np.array(self.first, np.int32)[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[1:][ends[1:] > 0] - 1] = -1
        before[ends[:-1][ends[:-1] < n]] = -1
        rank = np.full(n, NO_RANK, np.int32)
        has = np.flatnonzero(after >= 0)
        rank[has] = self._rank(symbol[has], symbol[has + 1])
        index: dict[int, list[np.ndarray]] = {}

        def note(places: np.ndarray) -> None:
            order = np.argsort(found := rank[places], kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found, prepend=-1)).tolist()
            for r, a, b in zip(found[cuts].tolist(), cuts, [*cuts[1:], len(found)]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        active: list[int] = []
        note(has[rank[has] < NO_RANK])
        while active:
            r = heapq.heappop(active)
            _, a, b, whole = self.by_rank[r]
            lists = index.pop(r)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[rank[i] == r]
            if a == b and len(i) > 1:  # of overlapping occurrences the left one goes first
                kept, gone = [], -1
                for x, y in zip(i.tolist(), after[i].tolist()):
                    if x != gone:
                        kept.append(x)
                        gone = y
                i = np.array(kept)
            j = after[i]
            k = after[j]
            symbol[i], symbol[j], rank[j], after[i] = whole, -1, NO_RANK, k
            right, left = k >= 0, (h := before[i]) >= 0
            before[k[right]] = i[right]
            h = before[i]
            ir, hl = i[right], h[left]
            rank[i] = NO_RANK
            rank[ir] = self._rank(symbol[ir], symbol[k[right]])
            rank[hl] = self._rank(symbol[hl], symbol[i[left]])
            touched = np.concatenate((ir, hl))
            touched = touched[rank[touched] < NO_RANK]
            if len(touched):
                note(np.unique(touched))
        alive = symbol >= 0
        return symbol[alive], np.concatenate(([0], np.cumsum(alive)))[ends]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge_all for some MERGE_BYTES of words at a time."""
        step = np.cumsum([0, *map(len, words)]) // MERGE_BYTES
        cuts = np.append(np.flatnonzero(np.diff(step[:-1], prepend=-1)), len(words)).tolist()
        found = [self.merge_all(words[a:b]) for a, b in zip(cuts, cuts[1:])]
        if len(found) < 2:
            return found[0] if found else self.merge_all(words)
        return np.concatenate([i for i, _ in found]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(e) for _, e in found]))))

    def segments(self, text: str) -> list[str]:
        """Pieces that can be encoded apart: specials, and stretches between single spaces."""
        if self.split and any(t in text for t in self.special):
            out: list[str] = []
            for k, part in enumerate(self.split.split(text)):
                out.extend([part] if k % 2 else self._stretches(part))
            return out
        return self._stretches(text)

    def _stretches(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in self.blanks):
            head, *rest = self.cut.split(text)
        else:
            head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def learn(self, new: list[str]) -> None:
        words, find = [], self.pattern.findall
        for s in new:
            words.append([s] if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else find(s))
        distinct = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        ids, ends = self._merged([w.encode() for w in distinct])
        order = np.fromiter(map(distinct.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        counts = np.diff(ends)[order]
        added = ids[spread(ends[order], counts)]
        bounds = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, words)])]
        self.memo.update(zip(new, range(len(self.run_at), len(self.run_at) + len(new))))
        self.run_at = np.concatenate((self.run_at, len(self.pool) + bounds[:-1]))
        self.run_len = np.concatenate((self.run_len, np.diff(bounds)))
        self.pool = np.concatenate((self.pool, added))
        self.memo_bytes += sum(map(len, new)) + 4 * len(added) + ENTRY_BYTES * len(new)

    def pieces(self, text: str) -> Iterator[str]:
        """A text in stretches of about LONG_TEXT characters that can be encoded apart."""
        at = 0
        while len(text) - at > 2 * LONG_TEXT and (m := self.cut.search(text, at + LONG_TEXT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 offsets. A long text comes alone and is read in pieces."""
        texts = [t or "" for t in texts]
        if len(texts) == 1 and len(texts[0]) > 2 * LONG_TEXT:
            ids = np.concatenate([self._encoded([p])[0] for p in self.pieces(texts[0])])
            return ids, np.array([0, len(ids)])
        return self._encoded(texts)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.memo_bytes > MEMO_BYTES:
            self._reset()
        parts = [self.segments(t) for t in texts]
        if new := list(dict.fromkeys(filterfalse(self.memo.__contains__, chain.from_iterable(parts)))):
            self.learn(new)
        order = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        counts = self.run_len[order]
        ids = self.pool[spread(self.run_at[order], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, parts)])]
        return ids, ends


class Pieces:
    """The bytes of each token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = {c: b for b, c in enumerate(byte_symbols())}
        named = {i: bytes(as_byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        named |= {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
        pieces = [named.get(i, b"") for i in range(max(named) + 1)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.at[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id runs; bytes that are no UTF-8 become replacement characters. A long run comes alone and is read in pieces."""
        if len(offsets) == 2 and len(ids) > LONG_TEXT:
            data = [self._bytes(ids[a : a + LONG_TEXT]) for a in range(0, len(ids), LONG_TEXT)]
            return [b"".join(data).decode("utf-8", "replace")]
        counts = self.lengths[ids]
        data = self._bytes(ids)
        ends = np.concatenate(([0], np.cumsum(counts)))[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str) -> object:
    """The worker's one copy of a vocabulary."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "token_ids", step: int = STEP_BYTES) -> DataFrame:
    """docs with the array<int> column `into`; a column of that name is replaced. Narrow: no shuffle. Long texts are read in pieces."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PairIndexBpe, vocabulary)
        for part in slices(batches, text, step):
            ids, ends = bpe.encode(part.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, into])
        _LOADED.clear()  # the worker lives on

    return docs.mapInArrow(released(run, 4), schema)


def decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """docs with the string column `into`; a null list decodes to empty text."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Pieces, vocabulary)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = 1
                size = len(batch.column(ids)[at]) if batch.column(ids)[at].is_valid else 0
                while at + n < batch.num_rows and size < 1 << 18:
                    x = batch.column(ids)[at + n]
                    size += len(x) if x.is_valid else 0
                    n += 1
                part = batch.slice(at, n)
                at += n
                column = part.column(ids)
                lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                texts = bpe.decode(flat, np.concatenate(([0], np.cumsum(lengths))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return docs.mapInArrow(released(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or default_vocabulary()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
