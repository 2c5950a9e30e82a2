import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cuemill.llm import lm
from cuemill.llm.common import text_bytes, word_hashes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def laid_out(texts):
    data, offsets = text_bytes(pa.array(texts))
    _, starts, lengths, at = word_hashes(data, offsets)
    return data, starts, lengths, at


def symbols(t):
    return (" ".join(words(t)) + "\n").encode()


def test_streams():
    out, ends = lm.token_stream(*laid_out([None, " The  cat\n", "", "ÀB", "\t"]))
    rows = [bytes(out[a + lm.DEPTH : b]) for a, b in zip(ends, ends[1:])]
    assert rows == [b"\n", b"the cat\n", b"\n", "Àb\n".encode(), b"\n"]


@pytest.mark.parametrize("limit", [1 << 20, 500, 40])
def test_codes_in_pieces(limit):
    texts = ["a bc  d", None, "word " * 400, "", "x" * 900, "end", "AB cd " * 30]
    found = [(int(c), int(r)) for code, row in lm.coded(*laid_out(texts), limit) for c, r in zip(code, row)]
    want = []
    for k, t in enumerate(texts):
        raw = b"\n" * lm.DEPTH + symbols(t)
        want += [(int.from_bytes(raw[i - lm.DEPTH : i][::-1] + raw[i : i + 1], "big"), k) for i in range(lm.DEPTH, len(raw))]
    assert found == want


class PlainTree:
    """A suffix tree with dictionaries: counts of all contexts, smoothed bottom up, retained by the same rule."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            raw = b"\n" * lm.DEPTH + symbols(t)
            for i in range(lm.DEPTH, len(raw)):
                for d in range(lm.DEPTH + 1):
                    self.counts[raw[i - d : i]][raw[i]] += 1
        self.memo = {}

    def smooth(self, s, a):
        """P(a | s) with Witten-Bell towards the suffix; the suffix's where s is rare."""
        if (s, a) not in self.memo:
            c = self.counts.get(s, Counter())
            n = sum(c.values())
            if not s:
                p = (c[a] + 1) / (n + 256)
            else:
                p = self.smooth(s[1:], a)
                if n >= lm.LEAST:
                    p = (c[a] + len(c) * p) / (n + len(c))
            self.memo[s, a] = p
        return self.memo[s, a]

    def passes(self, s):
        c = self.counts.get(s, Counter())
        n = sum(c.values())
        return n >= lm.LEAST and sum(k * math.log(k / n / self.smooth(s[1:], a)) for a, k in c.items()) > 0.5 * len(c) * math.log(n + 1)

    def score(self, t):
        raw, total = b"\n" * lm.DEPTH + symbols(t), 0.0
        for i in range(lm.DEPTH, len(raw)):
            s = next(raw[i - d : i] for d in range(lm.DEPTH, -1, -1) if not d or self.passes(raw[i - d : i]))
            total += math.log10(self.smooth(s, raw[i]))
        return total


def test_scores_are_those_of_a_plain_tree(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    tree = PlainTree([t for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2])
    monkeypatch.setattr(lm, "BATCH_BYTES", 20_000)  # several buckets
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    texts = dict(docs)
    assert sum(tree.passes(s) for s in list(tree.counts)[:20_000]) > 100
    assert {r.held_out for r in rows} == {True, False}
    for r in rows:
        want = tree.score(texts[r.doc_id])
        assert abs(r.score - want) < 2e-4 * len(symbols(texts[r.doc_id])), r.doc_id
        assert math.isclose(r.score, want, rel_tol=1e-4)


@pytest.mark.parametrize("kind", [np.uint64, np.int32, np.uint16, np.int64])
def test_squeezed_arrays_come_back(kind):
    x = np.random.default_rng(1).integers(0, 2**15, 1000).astype(kind)
    assert (lm.unsqueezed(lm.squeezed(x)) == x).all() and len(lm.unsqueezed(lm.squeezed(x[:0]))) == 0


def test_distributions_sum_to_one():
    codes = np.array([(c << 8) | a for c in (5, 9) for a in range(256)], np.uint64)
    count = np.random.default_rng(0).integers(0, 60, 512) * (np.arange(512) % 3 == 0)
    root = lm.Level(np.arange(256, dtype=np.uint64), count[:256] + count[256:], None)
    level = lm.Level(codes, count, root)
    assert math.isclose(root.used.sum(), 1) and np.allclose(level.smooth.reshape(2, -1).sum(1), 1) and np.allclose(level.used.reshape(2, -1).sum(1), 1)


def test_tree_grows_with_the_corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(5000)]
    kept = []  # a corpus whose vocabulary is not used up
    for n in (20_000, 160_000):
        code, count = lm.known_codes(lm.coded(*laid_out([" ".join(rng.choice(vocabulary, n))])), np.ones(1, bool))
        level = lm.above_roots(*lm.summed(lm.shorter(code, lm.ROOTS), count))
        retained = 0
        for depth in range(lm.ROOTS + 1, lm.DEPTH + 1):
            level = lm.Level(*lm.summed(lm.shorter(code, depth), count), level)
            retained += level.retained
        kept.append(retained)
    print("retained contexts", kept)
    assert kept[1] > 1.5 * kept[0] > 100


def check(rows, docs):
    train = Counter()
    for d, t in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    want = []
    for d, t in docs:
        ws = [*words(t), None]
        want.append((str(d), zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(ws), sum(w in train for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_base_and_model(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    rows = lm.op8_lm(spark, d).collect()
    check(rows, docs)


def test_model_beats_the_base_on_held_out_texts(spark):
    held = lm.op8_lm(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "A b"), (3, "a b " * 3000), (4, "x" * 50_000), (5, "a b"), (5, "a b"), (5, "c")]
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'k' as score", "1 as held_out", "2 as batch")).collect()
    check(rows, docs)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and all(r.score < 0 for r in rows)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
