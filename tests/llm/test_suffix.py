import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuemill.llm import suffix


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((gone, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def corpus(rng, unit):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passage = [" ".join(word() for _ in range(unit)) for _ in range(6)]
    texts = [None, "", "a", "ab" * unit * 4, "x" * unit * 9, "x" * unit * 7]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(passage)
            a, b = sorted((rng.randrange(len(t)), rng.randrange(len(t))))
            parts += [" ".join(word() for _ in range(rng.randrange(0, unit))), t[a:b] if rng.random() < 0.7 else t]
        texts.append(" ".join(parts))
    return texts + [texts[10], texts[10], texts[11] + "!"]


# 40 partitions are more than so small a table is worth: tasks merge them
@pytest.mark.parametrize("length,limit,parts", [(24, 2048, 3), (24, 1, 3), (400, 2048, 3), (24, 2048, 40)])
def test_equals_brute_force(spark, tmp_path, length, limit, parts):
    texts = corpus(random.Random(length + limit), 12 if length == 24 else 200)
    df = spark.createDataFrame([(None if k == 7 else k, t, "b") for k, t in enumerate(texts)], "doc_id long, text string, bytes string")
    df.write.parquet(str(tmp_path / "docs"))  # a table whose size is known
    df = spark.read.parquet(str(tmp_path / "docs")).repartition(parts)
    assert suffix.useful_partitions(df) == 8
    got = {r.doc_id: r for r in suffix.remove_repeats(df, length, edge_limit=limit).collect()}
    assert len(got) == len(texts)
    for k, (gone, kept) in enumerate(brute(texts, length)):
        r = got[None if k == 7 else k]
        assert r.bytes == "b" and bytes(r.kept) == kept, k
        assert sum(s.stop - s.start for s in r.repeats) == gone.sum()
        assert len(r.repeats) == int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())


def in_runs(strings, parts):
    runs = []
    for part in np.array_split(strings, parts):
        rows, counts = np.unique(part, axis=0, return_counts=True)
        runs.append((rows, counts))
    return runs


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_merge_gives_the_sorted_order_and_common_prefixes(letters):
    strings = np.random.default_rng(letters).integers(1, letters + 1, (400, 7)).astype(np.uint64)
    runs = in_runs(strings, 4)
    order, shared = suffix.merge_transforms([(suffix.transform(r), len(r)) for r, _ in runs])
    merged = np.concatenate([r for r, _ in runs])[order]
    assert (merged == merged[np.lexsort(merged.T[::-1])]).all()
    assert shared[0] == 0
    for a, b, n in zip(merged, merged[1:], shared[1:]):
        same = np.flatnonzero(a != b)
        assert n == (same[0] if len(same) else 7)
    count, kin = Counter(map(bytes, strings)), Counter(s[0] for s in {bytes(x): x for x in strings}.values())
    found = suffix.verdicts(order, shared, np.concatenate([c for _, c in runs]))
    stands = Counter()
    for r, v in zip(np.concatenate([r for r, _ in runs]), found):
        alone = kin[r[0]] == 1
        assert v in ((suffix.REPEAT, suffix.STANDS) if count[bytes(r)] > 1 else (suffix.ALONE,) if alone else (suffix.EDGE,))
        stands[bytes(r)] += v == suffix.STANDS
    assert all(stands[s] == (n > 1 and kin[np.frombuffer(s, np.uint64)[0]] > 1) for s, n in count.items())


def test_transform_is_a_transform():
    """Against suffixes sorted as Python tuples; and it can be inverted."""
    strings = np.unique(np.random.default_rng(1).integers(1, 4, (50, 7)).astype(np.uint64), axis=0)
    suffixes = sorted((tuple(s[j:].tolist()), i, int(s[j - 1]) if j else 0) for i, s in enumerate(strings) for j in range(8))
    bwt = suffix.transform(strings)
    assert bwt.tolist() == [c for _, _, c in suffixes]
    assert (suffix.inverted(bwt, len(strings)) == strings).all()


def test_long_texts_go_in_pieces():
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(5000))
    part = pa.RecordBatch.from_pydict({"text": [text]})
    seen = []
    for shift, data, offsets in suffix.pieces(part, 23, 700):
        assert len(data) <= 723
        _, p, lo, hi, gram = suffix.anchors(data, offsets, 24)
        symbols = suffix.symbols(data, p, lo, hi, gram, 24)
        seen += [(a + shift, b + shift) for a, b in zip(lo.tolist(), hi.tolist())]
        assert len(symbols) == len(p)
    assert [i for a, b in seen for i in range(a, b + 1)] == list(range(5000 - 23))


def test_frequent_anchor_is_split(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = "0" * 40  # holds one anchor's gram in many contexts
    texts = [" ".join(word() for _ in range(6)) + common + " ".join(word() for _ in range(6)) for _ in range(60)]
    texts += [texts[3], texts[5][10:], "".join(word() for _ in range(400)) + texts[7], "ü" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = df.select(F.col("doc_id").alias("__id"), F.col("doc_id").alias("__text"), "text")
    for hot in (20, 1 << 16):
        spans = {}
        for r in suffix.repeated_spans(plain, 24, hot=hot).collect():
            spans.setdefault(r["__id"], []).append((r.start, r.stop))
        for k, (gone, _) in enumerate(brute(texts, 24)):
            mask = np.zeros(len(gone), bool)
            for a, b in spans.get(k, []):
                mask[a:b] = True
            assert (mask == gone).all(), (hot, k)


def test_word_values_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(5)
    words = ["x" * rng.choice((1, 5, 900, 40000)) + str(rng.random()) for _ in range(60)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, stops, _ = suffix.word_bounds(data, np.array([0, len(data)]))
    whole = suffix.word_values(data, starts, stops)
    assert len(set(whole.tolist())) == len(set(words))
    monkeypatch.setattr(suffix, "SLICE_BYTES", 1000)
    assert (suffix.word_values(data, starts, stops) == whole).all()


def test_empty_table_and_query(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = {r.doc_id: r for r in suffix.op2_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for d, (gone, kept) in zip(docs, brute([d.text for d in docs], 400)):
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(gone), gone.sum(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [1 << 16, 40])
def test_runs_stay_large_and_levels_equal_brute_force(spark, monkeypatch, hot):
    """As many buckets as a large corpus has: the transforms of a shard don't get more and smaller, and shards are merged level by level."""
    texts = corpus(random.Random(8), 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df = df.select(F.col("doc_id").alias("__id"), F.col("doc_id").alias("__text"), "text")
    sent = []
    monkeypatch.setattr(suffix, "cut_lineage", lambda df, most=None, cut=suffix.cut_lineage: sent.append(cut(df, most)) or sent[-1])
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 2)
    monkeypatch.setattr(suffix, "FAN", 16, raising=False)
    monkeypatch.setattr(suffix, "SHARD_ANCHORS", 300)
    spans = {}
    for r in suffix.repeated_spans(df, 24, hot=hot).collect():
        spans.setdefault(r["__id"], []).append((r.start, r.stop))
    levels = [t for t in sent if "bucket" in t.columns]
    for t in levels:
        assert t.filter("bucket >= 0").groupBy("shard").count().agg(F.max("count")).first()[0] <= 16
    assert len(levels) == 3
    for k, (gone, _) in enumerate(brute(texts, 24)):
        mask = np.zeros(len(gone), bool)
        for a, b in spans.get(k, []):
            mask[a:b] = True
        assert (mask == gone).all(), k


def test_query_shows_what_is_kept(spark, tmp_path):
    """Passages of over 50 words and 400 bytes or more go from the text that the query returns; the rest of it stays."""
    rng = random.Random(9)
    made = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    planted, brief = " " + made(60, 7) + " ", " " + made(60, 4) + " "
    split = made(1, 399)
    parts = {0: planted, 1: planted, 2: brief, 3: brief}
    texts = {k: made(50, 6) + "W." + inner + "M." + made(50, 6) for k, inner in parts.items()}
    texts |= {4: made(90, 6), 5: None, 6: "", 7: "é" + split, 8: "©" + split}  # both end in the byte A9
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(planted) >= 400 > len(brief) + 4
    for (k, t), (gone, kept) in zip(texts.items(), brute(texts.values(), 400)):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(gone), gone.sum(), hashlib.sha256(kept).hexdigest())
        assert r.text == kept.decode(errors="replace"), k
        assert (r.text == (t or "")) == (r.n_removed == 0)
    assert got[7].text == got[8].text == "\ufffd"
    assert all(planted not in got[k].text for k in (0, 1)) and all(got[k].n_removed == 0 for k in (2, 3, 4))
