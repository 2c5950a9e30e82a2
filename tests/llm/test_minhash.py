import random
import re

import numpy as np
import pyarrow as pa

from cuemill.llm import minhash


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "ça"]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE Two"), (1005, "one two three four"), (None, "one two"), (1006, "x " * 9000)]
    for f in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for c in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((f * 40 + c, rng.choice([" ", "\t", "\n "]).join(words)))
    rows += [rows[20], rows[20], (rows[30][0], rows[40][1])]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 4)
    assert got(minhash.components(df, k=4)) == want
    monkeypatch.setattr(minhash, "BLOCK", 3)  # many blocks of a bucket, and no stars
    assert got(minhash.components(df, k=4, stars=())) == want


def test_empty_table(spark):
    assert minhash.components(spark.createDataFrame([], "doc_id long, text string"), k=4).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(minhash.op9_minhash(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in df.collect()], 4)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]  # similarity 0.6
    values = np.concatenate([a, b, pool[:1]])
    s = minhash.fast_sketch(values, np.array([0, 2000, 4000, 4001, 4001]), 512)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
    v, o = minhash.shingle_sets(pa.array(["a b c d e", "A  b c d\te", "a b", None]), 4)
    assert np.diff(o).tolist() == [2, 2, 1, 0] and (v[:2] == v[2:4]).all()


def test_pairs_of_cut_hashes_are_not_lost():
    """Sets that lost a shingle to a collision of 32-bit hashes, at exactly 80 %, and pairs that only chance could join."""
    one, two = np.arange(0, 89, dtype=np.uint32), np.arange(0, 80, dtype=np.uint32)
    far = np.arange(1000, 1100, dtype=np.uint32)
    near = np.concatenate((far[:88], np.arange(5000, 5012, dtype=np.uint32)))
    node, comp = np.array([4, 7, 9, 11]), np.array([4, 7, 9, 11])
    full = np.array([100, 90, 100, 100])  # truly 100 and 90 with 84 or more in common
    assert (4, 7) in minhash.joining_pairs(node, comp, [one, two, far, near], 80, full)
    assert not [p for p in minhash.joining_pairs(node[:2], comp[:2], [one, two], 80, np.array([140, 130])) if p != (4, 7)]
    sure = np.arange(0, 99, dtype=np.uint32)
    joined = minhash.joining_pairs(node[:3], comp[:3], [one[:89], np.arange(0, 90, dtype=np.uint32), sure[:89]], 80)
    assert len(joined) == 2  # one pair joins two components, the third is not asked again
