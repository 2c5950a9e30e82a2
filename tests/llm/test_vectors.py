import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cuemill.llm import ann, topk

NAN = float("nan")


def table(spark, name):
    rows = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def brute_topk(rows, every, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            best = sorted(((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), rng.normal(0, 0.2, 8).tolist()) for i in range(220)]
    data += [(int(i), [0.5] * 8) for i in range(220, 300)] + [(400, None), (450, [1.0] * 7 + [NAN]), (500, []), (550, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (600, [1.0, 2.0]), (650, [1e9] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = df.filter(topk.usable("embedding")).filter("vec_id is not null").select("vec_id", topk.quantised("embedding").alias("v"))
    queries = rows.filter("vec_id % 50 = 0").selectExpr("vec_id query_id", "v q")
    clashing = rows.selectExpr("*", "'x' as score", "1 as rank", "2 as name", "3 as query_id", "4 as d")
    for lists, block, depth in ((4, 64, 8), (3, 1000, 64), (4, 300, 6), (8, 16, 1)):
        got = sorted(map(tuple, topk.search(clashing, queries, 5, lists, block, depth).collect()))
        assert got == brute_topk(data, 50, 5)
    assert topk.search(rows.limit(0), queries.limit(0), 5).count() == 0


def test_topk_in_rounds_with_repeated_rows_and_large_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**29), 2**29, (90, 6))
    x[40:60] = x[39]  # ties
    x[5, 0] += 1
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 3
    rows = spark.createDataFrame(data, "vec_id long, v array<long>")
    monkeypatch.setattr(topk, "QUERIES", 10)
    got = sorted(map(tuple, topk.search(rows, rows.selectExpr("vec_id query_id", "v q"), 4, 4, 32, 8).collect()))
    want = []
    for q in range(90):
        best = sorted((-int(x[q] @ np.array(v)), i) for i, v in data if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert max(abs(s) for *_, s in got) > 2**53


def test_the_cutoff_saves_work():
    rng = np.random.default_rng(6)
    ids, x, q = np.arange(2048), rng.integers(-100, 100, (2048, 64)), rng.integers(-100, 100, (50, 64))
    own = np.full(50, -1)
    place, score, best = topk.heads_of(ids, x, own, q, 5, 4, topk.DEPTH)
    true = np.sort(q @ x.T, 1)[:, ::-1]
    assert (np.diff(score, axis=2) <= 0).all()
    assert (best[:, -1] <= true[:, 4]).all()  # safe
    scored = topk.score_lists(q, x, 4)
    assert all((np.take_along_axis(p, place[:, j], 1) == score[:, j]).all() and (score[:, j, 0] == p.max(1)).all() for j, p in enumerate(scored))
    cutoff = true[:, 4] * 5 // 4  # other blocks hold better rows
    at, row, total, work = topk.resolved(ids, x, own, q, place, score, cutoff, 5)
    assert sorted(zip(at.tolist(), total.tolist())) == sorted((i, int(v)) for i in range(50) for v in true[i, :5] if v >= cutoff[i])
    assert work < 0.1 * 4 * 50 * 2048
    print("list scores computed in phase 3:", work / (4 * 50 * 2048))


def test_topk_table(spark):
    ids, x = table(spark, "sf0.001")
    got = sorted(map(tuple, topk.op1_topk(spark, "/root/testdata/sf0.001").collect()))
    assert got == brute_topk(list(zip(ids.tolist(), x.tolist())), 50, 5)


def recall(got, ids, x, every, k):
    found = {}
    for q, rank, i, s in got:
        found.setdefault(q, []).append((s, i))
    hits = total = 0
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        assert len(found[q]) == k and found[q] == sorted(found[q])
        hits += len({i for _, i in found[q]} & set(ids[best].tolist()))
        total += k
        for s, i in found[q]:
            assert abs(s - d[ids == i][0]) < 1e-12
    return hits / total


def test_ann_recall(spark):
    ids, x = table(spark, "sf0.1")
    got = [tuple(r) for r in ann.op6_ann(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect()]
    r = recall(got, ids, x, 100, 10)
    print("recall", r)
    assert r >= 0.9


def test_ann_recall_with_many_lists(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(200_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "v": vectors}), tmp_path / "v.parquet", row_group_size=25_000)
    rows = spark.read.parquet(str(tmp_path / "v.parquet"))
    queries = rows.filter("vec_id % 2000 = 0").selectExpr("vec_id query_id", "v q")
    got = [tuple(r) for r in ann.search(rows, queries, 10).orderBy("query_id", "rank").collect()]
    r = recall(got, np.arange(len(x)), x.astype(float), 2000, 10)
    print("recall", r)
    assert r >= 0.95


def test_ann_odd_rows(spark):
    data = [(i, [float(i % 7), 1.0]) for i in range(30)] + [(100, None), (200, [0.0, NAN]), (300, [1.0]), (None, [1.0, 2.0])] + [(i, [3.5, 3.5]) for i in range(1000, 1400)]
    df = spark.createDataFrame(data, "vec_id long, v array<float>").filter("v is not null and vec_id is not null").filter(topk.usable("v"))
    out = ann.search(df, df.filter("vec_id % 100 = 0").selectExpr("vec_id query_id", "v q"), 10, shard=50).orderBy("query_id", "rank").collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[1000] == list(range(1001, 1011)) and by[1300] == list(range(1000, 1010)) and len(by[0]) == 10 and set(by) == {0, 1000, 1100, 1200, 1300}
    assert ann.search(df.limit(0), df.limit(0).selectExpr("vec_id query_id", "v q"), 10).count() == 0


def test_exact_switch(spark):
    x = np.random.default_rng(9).normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<float>")
    queries = df.filter("vec_id % 100 = 0").selectExpr("vec_id query_id", "v q")
    got = [tuple(r) for r in ann.search(df, queries, 10, exact=True).orderBy("query_id", "rank").collect()]
    assert recall(got, np.arange(3000), x.astype(float), 100, 10) == 1.0


def test_ann_repeated_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)).tolist()
    data = [(i, v) for i, v in enumerate(x) for _ in range(12 if i < 3 else 1)]  # one list holds them all
    df = spark.createDataFrame(data, "vec_id long, v array<double>").selectExpr("vec_id", "cast(v as array<float>) v")
    plain = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<double>").selectExpr("vec_id", "cast(v as array<float>) v")
    queries = plain.filter("vec_id % 10 = 0").selectExpr("vec_id query_id", "v q")
    rows = lambda t: [(r.query_id, r["rank"], r.vec_id) for r in ann.search(t, queries, 10).orderBy("query_id", "rank").collect()]
    got, y = rows(df), np.array(x)
    assert got == [(q, n + 1, i) for q in range(0, 60, 10) for n, i in enumerate(np.argsort(((y - y[q]) ** 2).sum(1))[1:11].tolist())]


@pytest.mark.parametrize("n", [1, 40, 700])
def test_graph_finds_the_nearest(n):
    rng = np.random.default_rng(n)
    g = ann.CentroidGraph(rng.normal(size=(n, 16)))
    q = rng.normal(size=(200, 16))
    ids, dist = g.nearest(q, 24)
    true = np.argmin(((q[:, None] - g.c[None]) ** 2).sum(2), 1)
    assert (ids[:, 0] == true).mean() > 0.95 and (np.diff(dist, axis=1) >= 0).all()
