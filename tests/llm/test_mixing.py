import math
from collections import defaultdict

import numpy as np

from cuemill.llm import mixing


def plain(rows, power, budget):
    """Raking with dictionaries."""
    cells = defaultdict(float)
    for key, tokens in rows:
        cells[key] += tokens
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    goals = []
    for d in range(3):
        share = defaultdict(float)
        for k, v in w.items():
            share[k[d]] += v
        raised = {k: v**power for k, v in share.items() if v > 0}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(400):
        for d in range(3):
            now = defaultdict(float)
            for k, v in w.items():
                now[k[d]] += v
            w = {k: v * (goals[d].get(k[d], 0) / now[k[d]] if now[k[d]] else 0) for k, v in w.items()}
    lo, hi = 0.0, 1e15
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(t * min(1, mid * w[k] / t) for k, t in cells.items() if t) < budget * total else (lo, mid)
    return w, {k: min(1, hi * w[k] / t) if t else 0 for k, t in cells.items()}


def test_table_against_plain_raking(spark):
    d = "/root/testdata/sf0.01"
    rows = mixing.op5_mixing(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.n_tokens == len(texts[r.doc_id].split()) for r in rows[:200])
    w, p = plain([((r.source, r.lang, r.topic), r.n_tokens) for r in rows], 0.5, 0.5)
    for r in rows:
        k = (r.source, r.lang, r.topic)
        assert math.isclose(r.weight, w[k], rel_tol=1e-3, abs_tol=1e-9) and math.isclose(r.probability, p[k], rel_tol=1e-3, abs_tol=1e-9)
    tokens = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens for r in rows if r.drawn) / tokens - 0.5) < 0.12


def test_distributed_cells_and_odd_rows(spark):
    data = [(k % 50, "word " * (k % 37 + 1), ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4 if k % 5 else 0], k) for k in range(120)]
    data += [(None, None, None, None, 1), (1, "", "en", "a", 1), (2, "x " * 50_000, "en", "a", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, weight int")
    near = mixing.mix(df, rounds=3)
    assert near.count() == len(data) and near.columns.count("weight") == 1
    far = mixing.mix(df, cells_on_driver=1, rounds=3)
    key = lambda r: (str(r.doc_id), r.n_tokens, str(r.source), str(r.lang), r.topic, r.probability, r.drawn)
    a, b = (sorted(map(key, x.collect())) for x in (near, far))
    assert a == b  # the same probabilities to the last digit, and the same rows
    cells = {k[2:5]: [0, k[5]] for k in a}
    for k in a:
        cells[k[2:5]][0] += k[1]
    assert math.isclose(sum(n * p for n, p in cells.values()), 0.5 * sum(n for n, _ in cells.values()), rel_tol=1e-6)
    assert mixing.mix(df.limit(0)).count() == 0


def test_given_targets_are_met():
    rng = np.random.default_rng(1)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(2), 3), 4), np.tile(np.arange(3), 8)]
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.75, 0.25]), np.array([0.2, 0.5, 0.3])]
    w = mixing.rake(rng.integers(1, 1000, 24).astype(float), codes, goals)
    for code, goal in zip(codes, goals):
        assert np.allclose(np.bincount(code, weights=w), goal, atol=1e-6)


def test_scale_is_exact():
    rng = np.random.default_rng(2)
    tokens, ratio = rng.integers(1, 1000, 300).astype(float), rng.random(300) ** 4

    def sums(f):
        full = f * ratio >= 1
        return tokens[full].sum(), (tokens * ratio)[~full].sum()

    for share in (0.0, 0.01, 0.5, 0.99):
        f = mixing.scale_for(sums, share * tokens.sum())
        assert math.isclose((tokens * np.minimum(1, f * ratio)).sum(), share * tokens.sum(), rel_tol=1e-12)
    assert mixing.scale_for(sums, 2 * tokens.sum()) == float("inf")
