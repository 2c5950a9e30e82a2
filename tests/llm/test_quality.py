import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuemill.llm import quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.op10_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = np.array([s for q, s in held if q]), np.array([s for q, s in held if not q])
    auc = (pos[:, None] > neg[None]).mean()
    print("auc", auc, "kept", (pos >= 0.3).mean(), "rejected", (neg < 0.3).mean())
    assert auc > 0.95 and (pos >= 0.3).mean() > 0.98 and (neg < 0.3).mean() > 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "x" * 300_000, 3), (2, "x" * 300_000, 3), (3, "fine words here.", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (2, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = model.score(docs).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.fit(docs, labels.limit(0)).score(docs.limit(0)).count() == 0


def test_risk_never_rewards_negative_parts():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (500, 3))
    u = np.concatenate([rng.normal(1, 1, (400, 3)), rng.normal(-2, 1, (100, 3))])
    m = quality.fit_nnpu(p, u, 0.8)
    z = ((u - m.mean) / m.scale) @ m.weight + m.bias
    assert (z[:400] > 0).mean() > 0.95 and (z[400:] < 0).mean() > 0.8


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(prior):
    rng = np.random.default_rng(int(100 * prior))
    p = rng.normal(1.5, 1, (4000, 4))
    n = int(6000 * prior)
    u = np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (6000 - n, 4))])
    assert abs(quality.estimated_prior(p, u[rng.permutation(6000)]) - prior) < 0.05


def test_features_are_those_of_a_plain_count(monkeypatch):
    """A row's features depend neither on its neighbours nor on the pieces that long texts are read in."""
    texts = ["A!! BB  cc\ncc", "", "!x", None, "!Y ~~ 12 a a b " * 400, "BBB"]
    together = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], together[k]), k
    monkeypatch.setattr(quality._counted, "__defaults__", (7,))
    assert np.allclose(quality.features(pa.array(texts)), together)
    raw = texts[0].encode()
    counts = quality._counted(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert counts[:256].tolist() == np.bincount(np.frombuffer(raw, np.uint8), minlength=256).tolist()
    assert counts[256:].tolist() == [1, 1, 1]


def test_hot_id_counts_once(spark):
    docs = spark.createDataFrame([(1, "good words in a row.")] * 300 + [(k, f"text {k} of words") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 20)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels).score(docs).count() == 338
