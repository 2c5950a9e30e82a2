import random

import pytest

import corpus_pipeline as P
from cuemill.llm import minhash, quality

tokenizers = pytest.importorskip("tokenizers")
D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, D)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    # the classifier rejects, and keeps texts as they are
    assert 0 < len(seen["quality"]) < len(texts) and all(r.text == texts[d] for d, r in seen["quality"].items())
    # one document of each group stays, and the groups are those of the operator
    sets = {d: set(zip(*[minhash_words(r.text)[i:] for i in range(5)])) for d, r in seen["near_dedup"].items()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) or not sets[a]
    assert seen["suffix_dedup"].keys() == seen["near_dedup"].keys()
    assert all(r.n_chars == len(r.text) <= len(texts[d]) for d, r in seen["suffix_dedup"].items())
    assert seen["mixing"].keys() < seen["suffix_dedup"].keys()
    library = tokenizers.Tokenizer.from_file(P.bpe.default_vocabulary())
    assert seen["bpe"].keys() == seen["mixing"].keys()
    assert all(r.token_ids == library.encode(seen["mixing"][d].text, add_special_tokens=False).ids for d, r in seen["bpe"].items())


def minhash_words(t):
    return t.lower().split()


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("the fine old words of a text".split()) + str(rng.randrange(999)) for _ in range(4000))
    rows = [(None, None, None, None, None, 1), (None, "", "en", "s", 0, 1), (5, long, "en", "s", 9, 2), (5, long, "en", "s", 9, 2), (6, long + " é", "fr", None, 9, 3), (7, "short", None, "t", 5, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, D)
        assert stage(spark, docs.limit(0), D).count() == 0, name
        out = out.collect()
        assert len(out) <= len(rows)
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in out) == ["5", "7", "None", "None"]


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(2)
    made = lambda n, size: [("%x" % rng.getrandbits(4 * size)).rjust(size, "g") for _ in range(n)]
    short, medium, fifty, half_a, half_b = made(51, 3), made(51, 5), made(50, 5), made(30, 5), made(30, 5)
    bulk = "".join(made(10, 45))
    body = lambda inner: " ".join([*made(40, 5), *inner, *made(40, 5)])
    inner = {1: short, 2: short, 3: medium, 4: medium, 5: fifty, 6: fifty, 7: half_a + half_b, 8: half_a, 9: half_b, 10: [bulk], 11: [bulk]}
    texts = {k: body(v) for k, v in inner.items()}
    texts[4] = texts[4].replace(" ", "\n")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.suffix_stage(spark, docs, D).collect()}
    for k in inner:
        words = texts[k].split()
        gone = range(40, 91) if k <= 4 else ()
        assert got[k].split() == [w for i, w in enumerate(words) if i not in gone] if k < 10 else bulk not in got[k]
