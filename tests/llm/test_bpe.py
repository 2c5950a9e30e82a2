import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cuemill.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    return bpe.PairIndexBpe(path), tokenizers.Tokenizer.from_file(path)


TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "hello  world", "it's we'll I'd  'd", "x\n y", "x \n y", "tab\tand  \n\n  lines ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
    "ça été Straße ñandú 日本語 😀😀   nbsp x  y \x85 z \x1c q", "aaaaaaaaaaaa" * 50, "1234 5678.90 %%% &&& ***", "\x00\x01 \x7f", "the the the" * 300, "á é", " 　 x", "trailing\n",
]


def test_ids_and_text_equal_the_library(both):
    ours, theirs = both
    ids, ends = ours.encode(TEXTS)
    for k, t in enumerate(TEXTS):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == want, t
    assert bpe.Pieces(bpe.default_vocabulary()).decode(ids, ends) == [theirs.decode(theirs.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in TEXTS]


def test_reset_of_the_memo_and_words_merged_in_groups(both, monkeypatch):
    ours, theirs = both
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 12))) for _ in range(200)) for _ in range(6)]
    texts += ["".join(rng.choice("aeinrst.,0") for _ in range(60_000)), "z" * 70_000]  # segments without blanks
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "MEMO_BYTES", 0)
    monkeypatch.setattr(bpe, "MERGE_BYTES", 50)
    for t, ids in zip(texts, want):
        assert ours.encode([t])[0].tolist() == ids
        assert ours.memo_bytes > 0
    ours._reset()
    assert ours.encode([])[0].tolist() == [] and ours.encode(texts)[0].tolist() == [i for ids in want for i in ids]
    ours._reset()


def test_long_texts_in_pieces(both, monkeypatch):
    ours, theirs = both
    rng = random.Random(5)
    monkeypatch.setattr(bpe, "LONG_TEXT", 300)
    for blank in (" ", "  ", " \n", "\u3000"):
        text = "".join(rng.choice(["word", "Über", "12", "it's", "<|endoftext|>", "!"]) + rng.choice([" ", " ", blank]) for _ in range(2000))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert len(list(ours.pieces(text))) > 5 and "".join(ours.pieces(text)) == text
        ids, ends = ours.encode([text])
        assert ids.tolist() == want and ends.tolist() == [0, len(want)]
        assert bpe.Pieces(bpe.default_vocabulary()).decode(ids, ends) == [theirs.decode(want, skip_special_tokens=False)]


def test_query_on_the_table(spark, both):
    rows = bpe.op3_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        e = both[1].encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_other_columns_pass_and_empty_tables_work(spark):
    df = spark.createDataFrame([(1, None, "k"), (None, "a b", None)], "doc_id long, text string, token_ids string")
    out = bpe.encode(df, bpe.default_vocabulary()).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert out[0].token_ids == [] and len(out[1].token_ids) == 2
    assert bpe.decode(bpe.encode(df.limit(0), bpe.default_vocabulary()), bpe.default_vocabulary()).count() == 0
