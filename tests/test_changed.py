"""Queries over damaged texts have to change some rows, or their equality with SQL says nothing."""

import pytest
from pyspark.sql import functions as F

from cuemill.functions import lang
from cuemill.plans import registry as R

SF = "/root/testdata/sf0.01"
DAMAGE = {
    "quotes_pipes_spaces": (6, {k: R.swap(*p) for k, p in R._QUOTES.items()}),
    "zero_one_in_word": (8, {k: R.swap(*p) for k, p in R._DIGITS.items()}),
    "midword_capitals": (8, {k: R.swap(*p) for k, p in R._DIGITS.items()}),
    "bracket_ellipsis_punct": (7, {k: R.swap(*p) for k, p in R._MARKS.items()}),
    "english_il_fixes": (6, {k: R.swap(*p) for k, p in R._IL.items()}),
    "italic_tidy": (5, {k: R.swap(*p) for k, p in R._TAGS.items()}),
    "fold_diacritics": (2, {}),
    "fix_list_words": (2, {}),
    "fix_list_rules": (2, {}),
}


@pytest.mark.parametrize("name", sorted(DAMAGE))
def test_rows_change(spark, name):
    before = R.damaged(spark, SF, *DAMAGE[name]).select("doc_id", F.col("text").alias("before"))
    assert R.QUERIES[name](spark, SF).join(before, "doc_id").filter("text <> before").count() > 20


def test_other_injections(spark):
    assert R.italic_spans(spark, SF).filter("spans <> ''").count() > 100
    assert R.allcaps_restore(spark, SF).filter(F.col("text").rlike(r"\p{Lu}{4,}")).count() > 100
    gate = [r.discard for r in R.dropped_gate(spark, SF).collect()]
    murky = [r.discard for r in R.placeholder_gate(spark, SF).collect()]
    assert len(gate) == len(murky) == 20 and any(murky)
    assert any(r.sdh for r in R.sdh_flag(spark, SF).collect())
    cased = R.sentence_case(spark, SF).filter(F.col("text").rlike(r"^\p{Ll}")).count()
    assert 0 < cased < 536


def test_counts_of_detected_languages(spark):
    """The counts that SURVEY 7.4 has for these texts."""
    docs = R.table(spark, SF, "documents").select("doc_id", "lang")
    found = {(r.lang, r.language): r["count"] for r in R.detect_language(spark, SF).join(docs, "doc_id").groupBy("lang", "language").count().collect() if r.language}
    assert found == {("en", "en"): 574, ("de", "de"): 122, ("fr", "fr"): 103, ("es", "es"): 36, ("fr", "en"): 1}


def test_detection_keeps_rows_apart(spark):
    rows = [(1, "and you know that the house is what they have for"), (1, "nicht und das ist der"), (None, "vous nous les avec pas mais est dans qui sur je nous"), (None, None), (2, "")]
    out = lang.detect(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.k), str(r.language)) for r in out.collect()) == [("1", "None"), ("1", "en"), ("2", "None"), ("None", "None"), ("None", "fr")]
