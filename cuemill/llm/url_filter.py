"""URL filters: host and path rules, then logistic regression on hashed character n-grams of host and path.

Main path of built-in functions only. The model is trained on a small labelled table of URLs (at most `TRAIN_ROWS` rows, checked), by
default the one that ships with the module: the same expressions hash its n-grams, digits counting as one character, and gradient steps on
the driver fit the weights, which enter the plan as one array literal. Scoring is a narrow projection that reads the url column alone.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is judged by the method; repeated rows
repeat; other columns pass through, but for own ones named host, path, rule, verdict and bad_probability, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import labelled_urls as table
from cuemill.llm.common import read_table

#: Bound of the labelled table, number of weights, n-gram lengths, and the probability from which the method blocks.
TRAIN_ROWS, WEIGHTS, GRAMS, THRESHOLD = 10_000, 4096, (3, 4), 0.5
#: verdict, host suffix, path prefix
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def labelled_urls(spark: SparkSession, rows: dict[int, str] = table.LABELLED) -> DataFrame:
    """url, bad (0 or 1), host, path of a labelled table."""
    return with_parts(spark.createDataFrame(table.rows(rows), "url string, bad int"))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path, which replace columns of these names."""
    u = F.col(url)
    start = F.instr(u, "://")
    rest = F.when(start > 0, F.substr(u, start + F.lit(3)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.drop("host", "path").withColumn("host", F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """rule (as `host/path`) and its verdict; of the rules that fit, the longest wins, the first listed of equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(name: str, n: int) -> Column:
    """Slots of the n-grams, built from the array of characters in linear time however long the text is."""
    plain = F.translate(name, "0123456789", "0000000000")
    chars = F.split(F.concat(F.lit("^"), plain, F.lit("$")), "")
    grams = chars
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(chars, k, F.size(chars)), lambda x, y: F.concat(x, y))
    return F.transform(F.filter(grams, lambda g: g.isNotNull()), lambda g: F.pmod(F.xxhash64(F.lit(name), g), F.lit(WEIGHTS)).cast("int"))


def slots() -> Column:
    """The weight slots of the n-grams of host and of path, the two marked apart; array<int>."""
    return F.concat(*[_grams(name, n) for name in ("host", "path") for n in GRAMS])


def fit(labelled: DataFrame, steps: int = 400, rate: float = 0.3, decay: float = 2e-4) -> list[float]:
    """WEIGHTS weights and the bias of a regularised logistic regression; features are slot counts over the number of n-grams' root."""
    rows = labelled.filter("bad is not null").select("bad", slots().alias("s")).limit(TRAIN_ROWS + 1).collect()
    if len(rows) > TRAIN_ROWS:
        raise ValueError(f"the labelled table is meant to be small: at most {TRAIN_ROWS} rows")
    if not rows:
        return [0.0] * (WEIGHTS + 1)
    rows = sorted((r["bad"], r["s"]) for r in rows)
    y = np.array([bad for bad, _ in rows], float)
    own = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows])
    slot = np.concatenate([np.array(s, np.int64) for _, s in rows])
    each = 1 / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(rows))))[own]
    w, b = np.zeros(WEIGHTS), 0.0
    m, v = np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1)
    for t in range(1, steps + 1):  # Adam
        z = b + np.bincount(own, weights=w[slot] * each, minlength=len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.append(np.bincount(slot, weights=e[own] * each, minlength=WEIGHTS) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return [*w.tolist(), float(b)]


def probability(model: list[float]) -> Column:
    weights = F.lit([float(x) for x in model[:-1]])
    s = F.col("__slots")
    total = F.aggregate(s, F.lit(0.0), lambda a, j: a + F.element_at(weights, j + 1))
    return 1 / (1 + F.exp(-(F.lit(model[-1]) + total / F.sqrt(F.greatest(F.size(s), F.lit(1))))))


def judge(pages: DataFrame, model: list[float], rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule, bad_probability and verdict."""
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.drop("rule", "verdict", "bad_probability")).withColumn("__slots", slots()).withColumn("bad_probability", probability(model)).drop("__slots")
    return parts.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_probability") >= THRESHOLD, "block").otherwise("allow")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "bad_probability")
