import math
import re

from cuemill.llm import labelled_urls
from cuemill.llm import url_filter as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme/en/", "http://", "https://EXAMPLE.com/en/7?x", "http://a.example.com/en/71#t", "http://example.com/en/8", "http://xcom/en/1", "http://com/en/", "ftp://b.example.net/de/8/x?y://z", "http://net/de/9", "http://x.org?q=/es/", "http://Ä.org/es/ñ\n/x", "a://b://c/d", "http://h/" + "p" * 100_000]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(k, u, "h", "r", "v", 7, k) for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string, verdict string, bad_probability int, extra int")
    model = [0.0] * U.WEIGHTS + [-1.0]
    out = U.judge(df, model)
    assert sorted(out.columns) == sorted(df.columns + ["path"])
    rows = {r.page_id: r for r in out.collect()}
    assert all(r.extra == k and r.bad_probability < 0.5 for k, r in rows.items())
    for k, u in enumerate(URLS):
        host, path = split(u)
        rule, verdict = ruled(host, path)
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == (host, path, rule, verdict or "allow"), u
    assert U.judge(df.limit(0), model).count() == 0


def test_query_blocks_bad_hosts(spark):
    df = U.op4_url_filter(spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "html" not in plan
    rows = [r for r in df.collect() if r.rule is None]
    bad = [r for r in rows if re.search("spam-farm|casino|adult|bets", r.host)]
    good = [r for r in rows if r not in bad]
    assert bad and sum(r.verdict == "block" for r in bad) / len(bad) > 0.9
    assert sum(r.verdict == "allow" for r in good) / len(good) > 0.95


def test_held_out_words(spark):
    """URLs whose telling words occur nowhere in the training table."""
    words = lambda t: {w for u, _ in labelled_urls.rows(t) for w in re.findall("[a-z]{6,}", u.split("://")[1])} - {"example"}
    model = U.fit(U.labelled_urls(spark))
    back = U.labelled_urls(spark, labelled_urls.KEPT_BACK)
    assert len(words(labelled_urls.KEPT_BACK) - words(labelled_urls.LABELLED)) > 20
    out = [(r.bad, r.bad_probability) for r in U.judge(back, model, rules=[]).collect()]
    right = sum((p >= U.THRESHOLD) == bool(bad) for bad, p in out)
    auc = sum(p > q for b, p in out if b for c, q in out if not c) / 144
    print("held-out accuracy", right / len(out), "auc", auc)
    assert len(out) == 24 and right / len(out) >= 0.85 and auc > 0.93


def test_probability_is_that_of_a_plain_computation(spark):
    model = U.fit(U.labelled_urls(spark), steps=20)
    rows = U.with_parts(spark.createDataFrame([(u,) for u in URLS[:-1]], "url string")).withColumn("__slots", U.slots()).withColumn("p", U.probability(model)).collect()
    for r in rows:
        marked = ["^" + re.sub("[0-9]", "0", r[name]) + "$" for name in ("host", "path")]
        grams = [x[i : i + n] for x in marked for n in U.GRAMS for i in range(len(x) - n + 1)]
        assert len(r["__slots"]) == len(grams)
        z = model[-1] + sum(model[s] for s in r["__slots"]) / math.sqrt(max(1, len(grams)))
        assert math.isclose(r.p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert U.fit(U.labelled_urls(spark).limit(0)) == [0.0] * (U.WEIGHTS + 1)
