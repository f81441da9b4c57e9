"""The URL filter: parts, rules, features, and what the trees learn."""

import math
import re

import pytest
from pyspark.sql import functions as F

from runpulse.llm import url_filter
from runpulse.llm.queries import QUERIES, URL_RULES
from runpulse.llm.url_filter import LEXICAL, host_and_path, learn, lexical_features, matched_rule, with_verdicts

URLS = [
    None, "", "no scheme/de/", "http://", "https://EXAMPLE.net/en/1?a=1&b=2#x", "http://a.example.net/en", "http://net/",
    "http://xnet/", "http://x.net", "http://x.net?q", "http://x.net#/de/", "http://example.com/de/7", "http://Sub.Example.COM/de/",
    "http://example.com/DE/7", "http://notexample.com/de/", "http://x.org/fr/2.html", "http://x.org:80/fr/", "a://b://c/d?e://f",
    "http://x.org/fr", "http://É.net/ü?#", "HTTPS://x.y.z/a/b/c.PHP?x&y&z", "http://a.net/\n/x", "http://x.com/" + "9" * 50_000,
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(url):
    host, path = parts(url)
    fits = []
    for verdict, rule in URL_RULES:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, url, "x") for i, url in enumerate(URLS)]
    kinds = ["net/a", "net/en/", "com/de/", "com/en/", "org/fr/", "org/en/"]
    hosts = [("cheap-pills-%d", 0), ("lab%d", 1)]
    rows += [(1000 + i, f"https://{hosts[i % 2][0] % i}.{'example.' if i % 3 else ''}{kinds[i % 6]}{i}", None) for i in range(600)]
    return spark.createDataFrame(rows, "page_id long, url string, HOST string").withColumn("rule", F.lit("old"))


def test_parts_and_rules(spark, pages):
    host, path = host_and_path(F.col("url"))
    rule, verdict = matched_rule(F.col("h"), F.col("p"), URL_RULES)
    found = pages.select("url", host.alias("h"), path.alias("p")).select("*", rule.alias("r"), verdict.alias("v")).collect()
    for row in found:
        assert (row.h, row.p) == parts(row.url) and (row.r, row.v) == rule_of(row.url), row.url
    with pytest.raises(ValueError):
        matched_rule(F.col("h"), F.col("p"), [("maybe", "net/")])


def test_equally_long_rules_block_first(spark):
    row = spark.range(1).select(F.lit("a.bc").alias("h"), F.lit("/d").alias("p"))
    rules = [("allow", "a.bc/"), ("block", "bc/d"), ("block", "bc/"), ("allow", "bc/d")]
    text, verdict = matched_rule(F.col("h"), F.col("p"), rules)
    assert row.select(text, verdict).head()[:] == ("a.bc/", "allow")
    text, verdict = matched_rule(F.col("h"), F.col("p"), rules[1:])
    assert row.select(text, verdict).head()[:] == ("bc/d", "block")


def test_features(spark, pages):
    def plain(url):
        host, path = parts(url)
        url = url or ""
        shares = [url.count(c) / len(url) for c in set(url)]
        digits = lambda t: sum(c in "0123456789" for c in t) / len(t) if t else 0.0
        query = (re.search(r"\?([^#]*)", url) or ["", ""])[1]
        return {
            "url_length": len(url), "host_length": len(host), "path_length": len(path),
            "labels": host.count(".") + 1 if host else 0, "hyphens": (host + path).count("-"),
            "depth": sum(p != "" for p in path.split("/")), "digit_ratio": digits(url), "host_digit_ratio": digits(host),
            "entropy": -sum(s * math.log2(s) for s in shares), "parameters": query.count("&") + 1 if query else 0,
            "has_fragment": "#" in url, "is_secure": url.lower().startswith("https://"),
        }

    host, path = host_and_path(F.col("url"))
    split = pages.select("url", host.alias("h"), path.alias("p"))
    rows = split.select("url", *[c.alias(n) for n, c in lexical_features(F.col("url"), F.col("h"), F.col("p")).items()]).collect()
    for row in rows:
        expected = plain(row.url)
        assert set(expected) == set(LEXICAL)
        for name, value in expected.items():
            assert row[name] == pytest.approx(float(value), abs=1e-9), (row.url, name)


def test_verdicts(spark, pages):
    model = learn(pages, URL_RULES)
    found = with_verdicts(pages, URL_RULES, model)
    assert found.columns == ["page_id", "url", "HOST", "host", "path", "rule", "verdict", "block_score"]
    rows = {tuple(r)[0]: r.asDict() | {"host": tuple(r)[3]} for r in found.collect()}
    assert len(rows) == pages.count()
    for row in rows.values():
        rule, verdict = rule_of(row["url"])
        assert row["rule"] == rule and row["verdict"] in ("block", "allow") and 0 <= row["block_score"] <= 1
        if verdict:
            assert row["verdict"] == verdict
        else:
            assert row["verdict"] == ("block" if row["block_score"] >= 0.5 else "allow")
    ruled = [r for r in rows.values() if r["rule"]]
    assert sum((r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in ruled) >= 0.95 * len(ruled)
    again = {r[0]: r["block_score"] for r in with_verdicts(pages.repartition(5), URL_RULES, learn(pages.repartition(7), URL_RULES)).collect()}
    assert again == {k: r["block_score"] for k, r in rows.items()}


def test_held_out_labels(spark, pages):
    """Trees from some of the labelled URLs judge the others as the rules do."""
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    model = learn(pages.where(~held), URL_RULES)
    rows = with_verdicts(pages.where(held), URL_RULES, model).where("rule IS NOT NULL").collect()
    assert len(rows) > 30
    assert sum((r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in rows) >= 0.9 * len(rows)


def test_all_labelled_urls_are_learned_from(spark, monkeypatch):
    """More URLs than once were sampled: shares and counts are those of all, and several tasks learn."""
    n = F.col("id")
    kind = F.when(n < 24_000, F.concat(F.lit("pills"), n % 97, F.lit(".net/"))).otherwise(F.concat(F.lit("lab"), n % 89, F.lit(".org/fr/")))
    path = F.concat(F.when(n < 12, "rare/").otherwise("often/"), n)
    pages = spark.range(45_000).select(F.concat(F.lit("http://"), kind, path).alias("url"))
    monkeypatch.setattr(url_filter, "URLS_PER_TASK", 10_000)
    seen = []
    fit = url_filter.GBTClassifier.fit
    monkeypatch.setattr(url_filter.GBTClassifier, "fit", lambda self, rows: seen.append((rows.count(), rows.rdd.getNumPartitions(), self.getMaxBins())) or fit(self, rows))
    model = learn(pages.union(pages.limit(100)), URL_RULES)
    assert model.blocked == 24_000 / 45_000
    known = {(r.kind, r.suffix): (r.urls, r.share) for r in model.statistics.collect()}
    assert known["host_suffix", "net"][0] == 24_000 and known["host_suffix", "org"][0] == 21_000
    share = 24_000 / 45_000
    assert known["first_segment", "rare"] == (12, pytest.approx((12 + 20 * share) / 32))
    (rows, tasks, bins), = seen
    assert rows == 45_000 and tasks > 1 and bins**2 >= rows
    wrong = with_verdicts(pages, URL_RULES, model).where((F.col("block_score") >= 0.5) != (F.col("verdict") == "block"))
    assert wrong.count() == 0


def test_nothing_to_learn_from(spark, pages):
    none = pages.where("url IS NULL")
    assert learn(none, URL_RULES) is None and learn(pages.limit(0), URL_RULES) is None
    assert [r[-2:] for r in with_verdicts(none, URL_RULES, None).collect()] == [("allow", 0.0)]
    assert with_verdicts(pages.limit(0), URL_RULES, None).collect() == []


def test_query(spark):
    found = QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.001")
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = found.collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule_of(urls[r.page_id])[0]
        assert r.verdict == (rule_of(urls[r.page_id])[1] or ("block" if r.block_score >= 0.5 else "allow"))
