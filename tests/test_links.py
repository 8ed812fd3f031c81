"""Labelled link tables: shape of the links, rates, and independence from partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from linksift.functions import vocabulary as V
from linksift.plans import inputs as I
from linksift.sources import links as G

N = 20000


def test_rows_do_not_depend_on_partitions(spark):
    one = G.balanced_links(spark.range(0, 500, numPartitions=1))
    many = G.balanced_links(spark.range(0, 500, numPartitions=16).orderBy(F.col("id").desc()))
    assert sorted(one.collect()) == sorted(many.collect())
    assert one.count() == 1000 and one.select("id").distinct().count() == 1000
    other = G.balanced_links(spark.range(0, 500), seed=43)
    assert sorted(other.collect()) != sorted(one.collect())


def _rate(df, condition):
    return df.agg(F.avg(F.expr(condition).cast("double"))).first()[0]


def test_legit_rates(spark):
    short = G.legit_links(spark.range(N), style=G.SHORT).persist()
    assert _rate(short, "url like '%?id=%'") == pytest.approx(0.2, abs=0.02)
    subs = "|".join(V.SHORT_LEGIT_SUBDOMAINS)
    assert _rate(short, f"url rlike '://(www.)?({subs})[.]'") == pytest.approx(0.1, abs=0.02)
    assert short.filter("url not rlike '^https://'").count() == 0
    ids = short.filter("url like '%?id=%'").select(F.regexp_extract("url", r"id=(\d+)", 1).cast("int").alias("n")).agg(
        F.min("n"), F.max("n")
    )
    low, high = ids.first()
    assert 100 <= low < 200 and 9800 < high <= 9999
    long = G.legit_links(spark.range(N), style=G.LONG).persist()
    bare = r"url rlike '^https?://[^/?]+$'"
    assert _rate(long, bare) == pytest.approx(0.15, abs=0.02)
    assert _rate(long, "url like 'http://%'") == pytest.approx(1 / 13, abs=0.02)
    assert _rate(long, "url like '%?page=%&sort=popular'") == pytest.approx(0.05 * 0.85, abs=0.01)
    assert _rate(long, "url like '%?q=%'") == pytest.approx(0.10 * 0.85, abs=0.015)


def test_phishing_patterns(spark):
    words, tlds = "|".join(V.PHISHING_KEYWORDS), "|".join(re.escape(t) for t in V.PHISHING_TLDS)
    brands, paths = "|".join(V.PHISHING_BRANDS), "|".join(V.PHISHING_PATHS)
    tail = rf"({tlds})({paths})(\?token=\d{{6}}&redirect=true)?"
    forms = {
        "combo": rf"(http://|https://|http://www\.)({words})([-.]?)({words})(\3({words}))?\3({brands}){tail}",
        "fake": rf"(http://|https://|http://www\.)({brands})-(?P<w>{words})\.(com|org|net)\.(?P=w)-({words}){tail}",
        "ip": rf"http://(\d+)\.(\d+)\.(\d+)\.(\d+)/({brands})/login",
        "nested": rf"(http://|https://|http://www\.)({brands})\.com(\.({words})){{2,4}}{tail}",
    }
    urls = [r["url"] for r in G.phishing_links(spark.range(4000), brands=V.PHISHING_BRANDS).collect()]
    seen = dict.fromkeys(forms, 0)
    for url in urls:
        kinds = [k for k, form in forms.items() if re.fullmatch(form, url)]
        assert kinds, url
        seen[kinds[0]] += 1
        if kinds[0] == "nested":
            picked = re.findall(rf"\.({words})(?=\.)", url.split(".com", 1)[1])
            assert len(picked) == len(set(picked)), url
        if kinds[0] == "ip":
            octets = list(map(int, re.findall(r"\d+", url)[:4]))
            assert all(0 <= o <= 255 for o in octets) and octets[0] >= 1 and octets[3] >= 1
    assert all(850 < n < 1150 for n in seen.values()), seen


def test_many_keys_are_built_in_many_tasks(spark, data, monkeypatch):
    """A small file of many keys is one split, but each key takes two links to build."""
    plain = I.keys(spark, data)
    monkeypatch.setattr(I, "KEY_ROWS", 100)
    dealt = I.keys(spark, data)
    assert dealt.rdd.getNumPartitions() == -(-plain.count() // 100) > plain.rdd.getNumPartitions()
    assert sorted(dealt.collect()) == sorted(plain.collect())
