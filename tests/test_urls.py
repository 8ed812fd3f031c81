"""URL splitting and features against the standard library, on golden rows and fuzz."""

import csv
import io
import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F
from pyspark.sql import types as T

from linksift.functions import urls as U
from linksift.functions.vocabulary import (
    FEATURES,
    RISK_WORDS,
    SPECIAL_CHARACTERS,
    SUSPICIOUS_TLDS,
)

GOLDEN = """\
url,url_length,domain_length,path_length,num_dots,num_hyphens,num_subdomains,has_https,has_ip,has_at_symbol,num_special_chars,digits_in_domain,suspicious_tld,has_login,has_verify,has_secure,has_account,has_update,has_query
https://www.google.com/search?q=weather,39,14,7,2,0,2,1,0,0,3,0,0,0,0,0,0,0,1
http://secure-paypal-login.xyz/verify?token=456789,50,23,7,1,2,1,0,0,0,3,0,1,1,1,1,0,0,1
https://github.com/python/cpython,33,10,15,1,0,1,1,0,0,1,0,0,0,0,0,0,0,0
http://192.168.1.100/chase/login,32,13,12,3,0,3,0,1,0,1,10,0,1,0,0,0,0,0
https://www.amazon.com/dp/B08N5WRWNW,36,14,14,2,0,2,1,0,0,1,0,0,0,0,0,0,0,0
http://account-verify-secure.login.confirm.tk/auth,50,38,5,3,2,3,0,0,0,1,0,1,1,1,1,1,0,0
http://secure-paypal-login.xyz/verify?token=123,47,23,7,1,2,1,0,0,0,3,0,1,1,1,1,0,0,1
HTTPS://Evil.XYZ/LOGIN,22,8,6,1,0,1,1,0,0,1,0,0,1,0,0,0,0,0
http://evil.xyz:8080/a,22,13,2,1,0,1,0,0,0,2,4,0,0,0,0,0,0,0
http://u@1.2.3.4:80/p;x=1?#f,28,12,2,3,0,3,0,1,1,6,6,0,0,0,0,0,0,0
google.com/login,16,0,16,1,0,0,0,0,0,0,0,0,1,0,0,0,0,0
,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0
http://[bad/x,13,9,0,0,0,1,0,0,0,2,0,0,0,0,0,0,0,0
http://a.com/x;y/z;w?q=1#?h,27,5,6,1,0,1,0,0,0,7,0,0,0,0,0,0,0,1
https://a.com?,14,5,0,1,0,1,1,0,0,2,0,0,0,0,0,0,0,0
  https://b.tk,14,4,0,1,0,1,1,0,0,1,0,1,0,0,0,0,0,0
http://999.999.999.999/,23,15,1,3,0,3,0,1,0,1,12,0,0,0,0,0,0,0
"""


def expected_parts(url):
    try:
        p = urlparse(url)
        return (p.scheme, p.netloc, p.path, p.query, False)
    except ValueError:
        return ("http", "error.com", "", "", True)


def expected_features(url):
    scheme, netloc, path, query, _ = expected_parts(url)
    low = url.lower()
    row = [
        len(url),
        len(netloc),
        len(path),
        url.count("."),
        netloc.count("-"),
        netloc.count("."),
        int(scheme == "https"),
        int(bool(re.search(r"\d{1,3}(\.\d{1,3}){3}", netloc))),
        int("@" in url),
        sum(map(SPECIAL_CHARACTERS.count, url)),
        sum(map(str.isdigit, netloc)),
        int(netloc.endswith(tuple(SUSPICIOUS_TLDS))),
        *(int(w in low) for w in RISK_WORDS),
        int(bool(query)),
    ]
    return tuple(row)


def fuzz(n, seed=7):
    rng = random.Random(seed)
    pieces = [
        "http", "https", "HTTP", "ftp", "tel", "mailto", "x+y.z-1", "1a", "://", ":", "//", "/",
        "?", "#", ";", "@", "[", "]", "[::1]", "[1::2%eth0]", "[1:2:3:4:5:6:7:8]", "[v1.a]",
        "[v.a]", "[1.2.3.4]", "[::1.2.3.4]", "[::01.2.3.4]", "[1::2::3]", "[:1]", "[1:2]",
        "[::1%]", "[1:2:3:4:5:6:7::]", "[::1%a%b]", ".", "-", "a", "Z", "login", "VERIFY",
        "xyz", ".xyz", ".tk", "com", "1.2.3.4", "999", "٣", "²", "①",
        "℀", "／", "：", "é", "K", "İ", "\U0001f100", "\U0001d7ce",
        " ", "\t", "\n", "\r", "\x00", "\x1f", "\x85", "　", "%41", "=", "&", "+", "\\", "'",
        "secure", "account", "update", "8080", "{", "}", "|", "~", "_",
    ]
    out = []
    for _ in range(n):
        body = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        start = rng.choice(["", "http://", "https://", "http://", "//", " ", "a:"])
        out.append(start + body)
    return out


def as_table(spark, urls):
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("url", T.StringType())]
    )
    return spark.createDataFrame(list(enumerate(urls)), schema)


def test_golden_rows(spark):
    rows = list(csv.DictReader(io.StringIO(GOLDEN)))
    got = U.with_url_features(as_table(spark, [r["url"] for r in rows])).orderBy("id").collect()
    for want, have in zip(rows, got):
        assert {f: int(want[f]) for f in FEATURES} == {f: have[f] for f in FEATURES}, want["url"]


def test_fuzz_equals_standard_library(spark):
    urls = fuzz(12000) + list(csv.reader(io.StringIO(GOLDEN)))[1][:1]
    df = U.with_url_features(as_table(spark, urls), keep_parts=True)
    for row in df.collect():
        assert tuple(row[c] for c in U.PARTS) == expected_parts(row["url"]), repr(row["url"])
        assert tuple(row[c] for c in FEATURES) == expected_features(row["url"]), repr(row["url"])


def test_every_digit_and_every_blank(spark):
    digits = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isdigit()]
    urls = [f"http://a{d}b.com/" for d in digits]
    got = U.with_url_features(as_table(spark, urls)).agg(F.min("digits_in_domain")).collect()
    assert got[0][0] == 1
    blanks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    table = as_table(spark, [f"{b}http://a{b}b{b}{b}" for b in blanks])
    got = table.select("id", U.normalise_url(F.col("url")).alias("u")).orderBy("id").collect()
    assert [r["u"] for r in got] == [f"http://a{b}b" for b in blanks]


def test_normalise_and_blanks(spark):
    urls = ["google.com/login", " httpbin.org ", "HTTPS://x", "", "   ", None, "http://a"]
    df = as_table(spark, urls)
    for prefix in ("https://", "http://"):
        got = [r["url"] for r in U.typed_urls(df, prefix=prefix).orderBy("id").collect()]
        assert got == [prefix + "google.com/login", "httpbin.org", prefix + "HTTPS://x", "http://a"]


def test_null_url_gives_nulls_and_a_reject(spark):
    df = as_table(spark, [None, "http://a.b"])
    good, bad = U.split_rejects(df)
    assert (good.count(), bad.count()) == (1, 1)
    row = U.with_url_features(bad, keep_parts=True).collect()[0]
    assert all(row[c] is None for c in FEATURES + U.PARTS)


def test_features_are_one_map_stage(spark, data, capsys):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    U.with_url_features(pages.select("page_id", "url")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
