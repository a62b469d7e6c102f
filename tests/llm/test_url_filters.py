"""The cascade of Bloom filters and the rules against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import urlfilters


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def verdict(url, rules, listed):
    host, path = plain(url)
    fit = [(len(h + p), h + p, v == "allow") for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, rule, allow = max(fit)
        return host, path, rule, "allow" if allow else "block"
    return host, path, None, "block" if host + path in listed else "allow"


RULES = [("allow", "com", "/"), ("block", "a.com", "/en/"), ("allow", "www.a.com", "/en/"), ("block", "net", "/es"), ("block", "b.org", ""), ("allow", "x.b.org", "/é"), ("block", "both.de", "/"), ("allow", "both.de", "/")]
URLS = [
    None, "", "no scheme", "http://", "://", "HTTP://COM/", "http://a.com", "http://a.com/en/x?y#z", "http://WWW.a.com/en/", "https://x.www.a.com/en/1", "http://aa.com/en/", "ftp://n.net/esx", "ftp://net/es", "http://net:80/es", "http://b.org", "http://b.org?q=/", "http://x.b.org/é/1",
    "http://x.b.org/e", "http://.com/", "http://..com/", "http://com./", "http://both.de/1", "a://b://c/d", "http://Ä.com/É", "x\n://h/\np#", "http://h/" + "p/" * 20000, "http://" + "a." * 20000 + "com/", "http://h/listed", "http://h/listed?x", "http://h/other",
]


def test_urls(spark):
    rows = [(i, u, "z", True) for i, u in enumerate(URLS)] + [(None, "http://net/es", "z", None), (3, "http://net/es", "z", None), (3, "http://net/es", "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, best boolean")
    listed = ["h/listed", "h/listed", None, "gone/away", "", "net/es"]
    keys = spark.createDataFrame([(k, 1) for k in listed], "key string, url int")
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in urlfilters.judged(pages, RULES, keys).collect()), key=repr)
    assert got == sorted(((i, u, *verdict(u, RULES, listed)) for i, u, _, _ in rows), key=repr)
    assert urlfilters.judged(pages.limit(0), RULES, keys).count() == 0
    free = urlfilters.judged(pages, [], keys.limit(0))
    assert {r.verdict for r in free.collect()} == {"allow"} and free.where("rule is not null").count() == 0


def test_every_key_of_the_universe_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(urlfilters, "CHUNK", 16)
    rng = random.Random(3)
    keys = [f"{rng.random()}" for _ in range(60000)]
    listed = set(keys[:9000])
    df = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    found = urlfilters.cascade(df)
    assert len(found.levels) > 2
    wrong = found.asked(df, "got", lambda holds: holds(F.col("key"))).where("got <> listed")
    assert wrong.count() == 0
    assert urlfilters.cascade(df.where("not listed")).levels == []


def test_a_list_too_long_for_a_level_is_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i % 40}") for i in range(100)], "page_id long, url string")
    keys = spark.createDataFrame([(f"h/{i}",) for i in range(0, 40, 3)], "key string")
    want = sorted(urlfilters.judged(pages, [], keys).collect())
    monkeypatch.setattr(urlfilters, "MOST_BITS", 1)
    assert sorted(urlfilters.judged(pages, [], keys).collect()) == want
    with pytest.raises(ValueError):
        urlfilters.judged(pages, [("block", "h", "/1")], keys)
