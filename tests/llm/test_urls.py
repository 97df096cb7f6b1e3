"""URL rules against a plain version, on urls of all shapes."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidepanel.llm import bindings, urlrules

SCHEMA = "page_id bigint, url string, row int, tokens string, verdict string, rule string, host int"


def plain(urls, rules=urlrules.RULES, support=urlrules.MIN_SUPPORT, least_rows=urlrules.MIN_ROWS, sure=urlrules.MIN_CONFIDENCE):
    """(host, path, rule, verdict) of each url by counting every combination of frequent tokens."""
    def low(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    parts, found, tokens = [], [], []
    for url in urls:
        _, mark, rest = (url or "").partition("://")
        before = re.split(r"[?#]", rest, maxsplit=1)[0] if mark else ""
        host, slash, path = before.partition("/")
        host, path = low(host), slash + path
        head = rest.split("#", 1)[0]
        query = head.split("?", 1)[1] if mark and "?" in head else ""
        parts.append((host, path))
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        found.append(max(fits, default=None))
        cut = lambda t, k: {k + w for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))}
        tokens.append(cut(host, "h:") | cut(path, "p:") | cut(query, "q:"))
    known = [i for i, f in enumerate(found) if f]
    least = max(least_rows, int(np.ceil(support * len(known))))
    often = {t for t, n in Counter(t for i in known for t in tokens[i]).items() if n >= least}
    counts: dict[frozenset, Counter] = {}
    for i in known:
        mine = sorted(tokens[i] & often)
        for k in range(1, len(mine) + 1):
            for c in itertools.combinations(mine, k):
                counts.setdefault(frozenset(c), Counter())[found[i][2]] += 1
    out = []
    for i, (host, path) in enumerate(parts):
        if found[i]:
            out.append((host, path, found[i][1], found[i][2]))
            continue
        best = {"allow": 0.0, "block": 0.0}
        for items, n in counts.items():
            if items <= tokens[i]:
                for v in best:
                    if n[v] >= least and n[v] / n.total() >= sure:
                        best[v] = max(best[v], n[v] / n.total())
        out.append((host, path, None, "block" if best["block"] > best["allow"] else "allow"))
    return out


def some_urls():
    draw = np.random.default_rng(5)
    pick = lambda *a: a[draw.integers(len(a))]
    urls = []
    for _ in range(400):
        host = pick("www.", "", "Blog.", "a-b.") + pick("spam", "news", "shop") + "." + pick("example.org", "example.com", "x.net", "notexample.org")
        path = pick("/es/", "/en/1", "/en/", "/de/", "/fr/", "") + pick("x", "y/z", "1", "")
        urls.append(pick("http", "https") + "://" + host + path + pick("", "?a=1&B=2", "#top", "?ref=spam#/es/"))
    return urls


ODD = [None, "", "nothing", "://", "http://", "http://org", "http://org/", "HTTP://EXAMPLE.ORG/ES/", "x://a.example.org/es/?://b", "a://b://c.org/",
       "http://org?/x", "http://com#/de/", "http://exa\nmple.org/es/\n1", "http://é.org/ü?ß=ñ", "http://example.org/en/1" + "/w" * 50_000, "http://.org/", "http://org./"]


def test_against_plain_counts(spark):
    urls = some_urls() + ODD + ["http://spam.x.net/es/x"] * 40
    rows = [(i if i % 9 else None, u, 1, "t", "v", "r", 2) for i, u in enumerate(urls)]
    got = urlrules.filter_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter((r[0], *p) for r, p in zip(rows, plain(urls), strict=True))
    assert Counter(map(tuple, got)) == want
    open_verdicts = Counter(r.verdict for r in got if r.rule is None)
    assert open_verdicts["block"] and open_verdicts["allow"]


def test_against_sql(spark):
    urls = some_urls() + [u for u in ODD if u is None or len(u) < 999]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = Counter(map(tuple, urlrules.filter_urls(frame).collect()))
    base = duckdb.connect()
    base.register("pages", frame.toPandas())
    assert got == Counter(base.execute(bindings.ORACLE["op11_urlrules"]).fetchall())


def test_mined_rules_are_pruned(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a", "c"], "block") for i in range(20)] + [(100 + i, ["b", "d", "e"], "allow") for i in range(10)]
    items, rules = urlrules.mine(spark.createDataFrame(rows, "row bigint, tokens array<string>, verdict string"))
    assert {(tuple(r["items"]), r.verdict, r.n, r.confidence) for r in rules.collect()} == {(("a",), "block", 20, 1.0), (("c",), "block", 10, 1.0), (("d",), "allow", 10, 1.0)}
    assert {(r.token, r.item) for r in items.collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "d")}


@pytest.mark.parametrize("urls", [[], [None, None], ["http://x.net/"], ["http://org/"]])
def test_small_tables(spark, urls):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = urlrules.filter_urls(frame).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == plain(urls)
