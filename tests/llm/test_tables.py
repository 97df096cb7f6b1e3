"""WARC, extraction, vectors, bit slices and mixing against plain versions on small fixtures."""

import base64
import collections
import gzip
import hashlib
import re

import numpy as np
import pytest

from tidepanel.llm import bitslice, extract, hnsw, mixing, warc

# --- WARC -----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://b\r\nX: y", None),
    (4, "u", ""), (6, "é", "été " * 20_000), (7, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.0\r\n"), (8, "z", "\r\n\r\n" * 9),
]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload_bytes", "2 AS _key")
    got = {r.page_id: r for r in warc.archive_pages(frame).collect()}
    assert len(got) == len(PAGES)
    last = {}
    for key, _, html in PAGES:
        last[html or ""] = max(key, last.get(html or "", 0))
    for key, _, html in PAGES:
        r, data = got[key], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), sha(data))
        first = last[html or ""] == key
        assert (r.record_type, r.refers_to) == ("response" if first else "revisit", None if first else last[html or ""])
    assert warc.archive_pages(frame.limit(0)).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, "u" * 40, "x" * (200 if i % 10 else 60_000 + i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archive(frame, str(tmp_path), file_bytes=1 << 17, small_record=1 << 12)
    files = warc.read_files(spark, str(tmp_path))
    sizes = [r.length for r in files.select("length").collect()]
    assert max(sizes) <= 1 << 17 and len(sizes) > 3
    records = warc.read_archive(files, keep_payload=False)
    got = {r.page_id: r.payload_bytes for r in warc.page_records(records).collect()}
    assert got == {i: len(h) for i, _, h in rows}


def test_repeated_and_missing_keys(spark):
    rows = [(4, "u", "x"), (4, "u", "x"), (None, "u", "x"), (None, None, "y")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(4, "response", None), (4, "response", None), (None, "revisit", 4), (None, "response", None)], key=str
    )


def record(name, payload, **headers):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    told = {"WARC-Type": "response", "Content-Type": "application/http", "WARC-Record-ID": f"<urn:record:{name}>", "WARC-Block-Digest": "sha1:" + sha(block)} | headers
    head = "".join(f"{k}: {v}\r\n" for k, v in told.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def names(data):
    return [(k, a, b, r[0]["warc-record-id"][12:-1] if k == "record" else r) for k, a, b, r in warc.salvage(data)]


@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "length", "header"])
def test_salvage_of_plain_archives(harm):
    one, two, three = (record(n, f"payload {n} ".encode() * 30) for n in (1, 2, 3))
    hurt = {
        "flip": two[:-40] + b"#" + two[-39:], "cut": two[: len(two) // 2], "junk": b"\x00junk" * 7,
        "length": two.replace(b"Content-Length: ", b"Content-Length: 9"), "header": two.replace(b"WARC-Type: ", b"WARC-Type "),
    }[harm]
    got = names(one + hurt + three)
    assert [g[0] for g in got] == ["record", "gap", "record"] and [got[0][3], got[2][3]] == ["1", "3"]
    assert (got[1][1], got[1][2]) == (len(one), len(one) + len(hurt))


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record(n, b"p%d" % n * 500), mtime=0) for n in range(4)]
    whole = names(b"".join(parts))
    assert [g[3] for g in whole] == ["0", "1", "2", "3"] and whole[-1][2] == sum(map(len, parts))
    parts[1] = parts[1][:20] + bytes(b ^ 255 for b in parts[1][20:30]) + parts[1][30:]
    got = names(b"".join(parts) + parts[3][:25])
    assert [g[0] for g in got] == ["record", "gap", "record", "record", "gap"]
    assert names(b"") == [] and names(b"nothing")[0][:3] == ("gap", 0, 7)


def test_salvage_of_damaged_first_records_and_mixed_archives():
    body = gzip.compress(b"gzip-encoded body " * 20, mtime=0)
    one, two, three = (record(n, body) for n in (1, 2, 3))
    got = names(b"X" + one[1:] + two + three)
    assert [(g[0], g[3]) for g in got] == [("gap", "version line"), ("record", "2"), ("record", "3")]
    member = gzip.compress(record(4, b"m" * 99), mtime=0)
    got = names(member + two + member + b"junk" + member + two[:30] + three)
    assert [g[0] for g in got] == ["record", "record", "record", "gap", "record", "gap", "record"]
    assert [g[3] for g in got if g[0] == "record"] == ["4", "2", "4", "4", "3"]
    assert [(a, b) for _, a, b, _ in got][1:3] == [(len(member), len(member + two)), (len(member + two), len(member + two + member))]


def test_long_headers():
    long = record(1, b"x", **{"WARC-Target-URI": "data:," + "a" * 100_000})
    assert [(g[0], g[3]) for g in names(long + record(2, b"y"))] == [("record", "1"), ("record", "2")]


def test_reader_reports_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1, b"x") + b"broken" + record(2, b""))
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.read_archive(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("start").collect()
    assert [(r.kind, r.payload and bytes(r.payload), r.payload_bytes) for r in rows] == [("record", b"x", 1), ("gap", None, None), ("record", b"", 0)]
    assert rows[1].reason == "version line" and rows[1].end - rows[1].start == 6


# --- extraction -----------------------------------------------------------------------------------

LONG = "Sentence number one of the article, which goes on for a while. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text only", "plain text only"), ("<html><body></body></html>", ""), ("a &lt; b &eacute; &#x41;", "a < b é A"),
        ("<title>t</title><script>if (a<b) x('</p>')</script><p>one\n  two<p>three", "one two\nthree"),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>Title</h1><p><b>{LONG}<br><p>Short.</article><footer>&copy; x</footer>",
         "Title\n" + LONG.strip() + "\nShort."),
        (f"<div id=main><div class='post-body'><p>{LONG}</p><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>",
         LONG.strip() + "\n" + LONG.strip()),
        (f"<body><header><h1>Site</h1></header><main><p>{LONG}</p><ul><li>a<li>b</ul><p>End</p></main><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form>",
         LONG.strip() + "\na\nb\nEnd"),
        ("<p title='unclosed>one</p><p>two", "one\ntwo"), ("<article><p>x</p></article", "x"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<", "<"),
    ],
)
def test_main_text(page, text):
    assert extract.main_text(page) == text


BODY = f"<div id=main><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"


@pytest.mark.parametrize("tag", ["p", "blockquote", "pre", "h1", "div"])
def test_branches_beside_the_article_count_by_density(tag):
    lead = "The lead of the article stands in front. " * 8
    assert extract.main_text(f"<body><{tag}>{lead}</{tag}>{BODY}").startswith("The lead of the article")


def test_wrapped_branches_count():
    page = f"<body>{BODY}<div><div><div><p>Second half. {LONG}</p><p>{LONG}</p></div></div></div>"
    assert extract.main_text(page).count("Sentence number one") == 20 and "Second half." in extract.main_text(page)


def test_words_of_chrome_inside_an_article():
    page = (
        f"<article><p>{LONG}</p><section id=discussion><h2 id='related-work'>Related</h2><p>{LONG}</p></section>"
        f"<div class='share-of-market'><p>Market.</p></div><div class=share><p>Share it.</p></div></article>"
    )
    got = extract.main_text(page)
    assert "Related" in got and got.count("Sentence number one") == 8 and "Market." in got and "Share it." not in got


WRAPPERS = [
    "<div data-id='nav-1'>", "<div data-role=search>", "<div title='my id=ad here'>", "<p data-hidden=x>", "<div style='overflow: hidden ;'>",
    "<div style='overflow:hidden !important'>", "<div class='layout has-sidebar'>", "<div class='container overflow-hidden'>",
    "<div class=social-history>", "<section id=search-theory>", "<my-article>", "<div class=widget>", "<form id=aspnetForm><div>", "<div hidden>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_keep_their_article(wrapper):
    menu = "<div class=menu><a href=/>Home</a> <a href=/a>About</a></div><div class=ad>Buy this now.</div>"
    page = f"<body>{menu}{wrapper}<p>One. {LONG}</p><p>Two. {LONG}</p></div><div class='site-nav'><a href=/>Top</a></div><div class=comments><p>Nice!</p></div>"
    assert extract.main_text(page) == f"One. {LONG.strip()}\nTwo. {LONG.strip()}"


def test_lists_of_terms_and_custom_elements_leave_menus_out():
    terms = "".join(f"<dt>Term {i}<dd>{LONG}" for i in range(3))
    menu = "<div><a href=/1>A</a> <a href=/2>B</a> <a href=/3>C</a> <a href=/4>D</a></div>"
    for page in (f"{menu}<dl>{terms}</dl>", f"{menu}<x-page><p>{LONG}</p><p>{LONG}</p></x-page>"):
        got = extract.main_text(page)
        assert "A B" not in got and got.count("Sentence number one") in (8, 12)


def test_adverts_of_a_short_page_stay_out():
    assert extract.main_text(f"<div class=ad>{LONG}</div><article><p>Short.</article>") == "Short."
    assert extract.main_text(f"<div class=ad>{LONG}</div>") == "" == extract.main_text(f"<div class=comments><p>{LONG}<p>{LONG}</div>")


def plain_sums(node, share):
    """Characters, tags, link characters, link tags, density of an element, and (element, sum) of all below: by recursion."""
    chars = tags = link_chars = link_tags = 0
    total, below = 0.0, []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                chars += len(child)
                total += len(child)
            continue
        c, t, lc, lt, density, sums = plain_sums(child, share)
        chars, tags, link_chars, link_tags, total = chars + c, tags + t + 1, link_chars + lc, link_tags + lt, total + density
        below += sums
    if node.tag == "a":
        link_chars, link_tags = chars, tags + 1
    density = 0.0
    if chars:
        base = np.log(chars / max(1, chars - link_chars) * link_chars + share * chars + np.e)
        density = chars / max(1, tags) * max(0.0, np.log(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / base
    return chars, tags, link_chars, link_tags, density, [*below, (node, total)]


def test_sums_equal_plain_recursion():
    page = f"<div><p>{LONG}<a href=x>link <b>bold</b></a></p><ul><li><a href=y>one</a><li>two</ul></div><my-box>own text<div>{LONG}</div></my-box>"
    root = extract.tree(page)
    order = extract.measure(root)
    share = root.link_chars / root.chars
    found = {id(n): (n, s) for n, s in plain_sums(root, share)[5]}
    assert len(found) == len(order) and root.density == pytest.approx(plain_sums(root, share)[4])
    for node in order:
        assert node.total == pytest.approx(found[id(node)][1] if node.container else 0.0)


def test_deep_and_long_pages():
    assert extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    body = "".join(f"<p>paragraph {i} with some words" for i in range(20_000))
    assert extract.main_text(body).count("\n") == 19_999


def test_extraction_of_a_table(spark):
    rows = [(1, "u", "<p>é &amp; ö"), (2, None, None), (2, None, None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "9 AS text", "8 AS n_chars")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract.page_texts(frame).collect())
    assert got == [(1, "é & ö", 5), (2, "", 0), (2, "", 0)]
    assert extract.page_texts(frame.limit(0)).count() == 0


# --- vectors --------------------------------------------------------------------------------------


def vector_rows():
    draw = np.random.default_rng(7)
    rows, key = [], 0
    for label in (0, 1, 1, 1, None):
        for _ in range(40):
            centre = draw.normal(size=16)
            for spread in (0.0, 0.0, 0.02, 0.05, 0.1):
                rows.append((key, (centre + spread * draw.normal(size=16)).astype(np.float32).tolist(), label))
                key += 1
    centre = draw.normal(size=16)
    rows += [(key + i, (centre + 0.03 * draw.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(200)]
    key = len(rows)
    rows += [(key, None, 1), (key + 1, [0.0] * 16, 1), (key + 2, [float("nan")] * 16, 1), (key + 3, [None] * 16, 1),
             (key + 4, [float("inf")] + [1.0] * 15, 1), (key + 5, [], 1), (key + 6, [1.0, 2.0], 1), (key + 7, [2.0, 4.0], 1)]
    return rows


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_vector_links_equal_brute_force(spark, shard_rows):
    rows = vector_rows()
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = collections.Counter()
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in {(r[2], len(r[1])) for r in good}:
        own = [r for r in good if (r[2], len(r[1])) == group]
        x = np.array([r[1] for r in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98 - 1e-12, 1))):
            a, b = own[i][0], own[j][0]
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS class", "2 AS shard")
    got = hnsw.near_vectors(frame, shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        r[0]: (links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows
    }


def test_vectors_repeated_and_missing(spark):
    rows = [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (9, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    got = sorted(map(tuple, hnsw.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == sorted([(3, 3, 3, True)] * 2 + [(9, 3, 3, False), (None, 3, 3, True), (None, 0, None, True)], key=str)
    assert hnsw.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_wide_beams_take_few_steps(monkeypatch):
    """Each step orders the whole beam, so the steps of a wide beam must not grow with it; it finds what a scan finds."""
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(1500, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    layers = hnsw.build(vectors, np.arange(1500))
    steps, order = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: steps.append(1) or order(*a, **b))
    found, near = hnsw.beam_search(vectors[:64], vectors, layers[-1][1], np.full((64, 1), layers[0][0][0]), 256)
    monkeypatch.undo()
    assert len(steps) < 40
    assert (np.diff(near, axis=1) <= 0).all() and all(len(set(row)) == 256 for row in found.tolist())
    best = order(-(vectors[:64] @ vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.tolist(), found.tolist(), strict=True)]) >= 0.98


def test_graph_recall_without_scans():
    """The graph alone, before audits widen the beam, finds nearly all close pairs of random clusters."""
    draw = np.random.default_rng(8)
    x = np.repeat(draw.normal(size=(300, 32)), 5, axis=0) + 0.1 * draw.normal(size=(1500, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    layers = hnsw.build(x, np.arange(1500))
    ids, _ = hnsw.search(x[:200], x, layers, 32)
    true = x[:200] @ x.T >= 0.95
    found = np.zeros_like(true)
    found[np.arange(200)[:, None], ids] = True
    assert (found & true).sum() >= 0.97 * true.sum()


def test_audit_without_links_in_the_sample():
    """A graph without edges finds nothing; the audit tells so although no audited query has a link."""
    draw = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    shard, queries = unit(draw.normal(size=(2000, 32))), unit(draw.normal(size=(1000, 32)))
    queries[1::7] = shard[:143]
    layers = [(np.arange(2000), np.full((2000, 4), -1, np.int64))]
    at, to, beam, _ = hnsw.shard_links(queries, np.arange(5000, 6000), shard, np.arange(2000), layers, 0.98)
    assert sorted(zip(at.tolist(), to.tolist())) == [(1 + 7 * i, i) for i in range(143)]
    assert beam == 2000


def test_graphs_are_asked_and_their_recall_is_reported(spark):
    """5,000 vectors in several graphs: no task scans its shard, audits pass, and links equal brute force."""
    draw = np.random.default_rng(10)
    x = np.repeat(draw.normal(size=(2500, 16)), 2, axis=0) + 0.03 * draw.normal(size=(5000, 16))
    x = x.astype(np.float32)
    rows = [("a", 16, i, 1, v.tolist()) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "label string, width int, class bigint, copies bigint, vector array<float>")
    found = hnsw.searched(classes, shard_rows=1250)
    tasks = hnsw.audits(found).collect()
    assert len(tasks) == 16 and all(t.graph and t.rows > 300 and t.recall >= 0.95 for t in tasks)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    got = {r["class"]: r.n for r in found.filter("class >= 0").groupBy("class").agg({"weight": "sum"}).toDF("class", "n").collect() if r.n}
    true = {i: int(n) for i, n in enumerate(near.sum(axis=1)) if n}
    assert sum(got.values()) >= 0.995 * sum(true.values()) and all(n <= true[i] for i, n in got.items())


def test_bit_slices_equal_integer_products(spark):
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(12)]  # ties
    rows += [(400, [1e6, -1e6]), (401, []), (402, [0.0] * 5), (450, None), (451, [float("nan")] * 5), (None, [1.0] * 5), (50, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS block")
    usable = [(k, np.floor(256 * np.array(v, float)).astype(np.int64)) for k, v in rows if k is not None and v is not None and np.isfinite(np.array(v, float)).all()]
    want = set()
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b))), k) for k, b in usable if k != q)
            want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])}
    got = bitslice.neighbours(frame)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["query_id", "rank", "vec_id", "score"]
    whole = frame.filter(bitslice.usable(frame.embedding)).select("vec_id", bitslice.quantised(frame.embedding).alias("v"))
    small = bitslice.top_k(whole.filter("vec_id % 50 = 0"), whole, 5, block_rows=64, batch_queries=2)
    assert {tuple(r) for r in small.collect()} == want
    assert bitslice.neighbours(frame.limit(0)).count() == 0
    assert bitslice.top_k(whole.filter("vec_id = 0"), whole.filter("vec_id in (0, 7)"), 5).count() == 1


# --- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix_meets_targets(spark):
    draw = np.random.default_rng(10)
    rows = []
    for source, n in ((None, 150), ("b", 400), ("a", 40), ("é", 90), ("Z", 300), ("c", 1), ("d", 700)):
        rows += [(len(rows) + i, " ".join(["w"] * int(k)), source) for i, k in enumerate(draw.integers(0, 60, n))]
    rows += [(9000, None, "b"), (9001, "", "a"), (None, "one two", "b"), (7, "x y z", "b"), (7, "x y z", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS copies", "3 AS n")
    got = mixing.mix_documents(frame).collect()
    again = mixing.mix_documents(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {s: 0 for _, _, s in rows}
    for _, text, s in rows:
        size[s] += len((text or "").split())
    target = plain_targets(size)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(size[s], round(target[s], 6)) for s in size})
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    taken = collections.Counter()
    planned = mixing.plan(mixing.document_sizes(frame)).collect()
    for r in planned:
        taken[r.source] += r.size * r.copies
    for s in size:
        assert abs(taken[s] - target[s]) <= 60, s
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.copies for r in planned)


def test_rounding_keeps_expectations(spark):
    """Over many seeds every document is chosen about as often as its fraction says."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34]
    chosen = np.zeros(8)
    units = spark.range(8).selectExpr("'s' AS source", "element_at(array(1,2,3,5,8,13,21,34), cast(id + 1 AS int)) * 1L AS size", "id AS key", "id AS doc_id", "1 AS n", "0.3D AS p")
    out = [mixing.pivotal(units, 4, seed=100 * s) for s in range(12)]
    for frame in out:
        rows = frame.collect()
        assert sorted(r.doc_id for r in rows) == list(range(8))
        total = sum(sizes[r.doc_id] * r.chosen for r in rows)
        assert abs(total - 0.3 * sum(sizes)) <= max(sizes)
        for r in rows:
            chosen[r.doc_id] += r.chosen
    assert 0.1 <= chosen[:6].sum() / 72 <= 0.6


def test_mix_of_nothing(spark):
    schema = "doc_id bigint, text string, source string"
    assert mixing.mix_documents(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.mix_documents(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_digests_by_columns(spark):
    import pyspark.sql.functions as F

    data = [b"", b"a", "é".encode() * 999]
    frame = spark.createDataFrame([(bytearray(d),) for d in data], "b binary")
    assert [r[0] for r in frame.select(warc.base32_sha1(F.col("b"))).collect()] == [sha(d) for d in data]
    assert re.fullmatch("[A-Z2-7]{32}", sha(b""))
