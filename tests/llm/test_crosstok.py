"""Token alignment against a plain version that uses the two libraries on whole texts."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import crosstok

SCHEMA = "doc_id bigint, text string, chunk int, pair string, groups int, n_a int"


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(P.path(crosstok.VOCABULARY_A))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path(crosstok.MODEL_B))
    alphabet = crosstok.byte_of_character()
    names = {i: n for n, i in one.get_vocab().items()}

    def bytes_a(i):
        return bytes(alphabet[c] for c in names[i])

    def bytes_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(text):
        return one.encode(" " + text, add_special_tokens=False).ids, two.encode(text), bytes_a, bytes_b

    return encode


def plain(rows, encode):
    found, docs = [], defaultdict(set)
    for number, text in enumerate(rows):
        groups = []
        if text:
            a, b, bytes_a, bytes_b = encode(text)
            raw = (" " + text).encode()
            if b"".join(map(bytes_a, a)) == raw == b"".join(map(bytes_b, b)):
                ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]), np.cumsum([len(bytes_b(i)) for i in b])
                cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                groups = [([], []) for _ in cuts]
                for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
                    for i, g in zip(ids, np.searchsorted(cuts, ends), strict=True):
                        groups[g][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for pair in links:
            docs[pair].add(number)
        found.append((groups, links))
    count = {p: len(d) for p, d in docs.items()}
    most: dict[int, int] = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for groups, links in found:
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), links.total(),
            sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), told,
        ))
    return out, count


def some_texts():
    draw = np.random.default_rng(3)
    words = "the Überraschung naïve don't 12345 tokenization – “quoted” 中文字符 emoji🙂🙂 x=y+z http://a.b/c?d=e word\tword\n\nend <|endoftext|> <0x41> АБВ ---- ...".split(" ")
    texts = [" ".join(draw.choice(words, draw.integers(1, 60))) for _ in range(120)]
    texts += [None, "", " ", "  ", "\n", "a", "▁x", "x▁y", "\x00", "a  b   c ", " lead", "trail ", "ﬁ ½ é", "a" * 5000, "中" * 3000, "ab " * 4000, " 　x﻿", "a\r\nb"]
    texts += ["word " * 30_000 + "▁", "one two 3 " * 20_000, " ".join(draw.choice(words, 30_000))]
    return texts + texts[:40]


@pytest.mark.parametrize("sizes", [(crosstok.SLAB_CHARS, crosstok.SEGMENT_CHARS), (300, 50)])
def test_texts_against_plain(libraries, sizes):
    texts = [t for t in some_texts() if sizes[0] > 300 or not t or len(t) < 20_000]
    a = crosstok.side_a(open(P.path(crosstok.VOCABULARY_A), "rb").read(), P.PATTERN)
    b = crosstok.side_b(open(P.path(crosstok.MODEL_B), "rb").read())
    got = crosstok.align_texts(texts, a, b, digest=False, slab_chars=sizes[0], segment_chars=sizes[1])
    want, count = plain(texts, libraries)
    for i, row in enumerate(want):
        assert (got["n_a"][i], got["n_b"][i], got["n_groups"][i], got["n_links"][i], got["groups"][i]) == (*row[:4], row[6]), texts[i] and texts[i][:80]
    width = len(b.bytes_of)
    assert {(p // width, p % width): n for p, n in zip(got["pairs"].tolist(), got["seen"].tolist(), strict=True)} == count


def test_other_vocabulary_order(libraries):
    """A file whose ids do not follow its merges is read by the tokenizers library, with the same tokens."""
    told = json.load(open(P.path(crosstok.VOCABULARY_A)))
    vocab = told["model"]["vocab"]
    ids = sorted(i for n, i in vocab.items() if n != "<|endoftext|>")
    moved = dict(zip(ids, ids[::-1], strict=True))
    told["model"]["vocab"] = {n: moved.get(i, i) for n, i in vocab.items()}
    other = crosstok.side_a(json.dumps(told).encode(), P.PATTERN)
    text = " Some don't words, naïve 🙂 <|endoftext|>"
    want = libraries(text[1:])[0]
    assert other.encode([text]) == [[moved[i] for i in want]]
    assert b"".join(other.bytes_of[i] for i in other.encode([text])[0]) == text.encode()


def test_documents_against_plain(spark, libraries):
    texts = some_texts()
    rows = [(i if i % 7 else None, t, 1, "p", 2, 3) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, count = plain(texts, libraries)
    got = crosstok.aligned(frame, digest=False)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    told = Counter(r.groups_sha256 for r in crosstok.align_documents(frame).collect())
    assert told == Counter(w[6] and hashlib.sha256(w[6].encode()).hexdigest() for w in want)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    table = crosstok.vocabulary_map(frame).collect()
    assert {tuple(r) for r in table} == {(a, b, n, n == most[a]) for (a, b), n in count.items()} and len(table) == len(count)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert crosstok.align_documents(empty).count() == 0 and crosstok.vocabulary_map(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    assert {tuple(r) for r in crosstok.align_documents(none).collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")}
