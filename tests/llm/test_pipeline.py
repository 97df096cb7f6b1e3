"""The pipeline against plain checks of what each stage must leave."""

import collections
import hashlib
import re

import numpy as np

import corpus_pipeline
from tidepanel.llm import mixing, shared

WORDS = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "stlnrmpk"]
BAD = "vile nasty rotten foul grim".split()
KEY = "token = 0123456789abcdef0123456789abcdef01234567"


def corpus():
    draw = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(400):
        body = draw.choice(WORDS, 60).tolist()
        toxic = i % 8 == 0
        if toxic:
            body[10:10] = draw.choice(BAD, 4).tolist()
        if i % 50 == 1:
            body.append(KEY)
        rows.append((i, " ".join(body), "en", f"s{i % 5}", None))
        labels.append((i, 1, int(toxic)))
    near = rows[2][1].split()
    near[5] = "changed"
    rows += [(500, rows[1][1], "en", "s1", 3), (501, " ".join(near), "en", None, 3), (502, None, None, None, None), (503, "", "en", "s1", 0), (None, "no id", "en", "s2", 5)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    clean = {r[0] for r in rows} - {i for i in range(400) if i % 8 == 0}
    assert ids("toxicity") == clean
    assert ids("near_duplicates") == clean - {500, 501}
    texts = {r.doc_id: r for r in seen["secrets"].collect()}
    assert set(texts) == clean - {500, 501}
    assert "[SECRET]" in texts[1].text and "0123456789abcdef" not in texts[1].text and texts[1].n_chars == len(texts[1].text)
    assert texts[2].text == rows[2][1] and texts[2].n_chars is None
    planned = {(r.doc_id, r.copies) for r in mixing.plan(mixing.document_sizes(seen["secrets"])).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in seen["mixing"].collect()) == dict(planned)
    last = seen["encoding"].collect()
    assert len(last) == seen["mixing"].count() and all(r.round_trip for r in last)
    assert all(r.ids_sha256 == hashlib.sha256(r.token_ids).hexdigest() and r.n_tokens * 4 == len(r.token_ids) for r in last)
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (str(r.doc_id), r.ids_sha256)
    assert sorted(map(key, got.collect())) == sorted(map(key, last))


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int, _own_x int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_are_cut_alike(spark):
    text = "a b c\td\x1ce f\x0bg\x85h"
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in frame.select(shared.digest_words(frame.t)).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0d]+", text)), 0] and len(shared.lowered_words(text)) == got[0]
