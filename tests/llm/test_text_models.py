"""Language ID and quality scores: held-out accuracy, awkward rows, statistics against plain counting."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from adlens.llm import common, langid, quality
from adlens.llm.queries import QUERIES


def test_held_out_languages(spark, sf_small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, sf_small).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, edge_docs):
    train = spark.createDataFrame([("en", "the cat sat on the mat " * 5), ("fr", "le chat et la souris sont dans la maison " * 5), (None, "x"), ("en", None)] * 8, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.fit(train)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(edge_docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (0, 1, 2))
    assert got[4].lang_pred == "en"
    kept = langid.keep_identified(edge_docs, model)
    assert kept.schema.simpleString() == edge_docs.schema.simpleString()
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(edge_docs, none).collect()} == {"und"}
    assert langid.predict(edge_docs.limit(0), model).count() == 0


def test_scores_don_t_depend_on_how_texts_are_cut_into_steps(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.5)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 3, 500, 4000)]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = model.scores(raw, off)
    for i, t in enumerate(texts):
        c = langid.counts(np.frombuffer(t, np.uint8))
        want = langid.softmax((c @ model.table / max(c.sum(), 1))[None, :].astype(float))[0]
        assert np.allclose(whole[i], want, atol=1e-4)


def test_statistics_are_those_of_each_text():
    texts = [b"", b"  \n ", b"Ab cd cd Ab.\nline two\nline two", "É 12 $$".encode()]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    s = quality.statistics(raw, off)
    assert not s[0].any() and not s[1].any()
    for t, row in zip(texts[2:], s[2:], strict=True):
        x, w = dict(zip(quality.STATS, row, strict=True)), t.split()
        assert np.isclose(x["word_len"], np.mean([len(i) for i in w])) and np.isclose(x["distinct_words"], len(set(w)) / len(w))
        assert np.isclose(x["upper"], sum(65 <= b <= 90 for b in t) / len(t)) and np.isclose(x["newline"], t.count(b"\n") / len(t))
    assert np.isclose(dict(zip(quality.STATS, s[2], strict=True))["same_next"], 1 / 8)


def test_long_texts_have_the_same_statistics(monkeypatch):
    rng = np.random.default_rng(3)
    pool = [b"a", b"to", b"word", b"Word.", b"1,234", "é".encode(), b"considerable;", b"x" * 40, b"\n", b"\r\n", b"\t", b" ", b"the end."]
    texts = [b" ".join(pool[i] for i in rng.integers(0, len(pool), n)) for n in (1, 7, 400, 3000)] + [b"y" * 5000, b" \n " * 900, b"z" * 900 + b"\nz"]
    for t in texts:
        want = quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        monkeypatch.setattr(quality, "text_parts", lambda b: common.text_parts(b, 256))
        monkeypatch.setattr(quality, "STEP_BYTES", 256)
        assert np.allclose(quality.long_statistics(memoryview(t)), want, rtol=1e-5, atol=1e-6), t[:40]
        both = quality.statistics(np.frombuffer(b"a b" + t, np.uint8), np.array([0, 3, 3 + len(t)]))[1]
        monkeypatch.undo()
        assert np.allclose(both, want, rtol=1e-5, atol=1e-6)


def test_a_very_long_text_takes_little_memory():
    import tracemalloc
    body = memoryview(b"some words of plain text, over and over again.\n" * 350_000)  # 16 MB
    tracemalloc.start()
    quality.statistics(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(body)


def test_isotonic_rates_never_fall():
    r = quality.isotonic(np.array([1.0, 2, 2, 1]), np.array([0.0, 2, 1, 1]))
    assert np.allclose(r, [0, 0.75, 0.75, 1])


def test_held_out_quality(spark, sf_small):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality"](spark, d).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_of_awkward_rows(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1), (9, 0), (6, 1), (10, None), (4, 1)], "doc_id long, quality int")
    every = F.lit(True)
    got = quality.score_documents(edge_docs, labels, every, F.col("doc_id") == 6).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    blank = quality.score_documents(edge_docs, labels.limit(0), every, ~every).collect()
    assert {r.score for r in blank} == {0.5}
    assert quality.score_documents(edge_docs.limit(0), labels, every, ~every).count() == 0
