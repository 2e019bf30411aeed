"""Counts of the quality rules against plain Python, the trees' monotony and flat form, held-out verdicts, awkward rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import rules as R
from adlens.llm.queries import QUERIES, fold


def naive_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_of_random_and_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [None, "", " \n\t", "a", "a b c a b c", "ü|ü\nü|ü\n\nü|ü", "x\r\nx\r\nx", "日本 語 x   y"]
    texts += ["".join(rng.choice(list("aab# \n\té|"), rng.integers(0, 400))) for _ in range(200)]
    for part in (1 << 20, 7):  # parts shorter than a word
        monkeypatch.setattr(R, "PART_BYTES", part)
        for t in texts:
            assert tuple(R.measure(memoryview((t or "").encode()))[0]) == naive_counts(t)
    monkeypatch.setattr(R, "PART_BYTES", 1 << 20)
    long = " ".join(f"w{i * i % 70_001}" for i in range(700_000))
    assert tuple(R.measure(memoryview(long.encode()))[0]) == naive_counts(long)


def test_windows_of_very_many_words_keep_exact_keys():
    ids = np.r_[np.arange(1 << 21), [5, 6, 7]].astype(np.int32)
    assert R.repeated_words(ids, 1 << 21) == 6


def test_scores_fall_with_the_chosen_features_and_equal_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(R.FEATURES))).astype(np.float32)
    s = R.FEATURES.index("symbol_share")
    y = ((np.sin(9 * x[:, s]) + x[:, 0] + rng.normal(0, 0.3, 3000)) > 0.7).astype(float)  # not monotonic in the data
    model = R.train(x, y)
    for name in R.FALLING:
        grid = np.repeat(x[:200], 50, axis=0)
        grid[:, R.FEATURES.index(name)] = np.tile(np.linspace(0, 1, 50), 200)
        assert (np.diff(model.raw(grid).reshape(200, 50), axis=1) <= 1e-12).all()
    free = R.train(x, y, falling=())
    grid = np.repeat(x[:50], 50, axis=0)
    grid[:, s] = np.tile(np.linspace(0, 1, 50), 50)
    assert (np.diff(free.raw(grid).reshape(50, 50), axis=1) > 0).any() and ((free.score(x) > 0.5) == y).mean() > 0.8
    for row in x[:20]:
        total = model.base
        for root in model.roots:
            at = root
            while model.left[at] != at:
                at = model.right[at] if row[model.feature[at]] > model.threshold[at] else model.left[at]
            total += model.value[at]
        assert total == pytest.approx(model.raw(row[None])[0])


def test_one_class_or_no_labels_keep_what_passes_the_base_rules(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(6, 0), (7, 0), (8, None), (None, 1)], "doc_id long, quality int")):
        rows = R.quality_rules(edge_docs, labels, F.lit(True)).collect()
        assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) == edge_docs.count()


def test_awkward_rows(spark, edge_docs):
    labels = spark.createDataFrame([(6, 1), (6, 0), (7, 1), (8, 1), (9, 0), (0, 0)], "doc_id long, quality int")
    docs = edge_docs.withColumn("n_words", F.lit("clash")).withColumn("quality", F.lit(5))
    got = R.quality_rules(docs, labels, F.lit(True)).collect()
    want = sorted((str(r.doc_id), *naive_counts(r.text)) for r in edge_docs.collect())
    assert sorted((str(r.doc_id), *[r[c] for c in R.COUNTS]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert R.quality_rules(edge_docs.limit(0), labels, F.lit(True)).count() == 0


def test_query_counts_and_held_out_verdicts(spark, sf_mid):
    rows = {r.doc_id: r for r in QUERIES["op12_quality_rules"](spark, sf_mid).collect()}
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert tuple(rows[d.doc_id][c] for c in R.COUNTS) == naive_counts(d.text)
    held = spark.read.parquet(f"{sf_mid}/labels.parquet").filter(fold(5) == 0).collect()
    judged = [(r.quality, rows[r.doc_id].kept) for r in held if not rows[r.doc_id].base_failed]
    good, poor = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.3 * len(poor)
