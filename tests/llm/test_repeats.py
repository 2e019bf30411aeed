"""Byte and word repeats against brute force: buckets, hot minimisers, awkward rows, whole queries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import substring_dedup as W
from adlens.llm import suffix_dedup as B
from adlens.llm.repeats import repeated_spans


def marks(seqs, w):
    """Covered positions of each sequence, by counting every window."""
    c = Counter(tuple(s[i : i + w]) for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        hit = np.zeros(len(s), bool)
        for i in range(len(s) - w + 1):
            if c[tuple(s[i : i + w])] > 1:
                hit[i : i + w] = True
        out.append(hit)
    return out


def test_interval_expansion_finds_the_windows_that_counting_finds():
    rng = np.random.default_rng(0)
    for _ in range(150):
        letters = int(rng.integers(1, 4))
        strings = [bytes(rng.integers(97, 97 + letters, rng.integers(0, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        w = int(rng.integers(2, 12))
        c = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
        want = [[c[s[i : i + w]] > 1 for i in range(len(s) - w + 1)] for s in strings]
        assert [x.tolist() for x in B.repeated_windows(strings, w)] == want


def test_sorted_windows_are_counted():
    got = W.repeated_windows([b"a b c d", b"x b c y", b"q r"], 2)
    assert [x.tolist() for x in got] == [[False, True, False], [False, True, False], [False]]


@pytest.mark.parametrize("hot", [4000, 1, 0])
def test_bytes_of_awkward_rows(spark, edge_docs, hot):
    rows = [(r.doc_id, (r.text or "").encode()) for r in edge_docs.collect()]
    want = Counter((i, len(t), int(m.sum())) for (i, t), m in zip(rows, marks([list(t) for _, t in rows], 40), strict=True))
    spans = repeated_spans(edge_docs, "doc_id", "text", False, 40, 20, B.repeated_windows, hot_strings=hot)
    assert set(spans.columns) == {"did", "h", "spans"}
    if hot == 4000:
        got = B.suffix_dedup(edge_docs, min_bytes=40).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == want
        texts = dict(rows)
        for r in got:
            assert len(r.kept) == r.n_bytes - r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
            assert r.doc_id is None or r.n_removed or r.kept == texts[r.doc_id]
    else:  # hot minimisers are spread, with the same result
        found = sum(e - s for r in spans.collect() for s, e in B.merge(r["spans"]))
        assert found == sum(k[2] for k in want)


def test_words_of_awkward_rows(spark, edge_docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in edge_docs.collect()]
    hits = marks([t for _, t in rows], 12)
    want = Counter((i, len(t), int(m.sum()), b" ".join(x for x, hit in zip(t, m, strict=True) if not hit).decode()) for (i, t), m in zip(rows, hits, strict=True))
    got = W.substring_dedup(edge_docs, window=12).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_removal_keeps_all_columns_and_untouched_texts(spark, edge_docs):
    out = W.remove_repeats(edge_docs, window=12)
    assert out.schema.simpleString() == edge_docs.schema.simpleString()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[2] == " \n\t " and got[7] == "début fin" and out.count() == edge_docs.count()


def test_empty_table(spark, edge_docs):
    assert W.substring_dedup(edge_docs.limit(0)).count() == 0
    assert B.suffix_dedup(edge_docs.limit(0)).count() == 0


def thue_morse(n, swap):
    """Strings of two letters whose polynomials modulo 2**64 agree, though they differ in every place."""
    return "".join("ab"[(bin(i).count("1") + swap) & 1] for i in range(n))


def test_strings_that_defeat_sums_modulo_a_power_of_two_are_told_apart(spark):
    rows = [(i, " ".join([*(f"p{j}" for j in range(20)), thue_morse(1024, i), *(f"q{j}" for j in range(20))])) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in W.substring_dedup(df).collect()] == [(41, 0)] * 2
    rng = np.random.default_rng(9)
    rows = [(i, "".join(thue_morse(2 ** int(rng.integers(1, 8)), int(rng.integers(0, 2))) for _ in range(40))) for i in range(12)]
    for spread in (False, True):
        texts = [(i, " ".join(t) if spread else t) for i, t in rows]
        df = spark.createDataFrame(texts, "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in (W.substring_dedup(df, window=70) if spread else B.suffix_dedup(df, min_bytes=70)).collect()}
        assert got == {i: int(m.sum()) for (i, _), m in zip(rows, marks([list(t) for _, t in rows], 70), strict=True)}


@pytest.mark.parametrize("op, unit", [(W.repeated_words, 60), (B.repeated_bytes, 1900)])
def test_copies_without_an_id_share_one_list_of_spans(spark, op, unit):
    text = " ".join(f"{i:030d}" for i in range(60))
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = op(df).collect()
    assert len(rows) == 1 and len(rows[0].spans) < unit


def test_a_copy_that_repeats_is_still_compared_with_other_strings(spark):
    inner = " ".join(f"s{i}" for i in range(14))
    rows = [(None, f"a {inner} b c d")] * 3 + [(1, f"x y {inner} z")]
    got = W.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=12).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == Counter({(None, ""): 3, (1, "x y z"): 1})


def test_rows_that_repeat_an_id_keep_their_own_spans(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(7, "a " + shared), (7, " ".join(f"t{i}" for i in range(41))), (7, shared + " b")]
    got = W.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 40, 40]


def test_long_texts_are_cut_into_steps_without_loss(spark, monkeypatch):
    monkeypatch.setattr("adlens.llm.repeats.STEP_BYTES", 500)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 100_000, 3000)]
    words[2000:2060] = words[100:160]
    raw = " ".join(words).encode()
    for by_word, w, seq in ((True, 20, words), (False, 60, list(raw))):
        from adlens.llm import repeats
        batch = __import__("pyarrow").record_batch({"did": np.array([1], np.int64), "h": np.array([2], np.int32), "body": [raw]})
        runs = [r for b in repeats.scan(by_word, w, 8)(iter([batch])) for r in b.to_pylist()]
        covered = sorted(i for r in {(r["start"], r["n_win"]) for r in runs} for i in range(r[0], r[0] + r[1]))
        assert set(covered) == set(range(len(seq) - w + 1))
