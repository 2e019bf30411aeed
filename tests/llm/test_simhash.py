"""SimHash groups against all pairs, the Gray index against all pairs, hot blocks, awkward rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from adlens.llm import simhash as S
from adlens.llm.graph import components


def naive_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(codes, distance):
    """Least position of each code's component, by all pairs."""
    codes = np.array(codes, np.uint64)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def planted(rng, n):
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
    out = [int(x) for x in base]
    while len(out) < n:
        x = int(out[rng.integers(len(out))])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_index_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    codes = np.unique(np.array(planted(rng, 1500), np.uint64))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    a, b = S.GrayIndex(np.zeros(len(codes), np.int64), codes).links(4, room=5000)
    label = S.joined(np.arange(len(codes)), a, b)
    want = groups_of(codes, 4)
    assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))


@pytest.mark.parametrize("max_block", [4096, 8])
def test_blocks_lose_no_link(spark, max_block):
    codes = sorted(set(planted(np.random.default_rng(5), 1200)))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = {r.node: r.root for r in components(S.near_links(df, 4, max_block)).collect()}
    want = groups_of(codes, 4)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    label = [got.get(c, c) for c in signed]
    assert len(set(zip(label, want, strict=True))) == len(set(want)) == len(set(label))


def test_components_of_a_long_chain_and_a_hub(spark):
    links = spark.range(0, 400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(
        spark.range(1001, 3000).select(F.lit(1000).cast("long").alias("u"), F.col("id").alias("v")))
    got = {r.node: r.root for r in components(links).collect()}
    assert {got[i] for i in range(401)} == {0} and {got[i] for i in range(1000, 3000)} == {1000}
    assert components(links.limit(0)).count() == 0


def test_awkward_rows(spark, edge_docs):
    rows = edge_docs.collect()
    got = S.simhash_groups(edge_docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{naive_print(r.text):016x}") for r in rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4
    kept = S.simhash_dedup(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({v for k, v in by.items() if k is not None and v == k})
    assert S.simhash_groups(edge_docs.limit(0)).count() == 0 and S.simhash_dedup(edge_docs.limit(0)).count() == 0


def test_dedup_tells_rows_apart_by_id_and_text(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(7, one), (7, two), (None, three), (None, three), (9, two), (7, one), (None, one), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _did int, code string")
    got = S.simhash_dedup(df)
    assert got.columns == df.columns
    found = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert found == sorted([("7", one), ("7", two), ("None", three), ("None", "")])
