"""Decontamination, nearest vectors, license scan, the registered queries' SQL, and the pipeline."""

import numpy as np
import pytest
from oracle_compare import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline as P
from adlens.llm import ann, decontaminate, licenses
from adlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_small, name):
    assert compare(spark, duck(sf_small), name, QUERIES[name], ORACLES[name], sf_small)


@pytest.mark.parametrize("set_windows", [50_000, 0])
def test_decontamination_of_awkward_rows(spark, edge_docs, set_windows):
    items = spark.createDataFrame([
        (1, "the CAT sat on the mat and looked at the dog"), (2, None), (3, "..."), (4, "One, two!"), (5, "the cat sat on the mat and looked at the dog and more"),
        (4, "One, two!")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(edge_docs, items, set_windows=set_windows).collect()}
    assert len(got) == len({r.doc_id for r in edge_docs.collect()})
    assert (got[0].n_words, got[1].n_words, got[2].n_words, got[0].contaminated) == (0, 0, 0, False)
    # the first ten words of items 1 and 5 are one window; item 1 has eleven words
    assert (got[4].n_words, got[4].n_hit, got[4].n_items) == (11, 11, 2) and got[3].n_hit == 2 and not got[6].contaminated
    clean = decontaminate.remove_contaminated(edge_docs, items, set_windows=set_windows)
    assert clean.columns == edge_docs.columns
    left = [r.doc_id for r in clean.collect()]
    assert not {3, 4, 5} & set(left) and len(left) == edge_docs.count() - 4
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(edge_docs, items, whole_documents=False, set_windows=set_windows).collect()}
    assert cut[3].strip() == "" and cut[4].strip() == "." and cut[6].startswith("w0 ") and cut[0] is None
    assert decontaminate.contamination(edge_docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(edge_docs.limit(0), items).count() == 0


@pytest.mark.parametrize("set_windows", [50_000, 0])
def test_decontamination_by_items_without_an_id(spark, edge_docs, set_windows):
    items = spark.createDataFrame([(None, "The cat sat on the mat and looked at the dog."), (1, "one two")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(edge_docs, items, set_windows=set_windows).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (3, 4, 5, 6)] == [(2, 1, True), (11, 0, True), (11, 0, True), (0, 0, False)]
    assert not {3, 4, 5} & {r.doc_id for r in decontaminate.remove_contaminated(edge_docs, items, set_windows=set_windows).collect()}


def test_nearest_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (20, [-1.0, 0.0]), (1, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.9), (0, 2, 2, 0.9), (0, 3, 20, -1.0), (20, 1, 1, -0.9), (20, 2, 2, -0.9), (20, 3, 0, -1.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (400, 16)).astype(np.uint8)
    codes[200:] = codes[:200]
    codes[200:, 3] ^= 5
    index = ann.CodeIndex(codes)
    for radius in (0, 2, 15, 16, 40, 55, 128):
        for i in (0, 17, 250):
            far = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
            assert index.within(codes[i], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_probes_prune_where_neighbours_are_close():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 64))
    x = (centres[:, None, :] + rng.normal(0, 0.02, (200, 30, 64))).reshape(-1, 64)  # groups of near vectors
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation = ann.learn_rotation(x[::3], ann.BITS)
    codes = ann.encode(x, rotation)
    radius = ann.learn_radius(x, codes, 20, len(x), 0.97)
    index, shares, hits = ann.CodeIndex(codes), [], 0
    for i in range(0, len(x), 60):
        found = index.within(codes[i], radius)
        shares.append(len(index.probed(codes[i], radius)) / len(x))
        near = np.argsort(-(x @ x[i]), kind="stable")[:21]
        hits += len(set(near.tolist()) & set(found.tolist()))
    assert np.mean(shares) < 0.2 and hits >= 0.9 * 21 * len(shares)


def test_recall_of_the_registered_search(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    rows = QUERIES["op5_nearest_vectors"](spark, sf_small).collect()
    hit = 0
    asked = ids[ids % 20 == 0]
    for q in asked:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = [r for r in rows if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 21))
        hit += len(best & {r.vec_id for r in mine})
    assert hit / (20 * len(asked)) >= 0.9


def test_license_inheritance(spark):
    files = spark.createDataFrame([
        (1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/x.py", "code"), (4, "c/y.py", "code"), (5, "a/z.py", "SPDX-License-Identifier: MIT\ncode"), (6, None, "code"), (7, "d/LICENSE", None), (8, "d/e", ""),
        (4, "c/y.py", "code")], "doc_id long, path string, text string").withColumn("license", F.lit(1))
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan_licenses(files, F.col("path").rlike("(^|/)LICENSE$")).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", None), 3: ("Apache-2.0", "a"), 4: ("MIT", ""), 5: ("MIT", None), 6: (None, None), 7: ("MIT", ""), 8: ("MIT", "")}
    assert licenses.scan_licenses(files.limit(0), F.lit(True)).count() == 0


def test_license_blocks_and_deciding_words(spark):
    want = notices()
    files = spark.createDataFrame([(i, f"f{i}", t) for i, (t, _) in enumerate(want)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(files, F.lit(False)).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(want)] == want


def notices():
    gpl = "\n".join(["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU {} as published by",
                     "# the Free Software Foundation, either version {} of the License, or", "# (at your option) any later version.", "import os"])
    return [
        ("A tale of cats and dogs. Released under the MIT License. More of it follows here", "MIT"), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS", "Apache-2.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), ("Licensed under the GNU GPL, version 2", "GPL-2.0"),
        ("Licensed under the Apache License, Version 1.1", None), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", None), ("SPDX-License-Identifier: Foo-1.0", None),
        (gpl.format("General Public License", 3), "GPL-3.0"), (gpl.format("Affero General Public License", 3), "AGPL-3.0"), (gpl.format("General Public License", 2), "GPL-2.0"),
        ("Released under the ISC License", "ISC"), ("Released under the Foo License", None), ("MIT License\n\nCopyright 2020 A Person", "MIT"), ("Cats license nothing", None)]


def test_license_query_inherits_in_the_given_tables(spark, sf_mid):
    got = QUERIES["op9_license_scan"](spark, sf_mid)
    rows = got.where("inherited_from IS NOT NULL").collect()
    assert rows and all(r.own_license is None and r.license for r in rows) and len({r.license for r in rows}) > 1


def test_license_query_and_its_sql_agree_on_notices(spark, sf_small, tmp_dir):
    more = ["Licensed under the Apache License,\r\nVersion 2.0.\r\n\r\nMore text. It is licensed under the MIT License! Yes", "licence 1.2.3 and 2..0 and 10.5", "", "SPDX-License-Identifier: a+b",
            "Licensed under CC BY-NC 4.0.\n\n\n", "spdx-license-identifier: (MIT OR ISC)", "GNU GPL, version 2", "Prose.\n# ---\nCopyright me. Released under the MIT License.\nPermission is hereby granted"]
    texts = [t for t, _ in notices()] + more + [None]
    docs = spark.createDataFrame([(i * 7, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    con = duck(sf_small)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    name = "op9_license_scan"
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], tmp_dir)
    assert {r.own_license for r in QUERIES[name](spark, tmp_dir).collect()} >= {"MIT", "AGPL-3.0", "GPL-2.0", "GPL-3.0", "CC-BY-NC-4.0", None}


def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, sf_small), "test-stage")
        assert name == "packed" or out.columns == names
        assert name in ("packed", "repeated_passages") or out.count() <= docs.count()
        docs = out
    assert docs.count() > 0


def test_pipeline_of_awkward_rows(spark, edge_docs, sf_small):
    docs = edge_docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, docs, sf_small), "test-edge")
        assert name == "packed" or out.columns == docs.columns
        docs = out
    for name, stage in P.STAGES:
        assert stage(spark, edge_docs.withColumn("lang", F.lit("en")).limit(0), sf_small).count() == 0


def test_pipeline_goes_on_where_it_stopped_and_keeps_the_tokens(spark, sf_small, tmp_dir, monkeypatch):
    ran = []

    def noted(name, stage, broken=False):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if broken:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)
        return name, run

    stages = P.STAGES
    monkeypatch.setattr(P, "STAGES", [noted(n, s, n == "repeated_passages") for n, s in stages])
    with pytest.raises(RuntimeError):
        P.run(spark, sf_small, tmp_dir)
    monkeypatch.setattr(P, "STAGES", [noted(n, s) for n, s in stages])
    ran.clear()
    rows = P.run(spark, sf_small, tmp_dir).collect()
    assert ran == ["repeated_passages", "decontaminated", "packed"]
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
    ran.clear()
    assert P.run(spark, sf_small, tmp_dir).count() == len(rows) and not ran
