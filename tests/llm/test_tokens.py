"""Token records round trip, encoder against the library, packing plans."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adlens.llm import packing, token_records
from adlens.llm.encoding import Encoder
from adlens.session import scratch_dir

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    random.seed(1)
    letters = "ab Z'sté\n\t  .,!9½ŉſ中Σσς ́ẞ\x1f\x85 İd'll <|endoftext|>"
    e, tok = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))  # as it comes
    assert e.kind in ("byte", "word")
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|", "a <|ENDOFTEXT|> b", "<|endoftext|> <|endoftext|>\n", "| a <| b |"):
        assert np.frombuffer(e(t), np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, t
    for i in range(6000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        t = "  ".join([t] * 3) if i % 10 == 0 else t
        assert np.frombuffer(e(t), np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_record_round_trip_and_damage(tmp_path):
    import io
    for doc_id, ids in ((None, [2]), (-5, [1, 65535]), (7, [70000, 2]), (1, [])):
        raw = token_records.record(doc_id, np.array(ids, "<u4").tobytes())
        got = token_records.read_record(io.BytesIO(raw))
        assert got == (doc_id, np.array(ids, "<u4").tobytes())
        for i in (0, len(raw) - 1):
            bad = bytearray(raw)
            bad[i] ^= 1
            with pytest.raises(ValueError):
                token_records.read_record(io.BytesIO(bytes(bad)))


def test_records_of_awkward_rows(spark, edge_docs):
    path = public_tokenizers.path(FILES[0])
    tok = Tokenizer.from_file(path)
    folder = scratch_dir(spark, "test-records")
    docs = edge_docs.repartition(3)
    manifest = token_records.write_records(docs, path, folder)
    rows = sorted(token_records.read_records(manifest, folder).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in edge_docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    assert [r.doc_id for r in rows] == [x[0] for x in want]
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids)) and (r.doc_id, ids) in want
        at += len(ids)
    for f in manifest.collect():  # by the index, in any order
        n = list(range(f.n_docs))[::-1]
        assert sum(len(ids) // 4 for _, ids in token_records.read_at(folder, f.file, n)) == f.n_ids
    assert token_records.token_records(edge_docs.limit(0), path).count() == 0


def check_packed(rows, length):
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= length
    return len(seq)


def test_packing_of_awkward_rows(spark, edge_docs):
    path = public_tokenizers.path(FILES[1])
    tok = Tokenizer.from_file(path)
    rows = packing.pack(edge_docs.repartition(4), path, length=512).collect()
    check_packed(rows, 512)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in edge_docs.collect())
    total = sum(r.length for r in rows)
    assert total == sum(len(x) for _, x in want)
    for r in rows:
        assert r.start == 512 * r.piece and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sum(r.piece == 0 for r in rows) == edge_docs.count()
    assert packing.pack(edge_docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_document_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.lognormal(6.3, 1.0, 20_000).astype(int) + 1, 4096)
    hist = np.bincount(sizes, minlength=4097)
    made = packing.plan(hist)
    used = np.zeros(4097, int)
    for lengths, n in made:
        assert sum(lengths) <= 4096 and n > 0
        for x in lengths:
            used[x] += n
    assert (used == hist).all()
    assert sum(n for _, n in made) <= 1.01 * -(-sizes.sum() // 4096)


def test_nnls_equals_the_solution_of_a_known_system():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 2])), [3, 2])
    assert np.allclose(packing.nnls(np.eye(2), np.array([1.0, -1])), [1, 0])


def test_patterns_fill_the_whole_length():
    got = packing.patterns(6, 3)
    assert all(sum(p) == 6 and len(p) <= 3 for p in got) and len(set(got)) == len(got) == 7


def test_registered_queries_count_every_document(spark, sf_small):
    from adlens.llm.queries import QUERIES
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    six = QUERIES["op6_token_records"](spark, sf_small)
    assert six.count() == n and six.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == six.agg(F.sum("n_tokens")).first()[0]
    eight = QUERIES["op8_packing"](spark, sf_small).collect()
    assert len({r.doc_id for r in eight}) == n
    assert check_packed(eight, 4096) <= 1 + -(-sum(r.length for r in eight) // 4096)
