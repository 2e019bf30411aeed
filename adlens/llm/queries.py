"""Registered queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, quality
from .ann import nearest
from .centroids import centroid_report, cluster_vectors
from .common import table
from .decontaminate import contamination
from .hard_negatives import hard_negatives
from .packing import pack
from .rules import quality_rules
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_records import token_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Bytes as pairs of hex digits, so that positions are bytes whatever the text holds.
ORACLES["op2_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, length(x) // 2 - 199)) AS u(i)),
rep AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM rep)),
mark AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
isl AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, g, min(i) AS s, max(i) + 200 AS e FROM isl GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM span
        UNION ALL SELECT d.doc_id, coalesce(max(span.e), 0), max(length(d.x) // 2) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(d.x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id),
n AS (SELECT doc_id, sum(e - s) AS r, count(*) AS c FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.r, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n.c, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.t)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op3_decontamination"] = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS k
      FROM it, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS u(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM g),
win AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM low, size, unnest(range(0, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT win.doc_id, win.i, win.n, g.item FROM win JOIN g USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM hit, unnest(range(0, n)) AS v(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(low.w) AS BIGINT) AS n_words, CAST(coalesce(cov.c, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.c, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(cov.c, 0) > 0 AS contaminated
FROM low LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def fold(n: int):
    """crc32 of the id as text, modulo n; null without an id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(4) != 2))
    return langid.predict(docs, model, more={"held_out": F.coalesce(fold(4) == 2, F.lit(False))}).select("doc_id", "held_out", "lang_pred", "score", "accepted")


@query
def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_records(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), fold(5) != 0, fold(5) == 1)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_LICENCE_FILE = r"(?i)^[^\n]*licen[cs]ed? |licen[cs][^\n]*\s*$"


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / thousands / hundreds / file. A text whose first line opens a licence, or
    whose last line speaks of one, is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    opens = F.coalesce(F.col("text").rlike(_LICENCE_FILE), F.lit(False))
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"),
                       F.concat(F.when(opens, "LICENSE-").otherwise("file-"), F.col("doc_id").cast("string")))
    return licenses.scan_licenses(docs.withColumn("path", path), F.col("path").contains("/LICENSE-"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICES = ",\n".join("({}, {}, {}, {}, {})".format(i, _sql(n), *map(_sql, licenses.deciding_words(t)), _sql(t))
                      for i, (n, t) in enumerate([*licenses.TEMPLATES, *licenses.MORE_TEMPLATES]))
_MARK = _sql(licenses.MARKERS)
# DuckDB's expressions have no look-around. A version is the head of a run of digits and points; an SPDX id is a run
# of its letters less one ending; a sentence ends where a mark and white space are, which become one character.
_HELD = ", ".join(f"CASE WHEN regexp_matches(low, {_sql(p)}) THEN '{k}' END" for k, p in licenses.FAMILIES.items())
_KINDS = ", ".join(f"CASE WHEN regexp_matches(low, {_sql(p)}) THEN '{k}' END" for k, p in licenses.KINDS.items())
_VERSIONS = (r"list_filter(list_transform(regexp_extract_all(low, '[0-9.]+'), lambda r: regexp_extract(r, '^([0-9](?:\.[0-9])?)(?:$|\.$|\.\.)', 1)), lambda v: v <> '')")
_IDS = (r"list_filter(list_transform(regexp_extract_all(low, 'spdx-license-identifier: *([a-z0-9.+-]+)', 1), "
        r"lambda r: regexp_extract(r, '^([a-z0-9.-]+?)(?:-only|-or-later|\+)?$', 1)), lambda v: v <> '')")
ORACLES["op9_license_scan"] = r"""
WITH t AS (SELECT * FROM (VALUES """ + _NOTICES + r""") AS v(t, name, t_held, t_kinds, text)),
tt AS (SELECT t, name, t_held, t_kinds, w AS term, count(*) AS n FROM
       (SELECT t, name, t_held, t_kinds, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t) GROUP BY ALL),
f AS (SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR),
             CASE WHEN coalesce(regexp_matches(text, """ + _sql(_LICENCE_FILE) + r"""), false) THEN 'LICENSE-' ELSE 'file-' END || doc_id) AS path FROM documents),
marked AS (SELECT doc_id, text, regexp_split_to_array(text, '\r?\n') AS ls,
                  list_filter(regexp_split_to_array(text, '\r?\n[^A-Za-z0-9\n]*\n'), lambda x: regexp_matches(x, """ + _MARK + r""")) AS ps
           FROM f WHERE regexp_matches(text, """ + _MARK + r""")),
spots AS (SELECT doc_id, ls, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM marked) WHERE regexp_matches(ls[i], """ + _MARK + r""")),
lines AS (SELECT DISTINCT doc_id, ls[i] AS x FROM spots),
sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS x FROM (SELECT doc_id, unnest(ps) AS p FROM marked)),
others AS (SELECT doc_id, array_to_string(ls[greatest(i - 1, 1):i], ' ') AS x FROM spots
           UNION SELECT doc_id, array_to_string(ls[i:i + 1], ' ') FROM spots
           UNION SELECT doc_id, array_to_string(ls[greatest(i - 1, 1):i + 1], ' ') FROM spots
           UNION SELECT doc_id, x FROM sentences WHERE regexp_matches(x, """ + _MARK + r""")
           UNION SELECT doc_id, unnest(ps) FROM marked UNION SELECT doc_id, text FROM marked),
block AS (SELECT doc_id, row_number() OVER () AS l, line, x, lower(x) AS low FROM
          (SELECT doc_id, true AS line, x FROM lines UNION ALL SELECT doc_id, false, x FROM (SELECT * FROM others EXCEPT SELECT * FROM lines))),
known AS (SELECT doc_id, l, line, low, list_filter([""" + _HELD + r"""], lambda k: k IS NOT NULL)
                 || list_transform(""" + _VERSIONS + r""", lambda v: CASE WHEN contains(v, '.') THEN v ELSE v || '.0' END) AS held,
                 array_to_string(list_filter([""" + _KINDS + r"""], lambda k: k IS NOT NULL) || """ + _IDS + r""", ' ') AS kinds FROM block),
c AS (SELECT doc_id, l, line, w AS term, count(*) AS n FROM (SELECT doc_id, l, line, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS w FROM known) GROUP BY ALL),
nf AS (SELECT count(DISTINCT doc_id) AS n_files FROM c WHERE line),
idf AS (SELECT term, ln((1.0 + n_files) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM
        (SELECT DISTINCT term FROM tt UNION SELECT DISTINCT term FROM c)
        LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM c WHERE line AND term IN (SELECT term FROM tt) GROUP BY term) USING (term), nf),
tw AS (SELECT t, name, t_held, t_kinds, term, n * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT t, sqrt(sum(w * w)) AS t_norm FROM tw GROUP BY t),
cw AS (SELECT doc_id, l, term, n * idf AS w FROM c JOIN idf USING (term)),
cn AS (SELECT doc_id, l, sqrt(sum(w * w)) AS norm FROM cw GROUP BY ALL),
fits AS (SELECT k.doc_id, k.l, t.t FROM known k JOIN t ON k.kinds = t.t_kinds AND (t.t_held = '' OR list_has_all(k.held, string_split(t.t_held, ' ')))),
dot AS (SELECT doc_id, l, t, name, sum(cw.w * tw.w / t_norm) AS dot FROM cw JOIN fits USING (doc_id, l) JOIN tw USING (t, term) JOIN tn USING (t) GROUP BY ALL),
best AS (SELECT doc_id, name AS own_license, score AS own_score FROM
         (SELECT doc_id, name, round(dot / norm, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 6) DESC, name) AS r
          FROM dot JOIN cn USING (doc_id, l)) WHERE r = 1 AND score >= 0.6),
a AS (SELECT f.doc_id, path, own_license, own_score FROM f LEFT JOIN best USING (doc_id)),
dir AS (SELECT d, own_license AS dl FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS d, own_license,
        row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY own_score DESC, own_license) AS r
        FROM a WHERE path LIKE '%/LICENSE-%' AND own_license IS NOT NULL) WHERE r = 1),
up AS (SELECT doc_id, n, array_to_string(string_split(path, '/')[1 : n], '/') AS d FROM a, unnest(range(0, len(string_split(path, '/')))) AS u(n) WHERE own_license IS NULL),
near AS (SELECT doc_id, d, dl FROM (SELECT doc_id, up.d, dl, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM up JOIN dir USING (d)) WHERE r = 1)
SELECT a.doc_id, path, own_license, own_score, coalesce(own_license, dl) AS license, d AS inherited_from FROM a LEFT JOIN near USING (doc_id)
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM d, unnest(range(0, len(w) - 34)) AS u(i)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM win, unnest(range(0, 35)) AS v(j) WHERE k IN (SELECT k FROM rep)),
word AS (SELECT doc_id, p, w[p + 1] AS t FROM d, unnest(range(0, len(w))) AS u(p)),
kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY word.p) FILTER (WHERE hit.p IS NULL) AS t, count(hit.p) AS r
         FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(kept.r, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.l = r.l AS same,
             CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i])) AS BIGINT) AS score
      FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the labels is left out of training, so that tests can hold the verdict against it."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_report(spark, *cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1))


def _clusters_sql(rounds: int) -> str:
    """Assignment and means, written out for each round."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    out = ["""v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
           """c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM
       (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT 16))"""]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT v.r, v.vec_id, v.q, c.c, CAST({gap} AS BIGINT) AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)")
        if i < rounds:
            out.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM
      (SELECT c, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(i) GROUP BY c, i) GROUP BY c)""")
            out.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


ORACLES["op13_centroid_clusters"] = _clusters_sql(3)
