"""The subpackage's registered queries and their SQL.

Beside the ten operators' own queries there are three over parts of them that SQL
can say: the targets of a mix, the base spans of a secret scan, and the base score
of language-model scoring (learning from all documents).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import bpe, exact_dedup, kneser_ney, mixing, mpeg, neighbours, ppm, secrets, simhash, site_tree
from millrace.llm.common import ship, table

_QUERIES = {
    "op1_mixing": mixing.query,
    "op2_bpe": bpe.query,
    "op3_quality_knn": neighbours.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_simhash": simhash.query,
    "op6_mpeg_audio": mpeg.query,
    "op7_site_tree": site_tree.query,
    "op8_toxicity_kn": kneser_ney.query,
    "op9_secret_scan": secrets.query,
    "op10_ppm_score": ppm.query,
}

_ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE}


def _targets(spark, sf_dir):
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def _base_spans(spark, sf_dir):
    return secrets.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def _base_score(spark, sf_dir):
    found = ppm.score(table(spark, sf_dir, "documents"), out_fold=-1)
    return found.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


_QUERIES |= {"mixing_targets": _targets, "secret_base_spans": _base_spans, "lm_base_score": _base_score}

_ORACLES["mixing_targets"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
-- sources in the order in which a rising level meets their caps; the level once those before are full
o AS (SELECT *, 3 * source_size / w AS full_at, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT level FROM l WHERE full_at > level ORDER BY k LIMIT 1)
SELECT doc_id, size, source_size, round(least(3.0::DOUBLE * source_size, coalesce((SELECT level FROM f), 1e300) * w), 3) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""

_ORACLES["secret_base_spans"] = r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 12))::BIGINT AS n_assign,
       len(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]{14,}'))::BIGINT AS n_access,
       len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}'))::BIGINT AS n_hex
FROM documents
"""

_ORACLES["lm_base_score"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') AS said FROM documents),
w AS (SELECT r, unnest(said) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, len(said)::BIGINT AS n_tokens, len(said)::BIGINT AS n_known, n AS train_tokens, round(score, 3) AS base_score
FROM d JOIN (SELECT r, sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))) AS score FROM w JOIN c USING (w), n GROUP BY r) USING (r), n
"""


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _shipped(q) for name, q in _QUERIES.items()}


def oracle_sql():
    return dict(_ORACLES)
