"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockwright.llm import bpe, fingerprint, jaccard_join, langid, line_crf, ngram_quality, packing, substring_dedup, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_trie_jaccard_join": jaccard_join.op1,
        "op2_order_minhash": fingerprint.op2,
        "op3_line_crf": line_crf.op3,
        "op4_kneser_ney_toxicity": toxicity.op4,
        "op5_two_stage_suffix_array": suffix_dedup.op5,
        "op6_harmonic_packing": packing.op6,
        "op7_byte_cnn_language": langid.op7,
        "op8_byte_bpe": bpe.op8,
        "op9_ngram_quality": ngram_quality.op9,
        "op10_prefix_suffix_tree": substring_dedup.op10,
    }


#: Components of similar documents: shingles that documents share, links, and all that links reach.
OP1 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n q ON x = q.doc_id JOIN n r ON y = r.doc_id WHERE 100 * c >= 75 * (q.n + r.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, t.c FROM t JOIN e ON t.doc_id = e.x)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.c) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id"""

#: What stays when each window of 13 words is kept only in the document with the smallest id.
OP10 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT k.doc_id, i FROM k JOIN m USING (k) WHERE first < doc_id), range(13) AS t(j)),
a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
b AS (SELECT a.doc_id, count(g.i) AS removed, string_agg(x, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN b USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express at a bearable cost; tests hold the others against brute force."""
    return {"op1_trie_jaccard_join": OP1, "op10_prefix_suffix_tree": OP10}
