"""Queries of this subpackage for the entry file, and their SQL."""

from __future__ import annotations

from .funnels import funnels_sql, op12_ordered_funnels
from .html_wrapper import op8_html_extraction
from .leak_scan import op11_decontamination
from .neardup_vectors import op9_embedding_near_dedup
from .ngram_join import op6_ngram_jaccard_join
from .packing import op4_packing
from .progressive_jpeg import op10_media_columns
from .quality import op2_quality_classifier
from .suffix_dedup import op7_suffix_array_dedup
from .toxicity import op3_toxicity
from .piece_scan import op1_sentencepiece
from .warc import op5_warc
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality_classifier, op3_toxicity, op4_packing, op5_warc, op6_ngram_jaccard_join, op7_suffix_array_dedup, op8_html_extraction, op9_embedding_near_dedup, op10_media_columns, op11_decontamination, op12_ordered_funnels, op13_embedding_whitening)}

ORACLES = {
    "op5_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
             g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN g USING (payload_digest)""",
    "op12_ordered_funnels": funnels_sql(),
    "op11_decontamination": r"""
        WITH l AS (SELECT text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)),
             s AS (SELECT text, CASE WHEN t IS NULL THEN [] ELSE regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM l),
             b AS (SELECT item_id, w, least(len(w), 10) AS k FROM benchmark JOIN s USING (text) WHERE len(w) > 0),
             x AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
             d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
             p AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN s ON d.text IS NOT DISTINCT FROM s.text, (SELECT DISTINCT k FROM b)),
             m AS (SELECT r, i, p.k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p) p JOIN x ON p.k = x.k AND p.g = x.g),
             h AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY 1),
             y AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS c FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d JOIN s ON d.text IS NOT DISTINCT FROM s.text LEFT JOIN h USING (r) LEFT JOIN y USING (r)""",
}
