"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from harborline.llm.bpe import op10_bpe
from harborline.llm.chat_format import op6_chat_format
from harborline.llm.collocations import PHRASE_SQL, op13_collocations
from harborline.llm.hilbert_sharding import op8_hilbert_sharding
from harborline.llm.lm_scoring import op2_lm_scoring
from harborline.llm.media_tiff import op4_media_tiff
from harborline.llm.ngram_join import op3_ngram_jaccard_join
from harborline.llm.packing import op5_best_fit_packing
from harborline.llm.quality_classifier import op7_quality_classifier
from harborline.llm.quality_rules import op1_quality_rules
from harborline.llm.ranked_search import SEARCH_SQL, op12_ranked_search
from harborline.llm.substring_dedup import op11_substring_dedup
from harborline.llm.url_filters import op9_url_filters

OPERATORS = (
    op1_quality_rules, op2_lm_scoring, op3_ngram_jaccard_join, op4_media_tiff, op5_best_fit_packing,
    op6_chat_format, op7_quality_classifier, op8_hilbert_sharding, op9_url_filters, op10_bpe,
    op11_substring_dedup, op12_ranked_search, op13_collocations,
)


def queries():
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


#: Shingle sets, all linked pairs and the smallest id that links reach, for DuckDB.
JOIN_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, MIN(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def oracle_sql() -> dict[str, str]:
    """The join, the search and the phrases: the others fit models, tokenise or hash in ways that SQL lacks, or look at every 50 bytes."""
    return {"op3_ngram_jaccard_join": JOIN_SQL, "op12_ranked_search": SEARCH_SQL, "op13_collocations": PHRASE_SQL}
