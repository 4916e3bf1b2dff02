"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from basalt.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from basalt.llm.embedding_dedup import op8_embedding_dedup
from basalt.llm.html_text import op10_html_text
from basalt.llm.language_id import op2_language_id
from basalt.llm.lexical_search import OP13_SQL, op13_lexical_search
from basalt.llm.mixing import OP4_SQL, op4_mix_sources
from basalt.llm.ngram_join import op7_shingle_join
from basalt.llm.sentence_pieces import op3_sentence_pieces
from basalt.llm.sharding import op9_ring_shards
from basalt.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from basalt.llm.tiff import op6_tiff_media
from basalt.llm.toxicity import op5_toxicity
from basalt.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_tiff_media": op6_tiff_media,
    "op7_shingle_join": op7_shingle_join,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_ring_shards": op9_ring_shards,
    "op10_html_text": op10_html_text,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}

#: All pairs are met here, so this is for small tables.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), t AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT l.a, r.c FROM l JOIN r ON r.doc_id = l.b
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = s.doc_id
"""
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.a, r.c FROM l JOIN r ON r.vec_id = l.b
), m AS (
  SELECT vec_id, min(c) AS c FROM r GROUP BY 1
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, m.c = e.vec_id AS kept FROM embeddings e JOIN m ON m.vec_id = e.vec_id
"""

ORACLE_SQL = {"op1_warc": OP1_SQL, "op4_mix_sources": OP4_SQL, "op7_shingle_join": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op11_substring_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
