"""The numbered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from sentiforge.llm.byte_bpe import op12_byte_bpe
from sentiforge.llm.chat_windows import op7_chat_windows
from sentiforge.llm.collision_search import op10_collision_search
from sentiforge.llm.disclosure import op2_disclosure
from sentiforge.llm.lexical_rank import ORACLE_SQL as LEXICAL_SQL
from sentiforge.llm.lexical_rank import op13_lexical_rank
from sentiforge.llm.ngram_join import op3_ngram_join
from sentiforge.llm.packing import op5_best_fit_packing
from sentiforge.llm.passages import op4_passages
from sentiforge.llm.pieces import op9_pieces
from sentiforge.llm.quality_classifier import op1_quality_classifier
from sentiforge.llm.quality_rules import op6_quality_rules
from sentiforge.llm.token_alignment import op11_token_alignment
from sentiforge.llm.token_codes import op8_token_codes

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_disclosure": op2_disclosure,
    "op3_ngram_join": op3_ngram_join,
    "op4_passages": op4_passages,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_windows": op7_chat_windows,
    "op8_token_codes": op8_token_codes,
    "op9_pieces": op9_pieces,
    "op10_collision_search": op10_collision_search,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_rank": op13_lexical_rank,
}

# every pair of sets that share a shingle, compared in full; components by following links; n_links counts different sets
NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2])
                                               WHEN len(ws) > 0 THEN [array_to_string(ws, chr(32))] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, x.class AS ca, y.class AS cb FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id,
       (SELECT count(DISTINCT cb) FROM link WHERE a = d.doc_id AND ca <> cb) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

# the exact neighbours: what the search finds where it misses none
NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLE: dict[str, str] = {"op3_ngram_join": NGRAM_SQL, "op10_collision_search": NEAREST_SQL, "op13_lexical_rank": LEXICAL_SQL}
