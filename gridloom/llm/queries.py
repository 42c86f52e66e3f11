"""The corpus operators' queries and their SQL, for the driver contract."""

from __future__ import annotations

from gridloom.llm.extraction import op6_main_text
from gridloom.llm.jaccard import op4_jaccard_join
from gridloom.llm.language import op3_word_crf_language
from gridloom.llm.mixing import op10_temperature_mixing
from gridloom.llm.packing import op9_best_fit_packing
from gridloom.llm.quality import op2_line_crf_quality
from gridloom.llm.sharding import op1_hash_tree_sharding
from gridloom.llm.substrings import op8_repeated_passages
from gridloom.llm.vectors import op5_collision_counting
from gridloom.llm.warc import op7_dictionary_warc

QUERIES = {q.__name__: q for q in (op1_hash_tree_sharding, op2_line_crf_quality, op3_word_crf_language, op4_jaccard_join, op5_collision_counting, op6_main_text, op7_dictionary_warc, op8_repeated_passages, op9_best_fit_packing, op10_temperature_mixing)}

#: Smallest node reachable from each node a over the links (a, b), both ways.
REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

#: Plain statements of what a query returns; op7's archives and dictionaries are files, and its SQL gives the table that is
#: read back from them. Those of op4, op5 and op8 compare everything with everything of a key.
SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""WITH RECURSIVE words AS (SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
named AS (SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS rep, s FROM sets),
tokens AS (SELECT rep, n, unnest(s) AS t FROM (SELECT rep, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY rep)),
links AS (SELECT x.rep AS a, y.rep AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
{REACH}
SELECT doc_id, n AS n_shingles, least(rep, coalesce(low.b, rep)) AS component_id FROM named LEFT JOIN low ON low.a = rep""",
    "op5_collision_counting": rf"""WITH RECURSIVE sound AS (SELECT vec_id::BIGINT AS v, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.v AS a, y.v AS b FROM sound x JOIN sound y ON x.label = y.label AND x.v < y.v AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{REACH},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id::BIGINT AS vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id))::BIGINT AS component_id, least(vec_id, coalesce(low.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN low ON low.a = vec_id""",
    "op8_repeated_passages": r"""WITH words AS (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM starts SEMI JOIN again USING (h)),
stay AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words LEFT JOIN lost USING (r) LEFT JOIN stay USING (r)""",
    "op7_dictionary_warc": r"""WITH p AS (SELECT page_id::BIGINT AS page_id, url, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
s AS (SELECT digest, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1),
r AS (SELECT p.*, s.response, coalesce(p.n >= 1000 AND s.response IS NOT NULL AND s.response IS DISTINCT FROM p.page_id, false) AS revisit FROM p LEFT JOIN s ON s.digest = p.digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN revisit THEN response END AS refers_to, regexp_replace(coalesce(url, ''), '[\x00-\x20]', '', 'g') AS url FROM r""",
}
