"""The registered query of each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimcheck.llm import (
    automaton,
    chat,
    credentials,
    licenses,
    mixing,
    negatives,
    packing,
    piecewise,
    simhash,
    toxicity,
    trie,
    vectors,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_document_fingerprints": piecewise.op5_document_fingerprints,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_embedding_dedup": vectors.op8_embedding_dedup,
    "op9_lm_scoring": automaton.op9_lm_scoring,
    "op10_warc": warc.op10_warc,
    "op11_secret_scans": credentials.op11_secret_scans,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op6_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + length('### : </turn>') + 1
    + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS written
  FROM turns
), found AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(written)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM found
""",
    "op8_embedding_dedup": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
""",
    "op10_warc": """
WITH read AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), least AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS smallest FROM read)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= 100 AND page_id <> smallest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND page_id <> smallest THEN smallest END AS refers_to
FROM least
""",
    "op11_secret_scans": credentials.oracle(),
    "op12_prefix_trie": """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, conv_id::VARCHAR AS c FROM numbered
), crc AS (  -- bit by bit: a byte is put in, eight shifts follow
  SELECT conv_id, head, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c, ''),
      lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS h
  FROM ids
), whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM numbered GROUP BY conv_id
), built AS (
  SELECT crc.conv_id, list_concat(coalesce(heads.turns[1:h], []), own.turns[h + 1:]) AS turns
  FROM crc JOIN whole own USING (conv_id) LEFT JOIN whole heads ON heads.conv_id = crc.head
), prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS key, len(turns) = d AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), tree AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth
), children AS (
  SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL
), facts AS (
  SELECT tree.*, coalesce(n, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(key[depth].text) ELSE 0 END AS saved
  FROM tree LEFT JOIN children USING (key, depth)
), below AS (
  SELECT up.key, sum(down.saved)::BIGINT AS saved_tokens, count(*) FILTER (down.n_children = 0) AS n_leaves
  FROM facts up JOIN facts down ON down.depth >= up.depth AND down.key[1:up.depth] = up.key GROUP BY up.key
)
SELECT facts.conv_id, facts.depth, up.conv_id AS parent_conv_id, facts.n_convs, facts.n_children, n_leaves,
  saved_tokens, facts.ends_sha256
FROM facts JOIN below USING (key) LEFT JOIN tree up ON up.depth = facts.depth - 1 AND up.key = facts.key[1:facts.depth - 1]
""",
    "op13_hard_negatives": """
WITH read AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM read a JOIN read b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT a, b, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT a AS anchor_id, p.b AS positive_id,
  row_number() OVER (PARTITION BY a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (a)
WHERE NOT same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
""",
}
