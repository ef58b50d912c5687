"""The queries of this subpackage, for ``__spark_entry__.py``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, chat, decontaminate, divergence, lines, ogg, packing, quality, secrets, sharding, simhash, toxicity, warc


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _over(decontaminate.contaminated, "documents", "benchmark"),
    "op2_secret_scan": _over(secrets.document_secrets, "documents"),
    "op3_ogg_media": _over(ogg.document_media, "documents"),
    "op4_chat_format": _over(chat.conversation_digests, "conversations"),
    "op5_simhash": _over(simhash.document_classes, "documents"),
    "op6_toxicity": _over(toxicity.scored, "documents", "labels"),
    "op7_packing": _over(packing.packed_documents, "documents"),
    "op8_quality": _over(quality.scored, "documents", "labels"),
    "op9_byte_shards": _over(sharding.document_shards, "documents"),
    "op10_warc": _over(warc.archived_pages, "pages"),
    "op11_source_divergence": _over(divergence.source_divergence, "documents"),
    "op12_line_dedup": _over(lines.document_lines, "documents"),
    "op13_alignment": _over(align.document_alignment, "documents"),
    "pipeline": _pipeline,
}


def _assignment(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_KEYWORDS = "|".join(map(_assignment, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
_QUOTE = "[\"'']?"
_ASSIGN = f"({_KEYWORDS}){_QUOTE} *[:=] *{_QUOTE}([A-Za-z0-9+/_.=-]+)"


def _kind_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the running lengths of the pieces between matches and of the matches themselves."""
    return f"""
    SELECT doc_id, start, {rank} AS rank, '{kind}' AS kind, start + n AS stop FROM (
      SELECT doc_id, n, g, CAST(sum(gap + n) OVER (PARTITION BY doc_id, copy ORDER BY k) - n AS BIGINT) AS start FROM (
        SELECT doc_id, copy, k, length(gaps[k]) AS gap, length(found[k]) AS n, length(parts[k]) AS g FROM (
          SELECT doc_id, copy, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
                 regexp_extract_all(text, '{pattern}', {group}) AS parts, unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS k
          FROM docs WHERE regexp_matches(text, '{pattern}'))))
    WHERE g >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS copy, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join((_kind_sql("assign", 0, _ASSIGN, 2, 6), _kind_sql("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20), _kind_sql("hex", 2, "[0-9a-f]{24,}", 0, 24)))}),
said AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
                count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h
         FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN said USING (doc_id)""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
moves AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN k = n AND role <> 'assistant' THEN false WHEN role = 'system' THEN k = 1
                     WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN coalesce(before = 'user', false) ELSE false END) AS valid
FROM moves GROUP BY conv_id""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, v.v, v.total AS lang_total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
                FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM full_counts),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
          ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY row, doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
top AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN top USING (html)""",
    # crc32 by its table, over the bytes of the text
    "op9_byte_shards": """
WITH crc AS (SELECT list(t ORDER BY n) AS tab FROM (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS t FROM (SELECT unnest(range(0, 256)) AS n))),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
             list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes FROM documents),
r AS (SELECT doc_id, size, CAST(xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
s AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS k FROM r WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(least((2 * upto - size) * 24 // (2 * total), 23) AS INT) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(k - min(k) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p""",
}
