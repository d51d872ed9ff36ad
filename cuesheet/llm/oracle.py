"""The queries of this subpackage in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

# The stream of a source is read from its start until the target is reached.
_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM sizes
), levels AS (
  SELECT *,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, number
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY 2 * source_size / weight, number) AS cap_rank
  FROM weighed
), fit AS (
  SELECT arg_min(level, cap_rank) FILTER (WHERE level <= 2 * source_size / weight) AS level FROM levels
), targets AS (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE, fit.level * weight) AS target
  FROM weighed, fit
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source
           ORDER BY md5(concat(coalesce(d.doc_id::VARCHAR, ''), ':', d.size)), d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE
          (words // source_size) * size
          + greatest(0, least(place + size, words % source_size) - place) END)::BIGINT AS taken
FROM placed
"""


# What is read back is what went in; only the length depends on the template.
_OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '&((?:amp;)*(?:lt|#91|#10);)', '&amp;\1', 'g'),
      '<(\||/?s>|</?SYS>>)', '&lt;\1', 'g'),
      '<(</?SYS>>)', '&lt;\1', 'g'),
      '\[(/?INST\])', '&#91;\1', 'g') AS shown
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(shown) + 24)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


_UUID = "printf('urn:uuid:%s-%s-3%s-8%s-%s', h[1:8], h[9:12], h[14:16], h[18:20], h[21:32])"
_NL = "chr(13) || chr(10)"


def _decoded(text: str) -> str:
    """The character references that the pages hold."""
    plain = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    return f"""replace(replace(replace({plain}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"')"""


_OP7 = rf"""
WITH responses AS (
  SELECT url AS target_uri, html AS payload, md5(concat('response', chr(10), page_id, chr(10), url)) AS h,
         strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
         concat('HTTP/1.1 200 OK', {_NL}, 'Content-Type: text/html; charset=utf-8', {_NL},
                'Content-Length: ', strlen(html)) AS source_headers
  FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
), digests AS (
  SELECT *, {_UUID} AS refers_to,
         'sha256:' || sha256(concat(source_headers, {_NL}, {_NL}, payload)) AS source_block_digest,
         'sha256:' || sha256(payload) AS source_payload_digest,
         trim(regexp_replace({_decoded("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)")}, '\s+', ' ', 'g')) AS title,
         list_transform(regexp_extract_all(payload, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1),
                        lambda x: concat('outlink: ', regexp_replace({_decoded("x")}, '\s+', '', 'g'), ' L a/@href', {_NL})) AS links
  FROM responses
), bare AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(payload,
      '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', ' ', 'g'),
      '(?s)<!--.*?(?:-->|\z)|<![^>]*>', ' ', 'g'),
      '(?i)</?(?:p|div|br|li|ul|h[1-6]|article|nav|footer|title|head|body|html)\b[^>]*>', chr(10), 'g'),
      '(?i)</?[a-z][^>]*(?:>|\z)', '', 'g'),
      '&amp;?', '&', 'g') AS shown
  FROM digests
), derived AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    concat(array_to_string(list_transform(string_split(source_headers, {_NL}),
             lambda x: concat('source-header: ', x, {_NL})), ''),
           'source-block-digest: ', source_block_digest, {_NL},
           'source-payload-digest: ', source_payload_digest, {_NL},
           'title: ', title, {_NL}, array_to_string(links, '')) AS block
  FROM bare
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8',
    trim(regexp_replace(regexp_replace(
      replace(replace(replace(shown, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'),
      '[ \t\r\f\v\x{{a0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))
  FROM bare
)
SELECT {_UUID} AS record_id, * EXCLUDE (h) FROM (
  SELECT md5(concat(warc_type, chr(10), refers_to)) AS h, warc_type, refers_to, target_uri, warc_date,
         source_headers, source_block_digest, source_payload_digest, content_type, block,
         'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length
  FROM derived)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_format_conversations": _OP2, "op4_mix_documents": _OP4, "op7_warc_derivatives": _OP7}
