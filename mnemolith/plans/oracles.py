"""DuckDB SQL for the registered queries of the archive and recall engine."""

from __future__ import annotations

from .queries import QUERY, TERMS

SPACE = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g'))"


def summary(x: str) -> str:
    c = collapse(x)
    return f"CASE WHEN length({c}) <= 120 THEN {c} ELSE concat(rtrim(substring({c}, 1, 120)), '...') END"


def preview(source: str, key: str, text: str) -> str:
    """A table ``key, preview`` of the rows of ``source``."""
    places = ", ".join(f"{{'at': strpos(lower(c), '{k}'), 'o': {i}, 'n': {len(k)}}}" for i, k in enumerate(QUERY.lower().split()))
    return f"""
      SELECT {key}, CASE WHEN h IS NULL THEN (CASE WHEN length(c) <= 120 THEN c ELSE concat(rtrim(substring(c, 1, 120)), '...') END)
        ELSE concat(CASE WHEN a > 0 THEN '...' ELSE '' END, trim(substring(c, a + 1, b - a)), CASE WHEN b < length(c) THEN '...' ELSE '' END) END AS preview
      FROM (SELECT *, greatest(0, h.at - 1 - greatest(20, (120 - h.n) // 2)) AS a, least(length(c), h.at - 1 + h.n + greatest(20, (120 - h.n) // 2)) AS b
        FROM (SELECT {key}, c, list_min(list_filter([{places}], lambda p: p.at > 0)) AS h FROM (SELECT {key}, {collapse(text)} AS c FROM {source})))"""


def _flush(a: str) -> str:
    content = strip(f"array_to_string({a}.b, '')")
    return f"CASE WHEN length({content}) >= 30 THEN list_append({a}.o, {{'content': {content}, 's': {a}.p - {a}.n, 'e': {a}.p}}) ELSE {a}.o END"


def chunked(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name(key…, i, c)``: the chunks of the rows of ``source`` with their places."""
    kind = "STRUCT(content VARCHAR, s BIGINT, e BIGINT)[]"
    return f"""{name}_d AS (SELECT {key}, {strip(text)} AS st FROM {source}),
    {name}_s AS (SELECT {key}, list_concat(regexp_extract_all(st, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+'),
        CASE WHEN regexp_matches(st, '[。！？\\n]$') THEN [''] ELSE [] END) AS g FROM {name}_d WHERE length(st) >= 5),
    {name}_f AS (SELECT {key}, list_reduce(list_transform(g, lambda x: {{'b': [x], 'n': length(x), 'p': 0::BIGINT, 'o': []::{kind}}}),
        lambda a, x: CASE WHEN a.n + x.n <= 500 THEN {{'b': list_concat(a.b, x.b), 'n': a.n + x.n, 'p': a.p + x.n, 'o': a.o}}
          ELSE {{'b': list_concat(a.b[-1:], x.b), 'n': coalesce(length(a.b[-1]), 0) + x.n, 'p': a.p + x.n, 'o': {_flush("a")}}} END,
        {{'b': []::VARCHAR[], 'n': 0::BIGINT, 'p': 0::BIGINT, 'o': []::{kind}}}) AS a FROM {name}_s),
    {name}_u AS (SELECT {key}, {_flush("a")} AS o FROM {name}_f),
    {name} AS (SELECT {key}, unnest(range(len(o))) AS i, unnest(o) AS c FROM {name}_u)"""


MESSAGES = """m AS (SELECT conv_id, turn, conv_id || '-' || turn AS message_id, conv_id::VARCHAR AS conversation_id, 'Conversation ' || conv_id AS title,
    'ChatGPT' AS source, role AS sender_type, text AS content, strftime(DATE '2024-01-01' + (conv_id % 365)::INTEGER, '%Y-%m-%d 00:00:00') AS ts FROM conversations)"""
DOCUMENTS = f"""{MESSAGES},
  rd AS (SELECT *, 'chatgpt:conversation_message:' || message_id AS raw_document_id, {strip("content")} AS body FROM m WHERE {strip("content")} <> '')"""
UNITS = f"""{DOCUMENTS}, {chunked("ch", "rd", "raw_document_id", "body")},
  mu AS (SELECT raw_document_id || ':' || i AS memory_unit_id, raw_document_id, i AS unit_index, 'chunk' AS unit_type, c.content AS content, c.s AS start_char, c.e AS end_char FROM ch
    UNION ALL SELECT raw_document_id || ':0', raw_document_id, 0, 'chunk', body, 0, length(body) FROM rd WHERE raw_document_id NOT IN (SELECT raw_document_id FROM ch))"""
_counts = ", ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) / {len(t)}" for t in TERMS)
_query = ", ".join(str(float(QUERY.count(t))) for t in TERMS)
HITS = f"""{UNITS},
  hv AS (SELECT *, [{_counts}, length(content)]::DOUBLE[] AS v FROM mu),
  hits AS (SELECT *, round(1 - list_sum(list_transform(list_zip(v, [{_query}, {float(len(QUERY))}]::DOUBLE[]), lambda z: z[1] * z[2])) / (
      sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform([{_query}, {float(len(QUERY))}]::DOUBLE[], lambda x: x * x)))), 6) AS score FROM hv)"""


def page(where: str, order: str) -> str:
    return f"""WITH {HITS}, top AS (SELECT * FROM hits ORDER BY score, memory_unit_id LIMIT 150),
      shown AS (SELECT memory_unit_id AS chunk_id, raw_document_id AS message_id, ts AS timestamp, length(content_1)::BIGINT AS char_count, title, content_1, score
        FROM (SELECT top.memory_unit_id, top.raw_document_id, top.score, top.content AS content_1, rd.title, rd.ts FROM top JOIN rd USING (raw_document_id))),
      pv AS ({preview("shown", "chunk_id", "content_1")})
      SELECT chunk_id, message_id, timestamp, char_count, title, preview, score FROM shown JOIN pv USING (chunk_id) WHERE {where} ORDER BY {order} LIMIT 50"""


OLDER = f"""{MESSAGES},
  cv AS (SELECT conversation_id, min(title) AS title FROM m GROUP BY 1 HAVING count(*) > 1),
  cm AS (SELECT * FROM m WHERE sender_type <> 'system'), {chunked("oc", "cm", "message_id, conv_id, turn, sender_type", "content")},
  chunk AS (SELECT conv_id * 10000000 + turn * 10000 + i AS chunk_id, message_id, i AS chunk_index, c.content AS content, (sender_type = 'assistant')::BIGINT AS is_embedded FROM oc)"""

ORACLE_SQL = {
    "raw_documents_from_conversations": f"""WITH {DOCUMENTS} SELECT raw_document_id, source, 'conversation_message' AS source_type, message_id AS external_id,
      conversation_id AS root_document_id, title, sender_type AS author, ts AS created_at, md5(body) AS content_hash FROM rd""",
    "chunk_documents": f"""WITH {chunked("k", "documents", "doc_id", "text")} SELECT doc_id, c.s AS start_char, c.e AS end_char, md5(c.content) AS content_md5 FROM k""",
    "memory_units_conversations": f"""WITH {UNITS} SELECT memory_unit_id, raw_document_id, unit_index::BIGINT AS unit_index, unit_type, start_char::BIGINT AS start_char,
      end_char::BIGINT AS end_char, md5(content) AS content_md5, {summary("content")} AS summary FROM mu""",
    "unit_counts_by_document": f"WITH {UNITS} SELECT raw_document_id, count(*) AS units, sum(length(content))::BIGINT AS chars FROM mu GROUP BY 1",
    "import_counters": f"WITH {UNITS} SELECT (SELECT count(*) FROM rd) AS raw_documents, (SELECT count(*) FROM mu) AS memory_units",
    "summary_documents": f"SELECT doc_id, {summary('text')} AS summary FROM documents",
    "preview_documents": preview("documents", "doc_id", "text"),
    "content_hash_dedupe": "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "chunk_hash_exists": f"WITH {OLDER} SELECT message_id FROM m WHERE md5(content) IN (SELECT md5(content) FROM chunk)",
    "vector_topk_cosine": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
      SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""",
    "vector_topk_l1": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
      SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q.e), lambda z: abs(z[1] - z[2]))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""",
    "term_count_recall": f"""WITH {HITS}, top AS (SELECT * FROM hits ORDER BY score, memory_unit_id LIMIT 10), pv AS ({preview("top", "memory_unit_id", "content")})
      SELECT memory_unit_id, score, {summary("top.content")} AS summary, preview, rd.source, 'conversation_message' AS source_type, rd.title, rd.sender_type AS author, rd.ts AS created_at,
        raw_document_id, rd.message_id AS external_id, rd.conversation_id AS root_document_id, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char
      FROM top JOIN rd USING (raw_document_id) JOIN pv USING (memory_unit_id)""",
    "recall_default": page("true", "score, chunk_id"),
    "recall_time_asc": page("true", "timestamp, score, chunk_id"),
    "recall_time_desc": page("true", "timestamp DESC, score, chunk_id"),
    "recall_filtered": page("char_count >= 60 AND timestamp[:10] >= '2024-01-05' AND timestamp[:10] <= '2024-03-20'", "score, chunk_id"),
    "trace_detail": f"""WITH {UNITS} SELECT memory_unit_id, raw_document_id, message_id AS external_id, conversation_id AS root_document_id, title, sender_type AS author, ts AS created_at,
      start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, md5(body) AS raw_md5 FROM mu JOIN rd USING (raw_document_id)""",
    "legacy_messages_scan": f"""WITH {OLDER} SELECT message_id, conversation_id, cv.title, sender_type, md5(content) AS content_hash, turn AS sequence, ts AS timestamp, source
      FROM m JOIN cv USING (conversation_id)""",
    "legacy_message_by_chunk": f"""WITH {OLDER} SELECT chunk_id, message_id, conversation_id, cv.title, sender_type, md5(m.content) AS content_hash, length(m.content) AS content_length
      FROM chunk JOIN m USING (message_id) JOIN cv USING (conversation_id)""",
    "grouped_chunks": f"WITH {OLDER} SELECT message_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_index, chunk_id) AS chunk_ids FROM chunk GROUP BY 1",
    "messages_needing_chunks": f"""WITH {OLDER} SELECT message_id, cv.title, sender_type FROM m JOIN cv USING (conversation_id) LEFT JOIN chunk USING (message_id) WHERE chunk_id IS NULL""",
    "unprocessed_chunks": f"""WITH {OLDER} SELECT chunk_id, message_id, cv.title, ts AS timestamp, md5(chunk.content) AS content_md5
      FROM chunk JOIN m USING (message_id) JOIN cv USING (conversation_id) WHERE is_embedded = 0 ORDER BY chunk_id LIMIT 100""",
    "bootstrap_raw_documents": f"""WITH {OLDER} SELECT 'legacy:message:' || message_id AS raw_document_id, source, 'legacy_message' AS source_type, message_id AS external_id,
      conversation_id AS root_document_id, cv.title, sender_type AS author, ts AS created_at, md5(content) AS content_hash, '{{}}' AS raw_payload FROM m JOIN cv USING (conversation_id)""",
    "bootstrap_memory_units": f"""WITH {OLDER} SELECT chunk_id::VARCHAR AS memory_unit_id, 'legacy:message:' || message_id AS raw_document_id, chunk_index::BIGINT AS unit_index,
      'legacy_chunk' AS unit_type, md5(chunk.content) AS content_md5, {summary("chunk.content")} AS summary, 'BAAI/bge-small-zh-v1.5' AS embedding_version, is_embedded
      FROM chunk JOIN m USING (message_id) JOIN cv USING (conversation_id)""",
    "upsert_last_wins": """WITH r AS (SELECT conv_id::VARCHAR AS raw_document_id, role AS sender_type, md5(text) AS content_hash,
        row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
      SELECT raw_document_id, sender_type, content_hash FROM r WHERE n = 1
      QUALIFY row_number() OVER (PARTITION BY raw_document_id ORDER BY sender_type) = 1""",
    "replace_memory_units": f"""WITH {UNITS} SELECT memory_unit_id, raw_document_id, md5(content) AS content_md5 FROM mu
        WHERE raw_document_id NOT IN (SELECT raw_document_id FROM rd WHERE sender_type = 'system')
      UNION ALL SELECT raw_document_id || ':new', raw_document_id, md5(body) FROM rd WHERE sender_type = 'system'""",
    "source_clashes": f"""WITH {DOCUMENTS}, cv AS (SELECT conversation_id FROM m GROUP BY 1 HAVING count(*) > 1)
      SELECT 'legacy:message:' || message_id AS raw_document_id, raw_document_id AS new_id FROM rd JOIN cv USING (conversation_id)""",
    "sequence_numbers": f"""WITH {DOCUMENTS} SELECT message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) - 1 AS sequence FROM rd""",
    "normalize_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS normalized FROM events",
    "format_timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS formatted FROM events",
    "count_rows_all": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("conversations", "documents", "embeddings", "events", "labels", "pages", "benchmark")),
    "metadata_values": f"""WITH {OLDER} SELECT f.field, f.value, count(*) AS n FROM (SELECT unnest([{{'field': 'title', 'value': cv.title}}, {{'field': 'source', 'value': source}},
        {{'field': 'sender_type', 'value': sender_type}}, {{'field': 'model', 'value': 'unknown'}}]) AS f FROM m JOIN cv USING (conversation_id)) GROUP BY ALL""",
    "openai_export": f"""WITH {MESSAGES} SELECT conversation_id, title, source, message_id, sender_type, md5(content) AS content_md5, length(content) AS content_length, 'm-1' AS model,
      row_number() OVER (PARTITION BY conversation_id ORDER BY turn) - 1 AS sequence, ts AS timestamp FROM m WHERE content <> ''""",
    "grok_export": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence FROM conversations), {MESSAGES}
      SELECT conversation_id, title, 'Grok' AS source, message_id, CASE WHEN sender_type = 'assistant' THEN 'assistant' ELSE 'user' END AS sender_type, md5(content) AS content_md5,
        length(content) AS content_length, 'm-1' AS model, n.sequence, ts AS timestamp FROM m JOIN n USING (conv_id, turn) WHERE content <> ''""",
    "stream_ingest": f"WITH {UNITS} SELECT memory_unit_id, raw_document_id, md5(content) AS content_md5, 1::BIGINT AS is_embedded FROM mu",
    "edit_replace": f"""WITH {OLDER}, e AS (SELECT message_id, conversation_id FROM m ORDER BY message_id LIMIT 1),
      rows AS (SELECT message_id, chunk_index, md5(content) AS content_md5, is_embedded FROM chunk WHERE message_id NOT IN (SELECT message_id FROM e)
        UNION ALL SELECT message_id, 0, md5('First line of the new text, long enough.' || chr(10) || 'And one more line of it.'), 1 FROM e)
      SELECT message_id, chunk_index::BIGINT AS chunk_index, CASE WHEN conversation_id IN (SELECT conversation_id FROM e) THEN 'Edited' ELSE cv.title END AS title, content_md5, is_embedded::BIGINT AS is_embedded
      FROM rows JOIN m USING (message_id) JOIN cv USING (conversation_id)""",
    "raw_document_by_id": f"""WITH {DOCUMENTS} SELECT raw_document_id, source, message_id AS external_id, title, sender_type AS author, md5(body) AS content_hash
      FROM rd WHERE raw_document_id = (SELECT min(raw_document_id) FROM rd)""",
    "units_of_document": f"""WITH {UNITS}, most AS (SELECT raw_document_id FROM mu GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      SELECT memory_unit_id, raw_document_id, unit_index::BIGINT AS unit_index, unit_type, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, md5(content) AS content_md5
      FROM mu JOIN most USING (raw_document_id)""",
    "unit_payload_by_id": f"""WITH {UNITS} SELECT memory_unit_id, unit_index::BIGINT AS unit_index, {summary("mu.content")} AS summary, raw_document_id, ts AS created_at, md5(body) AS raw_md5,
      sender_type AS author, turn AS sequence FROM mu JOIN rd USING (raw_document_id) WHERE memory_unit_id = (SELECT min(memory_unit_id) FROM mu)""",
    "chunks_of_message": f"""WITH {OLDER}, most AS (SELECT message_id FROM chunk GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      SELECT chunk_id, message_id, chunk_index::BIGINT AS chunk_index, md5(content) AS content_md5 FROM chunk JOIN most USING (message_id)""",
    "chunk_scan": f"WITH {OLDER} SELECT chunk_id, message_id, chunk_index::BIGINT AS chunk_index FROM chunk",
    "edit_metadata_fields": f"WITH {MESSAGES} SELECT message_id, title, source, 'unknown' AS model, sender_type AS tags FROM m",
    "rollback_state": f"WITH {UNITS} SELECT memory_unit_id, raw_document_id, md5(content) AS content_md5 FROM mu",
    "mark_embedded": f"""WITH {OLDER} SELECT chunk_id, (sender_type IN ('assistant', 'user'))::BIGINT AS is_embedded FROM chunk JOIN m USING (message_id)""",
    "save_conversations": f"""WITH {OLDER} SELECT message_id, coalesce(chunk_id, -1) AS chunk_id, cv.title || ' again' AS title FROM m JOIN cv USING (conversation_id)
      LEFT JOIN (SELECT message_id, chunk_id FROM chunk JOIN m USING (message_id) WHERE sender_type <> 'user') USING (message_id)""",
    "vectors_read_and_deleted": f"""WITH {UNITS} SELECT memory_unit_id AS id, raw_document_id, length(content)::DOUBLE AS length FROM mu ORDER BY memory_unit_id LIMIT 3 OFFSET 2""",
    "archive_counts": f"""WITH {UNITS} SELECT name, n FROM (SELECT 'raw_documents' AS name, count(*) AS n FROM rd UNION ALL SELECT 'memory_units', count(*) FROM mu
      UNION ALL SELECT 'vectors', count(*) FROM mu UNION ALL SELECT 'messages', 0)""",
    "search_response": f"""WITH {HITS} SELECT '{QUERY}' AS query, 10::BIGINT AS count, row_number() OVER (ORDER BY score, memory_unit_id) - 1 AS place, memory_unit_id, raw_document_id, score
      FROM hits ORDER BY score, memory_unit_id LIMIT 10""",
    "conversation_records_kept": f"""WITH {MESSAGES} SELECT conversation_id, 'ChatGPT' AS source, title, title AS own_title, count(*) AS nodes FROM m GROUP BY 1, 3""",
    "vector_topk_odd": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
      SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS distance FROM embeddings, q WHERE vec_id % 9 NOT IN (3, 4, 5) ORDER BY distance, vec_id LIMIT 10""",
    "pruned_lookups": f"""WITH {UNITS} SELECT memory_unit_id, raw_document_id, md5(mu.content) AS content_md5, message_id AS external_id, 'term-counts' AS embedding_version, md5(body) AS raw_md5
      FROM mu JOIN rd USING (raw_document_id) WHERE raw_document_id = (SELECT max(raw_document_id) FROM rd)""",
    "archive_search": f"""WITH {HITS}, top AS (SELECT * FROM hits ORDER BY score, memory_unit_id LIMIT 50)
      SELECT memory_unit_id, score, rd.title, rd.sender_type AS author, rd.ts AS created_at, rd.message_id AS external_id, md5(top.content) AS content_md5 FROM top JOIN rd USING (raw_document_id)""",
    "filled_page": f"""WITH {HITS} SELECT memory_unit_id AS chunk_id, raw_document_id AS message_id, rd.ts AS timestamp, length(hits.content)::BIGINT AS char_count, score
      FROM hits JOIN rd USING (raw_document_id) WHERE length(hits.content) >= 100 AND rd.ts[:10] >= '2024-01-03' AND rd.ts[:10] <= '2024-01-20' ORDER BY score, memory_unit_id LIMIT 20""",
    "restored_message": f"""WITH {OLDER}, known AS (SELECT message_id, conversation_id, content, cv.title FROM m JOIN cv USING (conversation_id)),
      e AS (SELECT message_id, conversation_id FROM known ORDER BY message_id DESC LIMIT 1),
      n AS (SELECT message_id, count(*) AS chunks, min(chunk_id) AS chunk_id FROM chunk GROUP BY 1)
      SELECT message_id, md5(CASE WHEN edited THEN new ELSE content END) AS content_md5, CASE WHEN conversation_id IN (SELECT conversation_id FROM e) THEN 'Edited too' ELSE title END AS title,
        md5(CASE WHEN edited THEN new ELSE content END) AS document_md5, CASE WHEN edited THEN 'Edited too' ELSE title END AS document_title,
        CASE WHEN edited THEN 1 ELSE coalesce(chunks, 0) END AS chunks, CASE WHEN edited THEN (SELECT max(chunk_id) FROM chunk) + 2 ELSE coalesce(chunk_id, -1) END AS chunk_id
      FROM (SELECT *, message_id IN (SELECT message_id FROM e) AS edited, 'A new text of the last message, long enough to stay.' AS new FROM known) LEFT JOIN n USING (message_id)""",
    "embedding_reuse": f"""WITH {UNITS} SELECT unnest(['import', 'import again', 'another version', 'vectors of one', 'vectors of two']) AS step, unnest([d, 0, d, 0, n]) AS n
      FROM (SELECT count(DISTINCT content) AS d, count(*) AS n FROM mu)""",
    "replayed_batch": f"""WITH {UNITS} SELECT step, CASE WHEN step % 2 = 0 THEN (SELECT count(*) FROM rd) ELSE 0 END AS raw_documents,
      CASE WHEN step % 2 = 0 THEN (SELECT count(*) FROM mu) ELSE 0 END AS memory_units, step // 2 + 1 AS version FROM (SELECT unnest(range(4)) AS step)""",
    "numbered_chunks": f"""WITH {OLDER} SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS numbers, (SELECT count(*) FROM chunk) + 1 AS edited
      FROM chunk WHERE message_id <> (SELECT min(message_id) FROM m)""",
    "marked_units": f"""WITH {OLDER} SELECT chunk_id::VARCHAR AS memory_unit_id, (sender_type IN ('assistant', 'user'))::BIGINT AS is_embedded
      FROM chunk JOIN m USING (message_id) JOIN cv USING (conversation_id)""",
    "vectors_rolled_back": f"WITH {UNITS} SELECT memory_unit_id AS id, length(mu.content)::DOUBLE AS length, title, md5(mu.content) AS content_md5 FROM mu JOIN rd USING (raw_document_id)",
    "edited_vectors": f"""WITH {OLDER} SELECT 'legacy:message:' || message_id AS raw_document_id, cv.title, 'editor' AS author, source, 'The thing and the rest of que de ch, long enough.' AS document,
      '2,1,1,0,1,1,1,49' AS embedding FROM m JOIN cv USING (conversation_id) ORDER BY message_id LIMIT 1""",
}
ORACLE_SQL |= {
    "vector_index_topk": ORACLE_SQL["vector_topk_cosine"],
    "split_openai_export": ORACLE_SQL["openai_export"],
    "split_grok_export": ORACLE_SQL["grok_export"],
    "deepseek_export": ORACLE_SQL["openai_export"],
}
