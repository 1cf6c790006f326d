"""DuckDB SQL for the rows of the registered queries."""

from __future__ import annotations

_DOCS = r"""
docs AS (
  SELECT *, tsec // 86400 AS shard, ((tsec // 86400) << 32) | ('0x' || substr(md5(id), 1, 8))::BIGINT AS indexed_id
  FROM (SELECT doc_id, coalesce(lang, '') AS mbox, 'doc' || doc_id AS id, coalesce(source, '') AS author, coalesce(text, '') AS body,
               split_part(coalesce(text, ''), chr(10), 1) AS title,
               1704067200 + (doc_id % 30) * 86400 + (doc_id * 7919) % 86400 AS tsec
        FROM documents)
)"""

_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

_POSTINGS = (
    _DOCS
    + r""", texts AS (
  SELECT mbox, 'fulltext' AS attr, indexed_id, body AS x FROM docs UNION ALL SELECT mbox, 'title', indexed_id, title FROM docs
  UNION ALL SELECT mbox, 'author', indexed_id, author FROM docs
), postings AS (
  SELECT DISTINCT mbox, attr, indexed_id >> 32 AS shard, indexed_id, unnest("""
    + _WORDS.format("x")
    + r""") AS token FROM texts
)"""
)

_HTML = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', ' ', 'g')"
_LINKS = "regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)"
_HEX = "printf('%016x', indexed_id)"
_BYTES = "strlen(id) + strlen(author) + strlen(body) + strlen(title)"
_THE = "mbox = 'en' AND attr = 'fulltext' AND token = 'the'"


def _with(ctes: str, sql: str) -> str:
    return f"WITH {ctes} {sql}"


def _matching(terms: list[tuple[str, str, str]], without: str = "", where: str = "TRUE") -> str:
    """A query for the ids that have all terms and none of the words of `without`."""
    tests = [f"count(*) FILTER (WHERE mbox = '{m}' AND attr = '{a}' AND token = '{t}') > 0" for m, a, t in terms]
    tests += [f"count(*) FILTER (WHERE mbox = 'en' AND attr = 'fulltext' AND token = '{t}') = 0" for t in without.split()]
    return f"SELECT indexed_id FROM postings WHERE {where} GROUP BY indexed_id HAVING {' AND '.join(tests)}"


def _en(words: str, attr: str = "fulltext") -> list[tuple[str, str, str]]:
    return [("en", attr, w) for w in words.split()]


_THREE = _en("the and from")
_START, _END = "(19727::BIGINT << 32)", "(19742::BIGINT << 32)"


def _found(match: str, where: str = "TRUE", columns: str = "indexed_id, id, author", tail: str = "") -> str:
    return _with(_POSTINGS, f"SELECT {columns} FROM docs WHERE indexed_id IN ({match}) AND {where} {tail}")


def _phrase(column: str, phrase: str) -> str:
    return f"contains(' ' || array_to_string({_WORDS.format(column)}, ' ') || ' ', ' {phrase} ')"


_PAGE = "ORDER BY indexed_id LIMIT 20"
_KEYS = f"SELECT {_HEX} AS key, shard, ({_BYTES})::BIGINT AS bytes FROM docs"

ORACLE: dict[str, str] = {
    "ingest_documents": _with(_DOCS, "SELECT indexed_id, shard, id, author, false AS is_comment, length(body)::BIGINT AS content_chars, title FROM docs"),
    "scan_postings": _with(_POSTINGS, "SELECT shard, mbox, attr, token, indexed_id FROM postings"),
    "get_document_by_id": _with(_DOCS, f"SELECT id, {_HEX} AS indexed_id, author FROM docs WHERE {_HEX} = '00004d0fb2d6a8a4'"),
    "term_search": _with(_POSTINGS, f"SELECT shard, indexed_id FROM postings WHERE {_THE}"),
    "token_shards": _with(_POSTINGS, "SELECT mbox, attr, token, string_agg(shard::VARCHAR, ',' ORDER BY shard) AS shards FROM (SELECT DISTINCT mbox, attr, token, shard FROM postings) GROUP BY ALL"),
    "index_dump": _with(_POSTINGS, f"SELECT {_HEX} AS key, strftime(to_timestamp(shard * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS time, id, author, title FROM docs WHERE indexed_id IN (SELECT indexed_id FROM postings WHERE {_THE})"),
    "merge_postings": _with(
        _POSTINGS
        + rf""", pagetexts AS (
  SELECT coalesce(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS mbox, page_id, {_HTML} AS body,
         trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1)) AS title FROM pages
), pagetokens AS (
  SELECT mbox, attr, page_id, unnest({_WORDS.format("x")}) AS token
  FROM (SELECT mbox, 'fulltext' AS attr, page_id, body AS x FROM pagetexts UNION ALL SELECT mbox, 'title', page_id, title FROM pagetexts)
), pagepostings AS (
  SELECT DISTINCT mbox, attr, 19723 + page_id % 30 AS shard,
         ((19723 + page_id % 30) << 32) | ('0x' || substr(md5('page' || page_id), 1, 8))::BIGINT AS indexed_id, token FROM pagetokens
)""",
        "SELECT mbox, attr, token, shard, indexed_id FROM postings UNION SELECT mbox, attr, token, shard, indexed_id FROM pagepostings",
    ),
    "mailbox_filter": _with(_POSTINGS, "SELECT mbox, attr, count(DISTINCT token)::BIGINT AS n_tokens, count(DISTINCT indexed_id)::BIGINT AS n_docs FROM postings WHERE mbox = 'de' GROUP BY mbox, attr"),
    "attribute_search": _with(_POSTINGS, _matching(_en("src7", "author"))),
    "time_start": _with(_POSTINGS, _matching(_THREE, where=f"indexed_id >= {_START}")),
    "time_end": _with(_POSTINGS, _matching(_THREE, where=f"indexed_id <= {_END}")),
    "time_range": _with(_POSTINGS, _matching(_THREE, "ha", f"indexed_id BETWEEN {_START} AND {_END}")),
    "negation": _with(_POSTINGS, _matching(_THREE, "ha")),
    "exact_phrase": _found(_matching(_en("of the")), _phrase(_HTML.replace("html", "body"), "of the")),
    "exact_title": _found(_matching(_en("the", "title")), _phrase(_HTML.replace("html", "title"), "in the")),
    "custom_check": _found(_matching(_THREE), "length(body) > 500 AND author = 'src7'"),
    "limit_check": _found(_matching(_THREE), "length(body) > 500 AND author = 'src7'", tail=_PAGE),
    "limit_phrase": _found(_matching(_en("of the")), _phrase(_HTML.replace("html", "body"), "of the"), tail="ORDER BY indexed_id LIMIT 7"),
    "relevance": _found(_matching(_THREE), "length(body) > 500", columns=f"id, {_HEX} AS indexed_id, (length(body) // 1000)::FLOAT AS relevance"),
    "result_json": _found(
        _matching(_THREE),
        columns=f"to_json(struct_pack(id := id, indexed_id := {_HEX}, author := author, content := struct_pack(content := body, title := title, links := []::VARCHAR[], images := []::VARCHAR[]), "
        "relevance := 0::FLOAT, timestamp := struct_pack(tsec := shard * 86400, tnsec := indexed_id & 4294967295)))::VARCHAR AS result",
        tail=_PAGE,
    ),
    "search_projection": _found(
        _matching(_THREE),
        columns=f"id, {_HEX} AS indexed_id, author, title, 0::INTEGER AS n_links, 0::FLOAT AS relevance, shard * 86400 AS tsec, indexed_id & 4294967295 AS tnsec",
    ),
    "dangling_postings": _found(_matching(_THREE), "author <> 'src7'", "indexed_id, id"),
    "and_search": _with(_POSTINGS, _matching(_THREE)),
    "common_shards": _with(_POSTINGS, " INTERSECT ".join(f"SELECT shard FROM postings WHERE mbox = 'en' AND attr = 'fulltext' AND token = '{t}'" for t in ("the", "and", "from"))),
    "negation_anti_join": _with(
        _POSTINGS,
        " INTERSECT ".join(f"SELECT indexed_id FROM postings WHERE mbox = 'en' AND attr = 'fulltext' AND token = '{t}'" for t in ("the", "and", "from"))
        + " EXCEPT SELECT indexed_id FROM postings WHERE mbox = 'en' AND attr = 'fulltext' AND token = 'ha'",
    ),
    "search_documents": _found(_matching(_THREE)),
    "multi_mailbox": _with(
        _POSTINGS,
        "SELECT indexed_id FROM postings WHERE mbox = 'en' AND attr = 'fulltext' AND token = 'the' AND indexed_id IN "
        "(SELECT p.indexed_id FROM postings p JOIN docs USING (indexed_id) WHERE author = 'src7' AND attr = 'fulltext' AND token = 'and')",
    ),
    "multi_attribute": _with(_POSTINGS, _matching([*_en("and"), *_en("the", "title")])),
    "posting_lists": _with(_POSTINGS, "SELECT mbox, attr, token, shard, count(*)::INTEGER AS n, string_agg(indexed_id::VARCHAR, ',' ORDER BY indexed_id) AS ids FROM postings GROUP BY mbox, attr, token, shard"),
    "token_positions": _with(
        _POSTINGS + f", words AS (SELECT mbox, attr, indexed_id, {_WORDS.format('x')} AS ws FROM texts), each AS (SELECT mbox, attr, indexed_id, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM words)",
        "SELECT mbox, attr, token, indexed_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM each GROUP BY mbox, attr, token, indexed_id",
    ),
    "index_shard_counts": _with(_POSTINGS, f"SELECT shard, count(*)::BIGINT AS n_ids FROM postings WHERE {_THE} GROUP BY shard"),
    "index_merged": _with(_POSTINGS, f"SELECT 'en.fulltext.the' AS name, count(DISTINCT shard)::BIGINT AS n_shards, count(DISTINCT indexed_id)::BIGINT AS n_ids FROM postings WHERE {_THE}"),
    "check_shard_docs": _with(_DOCS, "SELECT shard, count(*)::BIGINT AS n_docs FROM docs GROUP BY shard"),
    "list_totals": _with(_DOCS, f"SELECT count(*)::BIGINT AS n_keys, coalesce(sum({_BYTES}), 0)::BIGINT AS total_bytes FROM docs"),
    "key_bounds": _with(_DOCS, f"SELECT min({_HEX}) AS first_key, max({_HEX}) AS last_key FROM docs"),
    "merge_documents": _with(_DOCS, "SELECT indexed_id, id, CASE WHEN author = 'src7' THEN 'editor' ELSE author END AS author FROM docs "
        "UNION ALL SELECT ((19723 + page_id % 30) << 32) | ('0x' || substr(md5('page' || page_id), 1, 8))::BIGINT, 'page' || page_id, '' FROM pages"),
    "document_ids": _with(_DOCS, "SELECT id, indexed_id + CASE WHEN author = 'src7' THEN 4294967296 ELSE 0 END AS indexed_id FROM docs"),
    "range_compaction": _with(_POSTINGS, "SELECT indexed_id, id, 'editor' AS author, (SELECT count(*) FROM postings p WHERE p.indexed_id = d.indexed_id AND NOT (attr = 'fulltext' AND token = 'again')) + 1 AS terms FROM docs d"),
    "compact_chunks": f"""
WITH RECURSIVE {_DOCS}, keys AS (
  SELECT {_HEX} AS key, ({_BYTES})::BIGINT AS bytes, row_number() OVER (ORDER BY indexed_id) AS n FROM docs
), fold AS (
  SELECT n, key, bytes, bytes AS filled, 0::BIGINT AS chunk FROM keys WHERE n = 1
  UNION ALL
  SELECT k.n, k.key, k.bytes, CASE WHEN f.filled >= 100000 THEN k.bytes ELSE f.filled + k.bytes END,
         CASE WHEN f.filled >= 100000 THEN f.chunk + 1 ELSE f.chunk END
  FROM fold f JOIN keys k ON k.n = f.n + 1
)
SELECT chunk, min(key) AS first_key, max(key) AS last_key, count(*)::BIGINT AS n_keys, sum(bytes)::BIGINT AS bytes FROM fold GROUP BY chunk""",
    "terms_per_document": _with(_POSTINGS, "SELECT indexed_id, count(*)::BIGINT AS terms FROM postings GROUP BY indexed_id"),
    "list_running": _with(_DOCS, f"SELECT key, bytes, row_number() OVER (ORDER BY key)::BIGINT AS number, sum(bytes) OVER (ORDER BY key)::BIGINT AS running_bytes FROM ({_KEYS})"),
    "check_monotonic": _with(_DOCS, "SELECT count(*)::BIGINT AS n_out_of_order FROM (SELECT shard, lag(shard) OVER (ORDER BY id) AS previous FROM docs) WHERE previous > shard"),
    "check_boundaries": _with(_DOCS, f"SELECT key, shard, previous FROM (SELECT key, shard, lag(shard) OVER (ORDER BY key) AS previous FROM ({_KEYS})) WHERE previous <> shard"),
    "check_large_shard": _with(_DOCS, f"SELECT key, shard FROM ({_KEYS}) WHERE shard > 19740"),
    "limit_search": _found(_matching(_en("the")), tail="ORDER BY indexed_id LIMIT 7"),
    "page_one": _found(_matching(_THREE), tail=_PAGE),
    "page_two": _found(_matching(_THREE), tail="ORDER BY indexed_id LIMIT 20 OFFSET 20"),
    "page_state": _with(
        _POSTINGS + f", page AS (SELECT indexed_id FROM docs WHERE indexed_id IN ({_matching(_THREE)}) {_PAGE})",
        "SELECT count(*) <> 20 AS completed, printf('%016x', coalesce(max(indexed_id) + 1, 0)) AS next_document_id FROM page",
    ),
    "seek_term": _with(_POSTINGS, f"SELECT shard, indexed_id FROM postings WHERE {_THE} AND indexed_id >= (19735::BIGINT << 32) ORDER BY indexed_id LIMIT 5"),
    "id_pack": _with(_DOCS, "SELECT doc_id, ('0x' || substr(md5(id), 1, 8))::BIGINT AS aux, indexed_id FROM docs"),
    "id_unpack": _with(_DOCS, "SELECT indexed_id, (indexed_id >> 32) * 86400 AS tsec, indexed_id & 4294967295 AS aux FROM docs"),
    "id_hex": _with(_DOCS, f"SELECT indexed_id, {_HEX} AS hex FROM docs"),
    "id_parse": _with(_DOCS, "SELECT indexed_id, indexed_id AS parsed, shard AS leading FROM docs"),
    "shard_number": _with(_DOCS, "SELECT indexed_id, indexed_id >> 32 AS shard_no FROM docs"),
    "index_key": _with(_POSTINGS, "SELECT DISTINCT mbox || '.' || attr || '.' || token AS base, printf('%016x', shard) || '.' || mbox || '.' || attr || '.' || token AS key FROM postings"),
    "tokenize": f"SELECT doc_id, array_to_string({_WORDS.format('coalesce(text, $$$$)')}, ' ') AS words FROM documents",
    "ngram_tokens": rf"""
WITH words AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM words),
near AS (SELECT doc_id, w, pos::INTEGER AS pos, lag(w) OVER o AS before, lead(w) OVER o AS after FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, w AS token, pos FROM near WHERE length(w) >= 3
UNION ALL SELECT doc_id, before || w, pos FROM near WHERE length(w) < 3 AND before IS NOT NULL
UNION ALL SELECT doc_id, w || after, pos FROM near WHERE length(w) < 3 AND after IS NOT NULL""",
    "html_text": f"SELECT page_id, {_HTML} AS body FROM pages",
    "content_words": f"SELECT page_id, array_to_string({_WORDS.format(_HTML)}, ' ') AS words FROM pages",
    "json_props": """
SELECT event_id,
       CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN (props ->> '$.k')::BIGINT ELSE -1 END AS k,
       CASE WHEN json_type(props, '$.n') IN ('BIGINT', 'UBIGINT') THEN (props ->> '$.n')::BIGINT ELSE -1 END AS n,
       CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props ->> '$.k' ELSE 'none' END AS k_text,
       CASE WHEN json_type(props, '$.n') = 'VARCHAR' THEN props ->> '$.n' ELSE 'none' END AS n_text
FROM events""",
    "json_ingest": """
SELECT coalesce(lang, '') AS mbox, 'doc' || doc_id AS id, coalesce(source, '') AS author, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS tsec, coalesce(text, '') AS content, '' AS title,
       concat_ws(',', lang, source) AS links, CASE WHEN text IS NULL THEN 0 ELSE 1 END::BIGINT AS n_attrs
FROM documents""",
    "json_strings": f"SELECT page_id, array_to_string({_LINKS}, ' ') AS strings, len({_LINKS})::BIGINT AS n_strings, page_id::VARCHAR AS numbers FROM pages",
    "page_links": f"SELECT page_id, len({_LINKS})::BIGINT AS n_links, array_to_string({_LINKS}, ',') AS links FROM pages",
    "id_timestamp": _with(_DOCS, "SELECT indexed_id, strftime(to_timestamp(shard * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day FROM docs"),
    "dump_links": f"SELECT 'page' || page_id AS id, array_to_string({_LINKS}, ' ') AS links FROM pages",
}
