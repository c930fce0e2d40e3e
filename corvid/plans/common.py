"""SQL fragments that several DuckDB counterparts share."""

WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
DOC_URI = "'docs://corpus/' || lang || '/' || source || '/' || doc_id || '.md'"
# the greedy cut of 2048 characters: before a heading, else after a blank line, a sentence, white space, or hard
_LAST = lambda width, pattern, ahead: f"CASE WHEN regexp_matches(left(rest, {width}), '{pattern}') THEN length(regexp_extract(left(rest, {width}), '(?s)^(.*){pattern}', 1)) + {ahead} END"
_HEADING = f"greatest({_LAST(2050, chr(92) + 'n# ', 1)}, {_LAST(2051, chr(92) + 'n## ', 1)}, {_LAST(2052, chr(92) + 'n### ', 1)})"
CUT = f"CASE WHEN length(rest) <= 2048 THEN length(rest) ELSE coalesce({_HEADING}, {_LAST(2048, chr(92) + 'n' + chr(92) + 'n', 2)}, {_LAST(2048, '[.!?] ', 2)}, {_LAST(2048, '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'v]', 1)}, 2048) END"
_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"
CHUNKS = f"""SELECT sha1('default|docs://corpus|' || {DOC_URI} || '|body|' || locator) AS chunk_id, 'docs://corpus' AS connector_uri, {DOC_URI} AS object_uri, locator, content, 'body' AS chunk_kind, doc_id, lang, source, chunk_index FROM (
    SELECT *, '{{' || CASE WHEN count(*) OVER (PARTITION BY doc_id, s, e) > 1 THEN '"chunk_index":' || chunk_index || ',' ELSE '' END || '"lines":[' || s || ',' || e || ']}}' AS locator FROM (
        WITH RECURSIVE cuts AS (
            SELECT doc_id, lang, source, text AS rest, 0 AS n, CAST(1 AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS content, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM documents
            UNION ALL
            SELECT doc_id, lang, source, substring(rest, k + 1), n + 1, line + {_BREAKS.format('left(rest, k)')}, left(rest, k), line, line + {_BREAKS.format('left(rest, k)')} + CASE WHEN right(left(rest, k), 1) = chr(10) THEN 0 ELSE 1 END
            FROM (SELECT *, {CUT} AS k FROM cuts WHERE rest <> '')
        ) SELECT doc_id, lang, source, content, s, e, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index FROM cuts WHERE content IS NOT NULL AND regexp_matches(content, '[^ \\t\\n\\r\\f\\v]')))"""
LINES = r"""(CASE WHEN string_split({0}, chr(10))[-1] = '' THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END)"""


def bm25_sql(terms: list[str], where: str = "true", k: int = 10, extra: str = "", source: str = "true", chunks: str = CHUNKS) -> str:
    tf = ", ".join(f"len(list_filter(words, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))" for i in range(len(terms)))
    return f"""
        WITH chunks AS ({chunks}), w AS (SELECT *, {WORDS.format('content')} AS words FROM chunks WHERE {source}),
        c AS (SELECT * EXCLUDE (words, content), len(words) AS dl, {tf} FROM w),
        s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c)
        SELECT chunk_id, object_uri{extra}, round({score}, 6) AS score FROM c, s WHERE ({hit}) AND ({where}) ORDER BY score DESC, chunk_id LIMIT {k}"""
