"""SQL for the registered queries, written from what each operator means, for DuckDB."""

from __future__ import annotations

# Fixed values, written out here again: the pattern of a name, and the instruction block of the prompt.
NAME = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
SYSTEM_PROMPT = """<SystemPrompt>
A user's prompt, in the form of a question, or a description code to write, is shown below. Satisfy the user's prompt or question to the best of your ability. If asked to complete code, DO NOT type out any extra text, or backticks since your response will be appended to the end of the CurrentFile. DO NOT regurgitate the whole file. Simply return the new code, or the modified code.
</SystemPrompt>
"""  # noqa: E501

FILES = """
files AS (
  SELECT doc_id, lang AS workspace, source || '/' || doc_id || '.' || lang AS path, text, md5(text) AS md5
  FROM documents)"""

_KIND_WORD = """CASE right(l, 1) WHEN '.' THEN 'function' WHEN '!' THEN 'method' WHEN '|' THEN 'module'
      WHEN '#' THEN 'enum' WHEN '%' THEN 'interface' ELSE 'class' END"""
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SYMBOLS = (
    FILES
    + f""",
file_lines AS (
  SELECT doc_id, workspace, path, string_split(text, chr(10)) AS ls FROM files),
one_line AS (
  SELECT doc_id, workspace, path, ls, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line_no FROM file_lines),
defined AS (
  SELECT *, regexp_extract(l, '^({NAME})', 1) AS name, {_KIND_WORD} AS kind_word FROM one_line
  WHERE regexp_matches(l, '^{NAME}')),
extents AS (
  SELECT *, row_number() OVER w - 1 AS symbol_no,
    coalesce(lead(line_no) OVER w, len(ls)) - 1 AS end_line
  FROM defined WINDOW w AS (PARTITION BY workspace, path ORDER BY line_no)),
symbol AS (
  SELECT doc_id, workspace, path, symbol_no::INT AS symbol_no, kind_word, name, ls,
    CASE kind_word WHEN 'class' THEN 5 WHEN 'function' THEN 12 WHEN 'method' THEN 6 WHEN 'module' THEN 2
      WHEN 'interface' THEN 11 WHEN 'enum' THEN 10 ELSE 13 END AS kind,
    line_no::INT AS start_line, 0 AS start_col, end_line::INT AS end_line,
    length(ls[end_line + 1])::INT AS end_col,
    md5(workspace || chr(10) || path) AS file_id,
    md5(workspace || chr(10) || path) || ':' || symbol_no AS symbol_id,
    {_FOLD.format("name")} AS name_fold,
    path || ' ' || line_no || ':0-' || end_line || ':' || length(ls[end_line + 1]) AS uid,
    array_to_string(ls[line_no + 1:end_line + 1], chr(10)) AS body
  FROM extents)"""
)

# Two pieces when the range lies inside one line: its tail and its head.
_PLAIN_BODY = "CASE WHEN start_line = end_line THEN body || chr(10) || body ELSE body END"

REFERENCES = f""",
spans AS (
  SELECT workspace, path, line_no, regexp_extract_all(l, '({NAME})') AS m, string_split_regex(l, '{NAME}') AS g
  FROM one_line),
placed AS (
  SELECT workspace, path, line_no, m, g, unnest(range(1, len(m) + 1)) AS k FROM spans),
reference AS (
  SELECT workspace, path, line_no::INT AS line, m[k] AS content,
    (length(coalesce(array_to_string(g[1:k], ''), ''))
      + length(coalesce(array_to_string(m[1:k - 1], ''), '')))::INT AS start_col
  FROM placed)"""

RESOLVED = """,
in_file AS (
  SELECT workspace, path, name, uid AS file_uid FROM symbol
  QUALIFY row_number() OVER (PARTITION BY workspace, path, name ORDER BY start_line) = 1),
in_workspace AS (
  SELECT workspace, name, path AS ws_path, uid AS ws_uid FROM symbol
  QUALIFY row_number() OVER (PARTITION BY workspace, name ORDER BY path, start_line) = 1),
resolved AS (
  SELECT r.*, CASE WHEN f.file_uid IS NULL THEN ws_path ELSE r.path END AS def_path,
    coalesce(f.file_uid, ws_uid) AS uid
  FROM reference r
  LEFT JOIN in_file f ON f.workspace = r.workspace AND f.path = r.path AND f.name = r.content
  JOIN in_workspace w ON w.workspace = r.workspace AND w.name = r.content)"""

LABELLED = """,
labelled AS (SELECT f.*, quality, toxic FROM files f JOIN labels USING (doc_id)),
prior AS (
  SELECT workspace, path, CASE WHEN quality = 0 THEN md5(text || 'x') ELSE md5 END AS md5 FROM labelled)"""

OVERLAY = """,
opened AS (
  SELECT workspace, path, 'unsaved' || chr(10) || text AS open_text FROM labelled WHERE toxic = 1
  UNION ALL SELECT 'scratch', 'item/' || item_id, text FROM benchmark),
overlay AS (
  SELECT coalesce(f.workspace, o.workspace) AS workspace, coalesce(f.path, o.path) AS path,
    open_text IS NOT NULL AS is_open, coalesce(open_text, f.text) AS text
  FROM files f FULL JOIN opened o ON f.workspace = o.workspace AND f.path = o.path)"""

DOCUMENT_STATE = """
ev AS (
  SELECT 'file:///u/' || user_id AS uri, event_id AS seq, event_type, ts FROM events),
edges AS (
  SELECT uri, max(seq) AS last_seq, max(CASE WHEN event_type = 'signup' THEN seq END) AS opened,
    max(CASE WHEN event_type = 'error' THEN seq END) AS closed
  FROM ev GROUP BY uri),
state AS (
  SELECT e.uri, coalesce(opened > coalesce(closed, -1), false) AS is_open, opened, last_seq FROM edges e),
inserted AS (
  SELECT s.uri, string_agg(event_type || chr(10), '' ORDER BY seq DESC) AS added
  FROM state s JOIN ev ON ev.uri = s.uri AND is_open AND seq > opened GROUP BY s.uri),
document AS (
  SELECT s.uri, is_open, CASE WHEN is_open THEN 'log' END AS language_id,
    CASE WHEN is_open THEN opened::INT END AS version,
    CASE WHEN is_open THEN coalesce(added, '') || 'start ' || opened || chr(10) END AS text,
    CASE WHEN is_open THEN o.ts END AS last_edit, last_seq
  FROM state s LEFT JOIN inserted USING (uri) LEFT JOIN ev o ON o.seq = s.opened)"""

_METHOD = """CASE event_type WHEN 'signup' THEN 'textDocument/didOpen' WHEN 'error' THEN 'textDocument/didClose'
    ELSE 'textDocument/didChange' END"""
_PARAMS = """CASE event_type
    WHEN 'signup' THEN '{"textDocument":{"uri":"file:///u/' || user_id || '","languageId":"log","version":'
      || event_id || ',"text":"start ' || event_id || '\\n"}}'
    WHEN 'error' THEN '{"textDocument":{"uri":"file:///u/' || user_id || '"}}'
    ELSE '{"textDocument":{"uri":"file:///u/' || user_id || '","version":' || event_id
      || '},"contentChanges":[{"range":{"start":{"line":0,"character":0},"end":{"line":0,"character":0}},"text":"'
      || event_type || '\\n"}]}' END"""

# The text of a stream up to and including a chunk; positions are read off it.
SO_FAR = """
chunk AS (SELECT conv_id AS stream_id, turn AS seq, text FROM conversations),
so_far AS (
  SELECT c.stream_id, c.seq, any_value(c.text) AS text,
    string_agg(p.text, '' ORDER BY p.seq) AS upto,
    coalesce(string_agg(p.text, '' ORDER BY p.seq) FILTER (p.seq < c.seq), '') AS before
  FROM chunk c JOIN chunk p ON p.stream_id = c.stream_id AND p.seq <= c.seq GROUP BY c.stream_id, c.seq)"""

_NEWLINES = "(length({0}) - length(replace({0}, chr(10), '')))"
_LAST_LINE = "string_split({0}, chr(10))[-1]"

# Replays the reports: what a chunk with a newline shows is all text since the previous such chunk's
# first newline, up to its own first newline.
REPORTS = (
    SO_FAR
    + """,
closing AS (
  SELECT stream_id, seq, length(before) + instr(text, chr(10)) - 1 AS cut, upto FROM so_far
  WHERE contains(text, chr(10))),
report AS (
  SELECT stream_id, seq, 'progress: ' || substr(upto,
    coalesce((lag(cut) OVER w) + 1, 0) + 1,
    cut - coalesce((lag(cut) OVER w) + 1, 0)) AS message
  FROM closing WINDOW w AS (PARTITION BY stream_id ORDER BY seq))"""
)

SPEC_ITEMS = (
    SYMBOLS
    + LABELLED
    + OVERLAY
    + f""",
spec AS (
  SELECT doc_id AS spec_id, f.workspace, path, text, quality + 2 * toxic AS label,
    regexp_extract(text, '^({NAME})', 1) AS word
  FROM files f LEFT JOIN labels USING (doc_id)),
item AS (
  SELECT spec_id, workspace, 0 AS line_no, 0 AS item_no, path AS parts, 'file' AS type, path AS filename,
    '' AS identifier, NULL::BIGINT AS range_start, NULL::BIGINT AS range_end, NULL AS error
  FROM spec WHERE label IS NULL
  UNION ALL SELECT spec_id, workspace, 2, 0, path || '|1:2' || CASE word WHEN '' THEN '' ELSE '|' || word END || '|2:2',
    'range', path, '1:2', 1, 2, NULL FROM spec WHERE label IS NULL
  UNION ALL SELECT spec_id, workspace, 2, 1, path || '|1:2|' || word || '|2:2', 'symbol', path, word, NULL, NULL, NULL
  FROM spec WHERE label IS NULL AND word <> ''
  UNION ALL SELECT spec_id, workspace, 2, CASE word WHEN '' THEN 1 ELSE 2 END,
    path || '|1:2' || CASE word WHEN '' THEN '' ELSE '|' || word END || '|2:2', 'range', path, '2:2', 2, 2, NULL
  FROM spec WHERE label IS NULL
  UNION ALL SELECT spec_id, workspace, 0, 0, path || '|3:4|1:1000', 'range', path, '3:4', 3, 4, NULL
  FROM spec WHERE label = 0
  UNION ALL SELECT spec_id, workspace, 0, 1, path || '|3:4|1:1000', 'range', path, '1:1000', 1, 1000, NULL
  FROM spec WHERE label = 0
  UNION ALL SELECT spec_id, workspace, 0, 0, path || '|A', 'symbol', path, 'A', NULL, NULL, NULL
  FROM spec WHERE label = 1
  UNION ALL SELECT spec_id, workspace, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    CASE label WHEN 2 THEN 'bad range' ELSE 'unclosed quote' END FROM spec WHERE label IN (2, 3))"""
)

LOOKUP = """,
wanted AS ({wanted}),
hit AS (
  SELECT i.workspace, i.identifier, s.path, s.start_line, s.end_line, s.end_col,
    row_number() OVER (PARTITION BY i.workspace, i.identifier ORDER BY s.path, s.start_line) AS rank
  FROM (SELECT DISTINCT workspace, identifier FROM wanted) i
  JOIN symbol s ON s.workspace = i.workspace AND starts_with(s.name_fold, {fold})),
found AS (
  SELECT w.workspace, w.filename, w.identifier, h.start_line, h.end_line, h.end_col,
    row_number() OVER (PARTITION BY w.workspace, w.filename, w.identifier ORDER BY rank) AS first
  FROM wanted w JOIN hit h ON h.workspace = w.workspace AND h.identifier = w.identifier
    AND ends_with('/' || h.path, w.filename)),
located AS (
  SELECT w.*, f.start_line, f.end_line, f.end_col, string_split(o.text, chr(10)) AS ls
  FROM wanted w
  LEFT JOIN found f ON f.workspace = w.workspace AND f.filename = w.filename AND f.identifier = w.identifier
    AND first = 1
  LEFT JOIN overlay o ON o.workspace = w.workspace AND o.path = w.filename),
looked_up AS (
  SELECT workspace, filename, identifier,
    CASE WHEN start_line < len(ls) AND end_line < len(ls) AND end_col <= length(ls[end_line + 1]) THEN
      ls[start_line + 1] || chr(10)
      || CASE WHEN end_line - start_line > 1
           THEN array_to_string(ls[start_line + 2:end_line], chr(10)) || chr(10) ELSE '' END
      || left(ls[end_line + 1], end_col) END AS content,
    start_line IS NULL AS missing
  FROM located)"""

_LOOKUP_ITEMS = LOOKUP.format(
    wanted="SELECT DISTINCT workspace, filename, identifier FROM item WHERE type = 'symbol'",
    fold=_FOLD.format("i.identifier"),
)

# Lines a..b of a text: an end at or past the line count loses the last line.
_LINE_RANGE = """CASE WHEN {a} <= len({ls}) AND {a} - 1 <= least({b}, len({ls}) - 1)
    THEN coalesce(array_to_string({ls}[{a}:least({b}, len({ls}) - 1)], chr(10)), '') END"""

FETCHED = (
    SPEC_ITEMS
    + _LOOKUP_ITEMS
    + f""",
with_text AS (
  SELECT i.*, o.text, string_split(o.text, chr(10)) AS ls, u.content AS symbol_content, u.missing
  FROM item i LEFT JOIN overlay o ON o.workspace = i.workspace AND o.path = i.filename
  LEFT JOIN looked_up u ON i.type = 'symbol' AND u.workspace = i.workspace AND u.filename = i.filename
    AND u.identifier = i.identifier),
content AS (
  SELECT * EXCLUDE (error, text, ls), CASE type WHEN 'file' THEN text WHEN 'symbol' THEN symbol_content
    ELSE {_LINE_RANGE.format(a="greatest(range_start, 1)", b="range_end", ls="ls")} END AS content, error
  FROM with_text),
fetched AS (
  SELECT * EXCLUDE (error), CASE WHEN error IS NOT NULL THEN error
    WHEN type = 'symbol' AND missing THEN 'symbol not found'
    WHEN content IS NULL THEN 'range outside the file' END AS error
  FROM content),
rendered AS (
  SELECT *, CASE type WHEN 'file' THEN '<File' || chr(10) || 'file="' || filename || '"' || chr(10)
      WHEN 'range' THEN '<FileRange' || chr(10) || 'file="' || filename || '"' || chr(10) || 'range="' || identifier
        || '"' || chr(10)
      ELSE '<FileSymbol' || chr(10) || 'file="' || filename || '"' || chr(10) || 'symbol="' || identifier
        || '"' || chr(10) END
    || '>' || chr(10) || content || chr(10) || '</' || CASE type WHEN 'file' THEN 'File'
      WHEN 'range' THEN 'FileRange' ELSE 'FileSymbol' END || '>' || chr(10) AS rendered
  FROM fetched)"""
)

_VECTOR = """,
{name}_words AS (
  SELECT id, ('0x' || left(md5(w), 8))::BIGINT % 64 AS place
  FROM (SELECT id, unnest(string_split_regex({text}, '[ \\t\\n\\r\\x0b\\x0c]+')) AS w FROM {source})
  WHERE w <> ''),
{name}_counts AS (SELECT id, place, count(*) AS n FROM {name}_words GROUP BY id, place),
{name}_norms AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS norm FROM {name}_counts GROUP BY id),
{name}_places AS (
  SELECT s.id, p.place, coalesce((n / norm)::FLOAT, 0::FLOAT) AS value
  FROM {source} s CROSS JOIN (SELECT unnest(range(64)) AS place) p
  LEFT JOIN {name}_counts c ON c.id = s.id AND c.place = p.place LEFT JOIN {name}_norms m ON m.id = s.id)"""


def _vectors(name: str, source: str, text: str) -> str:
    return _VECTOR.format(name=name, source=source, text=_FOLD.format(text))


def _rows_of_index(files: str, symbols: str) -> str:
    return f"""SELECT 'file' AS "row", workspace, path, NULL::INT AS symbol_no, md5 AS value FROM {files}
  UNION ALL SELECT 'symbol', workspace, path, symbol_no, name FROM {symbols}"""


_PREFIX_SEARCH = " UNION ALL ".join(
    f"""(SELECT '{prefix}' AS prefix, {corrected} AS corrected, path, name, kind, start_line, start_col,
      end_line, end_col
    FROM symbol WHERE {condition} ORDER BY path, start_line LIMIT 100)"""
    for prefix, corrected, condition in [
        ("th", "false", "name_fold LIKE 'th%'"),
        ("TH", "false", "name_fold LIKE 'th%'"),
        ("t_e", "false", "name_fold LIKE 't_e%'"),
        ("é", "false", "name_fold LIKE 'é%'"),
        ("%ou", "false", "contains(name_fold, 'ou')"),
        ("th", "true", "starts_with(name_fold, 'th')"),
        ("TH", "true", "starts_with(name_fold, 'th')"),
        ("t_e", "true", "starts_with(name_fold, 't_e')"),
        ("é", "true", "starts_with(name_fold, 'é')"),
        ("%ou", "true", "starts_with(name_fold, '%ou')"),
    ]
)

_PROMPT_CONTEXT = """,
bounds AS (SELECT workspace, min(path) AS low, max(path) AS high FROM files GROUP BY workspace),
piece AS (
  SELECT b.workspace, 1 AS n, 2 AS upto, f.path, string_split(text, chr(10)) AS ls
  FROM bounds b JOIN files f ON f.workspace = b.workspace AND f.path = low
  UNION ALL SELECT b.workspace, 2, 1, f.path, string_split(text, chr(10))
  FROM bounds b JOIN files f ON f.workspace = b.workspace AND f.path = high),
ws_context AS (
  SELECT workspace, string_agg('<FileRange' || chr(10) || 'file="' || path || '"' || chr(10) || 'range="1:' || upto
    || '"' || chr(10) || '>' || chr(10) || coalesce(array_to_string(ls[1:least(upto, len(ls) - 1)], chr(10)), '')
    || chr(10) || '</FileRange>' || chr(10), '' ORDER BY n) AS context
  FROM piece GROUP BY workspace),
selected AS (
  SELECT f.path, context, len(ls) AS n, ls FROM (SELECT *, string_split(text, chr(10)) AS ls FROM files) f
  LEFT JOIN ws_context USING (workspace))"""


def _prompt(before: str, selected: str) -> str:
    return f"""md5(context || '<CurrentFile path="' || path || '">' || chr(10) || {before} || chr(10)
      || '</CurrentFile>' || chr(10) || '{SYSTEM_PROMPT.replace("'", "''")}'
      || '<UserPrompt>' || chr(10) || {selected} || chr(10) || '</UserPrompt>' || chr(10))"""


_BEFORE_CUT = """CASE n WHEN 2 THEN ls[1] ELSE array_to_string(
        list_concat([ls[1], substr(ls[2], 3)], ls[3:n - 1]), chr(10)) END"""
_SELECTED = """CASE n WHEN 2 THEN left(substr(ls[2], 3), 3) ELSE array_to_string(
        list_concat(list_concat([substr(ls[2], 3)], ls[3:n - 1]), [left(ls[n], 3)]), chr(10)) END"""
_FITS = "n >= 2 AND length(ls[2]) >= 2 AND length(ls[n]) >= CASE n WHEN 2 THEN 5 ELSE 3 END"

# Squares are summed place by place.
_DISTANCE = "sqrt(list_reduce(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y))"

_SYMBOL_COLUMNS = "kind, name, start_line, start_col, end_line, end_col"

ORACLES: dict[str, str] = {
    "scan_files": f"WITH {FILES} SELECT path, md5, strlen(text)::BIGINT AS n_bytes FROM files",
    "scan_include_roots": f"""WITH {FILES} SELECT path, md5, strlen(text)::BIGINT AS n_bytes FROM files
        WHERE (regexp_matches(path, '^src1[0-9]*/') AND workspace <> 'de')
          OR regexp_full_match(path, 'src[2-4]/[0-9]*[02468][.]en')""",
    "write_file_table": f"""WITH {FILES}
        SELECT md5(workspace || chr(10) || path) AS file_id, workspace, path, md5 FROM files""",
    "write_symbol_table": f"""WITH {SYMBOLS}
        SELECT symbol_id, workspace, path, {_SYMBOL_COLUMNS}, len(embedding)::INT AS dimensions
        FROM symbol LEFT JOIN embeddings ON vec_id = doc_id AND symbol_no = 0""",
    "read_workspace_index": f"""WITH {SYMBOLS}
        SELECT symbol_id, path, {_SYMBOL_COLUMNS} FROM symbol WHERE workspace = 'en'""",
    "parse_event_json": """
        WITH m AS (
          SELECT *, event_type = 'purchase' AS is_query, value > 50 AS broken,
            event_type IN ('view', 'click') AS is_change FROM events)
        SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close'
            WHEN 'purchase' THEN 'symbol' ELSE 'change' END AS event,
          CASE WHEN NOT broken AND NOT is_query THEN 'file:///u/' || user_id END AS uri,
          CASE WHEN NOT broken AND event_type = 'signup' THEN 'log' END AS language_id,
          CASE WHEN NOT broken AND (is_change OR event_type = 'signup') THEN event_id::INT END AS version,
          CASE WHEN NOT broken AND event_type = 'signup' THEN 'start ' || event_id || chr(10) END AS text,
          CASE WHEN NOT broken AND is_change THEN 1 END AS n_changes,
          CASE WHEN NOT broken AND is_change THEN 0 END AS first_line,
          CASE WHEN NOT broken AND is_change THEN event_type || chr(10) END AS first_text,
          CASE WHEN NOT broken AND is_query THEN 'user ' || event_id END AS query,
          CASE WHEN broken THEN 'bad params' END AS error
        FROM m""",
    "index_report_json": f"""WITH {SYMBOLS},
        record AS (
          SELECT workspace, path, list({{'name': name, 'kind': kind,
            'location': {{'uri': 'file:///repo/' || path, 'range': {{'start': {{'line': start_line, 'character': start_col}},
              'end': {{'line': end_line, 'character': end_col}}}}}},
            'RelativePath': path, 'Description': '', 'Embedding': NULL}} ORDER BY symbol_no) AS symbols
          FROM symbol GROUP BY workspace, path)
        SELECT f.path, to_json({{'symbols': symbols}})::VARCHAR AS report
        FROM files f LEFT JOIN record r ON r.workspace = f.workspace AND r.path = f.path""",
    "format_embedding": """
        SELECT vec_id, '[' || array_to_string(
            [regexp_replace(x::VARCHAR, '[.]0$', '') FOR x IN embedding], ', ') || ']' AS vector, len(embedding)::INT AS dimensions
        FROM embeddings""",
    "open_documents_snapshot": f"""WITH {DOCUMENT_STATE}
        SELECT uri, language_id, version, text, epoch_us(last_edit) AS last_edit, 0 AS last_edited_line FROM document WHERE is_open""",
    "context_graph_json": f"""WITH {SYMBOLS}{REFERENCES}{RESOLVED}
        SELECT r.path, 0 AS line, NULL AS file_md5, r.uid, count(*)::INT AS n_nodes, max(content) AS content,
          any_value(s.body) AS definition
        FROM resolved r JOIN symbol s ON s.workspace = r.workspace AND s.uid = r.uid GROUP BY r.path, r.uid
        UNION ALL SELECT path, 0, md5, NULL, NULL, NULL, NULL FROM files""",
    "exclude_glob_filter": f"""WITH {FILES} SELECT path FROM files
        WHERE NOT regexp_full_match(path, 'src1./.*')
          AND NOT regexp_full_match(path, '.*[^0-8][.](de|fr)') AND NOT regexp_full_match(path, 'src[0-2]/.*7.*')""",
    "relative_path": f"""WITH {FILES}
        SELECT '/repo/' || workspace || '/' || path AS path, workspace || '/' || path AS short_path,
          CASE WHEN workspace = 'en' THEN path END AS en_path FROM files""",
    "content_fingerprint": f"WITH {FILES} SELECT path, md5 FROM files",
    "event_fingerprint": f"""
        SELECT event_id AS seq, {_METHOD} AS method, sha1({_PARAMS}) AS request_hash,
          epoch_us(ts) * 1000 AS request_timestamp FROM events""",
    "detect_language": f"""WITH {FILES},
        named AS (
          SELECT path FROM files UNION ALL SELECT url FROM pages
          UNION ALL SELECT 'lib.d/' || lower(p_brand) || '.'
            || ['go', 'py', 'ts', 'tsx', 'jsx', 'js'][p_partkey % 6 + 1] FROM part),
        last_name AS (SELECT path, string_split(path, '/')[-1] AS base FROM named),
        tagged AS (
          SELECT path, CASE WHEN contains(base, '.') THEN string_split(base, '.')[-1] ELSE '' END AS language
          FROM last_name)
        SELECT path, language, language IN ('go', 'py', 'ts', 'tsx', 'jsx', 'js') AS known FROM tagged""",
    "supported_language_filter": f"""WITH {SYMBOLS},
        n AS (SELECT path, count(*) AS n FROM symbol WHERE workspace <> 'es' GROUP BY path)
        SELECT path, workspace AS language, workspace <> 'es' AS supported, coalesce(n, 0)::BIGINT AS n_symbols
        FROM files LEFT JOIN n USING (path)""",
    "extract_symbols": f"WITH {SYMBOLS} SELECT workspace, path, symbol_no, {_SYMBOL_COLUMNS} FROM symbol",
    "extract_references": f"""WITH {SYMBOLS}{REFERENCES}
        SELECT workspace, path, line, start_col, start_col + length(content)::INT AS end_col, 'word' AS node_type,
          content FROM reference""",
    "map_symbol_kind": f"""WITH {SYMBOLS},
        words AS (
          SELECT kind_word AS word FROM symbol UNION ALL SELECT event_type FROM events
          UNION ALL SELECT CASE WHEN c_acctbal > 5000 THEN 'type' ELSE 'macro' END FROM customer)
        SELECT word, CASE word WHEN 'class' THEN 5 WHEN 'function' THEN 12 WHEN 'method' THEN 6 WHEN 'module' THEN 2
          WHEN 'interface' THEN 11 WHEN 'enum' THEN 10 ELSE 13 END AS kind, count(*) AS n FROM words GROUP BY word""",
    "symbol_prefix_search": f"WITH {SYMBOLS} {_PREFIX_SEARCH}",
    "name_index_search": f"""WITH {SYMBOLS},
        word AS (
          SELECT 'text ' || item_id AS query_id, text AS query FROM benchmark
          UNION ALL SELECT 'word ' || item_id, string_split(text, ' ')[1] FROM benchmark),
        asked AS (FROM word UNION ALL SELECT 'head ' || query_id, left(query, 2) FROM word),
        query AS (SELECT *, unnest(['de', 'en', 'es', 'fr']) AS workspace FROM asked),
        hit AS (
          SELECT q.workspace, query_id, symbol_id, name, row_number() OVER (
            PARTITION BY q.workspace, query_id ORDER BY path, start_line)::INT AS rank
          FROM query q JOIN symbol s ON s.workspace = q.workspace AND starts_with(name_fold, {_FOLD.format("query")}))
        SELECT workspace, query_id, rank, symbol_id, name FROM hit WHERE rank <= 100""",
    "symbol_location_struct": f"""WITH {SYMBOLS}
        SELECT name, kind, 'file:///my%20repo/' || path AS uri, start_line, start_col AS start_character, end_line,
          end_col AS end_character FROM symbol""",
    "notification_filter": f"""
        SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'workspace/symbol' ELSE {_METHOD} END AS method,
          event_type <> 'purchase' AS one_way FROM events""",
    "detect_changed_files": f"""WITH {FILES}{LABELLED}
        SELECT workspace, path, md5 FROM files EXCEPT SELECT workspace, path, md5 FROM prior""",
    "skip_unchanged_files": f"""WITH {FILES}{LABELLED}
        SELECT workspace, path, md5 FROM files INTERSECT SELECT workspace, path, md5 FROM prior""",
    # A node's content is the list of all files below it, by relative path.
    "folder_changes": f"""WITH {FILES}{LABELLED},
        side AS (
          SELECT 'n' AS side, workspace AS ws, md5,
            split_part(path, '/', 1) || '/' || (doc_id // 100) || '/' || split_part(path, '/', 2) AS path FROM files
          UNION ALL
          SELECT 'o', workspace, CASE WHEN quality = 0 THEN md5(text || 'x') ELSE md5 END,
            split_part(path, '/', 1) || CASE WHEN workspace = 'de' THEN '/was-' ELSE '/' END || (doc_id // 100) || '/'
              || split_part(path, '/', 2) FROM labelled),
        file AS (
          SELECT DISTINCT side, ws, coalesce(md5, '') AS md5, path, string_split(path, '/') AS names FROM side
          WHERE ws IS NOT NULL AND path IS NOT NULL),
        node AS (
          SELECT side, ws, depth, array_to_string(names[1:depth], '/') AS path, depth < 3 AS is_dir,
            CASE WHEN depth > 0 THEN array_to_string(names[1:depth - 1], '/') END AS parent, count(*) AS n,
            string_agg(array_to_string(names[depth + 1:], '/') || ' ' || md5, ',' ORDER BY file.path, md5) AS content
          FROM file, range(4) AS depths(depth) GROUP BY 1, 2, 3, 4, 5, 6),
        lone AS (
          SELECT * FROM node x WHERE NOT EXISTS (
            FROM node y WHERE y.side <> x.side AND y.ws = x.ws AND y.depth = x.depth AND y.path = x.path)),
        top AS (
          SELECT * FROM lone a WHERE depth = 0 OR NOT EXISTS (
            FROM lone b WHERE b.side = a.side AND b.ws = a.ws AND b.depth = a.depth - 1 AND b.path = a.parent)),
        met AS (
          SELECT t.*, o.path AS old_path FROM top t LEFT JOIN (
            SELECT ws, is_dir, content, min(path) AS path FROM top WHERE side = 'o' GROUP BY ALL) o USING (ws, is_dir, content)
          WHERE side = 'n'),
        rest AS (
          SELECT side, ws, depth, path FROM met WHERE old_path IS NULL
          UNION ALL
          SELECT side, ws, depth, path FROM top t WHERE side = 'o' AND NOT EXISTS (
            FROM met m WHERE m.ws = t.ws AND m.is_dir = t.is_dir AND m.old_path = t.path)),
        loose AS (
          SELECT f.side, f.ws, f.path, f.md5 FROM file f, range(4) AS depths(depth)
          JOIN rest r ON r.depth = depths.depth AND r.side = f.side AND r.ws = f.ws
            AND r.path = array_to_string(f.names[1:depths.depth], '/')),
        met_file AS (
          SELECT l.*, o.path AS old_path FROM loose l LEFT JOIN (
            SELECT ws, md5, min(path) AS path FROM loose WHERE side = 'o' GROUP BY ALL) o USING (ws, md5)
          WHERE side = 'n')
        SELECT x.ws AS workspace, x.path, x.is_dir, 'changed' AS change, NULL::VARCHAR AS old_path, x.n AS n_files
        FROM node x JOIN node y USING (ws, depth, path) WHERE x.side = 'n' AND y.side = 'o' AND x.content <> y.content
        UNION ALL SELECT ws, path, is_dir, 'moved', old_path, n FROM met WHERE old_path IS NOT NULL
        UNION ALL SELECT ws, path, false, if(old_path IS NULL, 'added', 'moved'), old_path, 1 FROM met_file
        UNION ALL SELECT ws, path, false, 'removed', NULL, 1 FROM loose l WHERE side = 'o' AND NOT EXISTS (
          FROM met_file m WHERE m.ws = l.ws AND m.old_path = l.path)""",
    "delete_file_symbols": f"""WITH {SYMBOLS}{LABELLED},
        gone AS (SELECT path FROM labelled WHERE toxic = 1),
        kept_files AS (SELECT * FROM files WHERE path NOT IN (SELECT path FROM gone)),
        kept_symbols AS (SELECT * FROM symbol WHERE path NOT IN (SELECT path FROM gone))
        {_rows_of_index("kept_files", "kept_symbols")}""",
    # Every file of the scan is either unchanged or replaced, so the new index is the index of the scan.
    "replace_file_index": f"WITH {SYMBOLS} {_rows_of_index('files', 'symbol')}",
    "semantic_symbol_search": f"""WITH {SYMBOLS},
        parts AS (
          SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS place FROM embeddings),
        means AS (SELECT label, place, avg(v) AS mean FROM parts GROUP BY label, place),
        target AS (SELECT label AS query_id, list(mean ORDER BY place) AS q FROM means GROUP BY label),
        ranked AS (
          SELECT workspace, query_id, symbol_id, path, name, row_number() OVER (PARTITION BY workspace, query_id
            ORDER BY {_DISTANCE.format("q", "embedding::DOUBLE[]")}, symbol_id)::INT AS rank
          FROM symbol JOIN embeddings ON vec_id = doc_id AND symbol_no = 0 CROSS JOIN target)
        SELECT workspace, query_id, rank, symbol_id, path, name FROM ranked WHERE rank <= 10""",
    "hybrid_symbol_search": f"""WITH {SYMBOLS},
        embedded AS (SELECT *, symbol_id AS id, chr(10) || body AS embedded FROM symbol),
        asked_text AS (
          SELECT 'text ' || item_id AS query_id, text AS query FROM benchmark
          UNION ALL SELECT 'word ' || item_id, string_split(text, ' ')[1] FROM benchmark),
        query AS (SELECT *, unnest(['de', 'en', 'es', 'fr']) AS workspace FROM asked_text),
        prefix_hit AS (
          SELECT q.workspace, query_id, 'prefix' AS source, row_number() OVER (
            PARTITION BY q.workspace, query_id ORDER BY path, start_line)::INT AS rank, symbol_id, name
          FROM query q JOIN symbol s ON s.workspace = q.workspace AND starts_with(name_fold, {_FOLD.format("query")})),
        unmatched AS (
          SELECT q.*, query_id AS id FROM query q
          WHERE strlen(query) >= 10 AND contains(query, ' ') AND NOT EXISTS (
            SELECT 1 FROM prefix_hit h WHERE h.workspace = q.workspace AND h.query_id = q.query_id)),
        asked_once AS (SELECT DISTINCT id, query FROM unmatched)
        {_vectors("symbol", "embedded", "embedded")}{_vectors("asked", "asked_once", "query")},
        symbol_vector AS (SELECT id, list(value::DOUBLE ORDER BY place) AS v FROM symbol_places GROUP BY id),
        asked_vector AS (SELECT id, list(value::DOUBLE ORDER BY place) AS v FROM asked_places GROUP BY id),
        ranked AS (
          SELECT u.workspace, u.query_id, s.id AS symbol_id, row_number() OVER (PARTITION BY u.workspace, u.query_id
            ORDER BY {_DISTANCE.format("a.v", "s.v")}, s.id)::INT AS rank
          FROM unmatched u JOIN asked_vector a ON a.id = u.id JOIN embedded e ON e.workspace = u.workspace
          JOIN symbol_vector s ON s.id = e.id)
        SELECT workspace, query_id, source, rank, symbol_id, name FROM prefix_hit WHERE rank <= 100
        UNION ALL SELECT r.workspace, query_id, 'semantic', rank, symbol_id, name
        FROM ranked r JOIN symbol USING (symbol_id) WHERE rank <= 10""",
    "open_document_overlay": f"""WITH {FILES}{LABELLED}{OVERLAY}
        SELECT workspace, path, is_open, md5(text) AS text_md5 FROM overlay""",
    "lookup_symbol_text": f"""WITH {SYMBOLS}{LABELLED}{OVERLAY}{
        LOOKUP.format(
            wanted="SELECT workspace, path AS filename, max(name) AS identifier FROM symbol GROUP BY workspace, path",
            fold=_FOLD.format("i.identifier"),
        )}
        SELECT workspace, filename, identifier, content, CASE WHEN missing THEN 'symbol not found'
          WHEN content IS NULL THEN 'range outside the file' END AS error FROM looked_up""",
    "resolve_references": f"""WITH {SYMBOLS}{REFERENCES}{RESOLVED}
        SELECT workspace, path, line, start_col, content, def_path, uid FROM resolved""",
    "reference_classes": f"""WITH {SYMBOLS}{REFERENCES},
        definition_count AS (
          SELECT workspace, name AS content, count(*) AS n_definitions, min(uid) AS first_uid, max(uid) AS last_uid
          FROM symbol GROUP BY ALL),
        node_count AS (SELECT workspace, content, count(*) AS n_members FROM reference GROUP BY ALL)
        SELECT *, n_definitions * n_members AS n_links FROM definition_count JOIN node_count USING (workspace, content)""",
    "reference_members": f"""WITH {SYMBOLS}{REFERENCES},
        definition_count AS (SELECT workspace, name AS content, count(*) AS n_definitions FROM symbol GROUP BY ALL)
        SELECT workspace, path, line, start_col, content, n_definitions
        FROM reference JOIN definition_count USING (workspace, content)""",
    "linked_definitions": f"""WITH {SYMBOLS}{REFERENCES}{LABELLED}
        SELECT r.workspace, r.path, r.line, r.start_col, s.uid, s.path = r.path AS in_file
        FROM reference r JOIN symbol s ON s.workspace = r.workspace AND s.name = r.content
        WHERE r.path IN (SELECT path FROM labelled WHERE toxic = 1)""",
    "enclosing_definition": f"""WITH {SYMBOLS}{REFERENCES}
        SELECT r.workspace, r.path, r.line || ':' || r.start_col AS place, s.uid, md5(s.body) AS definition_md5
        FROM reference r JOIN symbol s ON s.workspace = r.workspace AND s.path = r.path
          AND s.start_line <= r.line AND r.line <= s.end_line""",
    "resolve_workspace_config": """
        WITH dirs AS (SELECT DISTINCT '/repo/' || lang || '/' || source AS directory, lang, source FROM documents),
        by_path AS (
          SELECT '/repo/' || lang || '/' || source AS directory, min(lang || '-' || doc_id) AS name, any_value(lang) AS lang
          FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1),
        by_name AS (SELECT DISTINCT source FROM documents WHERE lang = 'es')
        SELECT d.directory, coalesce(p.name, d.source) AS config_name,
          CASE WHEN p.name IS NOT NULL THEN '*.md' WHEN n.source IS NOT NULL THEN d.source || '/*' ELSE '' END AS include,
          CASE WHEN p.name IS NOT NULL THEN '*.' || p.lang ELSE '' END AS exclude,
          CASE WHEN p.name IS NOT NULL THEN 'path' WHEN n.source IS NOT NULL THEN 'name' ELSE 'default' END AS matched_by
        FROM dirs d LEFT JOIN by_path p USING (directory) LEFT JOIN by_name n ON n.source = d.source""",
    "model_defaults": """
        SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'llama3.1:8b' ELSE c_mktsegment END
            AS default_model,
          CASE WHEN c_acctbal > 0 THEN 'embed-' || c_nationkey ELSE 'nomic-embed-text' END AS embedding,
          CASE WHEN c_nationkey > 12 THEN c_name ELSE 'starcoder2:3b' END AS explain_code FROM customer""",
    "symbols_per_file": f"""WITH {SYMBOLS},
        n AS (SELECT workspace, path, count(*) AS n FROM symbol GROUP BY workspace, path),
        per_file AS (
          SELECT f.workspace, f.path, coalesce(n, 0)::BIGINT AS n_symbols
          FROM files f LEFT JOIN n ON n.workspace = f.workspace AND n.path = f.path)
        SELECT * FROM per_file
        UNION ALL SELECT 'total', count(*)::VARCHAR, sum(n_symbols)::BIGINT FROM per_file""",
    "failed_files": f"""WITH {FILES}{LABELLED}
        SELECT workspace, path, 'not a text file' AS error FROM labelled WHERE toxic = 1""",
    "group_captures": f"""WITH {SYMBOLS}{REFERENCES}{RESOLVED}
        SELECT r.workspace, r.path, r.uid,
          string_agg(line || ':' || r.start_col || ':' || content, ' ' ORDER BY line, r.start_col) AS nodes,
          md5(any_value(s.body)) AS definition_md5
        FROM resolved r JOIN symbol s ON s.workspace = r.workspace AND s.uid = r.uid
        GROUP BY r.workspace, r.path, r.uid""",
    "duration_stats": """
        WITH sample AS (SELECT event_type AS source, round(value * 1000000)::BIGINT AS nanos FROM events)
        SELECT source, (sum(nanos) // count(*))::BIGINT AS avg_nanos, min(nanos) AS min_nanos, max(nanos) AS max_nanos
        FROM sample GROUP BY source""",
    "duration_ratio": """
        WITH sample AS (SELECT event_type AS source, round(value * 1000000)::BIGINT AS nanos FROM events),
        average AS (SELECT source, (sum(nanos) // count(*))::DOUBLE AS avg FROM sample GROUP BY source)
        SELECT a.source AS subject, b.source AS base, round(a.avg / b.avg, 9) AS ratio,
          CASE WHEN a.avg / b.avg > 1 THEN 'slower' ELSE 'faster' END AS verdict
        FROM average a, average b
        WHERE (a.source, b.source) IN (('view', 'click'), ('click', 'view'), ('purchase', 'error'))""",
    "compare_listings": """
        WITH n AS (
          SELECT (SELECT count(*) FROM documents) AS a,
            (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS b)
        SELECT a AS n_first, b AS n_second, a <> b AS mismatch FROM n UNION ALL SELECT a, a, false FROM n""",
    "build_context": f"""WITH {FETCHED}
        SELECT spec_id,
          CASE WHEN count(error) = 0 THEN string_agg(rendered, '' ORDER BY line_no, item_no) END AS context,
          arg_min(error, line_no * 10 + item_no) FILTER (error IS NOT NULL AND line_no IS NOT NULL) AS failed,
          coalesce(failed, min(error) FILTER (line_no IS NULL)) AS error
        FROM rendered GROUP BY spec_id""",
    "stream_full_text": """
        SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS full_text
        FROM conversations GROUP BY conv_id""",
    "slice_text_range": f"""WITH {SYMBOLS}
        SELECT uid, md5({_PLAIN_BODY}) AS text_md5 FROM symbol""",
    "slice_line_range": f"""WITH {FILES}, t AS (SELECT path, string_split(text, chr(10)) AS ls FROM files)
        SELECT path, {_LINE_RANGE.format(a="3", b="9", ls="ls")} AS lines,
          {_LINE_RANGE.format(a="1", b="1000", ls="ls")} AS head,
          CASE WHEN len(ls) >= 3 THEN array_to_string(ls[3:1000], chr(10)) END AS corrected FROM t""",
    "text_end_offset": f"""WITH {FILES}
        SELECT path, {_NEWLINES.format("text")}::INT AS lines, length({_LAST_LINE.format("text")})::INT AS chars,
          strlen({_LAST_LINE.format("text")})::INT AS bytes FROM files""",
    "apply_text_edits": f"""WITH {FILES}, t AS (SELECT path, string_split(text, chr(10)) AS ls FROM files)
        SELECT path, CASE WHEN len(ls) > 1 THEN 'top' || chr(10) || left(ls[2], 2) || '<>'
            || substr(array_to_string(ls[2:], chr(10)), least(length(ls[2]), 2) + 1) END AS text,
          CASE WHEN len(ls) < 2 THEN 'line out of bounds' WHEN length(ls[2]) < 2 THEN 'column out of bounds' END AS error
        FROM t""",
    "tokenize_spec_line": """
        SELECT doc_id, CASE WHEN lang <> 'en' THEN source || ' |' || doc_id || ' |' || lang || ' "x|n' || n_chars END
            AS tokens,
          CASE WHEN lang <> 'en' THEN 4 END AS n_tokens FROM documents""",
    "parse_line_range": """
        SELECT doc_id, CASE WHEN doc_id <= n_chars AND lang NOT IN ('fr', 'de') THEN doc_id END AS range_start,
          CASE WHEN doc_id <= n_chars AND lang NOT IN ('fr', 'de') THEN n_chars END AS range_end FROM documents""",
    "parse_context_specs": f"""WITH {SPEC_ITEMS} SELECT * EXCLUDE (workspace) FROM item""",
    "render_context_item": f"""WITH {FETCHED}
        SELECT spec_id, line_no, item_no, rendered FROM rendered WHERE error IS NULL""",
    "selection_prompt": f"""WITH {FILES}{_PROMPT_CONTEXT}
        SELECT path, CASE WHEN {_FITS} THEN {_prompt(_BEFORE_CUT, _SELECTED)} END AS prompt_md5,
          CASE WHEN NOT ({_FITS}) THEN 'range outside the file' END AS error
        FROM selected""",
    "symbol_embedding_text": f"""WITH {SYMBOLS}
        SELECT path, symbol_no, md5(chr(10) || {_PLAIN_BODY}) AS text_md5 FROM symbol""",
    "definition_uid": f"WITH {SYMBOLS} SELECT path, symbol_no, uid FROM symbol",
    "running_symbol_totals": f"""WITH {SYMBOLS},
        n AS (SELECT workspace, path, count(*) AS n FROM symbol GROUP BY workspace, path),
        per_file AS (
          SELECT f.workspace, f.path, coalesce(n, 0)::BIGINT AS n_symbols
          FROM files f LEFT JOIN n ON n.workspace = f.workspace AND n.path = f.path)
        SELECT workspace, path, n_symbols, (sum(n_symbols) OVER (
          PARTITION BY workspace ORDER BY string_split(path, '/')))::BIGINT AS total_symbols FROM per_file""",
    "stream_cursor": f"""WITH {SO_FAR},
        start AS (SELECT DISTINCT conv_id AS stream_id, conv_id AS line0, conv_id + 7 AS char0
          FROM conversations WHERE role = 'user'),
        placed AS (
          SELECT s.*, coalesce(line0, 0) AS line0, coalesce(char0, 0) AS char0 FROM so_far s LEFT JOIN start USING (stream_id))
        SELECT stream_id, seq, line0 + {_NEWLINES.format("before")} AS insert_line,
          length({_LAST_LINE.format("before")}) + CASE WHEN contains(before, chr(10)) THEN 0 ELSE char0 END
            AS insert_character,
          line0 + {_NEWLINES.format("upto")} AS next_line,
          length({_LAST_LINE.format("upto")}) + CASE WHEN contains(upto, chr(10)) THEN 0 ELSE char0 END
            AS next_character
        FROM placed""",
    "stream_line_progress": f"WITH {REPORTS} SELECT * FROM report",
    "document_state_stream": f"""WITH {DOCUMENT_STATE}
        SELECT uri, is_open, language_id, version, text, epoch_us(last_edit) AS last_edit, last_seq FROM document""",
    # A change fails when the last open or close before it is not an open.
    "document_stream_problems": """
        WITH e AS (
          SELECT 'file:///u/' || user_id AS uri, event_id AS seq, event_type,
            last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (
              PARTITION BY user_id ORDER BY event_id) AS edge
          FROM events)
        SELECT uri, seq, 'document not open' AS reason FROM e
        WHERE event_type NOT IN ('signup', 'error') AND coalesce(edge, 'error') = 'error'
        UNION ALL SELECT uri, seq, 'late' FROM e WHERE event_type = 'purchase'""",
    "index_refresh_stream": f"""WITH {SYMBOLS}
        SELECT 'file' AS "row", 'all' AS workspace, path, NULL::INT AS symbol_no, md5 AS value FROM files
        UNION ALL SELECT 'symbol', 'all', path, symbol_no, name FROM symbol""",
    "index_refresh_problems": f"""WITH {FILES}{LABELLED}
        SELECT 'all' AS workspace, path || '~' AS path, true AS failed FROM labelled WHERE toxic = 1""",
    "index_refresh_embeddings": f"""WITH {SYMBOLS},
        embedded AS (
          SELECT md5('all' || chr(10) || path) || ':' || symbol_no AS id, chr(10) || body AS embedded FROM symbol)
        {_vectors("symbol", "embedded", "embedded")},
        vector AS (SELECT id, list(value ORDER BY place) AS v FROM symbol_places GROUP BY id)
        SELECT id AS symbol_id, list_position(v, list_max(v))::BIGINT AS place, len(v)::INT AS dimensions FROM vector""",
    "completion_stream": f"""WITH {REPORTS},
        last_chunk AS (SELECT * FROM so_far QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1),
        shown AS (SELECT stream_id, max(cut) + 1 AS upto_at FROM closing GROUP BY stream_id)
        SELECT l.stream_id, {_NEWLINES.format("upto")} AS line, length({_LAST_LINE.format("upto")}) AS "character",
          substr(upto, coalesce(upto_at, 0) + 1) AS pending, seq AS last_seq, true AS is_done, md5(upto) AS text_md5
        FROM last_chunk l LEFT JOIN shown USING (stream_id)""",
    "completion_stream_late": """
        SELECT conv_id AS stream_id, turn AS seq, md5(text) AS text_md5 FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, max(turn) + 1, md5('too late' || chr(10)) FROM conversations GROUP BY conv_id""",
    "completion_stream_reports": f"WITH {REPORTS} SELECT * FROM report",
    "embed_text": f"""WITH source AS (SELECT doc_id AS id, text FROM documents){_vectors("d", "source", "text")}
        SELECT id AS doc_id, place::INT AS place, round(value::DOUBLE, 6) AS value FROM d_places""",
    "symbol_search_with_text": f"""WITH {SYMBOLS}
        SELECT name, kind, 'file:///repo/' || s.path AS uri, start_line, start_col, end_line, end_col,
          body AS definition, f.md5
        FROM symbol s JOIN files f ON f.path = s.path WHERE name_fold LIKE 'th%'
        ORDER BY s.path, start_line LIMIT 100""",
}
ORACLES["build_context"] = f"SELECT * EXCLUDE (failed) FROM ({ORACLES['build_context']})"
ORACLES["vector_index_search"] = ORACLES["semantic_symbol_search"]
