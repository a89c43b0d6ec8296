"""DuckDB SQL for the registered queries.

The statements state the result independently of the Spark plans: spans are found with
plain range joins and grouped minima, search compares all pairs.
"""

from __future__ import annotations

from codeloom.operators.encode import STOP_WORDS
from codeloom.plans import queries as Q
from codeloom.plans.corpus import KEYS_PER_FILE, LAYOUTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join(_text(v) for v in values)


# --- corpora ---------------------------------------------------------------------


def modules(kind: str) -> str:
    """CTEs ``modules(path, text)`` and ``raw(path, ln, txt)``."""
    layout = LAYOUTS[kind]
    cases = " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(layout.parts))
    return f"""
part_text AS (
  SELECT replace(p_brand, '#', '_') AS brand, p_partkey // {KEYS_PER_FILE} AS block, p_partkey AS k,
         replace(replace(CASE p_partkey % {len(layout.parts)} {cases} END, '{{k}}', p_partkey::VARCHAR),
                 '{{z}}', p_size::VARCHAR) AS txt
  FROM part),
modules AS (
  SELECT brand || '/m' || block || '{layout.suffix}' AS path,
         replace({_text(layout.header)}, '{{b}}', block::VARCHAR) || string_agg(txt, '' ORDER BY k)
           || replace({_text(layout.trailer)}, '{{b}}', block::VARCHAR) AS text
  FROM part_text GROUP BY brand, block),
raw AS (
  SELECT path, unnest(l) AS txt, generate_subscripts(l, 1) AS ln
  FROM (SELECT path, string_split(text, chr(10)) AS l FROM modules))"""


def _change(column: str) -> str:
    return (
        f"(length(regexp_replace({column}, '[)\\]}}]', '', 'g')) - length(regexp_replace({column}, '[(\\[{{]', '', 'g')))"
    )


# The docstrings of the corpus use triple double quotes, its other strings double quotes.
_PYTHON_LINES = modules("python") + f""",
quoted AS (
  SELECT path, ln, txt,
         coalesce(sum((length(txt) - length(replace(txt, '\"\"\"', ''))) // 3) OVER (
           PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_string
  FROM raw),
bare AS (
  SELECT *, CASE WHEN in_string THEN '' ELSE
    rtrim(regexp_replace(regexp_replace(txt, '\"[^\"]*\"', '0', 'g'), '#.*$', '')) END AS code
  FROM quoted),
deep AS (
  SELECT *, length(txt) - length(ltrim(txt)) AS ind,
         coalesce(sum({_change('code')}) OVER (
           PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
  FROM bare),
stmt AS (SELECT * FROM deep WHERE code <> '' AND depth = 0)"""

_PYTHON_CHUNKS = _PYTHON_LINES + """,
heads AS (
  SELECT path, ln AS s, ind, 'functions' AS kind, regexp_extract(code, '^\\s*(?:async )?def (\\w+)', 1) AS name FROM stmt
  UNION ALL
  SELECT path, ln, ind, 'classes', regexp_extract(code, '^\\s*class (\\w+)', 1) FROM stmt),
blocks AS (
  SELECT h.path, h.s, h.kind, h.name, coalesce(min(t.ln), 1000000000) AS stop
  FROM heads h LEFT JOIN stmt t ON t.path = h.path AND t.ln > h.s AND t.ind <= h.ind
  WHERE h.name <> '' GROUP BY ALL),
assigned AS (
  SELECT path, ln AS s, regexp_extract(code, '^\\s*(\\w+)(: \\w+)? = (.*)$', 1) AS name,
         regexp_extract(code, '^\\s*(\\w+)(: \\w+)? = (.*)$', 3) AS rest,
         coalesce(lead(ln) OVER (PARTITION BY path ORDER BY ln), 1000000000) AS stop
  FROM stmt),
variables AS (
  SELECT path, s, stop, name, rest, false AS chained FROM assigned WHERE name <> ''
  UNION ALL
  SELECT path, s, stop, regexp_extract(rest, '^(\\w+) = ', 1), regexp_extract(rest, '^\\w+ = (.*)$', 1), true
  FROM assigned WHERE name <> '' AND regexp_matches(rest, '^\\w+ = ')),
found AS (
  SELECT path, s, stop, kind, name, false AS cut FROM blocks
  UNION ALL
  SELECT path, s, stop, 'variables',
         CASE WHEN regexp_full_match(rest, '[A-Za-z_]\\w*') AND NOT $DECLARED THEN rest ELSE name END,
         CASE WHEN $DECLARED THEN chained ELSE chained OR regexp_matches(rest, '^\\w+ = ') END
  FROM variables
  UNION ALL
  SELECT path, ln, ln + 1, 'imports', '', false FROM stmt
  WHERE $DECLARED AND regexp_matches(code, '^(import|from) ')),
ended AS (
  SELECT f.path, f.s, f.kind, f.name, f.cut, max(d.ln) AS e
  FROM found f JOIN deep d ON d.path = f.path AND d.ln >= f.s AND d.ln < f.stop AND d.code <> '' GROUP BY ALL),
content AS (
  SELECT n.path, n.s, n.e, n.kind, n.name, n.cut, rtrim(ltrim(string_agg(r.txt, chr(10) ORDER BY r.ln))) AS body
  FROM ended n JOIN raw r ON r.path = n.path AND r.ln BETWEEN n.s AND n.e GROUP BY ALL),
owned AS (
  SELECT c.path, c.s, c.e, c.kind, c.name, c.cut, c.body, arg_max(k.name, k.s) AS owner
  FROM content c LEFT JOIN ended k
    ON c.kind = 'functions' AND k.kind = 'classes' AND k.path = c.path AND k.s < c.s AND k.e >= c.e
  GROUP BY ALL),
chunk AS (
  SELECT path || '_' || CASE WHEN name = '' THEN kind ELSE name END || '_' || s AS id,
         CASE WHEN cut THEN regexp_replace(body, '^\\w+ = ', '') ELSE body END AS content,
         path AS file_path,
         CASE WHEN kind = 'classes' THEN '' ELSE name END AS function_name,
         CASE WHEN kind = 'classes' THEN name ELSE coalesce(owner, '') END AS class_name,
         s::INTEGER AS start_line, e::INTEGER AS end_line, 'python' AS language,
         CASE WHEN owner IS NOT NULL THEN 'methods' ELSE kind END AS chunk_type
  FROM owned)"""

_EFFECTIVE = _PYTHON_CHUNKS.replace("$DECLARED", "false")
_DECLARED = _PYTHON_CHUNKS.replace("$DECLARED", "true")

# (chunk type, expression with the name as group 1, modifiers left out of the content, block or statement)
_EXPORT = "(?:export )?"
_SCRIPT_HEADS = [
    ("functions", f"^\\s*{_EXPORT}(?:async )?function (\\w+)", "block"),
    ("classes", f"^\\s*{_EXPORT}class (\\w+)", "block"),
    ("variables", f"^\\s*{_EXPORT}(?:const|let|var) (\\w+)", "statement"),
]
_HEADS = {
    "go": [
        ("functions", "^func (?:\\([^)]*\\) )?(\\w+)", "block"),
        ("types", "^type (\\w+|\\()", "statement"),
        ("variables", "^\\s*var (\\w+)", "statement"),
        ("constants", "^\\s*const (\\w+|\\()", "statement"),
    ],
    "js": _SCRIPT_HEADS,
    "ts": [
        *_SCRIPT_HEADS,
        ("interfaces", f"^\\s*{_EXPORT}interface (\\w+)", "block"),
        ("types", f"^\\s*{_EXPORT}type (\\w+)", "statement"),
    ],
    "rust": [
        ("functions", "^\\s*(?:pub )?fn (\\w+)", "block"),
        ("structs", "^\\s*(?:pub )?struct (\\w+)", "block"),
        ("enums", "^\\s*(?:pub )?enum (\\w+)", "block"),
        ("impls", "^\\s*impl( )", "block"),
        ("traits", "^\\s*(?:pub )?trait (\\w+)", "block"),
        ("constants", "^\\s*(?:pub )?const (\\w+)", "statement"),
        ("statics", "^\\s*(?:pub )?static (?:mut )?(\\w+)", "statement"),
    ],
}


def brace(kind: str, arrows: bool = False) -> str:
    heads = _HEADS["ts" if kind == "tsx" else kind]
    found = " UNION ALL ".join(
        f"SELECT path, ln AS s, depth, '{chunk_type}' AS kind, '{style}' AS style, "
        f"trim(regexp_extract(code, {_text(pattern)}, 1)) AS name FROM deep "
        f"WHERE regexp_matches(code, {_text(pattern)})" + (" AND code NOT LIKE '%;'" if style == "block" else "")
        for chunk_type, pattern, style in heads
    )
    # The corpus only has arrow functions with an expression body on one line.
    arrow = """
  UNION ALL SELECT path || '_functions_' || ln, regexp_extract(txt, '\\([^()]*\\) => [^,]*'), path, '', '',
         ln::INTEGER, ln::INTEGER, 'typescript', 'functions' FROM raw WHERE txt LIKE '%=>%'"""
    # Literals that hold brackets, as the corpus writes them.
    plain = "replace(replace(replace(replace(txt, '/[{]/', 'S'), '/[}]/', 'S'), '/* a { /* b { */ c */', ''), 'r##\"{ \"# {\"##', 'S')"
    # The members of a group are indented by one tab.
    names = """CASE
    WHEN name = '(' AND kind = 'types' THEN regexp_extract_all(body, '\\n\\t(\\w+) (?:struct|\\[)', 1)
    WHEN name = '(' THEN string_split(array_to_string(list_transform(
      regexp_extract_all(body, '\\n\\t(\\w[\\w, ]*)=', 1), lambda l: trim(l)), ', '), ', ')
    WHEN regexp_matches(body, '^var \\w+, ') THEN string_split(regexp_extract(body, '^var ([\\w, ]+) =', 1), ', ')
    WHEN body LIKE 'let %' THEN regexp_extract_all(body, '(?:^let |, )(\\w+) = ', 1)
    ELSE [name] END"""
    # Two statements in one line, and one inside of a block's line.
    several = "".join(
        f""" UNION ALL
  SELECT path, ln, ln, 'variables', regexp_extract(txt, {_text(pattern)}, 2), regexp_extract(txt, {_text(pattern)}, 1)
  FROM raw WHERE regexp_matches(txt, {_text(pattern)})"""
        for pattern in ("(const (\\w+) = 1;) const", "; (const (\\w+) = .*;)$", "\\{ (var (\\w+) = \\d+;) \\}")
    )
    return f"""WITH {modules(kind)},
bare AS (
  SELECT *, rtrim(regexp_replace(regexp_replace(regexp_replace({plain}, '"[^"]*"', 'S', 'g'), '''[^'']''', 'S', 'g'), '//.*$', '')) AS code
  FROM raw),
deep AS (
  SELECT *, coalesce(sum({_change('code')}) OVER (
           PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
         sum({_change('code')}) OVER (PARTITION BY path ORDER BY ln) AS after
  FROM bare),
found AS ({found}),
ended AS (
  SELECT f.path, f.s, f.kind, f.name, min(d.ln) AS e FROM found f JOIN deep d
    ON d.path = f.path AND d.ln >= f.s AND d.after <= f.depth AND d.code <> '' AND (f.style = 'statement' OR d.code LIKE '%}}%')
  GROUP BY ALL),
content AS (
  SELECT n.path, n.s, n.e, n.kind, n.name, rtrim(ltrim(string_agg(r.txt, chr(10) ORDER BY r.ln))) AS body
  FROM ended n JOIN raw r ON r.path = n.path AND r.ln BETWEEN n.s AND n.e GROUP BY ALL),
named AS (
  SELECT path, s, e, kind, unnest({names}) AS name, body FROM content WHERE body NOT LIKE '%; const %'{several if kind == 'js' else ''})
SELECT path || '_' || CASE WHEN name = '' THEN kind ELSE name END || '_' || s AS id,
       regexp_replace(body, '^export ', '') AS content, path AS file_path,
       CASE WHEN kind = 'classes' THEN '' ELSE name END AS function_name,
       CASE WHEN kind = 'classes' THEN name ELSE '' END AS class_name,
       s::INTEGER AS start_line, e::INTEGER AS end_line, '{Q.KIND_LANGUAGES[kind]}' AS language, kind AS chunk_type
FROM named{arrow if arrows else ''}"""


# --- paths -----------------------------------------------------------------------

_PATHS = """
paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/', '') AS path FROM pages),
named AS (SELECT page_id, path, string_split(path, '/') AS parts FROM paths),
files AS (SELECT page_id, path, regexp_extract(parts[-1], '(\\.[^.]*)$', 1) AS extension, parts[1:-2] AS directories FROM named)"""

_ROTATED = f"""
rotated AS (
  SELECT replace(p_brand, '#', '_') || '/m' || p_partkey || ([{_list(Q.SUFFIXES)}])[1 + p_partkey % {len(Q.SUFFIXES)}] AS path
  FROM part)"""

# --- requests --------------------------------------------------------------------

_REQUESTS = f"""
blocks AS (
  SELECT conv_id, turn // {Q.TURNS_PER_REQUEST} AS blk, count(*) AS n FROM conversations GROUP BY ALL),
kept AS (
  SELECT *, blk % {Q.REQUESTS_PER_SESSION} AS line_no, blk // {Q.REQUESTS_PER_SESSION} AS part, (conv_id + blk) % 9 AS rule
  FROM blocks WHERE conv_id % 5 <> 0 OR blk % {Q.REQUESTS_PER_SESSION} = 0),
answers AS (
  SELECT 's' || conv_id || '-' || part AS session, line_no::INTEGER AS line_no,
         CASE WHEN rule IN (1, 2, 4, 7) THEN 'generated' ELSE 'req-' || conv_id || '-' || blk END AS id,
         CASE WHEN rule IN (0, 1, 8) THEN 'success' ELSE 'error' END AS status,
         CASE rule WHEN 2 THEN 'Invalid JSON: the line is not a JSON document'
                   WHEN 3 THEN 'No chunks provided'
                   WHEN 4 THEN '''NoneType'' object has no attribute ''get'''
                   WHEN 5 THEN '''content'''
                   WHEN 6 THEN 'duplicate ids in one request'
                   WHEN 7 THEN '''list'' object has no attribute ''get'''
                   ELSE '' END AS message,
         CASE WHEN rule IN (0, 1, 8) THEN n ELSE -1 END AS indexed_count
  FROM kept)"""

# --- keyed tables ----------------------------------------------------------------

_BATCHES = """
base AS (SELECT doc_id AS id, text AS document, 1 AS batch_seq FROM documents),
later AS (
  SELECT doc_id AS id, text || ' [quality ' || quality || ']' AS document, 2 AS batch_seq
  FROM documents JOIN labels USING (doc_id))"""

_MANIFEST = """
manifest AS (
  SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN text || ' old' ELSE text END) AS stored
  FROM documents JOIN labels USING (doc_id)),
changes AS (
  SELECT doc_id, source, sha256(text) AS sha256, stored IS NULL OR stored <> sha256(text) AS changed
  FROM documents LEFT JOIN manifest USING (doc_id))"""


def _footprint() -> str:
    names = ", ".join(f"({_text(n)})" for n in Q.FOOTPRINT_NAMES)
    return f"""
WITH entries AS (SELECT 'models--' || lang || '--' || source AS directory, n_chars FROM documents),
names(name) AS (VALUES {names})
SELECT name, round(sum(n_chars) / 1048576.0, 6) AS megabytes
FROM names LEFT JOIN entries
  ON contains(directory, replace(name, '/', '_')) OR contains(directory, replace(name, '/', '--'))
GROUP BY name"""


# --- search ----------------------------------------------------------------------

_PAIRS = """
probes AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % $STEP = 0),
pairs AS (
  SELECT query_id, vec_id AS id,
         round(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 6) AS distance
  FROM embeddings, probes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs)"""


def postings(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, bucket, weight)``."""
    code = "(unicode(substr(word, i, 1)) * 16384 + unicode(substr(word, i + 1, 1)) * 128 + unicode(substr(word, i + 2, 1))) % 16777216"
    return f"""
{name}_words AS (
  SELECT {key} AS key, unnest(string_split_regex(lower(regexp_replace({text}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+')) AS word
  FROM {source}),
{name}_counted AS (
  SELECT key, '^' || word || '$' AS word, count(*) AS n FROM {name}_words
  WHERE word <> '' AND word NOT IN ({_list(STOP_WORDS)}) GROUP BY ALL),
{name}_grams AS (
  SELECT key, n, unnest(list_transform(range(1, length(word) - 1), lambda i: {code})) AS code FROM {name}_counted),
{name}_raw AS (
  SELECT key, (code::BIGINT * 2654435761 % 4294967296 // 1048576)::INTEGER AS bucket, 1 + ln(sum(n)) AS raw
  FROM {name}_grams GROUP BY ALL),
{name} AS (SELECT key, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS weight FROM {name}_raw)"""


_HITS = """
dots AS (
  SELECT q.key AS query_id, c.key AS id, round(greatest(2 - 2 * sum(q.weight * c.weight), 0), 6) AS distance
  FROM q JOIN c USING (bucket) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM dots WHERE distance < 1.3)"""

_QUESTIONS = ", ".join(f"({_text(q)}, {_text(' '.join(words))})" for q, words in Q.QUESTIONS)

ORACLE: dict[str, str] = {
    "tree_filter": f"""WITH {_PATHS}
SELECT page_id, path, extension FROM files
WHERE extension IN ({_list(Q.TREE_EXTENSIONS)}) AND NOT list_has_any(directories, [{_list(Q.TREE_SKIPPED)}])""",
    "extension_set": f"WITH {_PATHS} SELECT DISTINCT extension FROM files",
    "detect_language": f"""WITH {_ROTATED}
SELECT path, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.go') THEN 'go' WHEN suffix(path, '.js') THEN 'javascript'
  WHEN suffix(path, '.ts') OR suffix(path, '.tsx') THEN 'typescript' WHEN suffix(path, '.rs') THEN 'rust' ELSE '' END AS language
FROM rotated""",
    "rejected_files": f"""WITH {_ROTATED}
SELECT path, 'unsupported file type: ' || path AS message FROM rotated
WHERE NOT regexp_matches(path, '\\.(py|go|js|ts|tsx|rs)$')""",
    "line_model": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS txt, generate_subscripts(parts, 1) AS ln FROM l),
plain AS (SELECT *, replace(replace(txt, chr(13), ' '), chr(12), ' ') AS t FROM raw),
led AS (SELECT *, regexp_extract(t, '^[ \\t]*') AS lead FROM plain)
SELECT doc_id, ln::INTEGER AS ln, (length(lead) + 7 * (length(lead) - length(replace(lead, chr(9), ''))))::INTEGER AS ind,
       t = lead AS blank, length(txt)::INTEGER AS n_chars, md5(txt) AS txt_md5 FROM led""",
    "code_mask": f"""WITH {_PYTHON_LINES}
SELECT path, ln::INTEGER AS ln, in_string AND trim(txt) <> '' AS in_string, depth::INTEGER AS depth,
       (CASE WHEN in_string THEN length(rtrim(txt))
             WHEN contains(regexp_replace(txt, '"[^"]*"', 'S', 'g'), '#') THEN length(rtrim(split_part(txt, '#', 1)))
             ELSE length(rtrim(txt)) END)::INTEGER AS code_end
FROM deep WHERE trim(txt) <> ''""",
    "py_chunks": f"WITH {_EFFECTIVE} SELECT * FROM chunk",
    "py_declared": f"WITH {_DECLARED} SELECT * FROM chunk",
    "brace_go": brace("go"),
    "brace_js": brace("js"),
    "brace_ts": brace("ts"),
    "brace_tsx": brace("tsx"),
    "brace_rust": brace("rust"),
    "brace_ts_arrows": brace("ts", arrows=True),
    "mixed_effective": f"WITH {_EFFECTIVE} SELECT id, language, chunk_type, md5(content) AS content_md5 FROM chunk",
    "chunk_requests": f"""WITH {_EFFECTIVE}
SELECT file_path, count(*)::INTEGER AS n_chunks, string_agg(id, ',' ORDER BY start_line, chunk_type, id) AS chunk_ids,
       string_agg(concat_ws('|', id, md5(content), file_path, nullif(function_name, ''), nullif(class_name, ''), start_line, end_line, language,
         chunk_type), ',' ORDER BY start_line, chunk_type, id) AS request
FROM chunk GROUP BY file_path""",
    "request_acks": f"WITH {_REQUESTS} SELECT * FROM answers",
    "ack_summary": f"""WITH {_REQUESTS}
SELECT status, count(*) AS requests, sum(CASE WHEN indexed_count > 0 THEN indexed_count ELSE 0 END)::BIGINT AS chunks FROM answers GROUP BY status""",
    "run_report": f"""WITH {_REQUESTS}
SELECT (SELECT count(*) FROM (SELECT DISTINCT conv_id, blk // {Q.REQUESTS_PER_SESSION} FROM blocks)) AS files_found,
       (SELECT count(*) FROM answers WHERE status = 'success') AS files_ok""",
    "stream_changes": """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
e AS (SELECT 3 AS sent, conv_id, turn, role,
             CASE WHEN role = 'assistant' THEN 'again: ' || coalesce(text, '') ELSE text END AS text FROM c),
a AS (SELECT 1 AS sent, * FROM c
      UNION ALL
      SELECT * FROM e WHERE EXISTS (SELECT 1 FROM c WHERE c.role = 'assistant'
                                    AND c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.turn IS NOT DISTINCT FROM e.turn))
SELECT DISTINCT sent, conv_id, turn, role, text, sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS digest FROM a""",
    "stream_index": """
SELECT 'c' || conv_id || '_' || turn AS id, md5(CASE WHEN role = 'assistant' THEN 'again: ' || text ELSE text END) AS document_md5, role
FROM conversations""",
    "collection_upsert": f"""WITH {_BATCHES},
everything AS (SELECT * FROM base UNION ALL SELECT * FROM later)
SELECT id, md5(document) AS document_md5, batch_seq FROM everything
QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_seq DESC) = 1""",
    "collection_add": f"""WITH {_BATCHES}
SELECT id, md5(document) AS document_md5, batch_seq FROM later
UNION ALL
SELECT id, md5(document), batch_seq FROM base WHERE NOT EXISTS (SELECT 1 FROM later WHERE later.id = base.id)""",
    "set_members": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "set_remove": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "collection_report": """
SELECT source, count(*) AS documents, (SELECT count(DISTINCT source) FROM documents) AS collections FROM documents GROUP BY source""",
    "footprint": _footprint(),
    "changed_files": f"WITH {_MANIFEST} SELECT doc_id, sha256, changed FROM changes",
    "group_refresh": f"""WITH {_MANIFEST},
flagged AS (SELECT doc_id, source, changed FROM changes)
SELECT * FROM flagged QUALIFY bool_or(changed) OVER (PARTITION BY source)""",
    "manifest_refresh": f"""WITH {_MANIFEST}
SELECT doc_id, CASE WHEN changed THEN sha256 ELSE stored END AS sha256 FROM changes LEFT JOIN manifest USING (doc_id)""",
    "normalize_ws": "SELECT doc_id, md5(trim(regexp_replace(text || ' ' || chr(65533) || ' end', '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS text_md5 FROM documents",
    "knn_exact": """
WITH pairs AS (
  SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)),
         lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 6) AS distance FROM embeddings)
SELECT row_number() OVER (ORDER BY distance, id)::INTEGER AS rank, id, distance FROM pairs ORDER BY distance, id LIMIT 50""",
    "knn_batch": f"WITH {_PAIRS.replace('$STEP', '1')} SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 50",
    "knn_threshold": f"""WITH {_PAIRS.replace('$STEP', '20')}
SELECT query_id, rank, id, distance, round(1.3 - distance, 6) AS similarity FROM ranked WHERE distance < 1.3 AND rank <= 5""",
    "knn_wide": f"""WITH {_PAIRS.replace('$STEP', '20')}
SELECT query_id, rank, id, distance, round(1.9 - distance, 6) AS similarity FROM ranked WHERE distance < 1.9 AND rank <= 5""",
    "encode_text": f"""WITH {postings('c', 'documents', 'doc_id', 'text')}
SELECT key AS doc_id, bucket, round(weight, 6) AS weight FROM c""",
    "search_text": f"""WITH {postings('c', 'documents', 'doc_id', 'text')}, {postings('q', 'benchmark', 'item_id', 'text')}, {_HITS}
SELECT query_id, rank, id, distance, round(1.3 - distance, 6) AS similarity FROM ranked WHERE rank <= 5""",
    "search_chunks": f"""WITH {_EFFECTIVE},
asked(query_id, text) AS (VALUES {_QUESTIONS}),
{postings('c', 'chunk', 'id', 'content')}, {postings('q', 'asked', 'query_id', 'text')}, {_HITS}
SELECT query_id, rank, ranked.id, content AS document, distance, round(1.3 - distance, 6) AS similarity
FROM ranked JOIN chunk USING (id) WHERE rank <= 5""",
}
