"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code: the fixture views are derived with
the same string expressions, then each operator is stated in plain SQL
(brute force where that is simplest, e.g. the pair similarity is a full
token self-join). Column names and types match the Spark side.
"""

from __future__ import annotations

from .. import rules
from ..sources import fixtures as FX


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]"


NL = "chr(10)"
P_HTTP = _s(rules.HTTP_PATTERN)
P_SQL = _s(rules.SQL_PATTERN)
P_CREATE = _s(rules.CREATE_TABLE_PATTERN)
P_FK = _s(rules.FOREIGN_KEY_PATTERN)


def _cap(e: str) -> str:
    return f"(upper(substr({e}, 1, 1)) || substr({e}, 2))"


def _class_of(name: str, key: str) -> str:
    w1, w2 = f"split_part({name}, ' ', 1)", f"split_part({name}, ' ', 2)"
    return f"({_cap(w1)} || {_cap(w2)} || {_list(FX.CLASS_SUFFIXES)}[{key} % 6 + 1])"


# ------------------------------------------------------------------ fixture views
LOG_LINES = f"""
log_lines AS (
  SELECT 'P' || CAST(CAST(floor(user_id * 2 / 3) AS BIGINT) AS VARCHAR) AS project_id,
         CAST(user_id AS VARCHAR) AS session_id, event_id AS line_no,
         CASE event_type
           WHEN 'view' THEN 'INFO GET /' || {_list(FX.RESOURCES)}[event_id % 8 + 1] || '/' || CAST(user_id AS VARCHAR) || '?v=1 HTTP/1.1'
           WHEN 'signup' THEN 'INFO POST /' || {_list(FX.RESOURCES)}[event_id % 8 + 1] || '/new -> insert into '
                || {_list(FX.NOUNS)}[(event_id + user_id) % 8 + 1] || ' values (' || CAST(event_id AS VARCHAR) || ')'
           WHEN 'click' THEN 'DEBUG select t.id from ' || {_list(FX.NOUNS)}[(event_id + user_id) % 8 + 1]
                || ' t where t.user = ' || CAST(user_id AS VARCHAR)
           WHEN 'purchase' THEN 'DEBUG update ' || {_list(FX.NOUNS)}[(event_id + user_id) % 8 + 1]
                || ' set qty = qty - 1 where id = ' || CAST(event_id AS VARCHAR)
           ELSE 'ERROR timeout for user ' || CAST(user_id AS VARCHAR) END AS line
  FROM events),
ev AS (
  SELECT project_id, session_id, line_no, 0 AS seq, 'HTTP' AS type,
         regexp_extract(line, {P_HTTP}, 1) AS method, regexp_extract(line, {P_HTTP}, 2) AS endpoint,
         regexp_extract(regexp_extract(line, {P_HTTP}, 2), '^/?([^/?]*)', 1) AS resource,
         CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS operation
  FROM log_lines WHERE regexp_extract(line, {P_HTTP}, 1) <> ''
  UNION ALL
  SELECT project_id, session_id, line_no, 1 AS seq, 'SQL' AS type, NULL, NULL, NULL,
         lower(regexp_extract(line, {P_SQL}, 3)), upper(regexp_extract(line, {P_SQL}, 1))
  FROM log_lines WHERE regexp_extract(line, {P_SQL}, 1) <> ''),
corr AS (
  SELECT * FROM (
    SELECT project_id, session_id, line_no, seq, type, table_name, operation,
           last_value(CASE WHEN type = 'HTTP' THEN resource END IGNORE NULLS) OVER (
             PARTITION BY project_id, session_id ORDER BY line_no, seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
    FROM ev)
  WHERE type = 'SQL' AND carried IS NOT NULL AND table_name IS NOT NULL),
efreq AS (
  SELECT project_id, endpoint, count(*) AS n, min(line_no * 2 + seq) AS first_seen
  FROM ev WHERE type = 'HTTP' AND endpoint IS NOT NULL GROUP BY ALL),
tfreq AS (
  SELECT project_id, table_name, count(*) AS n, min(line_no * 2 + seq) AS first_seen
  FROM ev WHERE type = 'SQL' AND table_name IS NOT NULL GROUP BY ALL)"""

CALL_ROWS = f"""
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount,
         coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount),
                  first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                    l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS to_partkey
  FROM lineitem),
pc AS (SELECT p_partkey, {_class_of('p_name', 'p_partkey')} AS cls FROM part),
cr AS (
  SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS project_id,
         'p' || CAST(l_suppkey AS VARCHAR) || '/Order' || CAST(l_orderkey AS VARCHAR) || '.java' AS path,
         l_suppkey, l_orderkey, l_linenumber, a.cls AS from_class, b.cls AS to_type,
         lower(substr(b.cls, 1, 1)) || substr(b.cls, 2) AS to_var,
         CASE WHEN l_discount = 0 THEN 'autowired' ELSE 'method_call' END AS call_type,
         {_list(FX.METHODS)}[l_linenumber] AS verb,
         CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_discount) * 3 + 1
              AS INTEGER)
           AS line_number
  FROM li JOIN pc a ON a.p_partkey = li.l_partkey JOIN pc b ON b.p_partkey = li.to_partkey),
calls AS (
  SELECT project_id, path, from_class, 'com.shop.p' || CAST(l_suppkey AS VARCHAR) AS from_package,
         CASE WHEN call_type = 'autowired' THEN to_type ELSE to_var END AS to_class,
         CASE WHEN call_type = 'autowired' THEN to_var ELSE verb END AS method_name,
         call_type, line_number
  FROM cr),
classes AS (SELECT DISTINCT project_id, from_class AS class_name FROM calls)"""

_COL_LINE = (f"CASE WHEN size % 2 = 0 THEN '  ' || adj || '_qty DECIMAL(' || CAST(size AS VARCHAR) || ', 2) NOT NULL' "
             f"ELSE '  ' || adj || '_name VARCHAR(' || CAST(size AS VARCHAR) || ')' END")
_STMT = (f"'CREATE TABLE ' || noun || ' (' || {NL} || '  id INT NOT NULL PRIMARY KEY,' || {NL} || cols || ',' || {NL} "
         f"|| '  ' || next_noun || '_id INT,' || {NL} || '  KEY_' || noun || ' INT' "
         f"|| CASE WHEN noun < next_noun THEN ',' || {NL} || '  FOREIGN KEY (' || next_noun || '_id) REFERENCES ' "
         f"|| next_noun || '(id)' ELSE '' END || {NL} || ');' || {NL} || {NL} "
         f"|| 'CREATE TABLE ' || noun || '_type (' || {NL} || '  id INT PRIMARY KEY,' || {NL} || '  ' || noun "
         f"|| '_id INT NOT NULL,' || {NL} || '  label VARCHAR(40)' || {NL} || ');' || {NL}")

SCHEMA = f"""
sp AS (
  SELECT l_suppkey, split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adj, min(p_size) AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
tb AS (SELECT l_suppkey, noun, string_agg({_COL_LINE}, ',' || {NL} ORDER BY adj) AS cols FROM sp GROUP BY ALL),
tn AS (
  SELECT *, coalesce(lead(noun) OVER (PARTITION BY l_suppkey ORDER BY noun),
                     first_value(noun) OVER (PARTITION BY l_suppkey ORDER BY noun
                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_noun
  FROM tb),
ddl_scripts AS (
  SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS project_id,
         'p' || CAST(l_suppkey AS VARCHAR) || '/src/main/resources/schema.sql' AS path,
         string_agg({_STMT}, {NL} ORDER BY noun) AS ddl
  FROM tn GROUP BY l_suppkey),
stm0 AS (SELECT project_id, regexp_extract_all(ddl, {P_CREATE}, 0) AS m FROM ddl_scripts),
stm AS (
  SELECT project_id, CAST(stmt_pos AS INTEGER) AS stmt_pos,
         lower(regexp_extract(stmt, {P_CREATE}, 1)) AS table_name, regexp_extract(stmt, {P_CREATE}, 2) AS body
  FROM (SELECT project_id, unnest(m) AS stmt, unnest(range(len(m))) AS stmt_pos FROM stm0)),
tbls AS (
  SELECT project_id, table_name, CAST(min(stmt_pos) AS INTEGER) AS table_pos, arg_max(body, stmt_pos) AS body
  FROM stm GROUP BY ALL),
seg0 AS (SELECT project_id, table_name, table_pos, regexp_split_to_array(body, ',\\s*\\n') AS parts FROM tbls),
seg AS (
  SELECT project_id, table_name, table_pos, CAST(ordinal AS INTEGER) AS ordinal,
         regexp_replace(seg, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS s
  FROM (SELECT project_id, table_name, table_pos, unnest(parts) AS seg, unnest(range(len(parts))) AS ordinal FROM seg0)),
cols AS (
  SELECT project_id, table_name, table_pos, ordinal, tok[1] AS name,
         regexp_replace(tok[2], '\\(.*\\)', '', 'g') AS type,
         NOT contains(upper(s), 'NOT NULL') AS nullable,
         contains(upper(s), 'PRIMARY KEY') OR lower(tok[1]) = 'id' AS primary_key
  FROM (SELECT *, regexp_split_to_array(s, '\\s+') AS tok FROM seg)
  WHERE s <> '' AND NOT regexp_matches(upper(s), '^({"|".join(rules.CONSTRAINT_KEYWORDS)})[^\\n]*$')
    AND len(tok) >= 2),
efk AS (
  SELECT project_id, table_name AS from_table, regexp_extract(fk, {P_FK}, 1) AS "column",
         lower(regexp_extract(fk, {P_FK}, 2)) AS references_table, regexp_extract(fk, {P_FK}, 3) AS references_column,
         false AS inferred, 0 AS k, stmt_pos AS a, CAST(fk_pos AS INTEGER) AS b
  FROM (SELECT project_id, table_name, stmt_pos, unnest(regexp_extract_all(body, {P_FK}, 0)) AS fk,
               unnest(range(len(regexp_extract_all(body, {P_FK}, 0)))) AS fk_pos FROM stm)),
ifk AS (
  SELECT c.project_id, c.table_name AS from_table, c.name AS "column", t.table_name AS references_table,
         'id' AS references_column, true AS inferred, 1 AS k, min(c.table_pos) AS a, min(c.ordinal) AS b
  FROM cols c JOIN tbls t ON t.project_id = c.project_id AND t.table_name = substr(lower(c.name), 1, length(c.name) - 3)
  WHERE ends_with(lower(c.name), '_id') AND lower(c.name) <> 'id'
    AND NOT EXISTS (SELECT 1 FROM efk WHERE efk.project_id = c.project_id AND efk.from_table = c.table_name
                    AND efk."column" = c.name)
  GROUP BY c.project_id, c.table_name, c.name, t.table_name),
fks AS (SELECT * FROM efk UNION ALL SELECT * FROM ifk),
tmetrics AS (
  SELECT t.project_id, t.table_name,
         CAST(coalesce(nc.n, 0) AS BIGINT) AS db_columns, CAST(coalesce(fo.n, 0) AS BIGINT) AS db_fk_out,
         CAST(coalesce(fi.n, 0) AS BIGINT) AS db_fk_in, CAST(coalesce(fo.n, 0) AS BIGINT) AS db_relations,
         CAST(coalesce(lf.n, 0) AS BIGINT) AS log_frequency
  FROM tbls t
  LEFT JOIN (SELECT project_id, table_name, count(*) AS n FROM cols GROUP BY ALL) nc USING (project_id, table_name)
  LEFT JOIN (SELECT project_id, from_table AS table_name, count(*) AS n FROM fks GROUP BY ALL) fo USING (project_id, table_name)
  LEFT JOIN (SELECT project_id, references_table AS table_name, count(*) AS n FROM fks GROUP BY ALL) fi USING (project_id, table_name)
  LEFT JOIN tfreq lf USING (project_id, table_name))"""


def _when_chain(expr: str, rules_list, default: str, op: str = "contains") -> str:
    parts = []
    for label, kws in rules_list:
        cond = " OR ".join(f"{op}({expr}, {_s(k)})" for k in kws)
        parts.append(f"WHEN {cond} THEN {_s(label)}")
    return f"CASE {' '.join(parts)} ELSE {_s(default)} END"


def _stem(expr: str) -> str:
    out = f"lower({expr})"
    for w in rules.TABLE_STEM_REMOVALS:
        out = f"replace({out}, {_s(w)}, '')"
    return out


def _flag(expr: str, *suffixes: str) -> str:
    return "CAST((" + " OR ".join(f"ends_with({expr}, {_s(s)})" for s in suffixes) + ") AS INTEGER)"


_STEREO = _when_chain("class_name", rules.STEREOTYPE_RULES, rules.STEREOTYPE_DEFAULT, op="ends_with")
_RANK = "CASE " + " ".join(f"WHEN stereotype = {_s(l)} THEN {r}" for l, r in rules.STEREOTYPE_RANK) + \
        f" ELSE {rules.STEREOTYPE_RANK_DEFAULT} END"
_CDOMAIN = _when_chain("lower(class_name)", rules.CLASS_DOMAIN_RULES, rules.CLASS_DOMAIN_DEFAULT)
_TDOMAIN = _when_chain("table_name", rules.TABLE_DOMAIN_RULES, rules.TABLE_DOMAIN_DEFAULT)

MATRIX = f"""
cmetrics AS (
  SELECT o.project_id, o.class_name, o.calls_out, CAST(coalesce(i.n, 0) AS BIGINT) AS calls_in, CAST(0 AS BIGINT) AS deps_unique,
         o.has_autowired
  FROM (SELECT project_id, from_class AS class_name, CAST(count(*) AS BIGINT) AS calls_out,
               max(CASE WHEN call_type IN ({", ".join(_s(t) for t in rules.INJECTION_CALL_TYPES)}) THEN 1 ELSE 0 END)
                 AS has_autowired
        FROM calls GROUP BY ALL) o
  LEFT JOIN (SELECT project_id, to_class AS class_name, count(*) AS n FROM calls GROUP BY ALL) i
    USING (project_id, class_name)),
rel AS (
  SELECT c.project_id, c.class_name,
         (SELECT t.table_name FROM tbls t
          WHERE t.project_id = c.project_id AND (contains({_stem('c.class_name')}, t.table_name)
                                                 OR contains(t.table_name, {_stem('c.class_name')}))
          ORDER BY length(t.table_name), t.table_name LIMIT 1) AS related_table
  FROM classes c),
matrix AS (
  SELECT r.project_id, r.class_name, r.related_table,
         CAST(coalesce(cm.calls_out, 0) AS BIGINT) AS calls_out, CAST(coalesce(cm.calls_in, 0) AS BIGINT) AS calls_in,
         CAST(coalesce(cm.deps_unique, 0) AS BIGINT) AS deps_unique,
         CAST(coalesce(cm.has_autowired, 0) AS INTEGER) AS has_autowired,
         CAST(coalesce(tm.db_columns, 0) AS BIGINT) AS db_columns, CAST(coalesce(tm.db_fk_out, 0) AS BIGINT) AS db_fk_out,
         CAST(coalesce(tm.db_fk_in, 0) AS BIGINT) AS db_fk_in, CAST(coalesce(tm.db_relations, 0) AS BIGINT) AS db_relations,
         CAST(coalesce(tm.log_frequency, 0) AS BIGINT) AS log_frequency,
         {_flag('r.class_name', 'Controller')} AS is_controller, {_flag('r.class_name', 'Service')} AS is_service,
         {_flag('r.class_name', 'Repository', 'Repo')} AS is_repository
  FROM rel r LEFT JOIN cmetrics cm USING (project_id, class_name)
  LEFT JOIN tmetrics tm ON tm.project_id = r.project_id AND tm.table_name = r.related_table),
classified AS (
  SELECT *, {_CDOMAIN} AS domain, {_STEREO} AS stereotype FROM matrix)"""


def _zcols(prefix: str = "") -> str:
    out = []
    for c in rules.NUMERIC_COLUMNS:
        out.append(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER w) / CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) "
                   f"OVER w > 0 THEN stddev_pop(CAST({c} AS DOUBLE)) OVER w ELSE 1.0 END AS num_{c}")
    return ",\n         ".join(out)


_CAMEL_STOP = _list(rules.CAMEL_STOP_WORDS)
FEATURES = f"""
zs AS (
  SELECT project_id, class_name,
         {_zcols()}
  FROM matrix WINDOW w AS (PARTITION BY project_id)),
camel AS (
  SELECT project_id, class_name,
         CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(kept, lambda x: lower(x)), ' ')
              ELSE lower(class_name) END AS tokens
  FROM (SELECT project_id, class_name,
               list_filter(list_filter(regexp_split_to_array(
                   regexp_replace(regexp_replace(class_name, '([A-Z][a-z]+)', ' \\1', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'),
                   '\\s+'), lambda x: x <> ''), lambda x: NOT list_contains({_CAMEL_STOP}, x)) AS kept
        FROM classes)),
tok AS (SELECT project_id, class_name, unnest(regexp_extract_all(lower(tokens), '\\b\\w\\w+\\b', 0)) AS token FROM camel),
tf AS (SELECT project_id, class_name, token, count(*) AS tf FROM tok GROUP BY ALL),
dfq AS (SELECT project_id, token, count(*) AS df FROM tf GROUP BY ALL),
nd AS (SELECT project_id, count(*) AS n_docs FROM camel GROUP BY ALL),
tw AS (SELECT tf.project_id, class_name, token, tf, df, tf * (ln((n_docs + 1.0) / (df + 1.0)) + 1) AS w
       FROM tf JOIN dfq USING (project_id, token) JOIN nd USING (project_id)),
tfidf AS (SELECT project_id, class_name, token, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY project_id, class_name)) AS value
          FROM tw)"""


def _with(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip().rstrip(",") for b in blocks) + "\n"


def _r(expr: str, alias: str, d: int = 6) -> str:
    return f"round({expr}, {d}) + 0.0 AS {alias}"


LOGS = _with(LOG_LINES)
SCH = _with(LOG_LINES, SCHEMA)
CALLS = _with(CALL_ROWS)
MAT = _with(LOG_LINES, SCHEMA, CALL_ROWS, MATRIX)
FEAT = _with(LOG_LINES, SCHEMA, CALL_ROWS, MATRIX, FEATURES)

_FK_COLS = 'project_id, from_table, "column", references_table, references_column, inferred'
_EDGE_COLS = "project_id, path, from_class, from_package, to_class, method_name, call_type, line_number, call_idx"
#: Edges of a plain file come one after the other.
_PLAIN = "SELECT *, CAST(row_number() OVER (PARTITION BY project_id, path ORDER BY line_number) - 1 AS INTEGER) AS call_idx FROM calls"
_FLUENT = """
      SELECT project_id, file AS path, 'Unknown' AS from_class, pkg AS from_package, 'Map<String, ' || to_type || '>' AS to_class,
             to_var AS method_name, 'autowired' AS call_type, CAST(3 AS INTEGER) AS line_number, CAST(0 AS INTEGER) AS call_idx
      FROM t WHERE call_type = 'autowired'
      UNION ALL SELECT project_id, file, from_class, pkg, first_link || '.next(three(four(5)))', 'done', 'method_call', 4, 0
      FROM t WHERE call_type <> 'autowired'
      UNION ALL SELECT project_id, file, from_class, pkg, first_link, 'next', 'method_call', 4, 1 FROM t WHERE call_type <> 'autowired'
      UNION ALL SELECT project_id, file, from_class, pkg, to_var, verb, 'method_call', 4, 2 FROM t WHERE call_type <> 'autowired'
      UNION ALL SELECT project_id, file, from_class, pkg, 'new ' || to_type || '()', 'go', 'method_call', 7, 3
      FROM t WHERE call_type <> 'autowired'"""
_FLUENT_ROWS = """, t AS (
      SELECT *, regexp_replace(path, '[.]java$', '_') || CAST(line_number AS VARCHAR) || '.java' AS file,
             'com.shop.p' || CAST(l_suppkey AS VARCHAR) AS pkg, to_var || '.' || verb || '(new ' || to_type || '(1))' AS first_link
      FROM cr)"""
#: All generated Java text: the outer link of a chain comes first.
TEXT = f"{_FLUENT_ROWS}, edges AS (SELECT {_EDGE_COLS} FROM ({_PLAIN}) UNION ALL {_FLUENT})"


def _adjacency(src: str, order: str) -> str:
    return f"""
      , firsts AS (SELECT project_id, from_class, to_class, min({order}) AS f, count(*) AS n_calls FROM {src} GROUP BY ALL)
      SELECT project_id, from_class, row_number() OVER (PARTITION BY project_id, from_class ORDER BY f, to_class) AS rank, to_class,
             n_calls, count(*) OVER (PARTITION BY project_id, from_class) AS n_targets FROM firsts"""


def _rank_filter(src: str, cols: str, order: str, k: int = rules.PREVIEW_ROWS) -> str:
    return (f"SELECT {cols}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {order}) "
            f"AS INTEGER) AS rank FROM {src}) WHERE rank <= {k}")


_DOC_TOKEN = r"[\p{L}\p{N}_]{2,}"
DOCS = f"""
WITH dtok AS (SELECT lang AS project_id, doc_id, unnest(regexp_extract_all(lower(text), {_s(_DOC_TOKEN)}, 0)) AS token
              FROM documents),
dtf AS (SELECT project_id, doc_id, token, count(*) AS tf FROM dtok GROUP BY ALL),
ddf AS (SELECT project_id, token, count(*) AS df FROM dtf GROUP BY ALL),
dnd AS (SELECT lang AS project_id, count(*) AS n_docs FROM documents GROUP BY ALL),
dtw AS (SELECT dtf.project_id, doc_id, token, tf, df, tf * (ln((n_docs + 1.0) / (df + 1.0)) + 1) AS w
        FROM dtf JOIN ddf USING (project_id, token) JOIN dnd USING (project_id)),
dv AS (SELECT project_id, doc_id, token, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY project_id, doc_id)) AS value FROM dtw)
"""


def _pairs(vec: str, doc: str, a: str, b: str, k: int = rules.TOP_PAIRS) -> str:
    """Brute force: every pair of documents (a < b) in a project, cosine by
    token self-join, zero for pairs sharing no token; top k by
    (similarity desc, a, b)."""
    return f"""
  , docs_ AS (SELECT DISTINCT project_id, {doc} AS d FROM {vec})
  , dots_ AS (SELECT x.project_id, x.{doc} AS a, y.{doc} AS b, round(sum(x.value * y.value), 9) AS sim
              FROM {vec} x JOIN {vec} y ON x.project_id = y.project_id AND x.token = y.token AND x.{doc} < y.{doc}
              GROUP BY ALL)
  , top_pos_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY sim DESC, a, b) AS r
                                FROM dots_ WHERE sim > 0) WHERE r <= {k})
  , first_ AS (SELECT * FROM (SELECT project_id, d, row_number() OVER (PARTITION BY project_id ORDER BY d) AS r
                              FROM docs_) WHERE r <= {2 * k})
  , zero_ AS (SELECT p.project_id, p.d AS a, q.d AS b, 0.0 AS sim FROM first_ p JOIN first_ q
              ON p.project_id = q.project_id AND p.d < q.d
              WHERE NOT EXISTS (SELECT 1 FROM dots_ s WHERE s.project_id = p.project_id AND s.a = p.d AND s.b = q.d
                                AND s.sim > 0))
  SELECT project_id, a AS {a}, b AS {b}, sim + 0.0 AS similarity, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY sim DESC, a, b) AS INTEGER) AS rank
    FROM (SELECT project_id, a, b, sim FROM top_pos_ UNION ALL SELECT project_id, a, b, sim FROM zero_))
  WHERE rank <= {k}"""


def _issues_sql() -> str:
    """A check that fails is one issue of its project and step."""
    neg = " OR ".join(f"{c} < 0" for c in rules.NUMERIC_COLUMNS)
    off = " OR ".join(f"NOT abs(avg(num_{c})) < {rules.MEAN_TOLERANCE}" for c in rules.NUMERIC_COLUMNS)
    const = " OR ".join(
        f"(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 THEN stddev_pop(CAST({c} AS DOUBLE)) ELSE 1.0 END) "
        f"< {rules.CONSTANT_SCALE}" for c in rules.NUMERIC_COLUMNS)
    return f"""
  , named AS (SELECT project_id FROM classes UNION SELECT project_id FROM ddl_scripts
              UNION SELECT 'N' || CAST(n_nationkey AS VARCHAR) FROM nation)
  , issues AS (
      SELECT DISTINCT project_id, 2 AS step FROM (SELECT project_id, class_name FROM matrix GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT project_id, 2 FROM (SELECT project_id FROM matrix GROUP BY project_id HAVING bool_or({neg}))
      UNION ALL SELECT project_id, 3 FROM (SELECT project_id FROM zs GROUP BY project_id HAVING {off})
      UNION ALL SELECT DISTINCT project_id, 3 FROM classes c WHERE NOT EXISTS (
          SELECT 1 FROM tfidf t WHERE t.project_id = c.project_id AND t.class_name = c.class_name AND t.value <> 0)
      UNION ALL SELECT project_id, 3 FROM (SELECT project_id FROM matrix GROUP BY project_id HAVING {const})
      UNION ALL SELECT project_id, 1 FROM ddl_scripts d WHERE NOT EXISTS (
          SELECT 1 FROM classes c WHERE c.project_id = d.project_id)
      UNION ALL SELECT project_id, 1 FROM named d WHERE NOT EXISTS (
          SELECT 1 FROM log_lines l WHERE l.project_id = d.project_id))
  , projects AS (SELECT project_id FROM named)
  , per AS (
      SELECT p.project_id, s.step, CAST(count(i.step) AS BIGINT) AS n_issues
      FROM projects p CROSS JOIN (SELECT unnest([1, 2, 3]) AS step) s
      LEFT JOIN issues i ON i.project_id = p.project_id AND i.step = s.step GROUP BY ALL)
  SELECT project_id, step, n_issues, n_issues = 0 AS ok FROM per
  UNION ALL
  SELECT project_id, 0 AS step, CAST(sum(n_issues) AS BIGINT) AS n_issues, bool_and(n_issues = 0) AS ok FROM per GROUP BY ALL"""


def _report_sql() -> str:
    parts = [
        ("classes", 1, "SELECT project_id, count(*) AS v FROM classes GROUP BY ALL"),
        ("calls", 1, "SELECT project_id, count(*) AS v FROM calls GROUP BY ALL"),
        ("tables", 1, "SELECT project_id, count(*) AS v FROM tbls GROUP BY ALL"),
        ("foreign_keys", 1, "SELECT project_id, count(*) AS v FROM fks GROUP BY ALL"),
        ("http_events", 1, "SELECT project_id, count(*) FILTER (WHERE type = 'HTTP') AS v FROM ev GROUP BY ALL"),
        ("sql_events", 1, "SELECT project_id, count(*) FILTER (WHERE type = 'SQL') AS v FROM ev GROUP BY ALL"),
        ("correlated_resources", 1, "SELECT project_id, count(DISTINCT carried) AS v FROM corr GROUP BY ALL"),
        ("matrix_rows", 2, "SELECT project_id, count(*) AS v FROM matrix GROUP BY ALL"),
        ("numeric_features", 3, f"SELECT project_id, {len(rules.NUMERIC_COLUMNS)} AS v FROM matrix GROUP BY ALL"),
        ("tfidf_tokens", 3, "SELECT project_id, count(DISTINCT token) AS v FROM tfidf GROUP BY ALL"),
        ("composite_features", 3,
         f"SELECT project_id, count(DISTINCT token) + {len(rules.NUMERIC_COLUMNS)} AS v FROM tfidf GROUP BY ALL"),
        ("weight_numeric", 3, f"SELECT DISTINCT project_id, {rules.W_NUMERIC} AS v FROM tfidf"),
        ("weight_tfidf", 3, f"SELECT DISTINCT project_id, {rules.W_TFIDF} AS v FROM tfidf"),
    ]
    named = [f"""SELECT project_id, 1 AS step, 'call_type:' || coalesce(call_type, '?') AS metric, CAST(count(*) AS DOUBLE) AS value FROM calls GROUP BY ALL""",
             f"""SELECT project_id, 1, 'domain:' || {_TDOMAIN}, CAST(count(*) AS DOUBLE) FROM tbls GROUP BY ALL"""]
    return "\n  UNION ALL ".join(
        [f"SELECT project_id, {step} AS step, '{name}' AS metric, CAST(v AS DOUBLE) AS value FROM ({sql})"
         for name, step, sql in parts] + named)


PAGES = f"""
WITH pl AS (
  SELECT regexp_extract(url, {_s(FX.URL_HOST)}, 1) AS project_id, url AS path,
         regexp_extract(url, {_s(FX.URL_PATH)}, 1) AS from_class,
         unnest(regexp_extract_all(html, {_s(FX.HREF)}, 1)) AS href,
         unnest(range(len(regexp_extract_all(html, {_s(FX.HREF)}, 1)))) AS pos
  FROM pages),
links AS (
  SELECT project_id, path, from_class, regexp_extract(href, '^([^?#]*)', 1) AS to_class,
         CAST(pos + 1 AS INTEGER) AS line_number
  FROM pl)
"""


def oracle_sql() -> dict[str, str]:
    num = ", ".join(rules.NUMERIC_COLUMNS)
    q: dict[str, str] = {}
    # -- logs
    q["log_events"] = LOGS + "SELECT * FROM ev"
    q["log_events_fixed_update"] = LOGS.replace(
        "lower(regexp_extract(line, " + P_SQL + ", 3))",
        "CASE WHEN lower(regexp_extract(line, " + P_SQL + ", 1)) = 'update' THEN lower(regexp_extract(line, "
        "'(?i)update\\s+(\\w+)', 1)) ELSE lower(regexp_extract(line, " + P_SQL + ", 3)) END") + "SELECT * FROM ev"
    q["log_correlation"] = LOGS + ("SELECT project_id, session_id, line_no, seq, carried AS resource, table_name, "
                                   "operation FROM corr")
    q["resource_table_map"] = LOGS + """
      , pairs AS (SELECT project_id, carried AS resource, table_name, min(line_no * 2 + seq) AS first_ord
                  FROM corr GROUP BY ALL)
      SELECT project_id, resource, string_agg(table_name, ',' ORDER BY first_ord, table_name) AS tables,
             count(*) AS n_tables, min(first_ord) AS first_seen FROM pairs GROUP BY ALL"""
    q["resource_table_pairs"] = LOGS + """
      SELECT project_id, carried AS resource, table_name, min(line_no * 2 + seq) AS first_ord, count(*) AS n_events
      FROM corr GROUP BY ALL"""
    q["endpoint_frequency"] = LOGS + "SELECT * FROM efreq"
    q["table_frequency"] = LOGS + "SELECT * FROM tfreq"
    q["log_totals"] = LOGS + ("SELECT project_id, count(*) FILTER (WHERE type = 'HTTP') AS total_http, "
                              "count(*) FILTER (WHERE type = 'SQL') AS total_sql, count(*) AS total_events "
                              "FROM ev GROUP BY ALL")
    q["top_endpoints"] = LOGS + _rank_filter("efreq", "project_id, endpoint, n, first_seen", "n DESC, endpoint")
    q["first_endpoints"] = LOGS + _rank_filter("efreq", "project_id, endpoint, n, first_seen", "first_seen, endpoint")
    q["top_tables"] = LOGS + _rank_filter("tfreq", "project_id, table_name, n, first_seen", "n DESC, table_name")
    q["first_tables"] = LOGS + _rank_filter("tfreq", "project_id, table_name, n, first_seen", "first_seen, table_name")
    # -- schema
    q["ddl_pick"] = SCH + "SELECT project_id, path, CAST(length(ddl) AS INTEGER) AS ddl_length FROM ddl_scripts"
    q["ddl_tables"] = SCH + "SELECT project_id, table_name, table_pos, body FROM tbls"
    q["ddl_columns"] = SCH + "SELECT project_id, table_name, ordinal, name, type, nullable, primary_key FROM cols"
    q["ddl_foreign_keys"] = SCH + f"SELECT {_FK_COLS} FROM efk"
    q["inferred_foreign_keys"] = SCH + f"SELECT {_FK_COLS} FROM ifk"
    q["inferred_foreign_keys_plural"] = SCH + """
      , hits AS (
        SELECT c.project_id, c.table_name AS from_table, c.name AS "column", t.table_name AS references_table,
               min(c.table_pos) AS a, min(c.ordinal) AS b
        FROM cols c JOIN tbls t ON t.project_id = c.project_id
          AND (t.table_name = substr(lower(c.name), 1, length(c.name) - 3)
               OR t.table_name = substr(lower(c.name), 1, length(c.name) - 3) || 's')
        WHERE ends_with(lower(c.name), '_id') AND lower(c.name) <> 'id'
          AND NOT EXISTS (SELECT 1 FROM efk WHERE efk.project_id = c.project_id AND efk.from_table = c.table_name
                          AND efk."column" = c.name)
        GROUP BY ALL)
      SELECT project_id, from_table, "column", references_table, 'id' AS references_column, true AS inferred
      FROM (SELECT *, row_number() OVER (PARTITION BY project_id, from_table, "column"
                                          ORDER BY length(references_table)) AS r FROM hits) WHERE r = 1"""
    q["all_foreign_keys"] = SCH + f"SELECT {_FK_COLS} FROM fks"
    q["table_domains"] = SCH + f"SELECT project_id, table_name, {_TDOMAIN} AS domain FROM tbls"
    q["domain_groups"] = SCH + f"""
      SELECT project_id, domain, string_agg(table_name, ',' ORDER BY table_pos) AS tables, count(*) AS n_tables
      FROM (SELECT project_id, table_name, table_pos, {_TDOMAIN} AS domain FROM tbls) GROUP BY ALL"""
    q["table_graph"] = SCH + """
      SELECT project_id, from_table, string_agg(references_table, ',' ORDER BY k, a, b) AS targets, count(*) AS n_targets
      FROM fks GROUP BY ALL"""
    q["schema_summary"] = SCH + """
      SELECT t.project_id, t.total_tables, coalesce(f.total_fks, 0) AS total_fks, coalesce(f.inferred_fks, 0) AS inferred_fks,
             t.table_names
      FROM (SELECT project_id, count(*) AS total_tables, string_agg(table_name, ',' ORDER BY table_pos) AS table_names
            FROM tbls GROUP BY ALL) t
      LEFT JOIN (SELECT project_id, count(*) AS total_fks, count(*) FILTER (WHERE inferred) AS inferred_fks
                 FROM fks GROUP BY ALL) f USING (project_id)"""
    # -- calls (the oracle for the text job is the structured derivation)
    q["call_edges"] = CALLS + f"SELECT {_EDGE_COLS} FROM ({_PLAIN})"
    q["call_edges_fluent"] = CALLS + _FLUENT_ROWS + _FLUENT
    q["injected_edges"] = CALLS + f"SELECT {_EDGE_COLS} FROM ({_PLAIN}) WHERE call_type = 'autowired'"
    q["adjacency"] = CALLS + TEXT + _adjacency("edges", "(path, call_idx)")
    q["adjacency_edges"] = CALLS + TEXT + """
      SELECT project_id, from_class, to_class, arg_min(path, (path, call_idx)) AS first_path,
             arg_min(line_number, (path, call_idx)) AS first_line, count(*) AS n_calls
      FROM edges GROUP BY ALL"""
    q["class_list"] = CALLS + "SELECT project_id, class_name FROM classes"
    q["call_summary"] = CALLS + """
      SELECT project_id, count(DISTINCT path) AS total_files, count(DISTINCT path) AS parsed_files,
             CAST(0 AS BIGINT) AS error_files, count(DISTINCT from_class) AS total_classes, count(*) AS total_calls
      FROM calls GROUP BY ALL"""
    q["call_type_histogram"] = CALLS + "SELECT project_id, coalesce(call_type, '?') AS call_type, count(*) AS n FROM calls GROUP BY ALL"
    q["first_calls"] = CALLS + TEXT + _rank_filter("edges", "project_id, path, line_number, from_class, to_class, method_name",
                                                   "path, call_idx")
    q["page_links"] = PAGES + "SELECT * FROM links"
    q["page_link_metrics"] = PAGES + """
      SELECT o.project_id, o.class_name, o.calls_out, CAST(coalesce(i.n, 0) AS BIGINT) AS calls_in, o.deps_unique,
             o.has_autowired
      FROM (SELECT project_id, from_class AS class_name, CAST(count(*) AS BIGINT) AS calls_out,
                   CAST(count(DISTINCT to_class) AS BIGINT) AS deps_unique, 0 AS has_autowired
            FROM links GROUP BY ALL) o
      LEFT JOIN (SELECT project_id, lower(to_class) AS k, count(*) AS n FROM links GROUP BY ALL) i
        ON i.project_id = o.project_id AND i.k = lower(o.class_name)"""
    q["page_link_adjacency"] = PAGES + _adjacency("links", "(path, line_number)")
    q["page_resources"] = f"""
      SELECT page_id, regexp_extract(url, {_s(FX.URL_HOST)}, 1) AS project_id,
             regexp_extract(url, {_s(FX.URL_PATH)}, 1) AS path,
             regexp_extract(regexp_extract(url, {_s(FX.URL_PATH)}, 1), '^/?([^/?]*)', 1) AS resource
      FROM pages"""
    # -- metrics
    q["calls_out_in"] = MAT + "SELECT project_id, class_name, calls_out, calls_in, deps_unique, has_autowired FROM cmetrics"
    inj = ", ".join(_s(t) for t in rules.INJECTION_CALL_TYPES)
    q["deps_unique_fixed"] = CALLS + f"""
      SELECT o.project_id, o.class_name, o.calls_out, CAST(coalesce(i.n, 0) AS BIGINT) AS calls_in, o.deps_unique,
             o.has_autowired
      FROM (SELECT project_id, from_class AS class_name, CAST(count(*) AS BIGINT) AS calls_out,
                   CAST(count(DISTINCT to_class) AS BIGINT) AS deps_unique,
                   max(CASE WHEN call_type IN ({inj}) THEN 1 ELSE 0 END) AS has_autowired
            FROM calls GROUP BY ALL) o
      LEFT JOIN (SELECT project_id, lower(to_class) AS k, count(*) AS n FROM calls GROUP BY ALL) i
        ON i.project_id = o.project_id AND i.k = lower(o.class_name)"""
    q["table_metrics"] = SCH + "SELECT * FROM tmetrics"
    # -- matrix
    q["related_table"] = MAT + "SELECT project_id, class_name, related_table FROM rel"
    q["class_domain"] = CALLS + f"""
      SELECT project_id, class_name, {_CDOMAIN} AS domain, stereotype, {_RANK} AS stereotype_rank
      FROM (SELECT *, {_STEREO} AS stereotype FROM classes)"""
    q["stereotype_flags"] = CALLS + f"""
      SELECT project_id, class_name, {_flag('class_name', 'Controller')} AS is_controller,
             {_flag('class_name', 'Service')} AS is_service, {_flag('class_name', 'Repository', 'Repo')} AS is_repository
      FROM classes"""
    q["feature_matrix"] = MAT + f"""
      SELECT project_id, class_name, coalesce(related_table, {_s(rules.NONE_RAW)}) AS related_table, {num} FROM matrix"""
    q["matrix_readable"] = MAT + f"""
      SELECT project_id, class_name, domain, stereotype, coalesce(related_table, {_s(rules.NONE_READABLE)}) AS related_table,
             calls_out, calls_in, CASE WHEN has_autowired = 1 THEN {_s(rules.YES)} ELSE {_s(rules.NO)} END AS injected,
             db_columns, db_relations, log_frequency FROM classified"""
    q["matrix_by_domain"] = MAT + f"""
      SELECT project_id, domain, class_name, stereotype, coalesce(related_table, {_s(rules.NONE_BY_DOMAIN)}) AS related_table,
             calls_out, calls_in, CASE WHEN has_autowired = 1 THEN {_s(rules.YES)} ELSE {_s(rules.NO)} END AS injected,
             log_frequency, {_RANK} AS stereotype_rank,
             row_number() OVER (PARTITION BY project_id ORDER BY domain, {_RANK}, class_name) AS sheet_row FROM classified"""
    q["classes_by_domain"] = MAT + """
      SELECT project_id, upper(domain) AS domain, class_name,
             count(*) OVER (PARTITION BY project_id, upper(domain)) AS n_classes FROM classified"""
    # -- features
    q["zscore_features"] = FEAT + "SELECT project_id, class_name, " + ", ".join(
        _r(f"num_{c}", f"num_{c}") for c in rules.NUMERIC_COLUMNS) + " FROM zs"
    q["camel_tokens"] = FEAT + "SELECT project_id, class_name, tokens FROM camel"
    q["tfidf"] = FEAT + f"SELECT project_id, class_name, token, tf, df, {_r('value', 'value')} FROM tfidf"
    zl = " UNION ALL ".join(f"SELECT project_id, class_name, 'num_{c}' AS feature, num_{c} * {rules.W_NUMERIC} AS v FROM zs"
                            for c in rules.NUMERIC_COLUMNS)
    q["composite_features"] = FEAT + f"""
      SELECT f.project_id, f.class_name, m.related_table, feature, {_r('v', 'value')} FROM (
        {zl}
        UNION ALL SELECT project_id, class_name, 'tfidf_' || token, value * {rules.W_TFIDF} FROM tfidf) f
      LEFT JOIN matrix m ON m.project_id = f.project_id AND m.class_name = f.class_name"""
    names = " UNION ALL ".join(f"SELECT DISTINCT project_id, 'num_{c}' AS f FROM matrix" for c in rules.NUMERIC_COLUMNS)
    q["wide_sheets"] = FEAT + f"""
      SELECT project_id, 'class_name,related_table,' || string_agg(f, ',' ORDER BY f) AS header, n_classes
      FROM ({names} UNION ALL SELECT DISTINCT project_id, 'tfidf_' || token FROM tfidf)
      JOIN (SELECT project_id, count(*) AS n_classes FROM matrix GROUP BY ALL) USING (project_id) GROUP BY project_id, n_classes"""
    q["nearest_pairs"] = FEAT + _pairs("tfidf", "class_name", "class_a", "class_b")
    q["tfidf_documents"] = DOCS + f"SELECT project_id, doc_id, token, tf, df, {_r('value', 'value')} FROM dv"
    q["nearest_documents"] = DOCS + _pairs("dv", "doc_id", "doc_a", "doc_b").replace("  , docs_", ", docs_", 1)
    # -- quality
    prof = " UNION ALL ".join(
        f"SELECT project_id, count(*) AS n_rows, '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)), 2) + 0.0 AS mean, "
        f"CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER (WHERE {c} = 0) AS zeros FROM matrix GROUP BY ALL"
        for c in rules.NUMERIC_COLUMNS)
    q["dq_profile"] = MAT + prof
    q["dq_duplicates"] = f"""
      SELECT project_id, class_name, row_order, 'issue' AS severity FROM (
        SELECT p_brand AS project_id, {_class_of('p_name', 'p_partkey')} AS class_name, p_partkey AS row_order,
               row_number() OVER (PARTITION BY p_brand, {_class_of('p_name', 'p_partkey')} ORDER BY p_partkey) AS occurrence
        FROM part) WHERE occurrence > 1"""
    negs = " UNION ALL ".join(
        f"SELECT project_id, '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value, min({c}) < 0 AS negative "
        f"FROM matrix GROUP BY ALL" for c in rules.NUMERIC_COLUMNS)
    q["dq_negatives"] = MAT + negs
    idle = ("SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS project_id, 'Idle' || CAST(n_nationkey AS VARCHAR) || 'Service' "
            "AS class_name FROM nation")
    q["dq_missing_inputs"] = MAT + f"""
      , named AS (SELECT project_id FROM classes UNION SELECT project_id FROM ({idle}))
      SELECT project_id, 'ddl_scripts' AS input, true AS required, 'stop' AS effect FROM named c
      WHERE NOT EXISTS (SELECT 1 FROM ddl_scripts d WHERE d.project_id = c.project_id)
      UNION ALL
      SELECT project_id, 'log_lines', false, 'issue' FROM named c
      WHERE NOT EXISTS (SELECT 1 FROM log_lines l WHERE l.project_id = c.project_id)""".lstrip()
    q["dq_empty_projects"] = MAT + f"""
      , named AS (SELECT project_id FROM ddl_scripts UNION SELECT project_id FROM ({idle}))
      SELECT project_id, 'issue' AS severity FROM named n
      WHERE NOT EXISTS (SELECT 1 FROM classes c WHERE c.project_id = n.project_id)""".lstrip()
    q["dq_isolated"] = MAT + f"""
      SELECT project_id, class_name, 'warning' AS severity FROM matrix WHERE calls_out = 0 AND calls_in = 0
      UNION ALL SELECT project_id, class_name, 'warning' FROM ({idle})"""
    const = " UNION ALL ".join(
        f"SELECT project_id, '{c}' AS \"column\", round(stddev_pop(CAST({c} AS DOUBLE)), 6) + 0.0 AS std, "
        f"stddev_pop(CAST({c} AS DOUBLE)) = 0 AS constant FROM matrix GROUP BY ALL" for c in rules.NUMERIC_COLUMNS)
    q["dq_constant"] = MAT + const
    zchk = " UNION ALL ".join(
        f"SELECT project_id, 'num_{c}' AS \"column\", round(avg(num_{c}), 6) + 0.0 AS mean, "
        f"round(stddev_pop(num_{c}), 6) + 0.0 AS std, abs(avg(num_{c})) < {rules.MEAN_TOLERANCE} AS mean_ok "
        f"FROM zs GROUP BY ALL" for c in rules.NUMERIC_COLUMNS)
    q["dq_zscore"] = FEAT + zchk
    q["dq_zero_tfidf"] = FEAT + f"""
      SELECT project_id, class_name, 'issue' AS severity FROM (SELECT project_id, class_name FROM classes UNION ALL {idle}) c
      WHERE NOT EXISTS (
        SELECT 1 FROM tfidf t WHERE t.project_id = c.project_id AND t.class_name = c.class_name AND t.value <> 0)"""
    q["step_status"] = FEAT + _issues_sql().replace("  , named", ", named", 1)
    q["report_metrics"] = FEAT + _report_sql()
    return q
