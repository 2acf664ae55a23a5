"""DuckDB SQL for the registered queries, written from the relations, not from the plans."""

from __future__ import annotations


def path(k: str) -> str:
    return f"'src/pkg' || CAST({k} % 50 AS VARCHAR) || '/m_' || CAST({k} AS VARCHAR) || '.py'"


BRAND = "lower(regexp_replace(replace(p_brand, '#', '_'), '[-_.]+', '-', 'g'))"
N = "CAST(regexp_extract({}, '([0-9]+)$', 1) AS INTEGER)"
FILES = f"SELECT o_orderkey AS key, {path('o_orderkey')} AS path, CASE o_orderstatus WHEN 'O' THEN 'runtime' WHEN 'F' THEN 'test' ELSE 'dev' END AS context, o_orderpriority = '1-URGENT' AS opaque FROM orders"
USED = f"""SELECT {BRAND} AS distribution, f.context, l_returnflag = 'R' AS optional, l_linestatus = 'F' AS platform_guarded, f.path AS file, l_linenumber AS line
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ({FILES}) f ON f.key = l_orderkey"""
DECLARED = f"""SELECT DISTINCT {BRAND} AS distribution,
  CASE WHEN p_type LIKE 'S%' THEN 'runtime' WHEN p_type LIKE 'P%' THEN 'group' ELSE 'optional' END AS kind,
  lower(split_part(p_type, ' ', 1)) AS label, CASE WHEN {N.format('p_brand')} % 2 = 0 THEN 'python_version < ''4''' END AS marker
FROM part WHERE p_size = 50 AND {N.format('p_brand')} % 3 = 0"""
EDGES = "SELECT DISTINCT l_orderkey AS src, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM orders) AS dst FROM lineitem WHERE l_quantity >= 42"
LOCK = f"""SELECT DISTINCT a.d AS src, b.d AS dst FROM
  (SELECT l_orderkey AS k, l_linenumber AS n, {BRAND} AS d FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN
  (SELECT l_orderkey AS k, l_linenumber - 1 AS n, {BRAND} AS d FROM lineitem JOIN part ON l_partkey = p_partkey) b USING (k, n)
  WHERE {N.format('b.d')} - {N.format('a.d')} BETWEEN 1 AND 2"""
CODE = "'TL' || lpad(CAST(l_partkey % 10 + 1 AS VARCHAR), 3, '0')"
KIND = f"""CASE WHEN {CODE} = 'TL001' THEN 'file' WHEN {CODE} IN ('TL002', 'TL005', 'TL009') THEN 'distribution' WHEN {CODE} = 'TL008' THEN 'binary'
  WHEN {CODE} IN ('TL006', 'TL007') THEN 'symbol' ELSE 'import' END"""
CANDIDATES = f"""SELECT code, kind, CASE WHEN kind IN ('file', 'symbol', 'import') THEN {path('l_orderkey')} END AS path,
  CASE WHEN kind = 'symbol' THEN 'pkg' || CAST(l_orderkey % 50 AS VARCHAR) || '.m_' || CAST(l_orderkey AS VARCHAR) WHEN kind = 'import' THEN 'mod' || CAST(l_partkey % 40 AS VARCHAR) END AS module,
  CASE WHEN kind IN ('distribution', 'binary', 'symbol') THEN 'name_' || CAST(l_partkey % 60 AS VARCHAR) END AS name, l_linenumber AS line,
  ['error', 'warning', 'info'][l_partkey % 3 + 1] AS severity, ['certain', 'likely', 'maybe'][l_suppkey % 3 + 1] AS confidence,
  CASE WHEN l_orderkey % 11 = 0 THEN 'member' || CAST(l_orderkey % 3 AS VARCHAR) END AS member, l_linenumber AS seq, l_orderkey
FROM (SELECT *, {CODE} AS code, {KIND} AS kind FROM lineitem)"""
TARGET = """coalesce(member || ':', '') || CASE kind WHEN 'file' THEN path WHEN 'distribution' THEN name WHEN 'binary' THEN name
  WHEN 'symbol' THEN coalesce(path, module) || ':' || name ELSE path || ':' || module END"""
DIRECTIVES = f"""SELECT {path('o_orderkey')} AS path, o_orderkey % 4 + 1 AS line, o_orderkey % 2 = 0 AS file_level,
  unnest(['TL' || lpad(CAST(o_orderkey % 10 + 1 AS VARCHAR), 3, '0'), 'TL003']) AS code FROM orders WHERE o_orderkey % 7 = 0"""
SEV = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
CONF = "CASE confidence WHEN 'certain' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END"
#: The emission pipeline of the queries: severities, ignores, floor.
EMITTED = f"""SELECT * FROM (
  SELECT * REPLACE (CASE code WHEN 'TL004' THEN 'info' ELSE severity END AS severity),
    {TARGET} AS target,
    CASE WHEN code = 'TL001' AND regexp_matches(path, '^src/pkg1.*/m_.*5\\.py$') OR code = 'TL002' AND name = 'name_11'
           OR code = 'TL006' AND regexp_matches(path, '^src/pkg2') AND regexp_matches(name, '^name_[0-9]5$') OR code = 'TL010' AND (path = 'mod9' OR module IN ('mod9', 'mod29')) THEN 'config'
         WHEN EXISTS (SELECT 1 FROM ({DIRECTIVES}) d WHERE d.path = c.path AND d.code = c.code AND d.file_level) THEN 'file'
         WHEN EXISTS (SELECT 1 FROM ({DIRECTIVES}) d WHERE d.path = c.path AND d.code = c.code AND d.line = c.line) THEN 'inline' END AS disposition
  FROM ({CANDIDATES}) c WHERE code <> 'TL007') WHERE {CONF} >= 1"""
REACH = f"""WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT dst FROM r JOIN e ON src = node)"""
DEPTH = f"""WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 97 = 0
  UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 40)"""
CLOSURE = f"""WITH RECURSIVE l AS ({LOCK}), r(distribution, depth) AS (SELECT distribution, 0 FROM ({DECLARED})
  UNION SELECT dst, depth + 1 FROM r JOIN l ON src = distribution WHERE depth < 30)"""
UNDECLARED = f"SELECT * FROM ({USED}) WHERE context = 'runtime' AND distribution NOT IN (SELECT distribution FROM ({DECLARED}))"
LADDER = """SELECT import_root, CASE WHEN tier = 1 THEN 'stdlib' WHEN tier IN (2, 3) THEN 'first_party' WHEN tier = 8 THEN 'unknown' ELSE 'third_party' END AS origin,
  CASE tier WHEN 4 THEN v[1] WHEN 5 THEN u[1] WHEN 6 THEN b[1] WHEN 7 THEN lower(replace(import_root, '_', '-')) END AS distribution,
  CASE WHEN tier <= 3 THEN 'certain' WHEN tier = 4 THEN CASE WHEN len(v) > 1 THEN 'maybe' ELSE 'certain' END WHEN tier = 5 THEN 'likely'
       WHEN tier = 6 THEN CASE WHEN len(b) > 1 THEN 'maybe' ELSE 'certain' END ELSE 'maybe' END AS confidence, tier, sites
FROM (SELECT *, CASE WHEN is_std THEN 1 WHEN is_own THEN 2 WHEN member THEN 3 WHEN v IS NOT NULL THEN 4 WHEN u IS NOT NULL THEN 5 WHEN b IS NOT NULL THEN 6
       WHEN contains(import_root, '_') THEN 7 ELSE 8 END AS tier
  FROM (SELECT import_root, count(*) AS sites, any_value(k) % 13 = 0 AS is_std, any_value(k) % 13 = 1 AS is_own, any_value(k) % 13 = 2 AS member,
    CASE WHEN any_value(k) % 7 = 0 THEN CASE WHEN any_value(k) % 2 = 0 THEN ['venv-a', 'venv-b'] ELSE ['venv-b'] END END AS v,
    CASE WHEN any_value(k) % 7 IN (0, 1) THEN ['user-' || CAST(any_value(k) AS VARCHAR)] END AS u,
    CASE WHEN any_value(k) % 7 IN (1, 2) THEN CASE WHEN any_value(k) % 3 = 0 THEN ['bundled-x', 'bundled-y'] ELSE ['bundled-y'] END END AS b
    FROM (SELECT l_partkey % 500 AS k, CASE WHEN l_partkey % 500 % 2 = 0 THEN 'root' || CAST(l_partkey % 500 AS VARCHAR) ELSE 'root_' || CAST(l_partkey % 500 AS VARCHAR) END AS import_root FROM lineitem) GROUP BY import_root))"""
MEMBER_AT = "CASE n_nationkey % 3 WHEN 0 THEN 'src/pkg' || CAST(n_nationkey AS VARCHAR) WHEN 1 THEN 'src' ELSE 'src/pkg' || CAST(n_nationkey AS VARCHAR) || '/sub' END"
TOKENS = r"""SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), ' '), lambda x: regexp_replace(x, '^[^A-Za-z0-9\-_.]+|[^A-Za-z0-9\-_.]+$', '', 'g')), lambda x: x <> '')) AS token FROM documents"""
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents"

#: The modules of the customers' trees (adapters.trees): c, k, r (place), live (reached), follows.
TREE = """o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER w AS r, lead(o_orderkey) OVER w AS nxt, lag(o_orderkey) OVER w AS prev,
    coalesce(sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
dep AS (SELECT c_custkey AS c, unnest([c_custkey % 7, c_custkey % 11 + 13]) AS n FROM customer),
use AS (SELECT o.*, l_partkey % 26 AS n, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey) + CASE WHEN k % 4 <> 0 AND nxt IS NOT NULL THEN 1 ELSE 0 END AS line FROM o JOIN lineitem ON l_orderkey = k),
lost AS (SELECT c, 'src/c' || CAST(c AS VARCHAR) || '/m_' || CAST(k AS VARCHAR) || '.py' AS path FROM o WHERE NOT live
  UNION ALL SELECT c_custkey, 'src/c' || CAST(c_custkey AS VARCHAR) || '/broken.py' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey IN (SELECT c FROM o))"""
MODULE = "'c' || CAST(c AS VARCHAR) || '.m_' || CAST({} AS VARCHAR)"
AT = "'src/c' || CAST(c AS VARCHAR) || '/m_' || CAST({} AS VARCHAR) || '.py'"

ORACLES: dict[str, str] = {
    "unreachable_files": f"{REACH} SELECT path, CASE WHEN opaque THEN 'likely' ELSE 'certain' END AS confidence, 'error' AS severity FROM ({FILES}) WHERE key NOT IN (SELECT node FROM r)",
    "reach_closure": f"{REACH} SELECT node FROM r",
    "reach_depth": f"{DEPTH} SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node",
    "trace_path": f"{DEPTH} SELECT node, CAST(min(depth) AS INTEGER) AS depth, CAST(min(depth) + 1 AS INTEGER) AS steps, TRUE AS follows_edges FROM r GROUP BY node",
    "incoming_imports": f"{REACH} SELECT dst, count(*) AS importers, count(*) FILTER (WHERE src IN (SELECT node FROM r)) AS reachable FROM e GROUP BY dst",
    "used_modules": f"{REACH} SELECT l_partkey AS part, count(*) AS imports FROM lineitem WHERE l_orderkey IN (SELECT node FROM r) GROUP BY l_partkey",
    "lock_closure": f"{CLOSURE} SELECT distribution, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY distribution",
    "resolve_ladder": LADDER,
    "ambiguous_roots": "SELECT 'root' || CAST(k AS VARCHAR) AS import_root, 'venv-a' AS chosen, CAST(2 AS INTEGER) AS candidates FROM (SELECT DISTINCT p_partkey % 500 AS k FROM part) WHERE k % 7 = 0 AND k % 2 = 0",
    "longest_prefix_owner": f"""SELECT path, (SELECT max_by('n' || CAST(n_nationkey AS VARCHAR), length({MEMBER_AT}) * 1000 + CASE WHEN {MEMBER_AT} = 'src' THEN list_position(list_sort(['n' || CAST(i AS VARCHAR) FOR i IN range(0, 100)]), 'n' || CAST(n_nationkey AS VARCHAR)) ELSE 0 END)
  FROM nation WHERE path = {MEMBER_AT} OR starts_with(path, {MEMBER_AT} || '/')) AS member FROM ({FILES}) f""",
    "unused_dep": f"SELECT DISTINCT distribution, marker FROM ({DECLARED}) WHERE kind <> 'group' AND marker IS NULL AND distribution NOT IN (SELECT distribution FROM ({USED}) WHERE distribution NOT IN ('brand-9', 'brand-18', 'brand-21'))",
    "unused_dep_strict": f"SELECT DISTINCT distribution, kind, label, CASE WHEN marker IS NULL THEN 'certain' ELSE 'likely' END AS confidence FROM ({DECLARED}) WHERE distribution NOT IN (SELECT distribution FROM ({USED}) WHERE distribution NOT IN ('brand-9', 'brand-18', 'brand-21'))",
    "missing_dep": f"{CLOSURE} SELECT distribution, CASE WHEN optional OR platform_guarded THEN 'info' ELSE 'error' END AS severity, count(*) AS n FROM ({UNDECLARED}) WHERE distribution NOT IN (SELECT distribution FROM r) GROUP BY ALL",
    "transitive_dep": f"{CLOSURE} SELECT distribution, CASE WHEN optional OR platform_guarded THEN 'info' ELSE 'error' END AS severity, count(*) AS n FROM ({UNDECLARED}) WHERE distribution IN (SELECT distribution FROM r) GROUP BY ALL",
    "misplaced_dep": f"SELECT distribution, 'warning' AS severity FROM (SELECT distribution FROM ({DECLARED}) WHERE label <> 'small' AND kind <> 'runtime' GROUP BY distribution HAVING bool_and(kind = 'group')) WHERE distribution IN (SELECT distribution FROM ({USED}) WHERE context = 'runtime')",
    "unlisted_binary": f"""SELECT "binary", coalesce(d, "binary") AS distribution, min(doc_id) AS first_doc FROM (SELECT doc_id, 'tool-' || CAST(length(token) % 60 AS VARCHAR) AS "binary" FROM ({TOKENS}))
  LEFT JOIN (SELECT 'tool-' || CAST(n_nationkey AS VARCHAR) AS "binary", 'brand-' || CAST(n_nationkey + 1 AS VARCHAR) AS d FROM nation) USING ("binary")
  WHERE coalesce(d, "binary") NOT IN (SELECT distribution FROM ({DECLARED})) GROUP BY ALL""",
    "duplicate_dep": f"SELECT distribution, string_agg(DISTINCT CASE WHEN kind = 'runtime' THEN 'runtime' ELSE kind || ':' || label END, ',' ORDER BY CASE WHEN kind = 'runtime' THEN 'runtime' ELSE kind || ':' || label END) AS contexts FROM ({DECLARED}) GROUP BY distribution HAVING count(DISTINCT CASE WHEN kind = 'runtime' THEN 'runtime' ELSE kind || ':' || label END) > 1",
    "unused_export": """WITH s AS (SELECT p_partkey AS seq, 'm' || CAST(p_partkey // 2 AS VARCHAR) AS module, 'f' || CAST(p_size AS VARCHAR) AS name, p_size % 4 = 0 AS exported, p_size % 7 = 0 AS decorated FROM part WHERE p_partkey // 2 % 3 <> 0),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY seq) AS k FROM s WHERE NOT decorated) WHERE k = 1),
  refs AS (SELECT DISTINCT 'm' || CAST(l_partkey // 2 AS VARCHAR) AS module, 'f' || CAST(l_suppkey % 50 + 1 AS VARCHAR) AS name, 'm' || CAST(l_orderkey // 2 AS VARCHAR) AS importer FROM lineitem)
  SELECT module, name, CASE WHEN exported THEN 'certain' ELSE 'likely' END AS confidence, 'warning' AS severity FROM f
  WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.module = f.module AND refs.name = f.name AND refs.importer <> f.module) AND module <> 'm7'""",
    "unused_reexport": """WITH x AS (SELECT DISTINCT 'm' || CAST(p_partkey // 2 AS VARCHAR) AS package, CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || 'f' || CAST(p_size AS VARCHAR) AS name, p_size % 4 = 0 AS exported FROM part),
  refs AS (SELECT DISTINCT 'm' || CAST(l_partkey // 2 AS VARCHAR) AS package, 'f' || CAST(l_suppkey % 50 + 1 AS VARCHAR) AS name FROM lineitem)
  SELECT package, name, 'likely' AS confidence FROM x WHERE (exported OR name NOT LIKE '\\_%' ESCAPE '\\') AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.package = x.package AND refs.name = x.name)""",
    "unresolved_import": f"""{REACH}, l AS ({LADDER}), i AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_partkey % 500 % 2 = 0 THEN 'root' ELSE 'root_' END || CAST(l_partkey % 500 AS VARCHAR) AS import_root FROM lineitem)
  SELECT DISTINCT {path('k')} AS path, line, import_root FROM i JOIN l USING (import_root) WHERE origin = 'unknown' AND k IN (SELECT node FROM r)""",
    "severity_override": f"SELECT code, severity, count(*) AS n FROM (SELECT * REPLACE (CASE code WHEN 'TL004' THEN 'info' ELSE severity END AS severity) FROM ({CANDIDATES}) WHERE code <> 'TL007') GROUP BY ALL",
    "ignore_filter": f"SELECT code, coalesce(disposition, 'reported') AS disposition, count(*) AS n FROM ({EMITTED}) GROUP BY ALL",
    "confidence_floor": f"SELECT code, confidence, count(*) AS n FROM ({CANDIDATES}) WHERE {CONF} >= 1 GROUP BY ALL",
    "include_exclude": f"SELECT code, count(*) AS n FROM ({CANDIDATES}) WHERE code IN ('TL001', 'TL003', 'TL008') AND code <> 'TL003' GROUP BY ALL",
    "fingerprints": f"SELECT code || ':' || {TARGET} AS fingerprint, count(*) AS n FROM ({CANDIDATES}) GROUP BY ALL",
    "sort_keys": f"SELECT CASE kind WHEN 'file' THEN path WHEN 'symbol' THEN module || ':' || name WHEN 'import' THEN path || ':' || CAST(line AS VARCHAR) || ':' || module ELSE name END AS sort_key, count(*) AS n FROM ({CANDIDATES}) GROUP BY ALL",
    "baseline_diff": f"SELECT coalesce(disposition, CASE WHEN code || ':' || target IN (SELECT code || ':' || {TARGET} FROM ({CANDIDATES}) WHERE l_orderkey % 3 = 0) THEN 'baseline' ELSE 'reported' END) AS disposition, count(*) AS n FROM ({EMITTED}) GROUP BY ALL",
    "summary_by_rule": f"SELECT code, count(*) AS n FROM ({EMITTED}) WHERE disposition IS NULL GROUP BY ROLLUP (code)",
    "exit_status": f"SELECT bool_or({SEV} >= 3 AND {CONF} >= 1) AS failed, bool_or({SEV} >= 2) AS failed_strict FROM ({EMITTED}) WHERE disposition IS NULL",
    "fix_plan": f"""WITH d AS (SELECT *, CASE kind WHEN 'runtime' THEN 0 WHEN 'optional' THEN 1 ELSE 2 END AS pr FROM ({DECLARED})),
  decl AS (SELECT distribution AS name, count(*) AS declared, max_by(label, CAST(pr AS VARCHAR) || label) AS label, count(*) FILTER (WHERE kind IN ('runtime', 'optional')) AS lasting, count(*) FILTER (WHERE kind = 'group') AS groups FROM d GROUP BY distribution),
  f AS (SELECT ['TL001', 'TL002', 'TL005', 'TL009'][n_nationkey % 4 + 1] AS code, 'brand-' || CAST(n_nationkey + 1 AS VARCHAR) AS name, CASE WHEN n_regionkey = 2 THEN 'likely' ELSE 'certain' END AS confidence FROM nation),
  j AS (SELECT f.*, coalesce(declared, 0) AS n, label, lasting, groups FROM f LEFT JOIN decl USING (name)),
  a AS (SELECT *, CASE WHEN confidence <> 'certain' THEN NULL WHEN code = 'TL002' AND n > 0 THEN 'remove_dependency' WHEN code = 'TL009' AND n >= 2 THEN 'remove_duplicate' WHEN code = 'TL005' AND lasting = 0 AND groups = 1 THEN 'move_to_runtime' END AS action FROM j)
  SELECT code, name, action, CASE WHEN action IS NOT NULL THEN label END AS label, CASE WHEN action IS NOT NULL THEN NULL WHEN code = 'TL001' THEN 'file_removal_denied' WHEN confidence <> 'certain' THEN 'not_fixable' WHEN code = 'TL002' THEN 'missing_origin' ELSE 'ambiguous' END AS reason FROM a""",
    "entry_merge": f"""SELECT path, max_by(symbol, seq) FILTER (WHERE symbol IS NOT NULL) AS symbol, CASE WHEN bool_or(context = 'runtime') THEN 'runtime' ELSE min_by(context, seq) END AS context, count(DISTINCT origin) AS origins FROM (
  SELECT {path('l_orderkey')} AS path, CASE WHEN l_partkey % 3 = 0 THEN 's' || CAST(l_partkey AS VARCHAR) END AS symbol, CASE l_linestatus WHEN 'O' THEN 'dev' ELSE CASE WHEN l_returnflag = 'R' THEN 'runtime' ELSE 'test' END END AS context,
  l_returnflag || l_linestatus AS origin, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem) GROUP BY path""",
    "module_index": "SELECT module, min(path) AS path FROM (SELECT 'src/pkg' || CAST(o_custkey % 50 AS VARCHAR) || '/m_' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path, 'pkg' || CAST(o_custkey % 50 AS VARCHAR) || '.m_' || CAST(o_custkey AS VARCHAR) AS module FROM orders) GROUP BY module",
    "module_paths": """WITH p AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'src/' WHEN o_orderkey % 3 = 1 THEN '' ELSE 'libs/x/src/' END || 'm_' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM orders),
  t AS (SELECT 'm_' || CAST(c_custkey AS VARCHAR) AS module FROM customer)
  SELECT module, coalesce((SELECT min_by(path, CASE path WHEN 'src/' || module || '.py' THEN 0 WHEN 'src/' || module || '/__init__.py' THEN 1 WHEN module || '.py' THEN 2 ELSE 3 END) FROM p WHERE path IN ('src/' || module || '.py', 'src/' || module || '/__init__.py', module || '.py', module || '/__init__.py')),
    (SELECT min(path) FROM p WHERE path IN ('libs/x/src/' || module || '.py', 'libs/x/src/' || module || '/__init__.py'))) AS path FROM t""",
    "origin_merge": "SELECT module, ['unknown', 'third_party', 'stdlib'][max(k) + 1] AS origin FROM (SELECT l_orderkey AS module, CASE WHEN l_suppkey % 10 = 0 THEN 2 WHEN l_suppkey % 10 < 6 THEN 1 ELSE 0 END AS k FROM lineitem) GROUP BY module",
    "binary_overlay": "SELECT 'bin' || CAST(p_partkey % 100 AS VARCHAR) AS \"binary\", max_by(p_brand, p_size % 3 * 1000000 + p_partkey) AS distribution FROM part GROUP BY ALL",
    "normalize_names": "SELECT lower(regexp_replace(replace(replace(p_brand, '#', '_.'), ' ', '-'), '[-_.]+', '-', 'g')) AS name, count(*) AS n FROM part GROUP BY ALL",
    "import_roots": "SELECT split_part(split_part(url, '://', 2), '.', 1) AS root, count(*) AS n FROM pages GROUP BY ALL",
    "path_context": """SELECT CASE WHEN starts_with(path, 'tests/') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '_test\\.py$') OR regexp_matches(path, '(^|/)conftest\\.py$') THEN 'test' WHEN starts_with(path, 'docs/') THEN 'docs' WHEN starts_with(path, 'scripts/') OR path = 'noxfile.py' THEN 'dev' ELSE 'runtime' END AS context, count(*) AS n
  FROM (SELECT ['tests/', 'src/', 'docs/', 'scripts/', 'pkg/tests/', ''][o_orderkey % 6 + 1] || ['a.py', 'test_b.py', 'c_test.py', 'conftest.py', 'noxfile.py', 'testx.py', 'main.py'][o_custkey % 7 + 1] AS path FROM orders) GROUP BY ALL""",
    "relative_imports": """SELECT module, count(*) AS n FROM (SELECT CASE WHEN base < 1 THEN NULL ELSE array_to_string(list_concat(parts[1:base], CASE WHEN l_suppkey % 3 = 0 THEN ['x'] WHEN l_suppkey % 3 = 1 THEN ['y'] ELSE [] END), '.') END AS module FROM (
  SELECT l_suppkey, ['a', 'b' || CAST(l_partkey % 9 AS VARCHAR), 'c', 'd'][1:l_orderkey % 4 + 1] AS parts, l_orderkey % 4 + 1 - CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END - (l_partkey % 3) AS base FROM lineitem)) GROUP BY ALL""",
    "config_tokens": f"SELECT token, count(*) AS n FROM ({TOKENS}) GROUP BY ALL",
    "workflow_binaries": "SELECT 'mod' || CAST(event_id % 40 AS VARCHAR) AS module, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL",
    "ini_sections": f"SELECT doc_id, section, count(*) AS n FROM (SELECT doc_id, coalesce(last_value(CASE WHEN regexp_matches(line, '^[A-ZÀ-Ü][a-z]+ ') THEN split_part(line, ' ', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM ({LINES})) GROUP BY ALL",
    "ignore_directives": f"SELECT file_level, code, count(*) AS n FROM (SELECT k % 2 = 0 AS file_level, unnest(CASE WHEN k % 3 = 0 THEN ['TL00' || CAST(k % 9 + 1 AS VARCHAR), 'TL010'] ELSE ['TL00' || CAST(k % 9 + 1 AS VARCHAR)] END) AS code FROM (SELECT doc_id + n - 1 AS k FROM ({LINES})) WHERE k % 5 <> 0) GROUP BY ALL",
    "glob_filter": f"SELECT count(*) FILTER (WHERE regexp_matches(path, '^src/.*1\\.py$')) AS crossing, count(*) FILTER (WHERE regexp_matches(path, '^src/pkg(7|8)/')) AS braces, count(*) FILTER (WHERE regexp_matches(path, 'm_[0-4][^/]\\.py$')) AS classes FROM ({FILES})",
    "probe_counts": f"SELECT context, opaque, count(*) AS n FROM ({FILES}) GROUP BY GROUPING SETS ((context), (opaque))",
    "false_positive_rate": f"SELECT code, count(*) AS labelled, count(*) FILTER (WHERE severity = 'info') AS false_positives, CAST(count(*) FILTER (WHERE severity = 'info') * 1000 // count(*) AS BIGINT) AS permille FROM ({CANDIDATES}) GROUP BY code",
    "parse_cache": "SELECT state, count(*) AS n, count(DISTINCT h) AS contents FROM (SELECT md5(text) AS h, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) THEN 'hit' ELSE 'miss' END AS state FROM documents) GROUP BY ALL",
    "corpus_findings": f"""WITH {TREE} SELECT 'TL001' AS code, 'error' AS severity, 'certain' AS confidence, count(*) AS n FROM lost HAVING count(*) > 0
  UNION ALL SELECT 'TL002', 'error', 'certain', count(*) FROM dep WHERE NOT EXISTS (SELECT 1 FROM use WHERE use.c = dep.c AND use.n = dep.n)
  UNION ALL SELECT 'TL003', 'error', 'certain', count(*) FROM use WHERE live AND NOT EXISTS (SELECT 1 FROM dep WHERE use.c = dep.c AND use.n = dep.n)
  UNION ALL SELECT 'TL006', 'warning', 'likely', count(*) FROM o WHERE live AND r > 1""",
    "corpus_unused_files": f"WITH {TREE} SELECT 'c' || CAST(c AS VARCHAR) AS project, path, 'error' AS severity FROM lost UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'src/c' || CAST(c_custkey AS VARCHAR) || '/broken.py', 'warning' FROM customer WHERE FALSE",
    "corpus_strict_missing": f"""WITH {TREE} SELECT 'c' || CAST(c AS VARCHAR) AS project, {AT.format('k')} AS path, 'dep_' || CAST(n AS VARCHAR) AS module, CAST(line AS INTEGER) AS line,
  'imported but not declared: dep-' || CAST(n AS VARCHAR) || ' (no lockfile)' AS message FROM use WHERE live AND NOT EXISTS (SELECT 1 FROM dep WHERE use.c = dep.c AND use.n = dep.n)""",
    "corpus_reach": f"WITH {TREE} SELECT 'c' || CAST(c AS VARCHAR) AS project, {AT.format('k')} AS node, CAST(r - 1 AS INTEGER) AS depth, CASE WHEN r > 1 THEN {AT.format('prev')} END AS pred FROM o WHERE live",
    "corpus_facts": f"""WITH {TREE}, c AS (SELECT c_custkey AS c, (SELECT count(*) FROM o WHERE o.c = c_custkey) AS n FROM customer),
  f AS (SELECT c, 'project' AS fact, 1 AS n FROM c UNION ALL SELECT c, 'file', n + 2 + CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END FROM c UNION ALL SELECT c, 'declared', 2 FROM c UNION ALL SELECT c, 'hinted', 1 FROM c
    UNION ALL SELECT c, 'own', 2 FROM c UNION ALL SELECT c, 'point', 1 FROM c WHERE n > 0)
  SELECT 'c' || CAST(c AS VARCHAR) AS project, fact, CAST(n AS BIGINT) AS n FROM f""",
    "corpus_declared": f"WITH {TREE} SELECT 'c' || CAST(c AS VARCHAR) AS project, 'dep-' || CAST(n AS VARCHAR) AS distribution, 'runtime' AS kind, 'pyproject.toml' AS file, 'project.dependencies' AS place FROM dep",
    "corpus_imports": f"""WITH {TREE} SELECT module, CAST(line AS INTEGER) AS line, 'runtime' AS context, count(*) AS n FROM (SELECT 'dep_' || CAST(n AS VARCHAR) AS module, line FROM use
  UNION ALL SELECT {MODULE.format('nxt')}, 1 FROM o WHERE k % 4 <> 0 AND nxt IS NOT NULL) GROUP BY ALL""",
    "corpus_symbols": f"""WITH {TREE} SELECT 'c' || CAST(c AS VARCHAR) AS project, {MODULE.format('k')} AS module, 'main' AS name,
  CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = k) + 1 + CASE WHEN k % 4 <> 0 AND nxt IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS line FROM o""",
    "parse_counters": f"WITH {TREE}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 5 = 0) AS bad FROM customer) SELECT (SELECT count(*) FROM o) + n + bad AS parsed, bad AS errors, n AS skipped FROM c",
    "parse_cache_runs": f"""WITH {TREE}, c AS (SELECT (SELECT count(*) FROM o) + count(*) + count(*) FILTER (WHERE c_custkey % 5 = 0) AS n FROM customer)
  SELECT CAST(0 AS INTEGER) AS run, n AS parsed, n AS fresh, CAST(0 AS BIGINT) AS cached FROM c UNION ALL SELECT 1, n, 0, n FROM c""",
    "issue_ordinals": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem",
    "pattern_ignores": f"""WITH p AS (SELECT 'TL' || lpad(CAST(n_nationkey % 10 + 1 AS VARCHAR), 3, '0') AS code, '^src/pkg' || CAST(n_nationkey * 2 AS VARCHAR) || '/.*' || CAST(n_nationkey % 4 AS VARCHAR) || '\\.py$' AS x FROM nation)
  SELECT code, EXISTS (SELECT 1 FROM p WHERE p.code = c.code AND (regexp_matches(c.path, x) OR coalesce(regexp_matches(c.module, x), FALSE))) AS by_pattern, count(*) AS n FROM ({CANDIDATES}) c WHERE kind IN ('file', 'import') GROUP BY ALL""",
}
