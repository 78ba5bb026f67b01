"""The flagship: all generators of isolated issues over stand-ins for a repository's summary. The twin is written by itself,
with theta joins, subqueries and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import issues
from sparkloom.plans.catalog import sql_frame
from sparkloom.plans.graphs import _GRAPH, _links, _nodes
from sparkloom.plans.registry import query
from sparkloom.session import ready

_CATALOG = [(1, "small ring", ["11", "^2"], "critical"), (2, "blue bolt", ["~1"], "high"), (3, "hot gear", ["x", "all"], "medium"), (4, "nowhere", ["*"], "critical"), (5, "red widget", [], "low")]

_PATH = "concat(lower(p_type), '/', lower(p_brand), '/', replace(p_name, ' ', '_'), '_', p_partkey, '.ts')"
_FILES = f"SELECT p_partkey AS ord, {_PATH} AS path, lower(p_brand) AS module, p_size * 2 AS complexity, p_partkey % 100 AS symbols FROM part UNION ALL SELECT 1000000000 + s_suppkey, concat(lower(n_name), '/', s_name), lower(n_name), s_suppkey % 100 + 1, s_suppkey % 50 FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_MODULES = """SELECT CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 'services' WHEN p_type = 'SMALL' AND p_size <= 25 THEN 'tests' WHEN p_type = 'SMALL' THEN 'docs-site' WHEN p_type = 'MEDIUM' THEN 'components' WHEN p_type = 'ECONOMY' THEN 'Shared' ELSE 'mailQueue' END AS name, count(*) AS files, min(p_partkey) AS ord FROM part GROUP BY 1"""
#: Entry points by a supplier's bare name, a part's path with slashes behind it, nothing known, a file's bare name, a node's id.
_ENTRIES = f"""SELECT n_nationkey AS ord, CASE n_nationkey % 5 WHEN 0 THEN 'nowhere.ts' WHEN 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = n_nationkey) WHEN 2 THEN concat((SELECT {_PATH} FROM part WHERE p_partkey = n_nationkey), '//')
WHEN 3 THEN (SELECT concat(replace(p_name, ' ', '_'), '_', p_partkey, '.ts') FROM part WHERE p_partkey = n_nationkey) ELSE concat('src/', lower(n_name)) END AS entry FROM nation"""
_CYCLES = """SELECT n_nationkey AS cycle, n_name AS a, lead(n_name) OVER (ORDER BY n_nationkey) AS b, lead(n_name, 2) OVER (ORDER BY n_nationkey) AS c FROM nation UNION ALL SELECT 1000 + s_suppkey, s_name, concat('x', s_name), CAST(NULL AS VARCHAR(9)) FROM supplier"""
_PACKAGES = f"""SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('@', p_brand, '/', p_name) END AS name, p_name AS bare, concat(p_size, '.', p_partkey % 10, '.0') AS version,
CASE p_partkey % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(99)) WHEN 1 THEN '  ' ELSE {_PATH} END AS source_file, CASE p_partkey % 5 WHEN 0 THEN 'NPM' WHEN 1 THEN 'pypi.org' WHEN 2 THEN 'golang' WHEN 3 THEN 'rust' ELSE 'other' END AS ecosystem FROM part"""
_READINESS = "SELECT r_regionkey AS ord, 'blocker' AS kind, concat('no set-up for ', r_name, ' and whatever else a new contributor may need there') AS text FROM region UNION ALL SELECT n_nationkey, 'warning', n_name FROM nation"
_SCORE = "SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 0.0 END) / count(*) AS score FROM orders"

_TWIN = f"""WITH {_GRAPH}, h AS ({_FILES}), m AS ({_MODULES}), p AS ({_PACKAGES}), score AS ({_SCORE}), e0 AS ({_ENTRIES}), e AS (SELECT ord, entry, regexp_replace(entry, '/+$', '') AS en FROM e0),
cat(entry, package, versions, severity) AS (VALUES {", ".join(f"({i}, '{n}', {v}::VARCHAR[], '{s}')" for i, n, v, s in _CATALOG)}),
hit AS (SELECT e.ord AS k, 0 AS stage, 0.0 AS score, n.ord AS o, id FROM e JOIN n ON id = en QUALIFY count(*) OVER (PARTITION BY e.ord) = 1 UNION ALL SELECT e.ord, 1, importance, n.ord, id FROM e JOIN n ON ends_with(id, '/' || en)
UNION ALL SELECT e.ord, 2, 0, h.ord, path FROM e JOIN h ON path = en QUALIFY count(*) OVER (PARTITION BY e.ord) = 1 UNION ALL SELECT e.ord, 3, complexity, h.ord, path FROM e JOIN h ON ends_with(path, '/' || en)
UNION ALL SELECT e.ord, 4, importance, n.ord, id FROM e JOIN n ON NOT contains(en, '/') AND regexp_extract(id, '[^/]*$') = en UNION ALL SELECT e.ord, 5, complexity, h.ord, path FROM e JOIN h ON NOT contains(en, '/') AND regexp_extract(path, '[^/]*$') = en),
res AS (SELECT e.ord, e.entry, coalesce(id, entry) AS resolved, id IS NOT NULL AS known FROM e LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY k ORDER BY stage, score DESC, o) = 1) x ON x.k = e.ord),
g1 AS (SELECT DISTINCT entry * 1099511627776 + p.ord AS ord, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS tier, CASE WHEN severity = 'critical' THEN 'Remove or upgrade ' ELSE 'Audit ' END || name || '@' || version AS title,
[CASE WHEN trim(coalesce(source_file, '')) <> '' THEN source_file ELSE CASE ecosystem WHEN 'pypi.org' THEN 'requirements.txt' WHEN 'golang' THEN 'go.mod' WHEN 'rust' THEN 'Cargo.toml' ELSE 'package.json' END END] AS paths
FROM cat JOIN p ON (name = package OR bare = package) AND (len(versions) = 0 OR list_has_any(versions, ['*', 'all']) OR len(list_filter(versions, lambda v: starts_with(version, ltrim(v[1], '^~') || v[2:]))) > 0)),
c0 AS ({_CYCLES}), c AS (SELECT cycle, list_filter([a, b, c], lambda x: x IS NOT NULL) AS seg FROM c0), s AS (SELECT cycle, i - 1 AS i, seg[i] AS seg, seg[i % len(seg) + 1] AS nxt, len(seg) > 1 AS two FROM c, range(1, 4) t(i) WHERE i <= len(seg)),
one AS (SELECT cycle, id AS path, min(ord)::HUGEINT AS x FROM s JOIN n ON id = seg OR ends_with(id, '/' || seg) GROUP BY cycle, id),
lm AS (SELECT l.src, l.dst, l.ord, f.module AS fm, t.module AS tm FROM l JOIN n f ON f.id = l.src JOIN n t ON t.id = l.dst),
two AS (SELECT cycle, i, ord, src, dst FROM s JOIN lm ON fm = seg AND tm = nxt WHERE two AND cycle NOT IN (SELECT cycle FROM one)),
twos AS (SELECT cycle, path, min(i * 4e18::HUGEINT + ord * 2 + z) AS x FROM (SELECT cycle, i, ord, src AS path, 0 AS z FROM two UNION ALL SELECT cycle, i, ord, dst, 1 FROM two) GROUP BY cycle, path),
three AS (SELECT cycle, (SELECT id FROM n WHERE module = seg ORDER BY importance DESC, ord LIMIT 1) AS path, i::HUGEINT AS x FROM s WHERE cycle NOT IN (SELECT cycle FROM one UNION ALL SELECT cycle FROM twos)),
cp AS (SELECT cycle, list(path ORDER BY importance DESC, x)[:3] AS paths FROM (SELECT * FROM one UNION ALL SELECT * FROM twos UNION ALL SELECT cycle, path, min(x) FROM three WHERE path IS NOT NULL GROUP BY cycle, path) y JOIN n ON id = path GROUP BY cycle),
g2 AS (SELECT c.cycle AS ord, 0 AS tier, 'Break cycle ' || array_to_string(seg, ' > ') AS title, coalesce(paths, []) AS paths, seg FROM c LEFT JOIN cp ON cp.cycle = c.cycle),
g3 AS (SELECT row_number() OVER (ORDER BY complexity DESC, h.ord) AS ord, CASE WHEN complexity > 60 THEN 1 ELSE 2 END AS tier, 'Refactor ' || regexp_extract(path, '[^/]*$') || ', complexity ' || complexity AS title, [path] AS paths, [module] AS mods FROM h WHERE complexity > 45 QUALIFY row_number() OVER (ORDER BY complexity DESC, h.ord) <= 5),
taken AS (SELECT unnest(paths) AS path FROM g1 UNION ALL SELECT unnest(paths) FROM g2 UNION ALL SELECT unnest(paths) FROM g3),
g4 AS (SELECT ord, path, module FROM (SELECT * FROM h ORDER BY ord LIMIT 20) f WHERE path NOT IN (SELECT path FROM taken) AND NOT EXISTS (SELECT 1 FROM l WHERE dst = f.path) AND NOT EXISTS (SELECT 1 FROM res WHERE resolved = f.path OR regexp_extract(entry, '[^/]*$') = regexp_extract(f.path, '[^/]*$')) ORDER BY ord LIMIT 5),
lead_ AS (SELECT list(path ORDER BY ord) AS l FROM (SELECT * FROM h ORDER BY ord LIMIT 3)), own AS (SELECT list(resolved ORDER BY ord) FILTER (known) AS l FROM (SELECT * FROM res ORDER BY ord LIMIT 3)), about AS (SELECT coalesce((SELECT l FROM own), (SELECT l FROM lead_)) AS l),
mk AS (SELECT count(*) AS n, sum(files) AS files, sum(files) FILTER (regexp_matches(name, '^(?i)(tests?|specs?|__tests__)')) AS tests, sum(files) FILTER (NOT regexp_matches(name, '^(?i)(tests?|specs?|__tests__|node_modules|dist|build|[.])')) AS src,
arg_min(name, ord) FILTER (regexp_matches(name, '^(?i)(component|page|view|ui|frontend)')) AS ui, arg_min(name, ord) FILTER (regexp_matches(name, '^(?i)(api|service|hook|data|backend|server)')) AS dt, list(name ORDER BY ord)[:3] AS firsts,
(CASE WHEN bool_or(regexp_full_match(name, '[a-z]+(-[a-z]+)+')) THEN 1 ELSE 0 END + CASE WHEN bool_or(regexp_matches(name, '^[a-z]+[A-Z]')) THEN 1 ELSE 0 END + CASE WHEN bool_or(name[1] BETWEEN 'A' AND 'Z') THEN 1 ELSE 0 END) AS styles FROM m),
z AS (SELECT count(*) AS nodes, (SELECT count(*) FROM l) AS edges FROM n), fan AS (SELECT list(src ORDER BY c DESC, o)[:3] AS f FROM (SELECT src, count(*) AS c, min(ord) AS o FROM l GROUP BY src) y),
i AS (SELECT 1 AS gen, ord, tier, 'security' AS category, 0 AS rank, title, paths, []::VARCHAR[] AS mods FROM g1
UNION ALL SELECT 2, ord, tier, 'critical_path', 1, title, paths, seg FROM g2 UNION ALL SELECT 3, ord, tier, 'complexity', 8, title, paths, mods FROM g3
UNION ALL SELECT 4, ord, 1, 'dead_code', 2, 'Remove or confirm ' || regexp_extract(path, '[^/]*$'), [path], [module] FROM g4
UNION ALL SELECT 5, ord, 2, 'coupling', 4, 'Take one seam out of ' || name, [], [name] FROM m, mk WHERE mk.n > 1 AND m.files > 0.3 * mk.files
UNION ALL SELECT 6, ord, 1, 'documentation', 9, 'Setup blocker: ' || text[:60] || CASE WHEN length(text) > 60 THEN '…' ELSE '' END, ['README.md'], [] FROM ({_READINESS}) y WHERE kind = 'blocker'
UNION ALL SELECT 6, 1099511627776 + ord, 2, 'structure', 6, 'Setup warning: ' || text, ['README.md'], [] FROM ({_READINESS}) y WHERE kind = 'warning'
UNION ALL SELECT 7, 0, 2, 'layer_violation', 5, 'Look for imports of data from the interface', [], [ui, dt] FROM mk WHERE n >= 3 AND ui IS NOT NULL AND dt IS NOT NULL
UNION ALL SELECT 8, ord, 4, 'structure', 6, 'Split ' || name, [], [name] FROM m WHERE files > 20
UNION ALL SELECT 9, 0, 3, 'test_coverage', 3, CASE WHEN coalesce(tests, 0) = 0 THEN 'Add tests' ELSE 'Add more tests' END, l, [] FROM mk, about WHERE (src > 10 AND coalesce(tests, 0) = 0) OR (tests > 0 AND tests * 5 < src)
UNION ALL SELECT 10, ord, 3, 'documentation', 9, 'Document ' || regexp_extract(resolved, '[^/]*$'), [resolved], [] FROM (SELECT * FROM res WHERE known AND (SELECT sum(symbols) FROM h) > 50 ORDER BY ord LIMIT 2) y
UNION ALL SELECT 11, 0, 4, 'performance', 7, 'Look at imports: ' || printf('%.1f', edges / nodes) || ' a file', f, [] FROM z, fan WHERE edges > 5 * nodes
UNION ALL SELECT 12, 0, 5, 'naming', 10, 'Settle on one of ' || styles || ' naming styles', [], firsts FROM mk WHERE n > 2 AND styles >= 2
UNION ALL SELECT 13, 0, 5, 'style', 11, 'Write guidelines', ['CONTRIBUTING.md', 'README.md'], [] FROM mk, z WHERE n > 2 AND nodes > 15
UNION ALL SELECT 14, 0, CASE WHEN score < 40 THEN 1 ELSE 2 END, 'test_coverage', 3, 'Raise the mutation score of ' || CAST(round(score) AS INT), l, [] FROM score, about WHERE score < 60),
"""


def _twin() -> str:
    """The modules of an issue's files in the order of the files, each once."""
    own = """q AS (SELECT gen, ord, title, list(module ORDER BY jj) AS own FROM (SELECT gen, ord, title, module, min(j) AS jj FROM (SELECT gen, ord, title, unnest(paths) AS path, generate_subscripts(paths, 1) AS j FROM i WHERE gen IN (1, 2, 10, 11)) a
JOIN (SELECT path, arg_min(module, ord) AS module FROM h GROUP BY path) b ON a.path = b.path GROUP BY gen, ord, title, module) x GROUP BY gen, ord, title)"""
    return f"""{_TWIN}{own}
SELECT row_number() OVER (ORDER BY tier, rank, i.gen, i.ord, i.title) AS position, 'P' || tier AS tier, category, i.gen, i.title, array_to_string(paths, '|') AS paths, array_to_string(coalesce(own[:3], CASE WHEN i.gen = 2 THEN mods[:3] ELSE mods END), '|') AS modules
FROM i LEFT JOIN q ON q.gen = i.gen AND q.ord = i.ord AND q.title = i.title"""


def _entries(spark, d):
    """_ENTRIES, with suppliers and parts cut down to the few nations' before they are looked up: look-ups as subqueries send
    the looked-up table to all tasks."""
    read = lambda text: sql_frame(spark, d, text)
    nations = read("SELECT n_nationkey AS ord, n_name FROM nation")
    few = F.broadcast(nations.select("ord"))
    suppliers = read("SELECT s_suppkey AS ord, s_name FROM supplier").join(few, "ord", "left_semi")
    parts = read(f"SELECT p_partkey AS ord, {_PATH} AS path, concat(replace(p_name, ' ', '_'), '_', p_partkey, '.ts') AS file FROM part").join(few, "ord", "left_semi")
    entry = "CASE ord % 5 WHEN 0 THEN 'nowhere.ts' WHEN 1 THEN s_name WHEN 2 THEN concat(coalesce(path, ''), '//') WHEN 3 THEN file ELSE concat('src/', lower(n_name)) END AS entry"
    return nations.join(suppliers, "ord", "left").join(parts, "ord", "left").selectExpr("ord", entry)


def review(spark, d) -> issues.Review:
    ready(spark)
    cycles = sql_frame(spark, d, _CYCLES).select("cycle", F.array_compact(F.array("a", "b", "c")).alias("segments"))
    catalog = spark.createDataFrame(_CATALOG, "entry int, package string, versions array<string>, severity string")
    read = lambda text: sql_frame(spark, d, text)
    return issues.Review(read(_PACKAGES), catalog, cycles, read(_FILES), _nodes(spark, d), _links(spark, d), read(_MODULES), _entries(spark, d), read(_READINESS), read(_SCORE))


@query("flagship_issues", _twin())
def _flagship(spark, d):
    out = issues.isolated(review(spark, d))
    text = lambda c: F.array_join(c, "|").alias(c)
    return out.select("position", "tier", "category", "gen", "title", text("paths"), text("modules"))


@query("agg_issue_generators", f"SELECT gen, count(*) AS n, min(position) AS first FROM ({_twin()}) t GROUP BY gen")
def _generators(spark, d):
    """How many issues each generator gives, and where its first one stands."""
    return _flagship(spark, d).groupBy("gen").agg(F.count("*").alias("n"), F.min("position").alias("first"))
