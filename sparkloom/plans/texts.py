"""Queries on readers, scalars and joins of work items, over texts put together from the tables; each twin says in plain SQL
what must come out of the texts' known parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import events as event_texts
from sparkloom.functions import scalars, text
from sparkloom.operators import lifecycle, matching
from sparkloom.operators.ranges import width
from sparkloom.plans.records import rows
from sparkloom.plans.registry import query
from sparkloom.session import ready, table
from sparkloom.sources import manifests, sinks
from sparkloom.streaming import state

# -- readers -----------------------------------------------------------------------------------------------------


@query("src_manifests", """SELECT 'm/' || o_orderkey || '/package.json' AS source_file, CASE WHEN o_orderkey % 3 = 0 THEN '@acme/' ELSE '' END || 'p' || o_custkey AS name, o_orderkey % 9 || '.' || o_custkey % 7 || '.0' AS version FROM orders WHERE o_orderkey % 5 > 0
UNION ALL SELECT 'm/' || o_orderkey || '/package.json', 'dev' || o_custkey, '1.0.' || o_orderkey % 4 FROM orders WHERE o_orderkey % 5 > 0""")
def _manifests(spark, d):
    """A manifest for each order: a dependency, one for development, one of the workspace, and every fifth broken off."""
    content = """concat('{"name":"x","dependencies":{"', CASE WHEN o_orderkey % 3 = 0 THEN '@acme/' ELSE '' END, 'p', o_custkey, '":"', CASE o_orderkey % 4 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' ELSE '' END, o_orderkey % 9, '.', o_custkey % 7, '.0"},
"devDependencies":{"dev', o_custkey, '":">=0.9.0 <2 1.0.', o_orderkey % 4, '","own":"workspace:*"}', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '}' END)"""
    files = rows(spark, d, "orders", "concat('m/', o_orderkey, '/package.json') path", f"{content} content")
    return manifests.packages(files).select("source_file", "name", "version")


@query("src_npm_locks", "SELECT 'l/' || o_orderkey || '/package.json' AS source_file, 'p' || o_custkey AS name, '2.' || o_orderkey % 6 || '.1' AS version FROM orders WHERE o_orderkey % 4 <> 1")
def _npm_locks(spark, d):
    content = """concat('{"lockfileVersion":1,"dependencies":{"p', o_custkey, '":{"version":"', CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE concat('2.', o_orderkey % 6, '.1') END, '","dev":true},"none":{}}}')"""
    return manifests.npm_locks(rows(spark, d, "orders", "concat('l/', o_orderkey, '/package-lock.json') path", f"{content} content"))


@query("src_yarn_locks", "SELECT '@s/p' || c_custkey AS name, '3.' || c_custkey % 11 || '.0' AS version FROM customer WHERE c_custkey % 3 = 1")
def _yarn_locks(spark, d):
    """A header of two ranges, and its version four or more lines below it: the fifth line is too far."""
    content = """concat('# yarn\\n"@s/p', c_custkey, '@^1", "@s/p', c_custkey, '@2":\\n\\n"@s/p', c_custkey, '@npm:3":\\n', repeat('  x "y"\\n', CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_custkey % 3 END), '  version "3.', c_custkey % 11, '.0"\\n')"""
    return manifests.yarn_locks(rows(spark, d, "customer", "concat(c_custkey, '/yarn.lock') path", f"{content} content"))


@query("src_scanned_findings", """SELECT o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS severity, 'p' || o_custkey AS package_name, CASE WHEN o_orderkey % 6 = 0 THEN 'exposed' ELSE 'package_exposure' END AS finding_type, CASE WHEN o_orderkey % 7 = 0 THEN 'n' || o_custkey ELSE 'p' || o_custkey END AS normalized_name
FROM orders WHERE o_orderkey % 5 NOT IN (0, 1)""")
def _scanned_findings(spark, d):
    """Lines of a scanner: findings, packages, broken ones; what is missing or empty has its default."""
    value = """CASE o_orderkey % 5 WHEN 0 THEN '{"record_type":"package"}' WHEN 1 THEN concat('{"record_type":"finding",', o_orderkey) ELSE concat('{"record_type":"finding","record_id":"', o_orderkey, '","package_name":"p', o_custkey, '","severity":"', CASE WHEN o_orderkey % 4 = 0 THEN 'high' ELSE '' END, '"',
CASE WHEN o_orderkey % 6 = 0 THEN ',"finding_type":"exposed"' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN concat(',"normalized_name":"n', o_custkey, '"') ELSE '' END, '}') END"""
    return manifests.scanned_findings(rows(spark, d, "orders", "o_orderkey ord", f"{value} value")).select("ord", "severity", "package_name", "finding_type", "normalized_name")


@query("src_chat_streams", """SELECT l_orderkey AS stream, string_agg('w' || l_partkey || ' ', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS content, CASE WHEN l_orderkey % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey ELSE 0 END AS total_tokens FROM lineitem GROUP BY l_orderkey""")
def _chat_streams(spark, d):
    """The lines of an order as what a chat sends piece by piece, between lines that say nothing."""
    # a number for each key: put together in one number, large keys would reach into the next one's place
    at = lambda kind, *keys: f"struct({kind} kind, " + ", ".join(f"isnull({k}) no{i}, cast({k} as bigint) k{i}" for i, k in enumerate(keys)) + ") ord"
    none = ["cast(null as bigint)"] * 3
    parts = rows(spark, d, "lineitem", "l_orderkey stream", at(0, "l_linenumber", "l_partkey", "l_suppkey"), """concat('data: {"choices":[{"delta":{"content":"w', l_partkey, ' "}}]}') value""")
    orders = parts.select("stream").distinct()  # those that have lines, whether the table of orders knows them or not
    ends = orders.where("stream % 3 = 0").selectExpr("stream", at(1, *none), """concat('data: {"choices":[{"delta":{},"finish_reason":"length"}],"usage":{"total_tokens":', stream, '}}') value""")
    noise = orders.selectExpr("stream", at(2, *none), "'data: {broken' value").unionByName(orders.selectExpr("stream", at(3, *none), "'data: [DONE]' value"))
    got = manifests.chat_stream(parts.unionByName(ends).unionByName(noise))
    return got.select("stream", "content", "finish_reason", F.col("usage.total_tokens").alias("total_tokens"))


@query("src_listing", "SELECT c_nationkey AS scope, c_custkey AS ord FROM customer WHERE c_custkey % 7 > 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 40")
def _listing(spark, d):
    path = "concat(CASE c_custkey % 7 WHEN 0 THEN '.github/' WHEN 1 THEN 'a/node_modules/' WHEN 2 THEN 'a/b/c/d/e/' WHEN 3 THEN 'a/b/c/d/' ELSE '' END, c_name)"
    return manifests.listing(rows(spark, d, "customer", "c_nationkey scope", "c_custkey ord", f"{path} path"), 4, 40).select("scope", "ord")


@query("src_catalog_entries", "SELECT s_suppkey AS catalog, i AS ord, 'E' || i AS id, 'p' || s_nationkey AS package, s_suppkey % 3 + 1 AS n_versions FROM supplier, range(2) t(i) WHERE s_suppkey % 4 > 0")
def _catalog_entries(spark, d):
    value = """concat('{', CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '"schema_version":"1",' END, '"entries":[', array_join(transform(sequence(0, 1), i -> concat('{"id":"E', i, '","package":"p', s_nationkey, '","versions":[', array_join(array_repeat('"1"', cast(s_suppkey % 3 + 1 as int)), ','), ']}')), ','), ']}')"""
    got = manifests.catalog_entries(rows(spark, d, "supplier", "s_suppkey catalog", f"{value} value"))
    return got.select("catalog", F.col("ord").cast("long").alias("ord"), "id", "package", F.size("versions").cast("long").alias("n_versions"))


# -- scalars -----------------------------------------------------------------------------------------------------


@query("str_issue_id", r"""SELECT p_partkey, 'package-' || CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END || '-' || regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') || '-' || regexp_replace(p_size || '.0 beta', '[^A-Za-z0-9_-]', '_', 'g') || '-' || CASE p_partkey % 3 WHEN 0 THEN 'C_' || p_partkey WHEN 1 THEN 'exposed' ELSE 'finding' END || '-f' || p_partkey AS id FROM part""")
def _issue_id(spark, d):
    of = "CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END s", "concat(p_size, '.0 beta') v", "CASE p_partkey % 3 WHEN 0 THEN concat('C ', p_partkey) WHEN 1 THEN '' END c", "CASE WHEN p_partkey % 3 = 1 THEN 'exposed' ELSE '' END t", "concat('f', p_partkey) f"
    return rows(spark, d, "part", "p_partkey", "p_name", *of).select("p_partkey", scalars.issue_id(*[F.col(c) for c in ("s", "p_name", "v", "c", "t", "f")]).alias("id"))


@query("str_brief", r"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '# Plan' || chr(10) || 'do ' || o_custkey WHEN 1 THEN '## A' || chr(10) || 'x' ELSE 'do ' || o_custkey END AS brief FROM orders""")
def _brief(spark, d):
    """Answers with thoughts, fences, and talk before the first heading or the text."""
    answer = r"""CASE o_orderkey % 5 WHEN 0 THEN concat('<think>hm\n# no</think>\nSome talk.\n# Plan\ndo ', o_custkey, '\n') WHEN 1 THEN '```markdown\n## A\nx\n```' WHEN 2 THEN concat('Sure, here you go:\n\ndo ', o_custkey) WHEN 3 THEN concat('Refined mission brief:\ndo ', o_custkey, '  ') ELSE concat('  do ', o_custkey) END"""
    return rows(spark, d, "orders", "o_orderkey", f"{answer} a").select("o_orderkey", scalars.brief(F.col("a")).alias("brief"))


@query("str_closed_json", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"a":[1,{"b":"' || event_type || '"}]}' WHEN 1 THEN '{"a":"x' || user_id || '"}' WHEN 2 THEN '[1,[2]]' WHEN 3 THEN '{"done":true}' WHEN 4 THEN NULL ELSE '{"t":"a\\nb"}' END AS closed FROM events""")
def _closed_json(spark, d):
    """Texts that break off in a string, an array or an object, whole ones, one beyond help, and one with a raw line end."""
    broken = r"""CASE event_id % 6 WHEN 0 THEN concat('{"a":[1,{"b":"', event_type) WHEN 1 THEN concat('{"a":"x', user_id) WHEN 2 THEN '[1,[2' WHEN 3 THEN '{"done":true}' WHEN 4 THEN '{"a":tru' ELSE '{"t":"a\nb"}' END"""
    cut = rows(spark, d, "events", "event_id", f"{broken} t")
    return cut.select("event_id", text.close_json_udf(text.escape_controls_udf(F.col("t"))).alias("closed"))


@query("str_checks", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'run t;run l' WHEN 1 THEN 'run c' WHEN 2 THEN 'run other' ELSE '' END AS checks FROM customer""")
def _checks(spark, d):
    listed = """CASE c_custkey % 4 WHEN 0 THEN array(named_struct('name', 'lint', 'command', 'run l'), named_struct('name', 'test', 'command', 'run t'), named_struct('name', 'test', 'command', 'again')) WHEN 1 THEN array(named_struct('name', 'other', 'command', 'run o'), named_struct('name', 'typecheck', 'command', 'run c'))
WHEN 2 THEN array(named_struct('name', 'build', 'command', 'run other')) ELSE cast(array() as array<struct<name:string,command:string>>) END"""
    return rows(spark, d, "customer", "c_custkey", f"{listed} l").select("c_custkey", F.array_join(scalars.checks(F.col("l")), ";").alias("checks"))


@query("str_supply_label", """SELECT p_brand, count(*) || ' supply-chain finding' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || CASE WHEN count(*) FILTER (p_size > 48) > 0 THEN ' · ' || count(*) FILTER (p_size > 48) || ' critical' ELSE '' END || CASE WHEN count(*) FILTER (p_size BETWEEN 45 AND 48) > 0 THEN ' · ' || count(*) FILTER (p_size BETWEEN 45 AND 48) || ' high' ELSE '' END AS label FROM part GROUP BY p_brand""")
def _supply_label(spark, d):
    n = rows(spark, d, "part", "p_brand", "p_size").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 48).alias("c"), F.count_if(F.col("p_size").between(45, 48)).alias("h"))
    return n.select("p_brand", scalars.supply_label(F.col("n"), F.col("c"), F.col("h")).alias("label"))


@query("mth_small_scalars", """SELECT o_orderkey, floor((o_totalprice - 150000) / 10 + 0.5) AS rounded, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE least(greatest((o_orderkey % 100 - o_custkey % 50) * 100.0 / nullif(o_orderkey % 100, 0), 0), 100) END AS progress,
40 + o_orderkey % 9 * 4 + o_custkey % 7 * 4 + o_orderkey % 5 * 6 AS tokens, CASE WHEN o_orderkey % 25 < 20 THEN least(1000 * pow(1.5, o_orderkey % 25), 30000) END AS wait FROM orders WHERE o_orderkey % 100 > 0""")
def _small_scalars(spark, d):
    o = rows(spark, d, "orders", "o_orderkey k", "o_custkey c", "o_totalprice p").where("k % 100 > 0")
    left = F.when(F.col("k") % 4 == 0, F.lit(float("inf"))).otherwise((F.col("c") % 50).cast("double"))
    k = F.col("k")
    return o.select(k.alias("o_orderkey"), scalars.rounded((F.col("p") - 150000) / 10).alias("rounded"), scalars.burn_progress(k % 100, left).alias("progress"), scalars.context_tokens(k % 9, F.col("c") % 7, k % 5).alias("tokens"), scalars.backoff_ms(k % 25).alias("wait"))


@query("dat_stamps", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'live' ELSE strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS stamp, event_id % 5 NOT IN (0, 1, 4) AS valid, CASE WHEN event_id % 3 = 0 THEN 'Infinity'::DOUBLE ELSE (1706659200000 - epoch_us(ts) // 1000)::DOUBLE END AS age FROM events""")
def _stamps(spark, d):
    """Times as texts and ages, and whether a window and its burn time are valid."""
    e = rows(spark, d, "events", "event_id", "coalesce(event_id % 3 = 0, false) live", "cast(ts as timestamp) t", "CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN cast('Infinity' as double) ELSE 10 END w", "CASE event_id % 5 WHEN 4 THEN 11 ELSE 10 END b")
    # an event without a time has neither text nor age, and one without an id no verdict
    timed = lambda x: F.when(F.col("live") | F.col("t").isNotNull(), x)
    # any time is one here; milliseconds are cut towards 1970, and years of five digits bear no sign
    t = F.when(~F.col("live"), F.timestamp_millis(F.expr("unix_micros(t) div 1000")))
    return e.select(
        "event_id",
        timed(F.regexp_replace(scalars.stamp(F.unix_millis(t), -(1 << 63)), "^[+]", "")).alias("stamp"),
        F.when(F.col("event_id").isNotNull(), scalars.valid_durations(F.col("w"), F.col("b").cast("double"))).alias("valid"),
        timed(scalars.age_ms(F.timestamp_millis(F.lit(1706659200000)), t)).alias("age"),
    )


@query("flt_commands", """SELECT c_custkey, c_custkey % 6 IN (0, 1) AS safe, c_custkey % 4 IN (0, 1) AS hopeless, c_custkey % 3 > 0 AS two FROM customer""")
def _commands(spark, d):
    """Commands that may be run, failures that would only come again, and contracts that ask for a second validator."""
    command = "CASE c_custkey % 6 WHEN 0 THEN concat('npm run test:', c_custkey) WHEN 1 THEN 'make' WHEN 2 THEN 'cat ../x' WHEN 3 THEN 'a; b' WHEN 4 THEN 'a  b' END"
    message = "CASE c_custkey % 4 WHEN 0 THEN 'Unable to register pi model x' WHEN 1 THEN 'no SUCH provider' WHEN 2 THEN 'unable to register a model' END"
    accepted = "CASE c_custkey % 3 WHEN 0 THEN ' None ' WHEN 1 THEN 'it works' ELSE c_name END"
    c = rows(spark, d, "customer", "c_custkey", f"{command} c", f"{message} m", f"{accepted} a")
    return c.select("c_custkey", scalars.safe_command(F.col("c")).alias("safe"), scalars.hopeless(F.col("m"), "pi").alias("hopeless"), (F.size(matching.validators(F.col("a"))) == 2).alias("two"))


# -- joins and groupings of work items ---------------------------------------------------------------------------


_UNIT = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"


@query("join_todo_of_unit", f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_UNIT} AS id FROM lineitem),
t AS (SELECT l_orderkey AS mission, CASE l_partkey % 3 WHEN 0 THEN 'goal ' || l_partkey ELSE 'other' END AS goal, CASE WHEN l_partkey % 3 = 1 THEN 'goal ' || CAST(l_partkey AS VARCHAR)[:2] ELSE 'none' END AS title, l_suppkey AS f FROM l),
m AS (SELECT id, CASE WHEN goal = 'goal ' || l_partkey THEN 0 WHEN starts_with('goal ' || l_partkey, title) THEN 1 WHEN f = l_suppkey THEN 2 END AS stage FROM l JOIN t ON mission = l_orderkey) SELECT id AS unit, min(stage) AS stage FROM m GROUP BY id""")
def _todo_of_unit(spark, d):
    """Lines of an order as units and as todos: some have a line's goal, some begin it, all list their supplier."""
    lines = rows(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # dealt once by order, in as many pieces as a shuffle has: repeats are dropped and orders joined where they lie
    lines = lines.repartition(width(spark), "l_orderkey").distinct().selectExpr("*", f"{_UNIT} id")
    units = lines.selectExpr("id", "l_orderkey mission", "concat('goal ', l_partkey) description", "array(l_suppkey) paths")
    todos = lines.selectExpr("id", "l_orderkey mission", "id ord", "CASE l_partkey % 3 WHEN 0 THEN concat('goal ', l_partkey) ELSE 'other' END goal", "CASE WHEN l_partkey % 3 = 1 THEN concat('goal ', substr(l_partkey, 1, 2)) ELSE 'none' END title", "'implementation' type", "array(l_suppkey) files")
    return matching.todo_of_unit(units, todos).select("unit", "stage")


@query("join_units_to_retry", """WITH u AS (SELECT o_orderkey AS id, o_custkey AS milestone, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'completed' END AS status FROM orders), v AS (SELECT *, row_number() OVER (PARTITION BY milestone ORDER BY id) AS n FROM u),
f AS (SELECT milestone, count(*) FILTER (n = 1 AND milestone % 3 = 0) > 0 AS named FROM v WHERE milestone % 3 < 2 GROUP BY milestone)
SELECT v.id FROM v JOIN f ON f.milestone = v.milestone WHERE CASE WHEN named THEN n = 1 ELSE status IN ('failed', 'completed') END""")
def _units_to_retry(spark, d):
    """Milestones by their number: a verdict that names the first unit, one that names none, none at all."""
    units = rows(spark, d, "orders", "o_orderkey id", "o_custkey milestone", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'completed' END status")
    first = units.groupBy("milestone").agg(F.min("id").alias("first")).where("milestone % 3 < 2")
    verdicts = first.selectExpr("milestone", "CASE WHEN milestone % 3 = 0 THEN 'fail' ELSE 'pass' END verdict", "CASE WHEN milestone % 3 = 0 THEN array(first) ELSE cast(array() as array<bigint>) END failed")
    return matching.units_to_retry(units, verdicts).select("id")


@query("join_models", "SELECT n_name AS provider, p_name || p_partkey AS model FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE n_nationkey % 2 = 0")
def _models(spark, d):
    """Models under their provider's name, some of them under it twice; half of the providers are known."""
    n = rows(spark, d, "nation", "n_nationkey", "n_name")
    ids = rows(spark, d, "part", "p_partkey % 25 n_nationkey", "p_partkey", "p_name").join(n, "n_nationkey").selectExpr("concat(n_name, '/', CASE WHEN p_partkey % 4 = 0 THEN concat(n_name, '/') ELSE '' END, p_name, p_partkey) id")
    return matching.models_of(n.where("n_nationkey % 2 = 0").selectExpr("n_name id"), ids)


@query("agg_verdicts", """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'fail' ELSE 'pass' END AS status, string_agg('t' || o_orderkey % 3 || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, '; ' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS reason FROM orders GROUP BY o_custkey""")
def _verdicts(spark, d):
    given = rows(spark, d, "orders", "o_custkey", "o_orderkey ord", "concat('t', o_orderkey % 3) type", "CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END verdict", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END findings")
    return matching.verdict_of(given, "o_custkey")


@query("agg_retries", "SELECT c_custkey AS unit, count(o_orderkey) AS used, count(o_orderkey) < 15 AS may_retry FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _retries(spark, d):
    return matching.retries_left(rows(spark, d, "customer", "c_custkey id"), rows(spark, d, "orders", "o_custkey id"), 15)


@query("snk_upsert", """WITH c AS (SELECT user_id AS key, event_id AS ord, event_type, event_type = 'error' AS gone FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1)
SELECT key, event_type AS v FROM l WHERE NOT gone UNION ALL SELECT c_custkey, 'kept' FROM customer WHERE c_custkey NOT IN (SELECT key FROM l)""")
def _upsert(spark, d):
    changes = rows(spark, d, "events", "user_id key", "event_id ord", "event_type v", "event_type = 'error' deleted")
    return sinks.upsert(rows(spark, d, "customer", "c_custkey key", "'kept' v"), changes, ["key"], "ord")


@query("stm_live_counts", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _live_counts(spark, d):
    ready(spark)
    counts = state.live_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("agg_settled_dependencies", """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'passed' WHEN 2 THEN 'merged' ELSE 'blocked' END AS status FROM orders), n AS (SELECT o_orderkey AS id, o_orderkey - 1 - o_custkey % 2 AS needs FROM orders)
SELECT t.id FROM t WHERE status = 'pending' AND coalesce((SELECT bool_and(s.status IN ('passed', 'merged')) AND count(*) = count(s.id) FROM n LEFT JOIN t s ON s.id = n.needs WHERE n.id = t.id), true)""")
def _settled(spark, d):
    """Pending todos whose one dependency, one or two before, is settled."""
    todos = rows(spark, d, "orders", "o_orderkey id", "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'passed' WHEN 2 THEN 'merged' ELSE 'blocked' END status")
    return lifecycle.settled_dependencies(todos, rows(spark, d, "orders", "o_orderkey id", "o_orderkey - 1 - o_custkey % 2 needs")).select("id")


@query("join_lost_missions", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def _lost_missions(spark, d):
    """Orders that should be running without a line that runs."""
    listed = rows(spark, d, "orders", "o_orderkey id", "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'planning' ELSE 'completed' END status")
    return matching.orphans(listed, rows(spark, d, "lineitem", "l_orderkey id", "l_returnflag").where("l_returnflag = 'N'")).select("id")


@query("agg_mission_states", "SELECT count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'F') AS ended FROM orders")
def _mission_states(spark, d):
    return matching.counts_by_state(rows(spark, d, "orders", "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'paused' ELSE 'failed' END status"))


@query("join_authorised", "SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 1) AND c_nationkey % 2 = 0")
def _authorised(spark, d):
    """Requests for repositories by address, with and without an ending, by another host and without a name."""
    repos = rows(spark, d, "nation", "n_nationkey", "concat('https://github.com/acme/r', n_nationkey, '.git') clone_url").where("n_nationkey % 2 = 0")
    url = "CASE c_custkey % 4 WHEN 0 THEN concat('https://github.com/acme/r', c_nationkey) WHEN 1 THEN concat('https://github.com/acme/r', c_nationkey, '.git') WHEN 2 THEN concat('https://elsewhere.org/acme/r', c_nationkey) ELSE 'https://github.com/acme' END"
    return matching.authorised(rows(spark, d, "customer", "c_custkey", f"{url} clone_url"), repos).select("c_custkey")


@query("agg_evidence", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS branch, CASE WHEN o_orderkey % 3 = 0 THEN 'a,b,c' ELSE 'a,b' END AS commits, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END AS tests FROM orders""")
def _evidence(spark, d):
    old = rows(spark, d, "orders", "o_orderkey", "'old' branch", "'pass' verdict", "array('a', 'b') commits", "array('f') files", "cast(null as array<string>) notes", "array('t') tests")
    new = rows(spark, d, "orders", "o_orderkey", "'new' branch", "cast(null as string) verdict", "array('b', 'c') commits", "array('f') files", "array('n') notes", "array('t', 'u') tests").where("o_orderkey % 3 = 0")
    got = matching.merged_evidence(old, new, "o_orderkey")
    return got.select("o_orderkey", "branch", F.array_join("commits", ",").alias("commits"), F.size("tests").alias("tests"))


_PAYLOAD = """CASE event_id % 6 WHEN 0 THEN concat('{"agentType":"worker","status":"in_progress","agentId":"a', user_id, '"}') WHEN 1 THEN concat('{"code":"E_', user_id, '","message":"it broke"}') WHEN 2 THEN '{"summary":{"totalFindings":7},"missionId":"m1"}' WHEN 3 THEN concat('{"missionId":"mission-', user_id, '","finalState":"completed"}') WHEN 4 THEN concat('{"missionId":"mission-', user_id, '"}') ELSE '{}' END"""
_TYPE = "CASE event_id % 6 WHEN 0 THEN 'agent_status' WHEN 1 THEN 'mission_error' WHEN 2 THEN 'scan_completed' WHEN 3 THEN 'mission_completed' WHEN 4 THEN 'escalation' ELSE 'odd_thing' END"


def _told(spark, d):
    return rows(spark, d, "events", "event_id seq", f"{_TYPE} type", f"parse_json({_PAYLOAD}) payload")


@query("prj_feed_items", """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'agent' WHEN 1 THEN 'error' WHEN 2 THEN 'scan' ELSE 'event' END AS kind, CASE event_id % 6 WHEN 0 THEN 'AGENT' WHEN 1 THEN 'E ' || user_id WHEN 2 THEN 'SCAN' WHEN 3 THEN 'DONE' WHEN 4 THEN 'ESCALATION' ELSE 'ODD_THING' END AS label,
CASE event_id % 6 WHEN 0 THEN 'worker → in progress' WHEN 1 THEN 'it broke' WHEN 2 THEN 'scan complete: 7 findings' WHEN 3 THEN 'mission completed' WHEN 4 THEN 'escalation' ELSE 'odd thing' END AS message FROM events""")
def _feed_items(spark, d):
    return event_texts.feed(_told(spark, d)).select("seq", "kind", "label", "message")


@query("prj_summaries", """SELECT event_id AS seq, CASE event_id % 6 WHEN 0 THEN 'worker a' || user_id || ' -> in_progress' WHEN 1 THEN 'E_' || user_id || ': it broke' WHEN 2 THEN 'm1' WHEN 3 THEN 'mission-' || user_id WHEN 4 THEN 'mission-' || user_id ELSE '<odd_thing>' END AS summary FROM events""")
def _summaries(spark, d):
    return _told(spark, d).select("seq", event_texts.summary(F.col("type"), F.col("payload")).alias("summary"))


@query("prj_notifications", """SELECT 'mission-' || user_id AS mission_id, CASE event_id % 6 WHEN 3 THEN 'completed' ELSE 'escalation' END AS notice, min(event_id) AS seq FROM events WHERE event_id % 6 IN (3, 4) GROUP BY ALL""")
def _notifications(spark, d):
    return event_texts.notifications(_told(spark, d)).select("mission_id", "notice", "seq")


@query("src_repositories", "SELECT c_custkey AS id, 'acme/' || c_name AS full_name, c_custkey % 2 = 0 AS private FROM customer")
def _repositories(spark, d):
    """Pages of a service with all repositories of a nation each."""
    one = """concat('{"id":', c_custkey, ',"full_name":"acme/', c_name, '","private":', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"stars":5}')"""
    pages = rows(spark, d, "customer", "c_nationkey", f"{one} r").groupBy("c_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    return manifests.repositories(pages).select("id", "full_name", "private")


@query("src_first_existing", "SELECT o_orderkey AS scope, CASE WHEN o_orderkey % 3 = 0 THEN 'pnpm-lock.yaml' ELSE 'yarn.lock' END AS name FROM orders WHERE o_orderkey % 3 < 2")
def _first_existing(spark, d):
    found = rows(spark, d, "orders", "o_orderkey scope", "explode(CASE o_orderkey % 3 WHEN 0 THEN array('yarn.lock', 'pnpm-lock.yaml', 'x') WHEN 1 THEN array('README.md', 'yarn.lock') ELSE array('x') END) name")
    return manifests.first_existing(found, ["pnpm-lock.yaml", "yarn.lock"], "scope")


@query("src_first_parsed", "SELECT o_orderkey AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'b.json' ELSE 'a.json' END AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS k FROM orders WHERE o_orderkey % 5 > 0")
def _first_parsed(spark, d):
    """Reports in two places, of which the first is broken for every second and both for every fifth."""
    content = "CASE WHEN path = 'a.json' AND o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN '{\"k\":' WHEN path = 'a.json' THEN concat('{\"k\":', o_custkey + 1, '}') ELSE concat('{\"k\":', o_custkey, '}') END"
    found = rows(spark, d, "orders", "o_orderkey", "o_custkey", "explode(array('b.json', 'a.json', 'c.json')) path").selectExpr("o_orderkey scope", "path", f"{content} content", "1 modificationTime")
    return manifests.first_parsed(found, ["a.json", "b.json"], "scope").select("scope", "path", F.try_variant_get("report", "$.k", "bigint").alias("k"))


@query("snk_issue_status", "SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0 AND o_custkey = 7) AS done FROM orders GROUP BY o_custkey")
def _issue_status(spark, d):
    """Reports of a customer's orders; issue 0 of report 7 is done."""
    reports = rows(spark, d, "orders", "o_custkey id", "named_struct('id', o_orderkey % 7, 'status', 'open') i").groupBy("id").agg(F.collect_list("i").alias("issues"))
    got = sinks.updated_issue(reports, 7, 0, "done")
    return got.select("id", F.size("issues").cast("long").alias("n"), F.size(F.filter("issues", lambda i: i["status"] == "done")).cast("long").alias("done"))


@query("snk_new_index_rows", "SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _new_index_rows(spark, d):
    return sinks.new_index_rows(rows(spark, d, "customer", "c_custkey id").where("id % 2 = 0"), rows(spark, d, "events", "user_id id"))


@query("snk_transcripts", """SELECT c_nationkey AS key, '## Events' || chr(10) || string_agg(c_name, chr(10) ORDER BY c_custkey) || CASE WHEN c_nationkey % 2 = 0 THEN chr(10) || chr(10) || '## Costs' || chr(10) || 'n' || c_nationkey ELSE '' END AS document FROM customer GROUP BY c_nationkey""")
def _transcripts(spark, d):
    sections = [("Events", rows(spark, d, "customer", "c_nationkey key", "c_custkey ord", "c_name line")), ("Costs", rows(spark, d, "nation", "n_nationkey key", "0 ord", "concat('n', n_nationkey) line").where("key % 2 = 0"))]
    got = sinks.transcript(sections, "key").select("key", "document")
    return got.join(rows(spark, d, "customer", "c_nationkey key").distinct(), "key", "left_semi")


@query("stm_fresh_rows", "SELECT event_id FROM events WHERE event_id % 3 > 0 AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000 - epoch_us(ts) // 1000 <= 864000000")
def _fresh_rows(spark, d):
    seen = rows(spark, d, "events", "event_id", "CASE WHEN event_id % 3 > 0 THEN cast(ts as timestamp) END seen")
    return state.fresh(seen, "seen", F.lit("2024-01-20").cast("timestamp"), 864_000_000).select("event_id")
