"""DataFrame plans of the catalog's simpler queries; their twins stand in `plans.catalog` as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import scalars
from sparkloom.operators import lifecycle, matching
from sparkloom.operators.ranges import dealt, running
from sparkloom.plans.catalog import edge_keys, view
from sparkloom.plans.records import rows
from sparkloom.plans.registry import query
from sparkloom.sources import manifests
from sparkloom.streaming import state

c = F.col


def _ms(at: str) -> str:
    return f"unix_millis(cast({at} as timestamp))"


def _counts(df: DataFrame, key: list[str], **when) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("total"), *[F.count_if(w).alias(n) for n, w in when.items()])


@query("prj_coalesce_defaults")
def _defaults(spark, d):
    docs = rows(spark, d, "documents", "doc_id", "source").join(rows(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")
    return docs.fillna({"quality": -1, "toxic": 0}).withColumn("source", F.when(F.length("source") > 0, c("source")).otherwise("unknown")).select("doc_id", "quality", "toxic", "source")


@query("prj_event_case")
def _event_case(spark, d):
    said = {"signup": "Account opened", "purchase": "Order placed", "error": "Something failed", "view": "Page seen"}
    known = F.create_map(*[F.lit(x) for kv in said.items() for x in kv])
    return rows(spark, d, "events", "event_id", "event_type").select("event_id", F.coalesce(known[c("event_type")], F.concat(F.lit("Event "), "event_type")).alias("summary"))


@query("flt_issue_list")
def _issue_list(spark, d):
    said = F.lower(F.concat_ws(" ", "body", c("cat").cast("string")))
    return view(spark, d, "v_issues").where((c("tier") == "P1") & (c("status") != "dismissed") & c("body").isNotNull() & said.contains("the")).select("id", "tier", "status")


@query("flt_actionable_case")
def _actionable(spark, d):
    quiet = c("cat").isin(9, 10, 11)
    urgent = c("tier").isin("P0", "P1", "P2") | (c("status") == "queued")
    return view(spark, d, "v_issues").select("id", (urgent | (~quiet & (c("tier") == "P3"))).alias("actionable"))


@query("flt_path_prefix")
def _path_prefix(spark, d):
    under = c("path").startswith("economy/b") | (c("path") == "small") | c("path").startswith("small/") | c("path").startswith("standard/")
    return view(spark, d, "v_hotspots").where(under).select("path")


@query("flt_regex_classify")
def _classify(spark, d):
    name, kind = F.lower("p_name"), F.lower("p_type")
    return rows(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand").select("p_partkey", (name.startswith("part") | name.startswith("name")).alias("ui_like"), (kind.startswith("eco") | kind.startswith("sta")).alias("data_like"), F.substring("p_brand", 7, 1).isin("1", "2", "3").alias("low_brand"))


@query("join_index_lookup")
def _index_lookup(spark, d):
    ids = rows(spark, d, "orders", "o_custkey c_custkey", "o_orderkey").groupBy("c_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    found = rows(spark, d, "customer", "c_custkey").join(ids, "c_custkey").select("c_custkey", F.posexplode("ids").alias("at", "o_orderkey"))
    return found.select("c_custkey", "o_orderkey", (c("at") + 1).cast("long").alias("pos"))


@query("join_anti_tombstone")
def _tombstone(spark, d):
    returned = rows(spark, d, "lineitem", "l_orderkey o_orderkey", "l_returnflag").where("l_returnflag = 'R'")
    return rows(spark, d, "orders", "o_orderkey").join(returned, "o_orderkey", "left_anti")


@query("join_anti_dependencies")
def _dependencies(spark, d):
    return lifecycle.settled_dependencies(view(spark, d, "v_todos"), view(spark, d, "v_deps").withColumnRenamed("dep", "needs")).select("id")


@query("join_anti_synthesize")
def _synthesize(spark, d):
    expected = rows(spark, d, "documents", "doc_id milestone", "'quality' type")
    given = rows(spark, d, "labels", "doc_id milestone", "'quality' type", "quality verdict", "'' findings").join(expected.select("milestone"), "milestone", "left_semi")
    found = matching.with_missing_verdicts(expected, given, F.lit("none"))
    return found.select(c("milestone").alias("doc_id"), F.when(c("synthetic"), 0).otherwise(c("verdict").cast("int")).alias("verdict"), F.when(c("synthetic"), "synthetic").otherwise("given").alias("kind"))


@query("join_hydrate")
def _hydrate(spark, d):
    """Open lines are counted by order first, so no order is there more than once."""
    open_ = rows(spark, d, "lineitem", "l_orderkey o_orderkey", "l_linestatus").where("l_linestatus <> 'F'").groupBy("o_orderkey").agg(F.count("*").alias("k"))
    per = rows(spark, d, "orders", "o_orderkey", "o_custkey c_custkey").join(open_, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    zero = lambda x, name: F.coalesce(x, F.lit(0)).alias(name)
    return rows(spark, d, "customer", "c_custkey").join(per, "c_custkey", "left").select("c_custkey", zero("n", "n_orders"), zero("k", "n_open"))


@query("join_left_coalesce")
def _left_coalesce(spark, d):
    top = rows(spark, d, "supplier", "s_nationkey c_nationkey", "s_name").groupBy("c_nationkey").agg(F.min("s_name").alias("top"))
    met = rows(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(top), "c_nationkey", "left")  # a row a nation
    return met.select("c_custkey", F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment")).otherwise(c("top")).alias("segment"))


@query("join_full_outer")
def _full_outer(spark, d):
    sides = rows(spark, d, "events", "user_id id", "1L n", "true e", "false k").unionByName(rows(spark, d, "customer", "c_custkey id", "0L n", "false e", "true k"))
    return sides.groupBy("id").agg(F.bool_or("e").alias("has_events"), F.bool_or("k").alias("is_customer"), F.sum("n").alias("n"))


@query("join_price_fallback")
def _price(spark, d):
    exact = F.create_map(*map(F.lit, ("A/F", 3, "N/O", 2)))
    by_provider = F.create_map(*map(F.lit, ("R", 5, "N", 1)))
    price = F.coalesce(exact[c("model")], by_provider[scalars.provider(c("model"))], F.lit(0))
    return view(spark, d, "v_costs").select("item", "ln", "pk", "session", price.alias("price"))


@query("agg_count_by_tier")
def _by_tier(spark, d):
    return view(spark, d, "v_issues").groupBy("tier").count().withColumnRenamed("count", "n")


@query("agg_severity_pivot")
def _severities(spark, d):
    names = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
    by = rows(spark, d, "orders", "o_orderstatus", "o_orderpriority").groupBy("o_orderstatus").pivot("o_orderpriority", [*names, "4-NOT SPECIFIED"]).count().fillna(0)
    every = sum((c(f"`{n}`") for n in [*names, "4-NOT SPECIFIED"]), F.lit(0))
    return by.select("o_orderstatus", every.cast("long").alias("total"), *[c(f"`{k}`").alias(v) for k, v in names.items()])


@query("agg_zero_filled")
def _zero_filled(spark, d):
    known = F.array(*map(F.lit, lifecycle.TODO_STATUSES))
    every = spark.range(1).select(F.explode(known).alias("status"), F.lit(0).alias("n"))
    return view(spark, d, "v_todos").where(c("status").isin(lifecycle.TODO_STATUSES)).select("status", F.lit(1).alias("n")).unionByName(every).groupBy("status").agg(F.sum("n").alias("n"))


@query("agg_ratio_score")
def _ratio(spark, d):
    kind = c("event_type")
    n = _counts(rows(spark, d, "events", "user_id", "event_type"), ["user_id"], k=kind == "purchase", s=kind == "error", t=kind == "view")
    all_ = c("k") + c("s") + c("t")
    return n.select("user_id", "total", F.when(all_ > 0, F.floor(c("k") * 10000.0 / all_ + 0.5) / 100.0).alias("score"))


@query("agg_conditional_ratio")
def _conditional(spark, d):
    n = _counts(rows(spark, d, "part", "p_brand", "p_size"), ["p_brand"], src=c("p_size") > 10, tst=c("p_size") <= 10)
    said = F.when((c("src") > 10) & (c("tst") == 0), "none").when(c("tst") * 5 < c("src"), "low").otherwise("ok")
    return n.select("p_brand", said.alias("tests"), "src", "tst")


@query("agg_cost_rollup")
def _rollup(spark, d):
    """By session first, as a service sums up, then by model."""
    by = view(spark, d, "v_costs").groupBy("model", "session").agg(F.sum("cost").alias("c"), F.sum(c("prompt") + c("completion")).alias("t"), F.count("*").alias("n"))
    return by.groupBy("model").agg(F.sum("c").cast("double").alias("cost"), F.sum("t").cast("long").alias("tokens"), F.sum("n").alias("entries"))


@query("agg_snapshot")
def _snapshot(spark, d):
    n = _counts(rows(spark, d, "orders", "o_custkey", "o_orderstatus"), ["o_custkey"], done=c("o_orderstatus") == "F")
    return n.withColumn("progress", c("done") * 100.0 / c("total"))


@query("agg_max_severity")
def _max_severity(spark, d):
    worst = rows(spark, d, "orders", "o_custkey c_custkey", "o_orderpriority").groupBy("c_custkey").agg(F.min("o_orderpriority").alias("p"), F.count("*").alias("n"))
    risk = F.when(c("p").startswith("1"), "CRITICAL").when(c("p").startswith("2"), "HIGH").when(c("p").startswith("3"), "MEDIUM").otherwise("LOW")
    met = rows(spark, d, "customer", "c_custkey").join(worst, "c_custkey", "left")
    return met.select("c_custkey", risk.alias("risk"), F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_first_match_fallback")
def _first_match(spark, d):
    first = lambda when: F.min(F.when(when, c("id")))
    of = view(spark, d, "v_issues").groupBy("lang").agg(first((c("tier") == "P0") & (c("status") == "done")).alias("a"), F.min("id").alias("b"), first(c("status") == "queued").alias("x"), first(c("cat") < 4).alias("y"))
    return of.select("lang", F.coalesce("a", "b").alias("impact"), F.coalesce("x", "y").alias("safest"))


@query("agg_histogram")
def _histogram(spark, d):
    bounds = F.array(*map(F.lit, (10.0, 50.0, 100.0)))
    bucket = F.size(F.filter(bounds, lambda b: c("value") >= b))
    return rows(spark, d, "events", "event_type", "value").groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("win_share_of_total")
def _share(spark, d):
    n = rows(spark, d, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n"))
    met = n.join(F.broadcast(n.agg(F.sum("n").alias("all"))), F.lit(True))  # one row
    return met.select("lang", "n", F.floor(c("n") * 100.0 / c("all") + 0.5).cast("long").alias("pct"), (c("n") > 0.3 * c("all")).alias("coupled"))


def _costs(spark, d) -> DataFrame:
    """Costs with what an item has cost so far, added up by ranges."""
    at = ["ln", "pk", "session"]
    return running(dealt(view(spark, d, "v_costs").select("item", *at, "cost"), ["item"], at), ["item"], at, {"so_far": "cost"})


@query("win_running_cost")
def _running_cost(spark, d):
    return _costs(spark, d).select("item", "ln", "pk", "session", c("so_far").cast("double").alias("running"))


@query("win_threshold_crossing")
def _crossing(spark, d):
    return _costs(spark, d).where("so_far >= 5000").groupBy("item").agg(F.min("ln").alias("crossed_at"))


@query("win_row_cap")
def _row_cap(spark, d):
    one = rows(spark, d, "events", "event_id", "user_id", "ts", "1 one")
    return running(dealt(one, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], {"n": "one"}).select("event_id", (c("n") > 20).alias("over_cap"))


@query("win_lead_pairs")
def _lead_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = rows(spark, d, "events", "event_id", "event_type", "user_id", "ts")
    first = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first"))
    return e.withColumn("next", F.lead("event_type").over(w)).join(first, "user_id").select("event_id", "event_type", F.coalesce("next", "first").alias("next_type"))


@query("setop_feed_union")
def _feed(spark, d):
    return rows(spark, d, "events", "'event' kind", "event_id id", f"{_ms('ts')} at").unionByName(rows(spark, d, "orders", "'order' kind", "o_orderkey id", f"{_ms('o_orderdate')} at"))


@query("setop_upsert_latest")
def _latest(spark, d):
    """The last state by time, but an error once there was one."""
    e = rows(spark, d, "events", "user_id key", "struct(ts, event_id) seq", "event_type status")
    return state.current_states(e, "error").select(c("key").alias("user_id"), "state")


@query("str_basename")
def _basename(spark, d):
    return view(spark, d, "v_hotspots").select("ord", scalars.basename(c("path")).alias("base"))


@query("str_sanitize")
def _sanitize(spark, d):
    return view(spark, d, "v_packages").select("ord", scalars.sanitized(c("full_name")).alias("safe"), scalars.without_scope(c("full_name")).alias("bare"))


@query("str_truncate")
def _truncate(spark, d):
    return rows(spark, d, "documents", "doc_id", "text").select("doc_id", scalars.shortened(c("text"), 60).alias("short"))


@query("str_provider_prefix")
def _prefix(spark, d):
    return view(spark, d, "v_costs").groupBy("model").agg(F.first(scalars.provider(c("model"))).alias("provider"))


@query("str_concat_nonempty")
def _nonempty(spark, d):
    talk = rows(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return talk.select("conv_id", "turn", scalars.lines(c("role"), c("text"), F.when(c("turn") == 0, "opening")).alias("prompt"))


@query("mth_score_band")
def _band(spark, d):
    top = rows(spark, d, "events", "user_id", "value").groupBy("user_id").agg(F.floor(F.max("value")).alias("s"))
    return top.select("user_id", scalars.score_band(c("s")).alias("band"))


@query("arr_collapse_single")
def _collapse(spark, d):
    lines = rows(spark, d, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("z"), F.count("*").alias("n"))
    return lines.select("l_orderkey", F.when(c("a") == c("z"), 1).otherwise(c("n")).alias("units"))


@query("stm_quota_admission")
def _admission(spark, d):
    e = rows(spark, d, "events", "event_id", "user_id", f"{_ms('ts')} ms")
    first = e.groupBy("user_id").agg(F.min("ms").alias("f"))
    return e.join(first, "user_id").select("event_id", (~(c("ms") - c("f")).between(3_600_000, 17_999_999)).alias("admitted"))


@query("stm_transition_valid")
def _transition(spark, d):
    """The event before comes from ranges: the highest one so far."""
    allowed = {"view": ["click", "view"], "click": ["purchase", "view"], "signup": ["view"]}
    e = rows(spark, d, "events", "event_id", "user_id", "ts", "event_type", "struct(ts, event_id, event_type) at")
    met = running(dealt(e, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], None, {"last": "at"}, inclusive=False)
    before = c("last.event_type")
    known = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return met.select("event_id", (before.isNull() | F.coalesce(F.array_contains(known[before], c("event_type")), F.lit(False))).alias("valid"))


@query("stm_idle_sessions")
def _idle(spark, d):
    """Sessions are counted by ranges: a new one begins where the event before is two hours away."""
    e = rows(spark, d, "events", "event_id", "user_id", "ts", f"{_ms('ts')} ms")
    gaps = running(dealt(e, ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], None, {"last": "ms"}, inclusive=False)
    new = gaps.withColumn("new", F.when(c("ms") - c("last") < 7_200_000, 0).otherwise(1))
    numbered = running(new, ["user_id"], ["ts", "event_id"], {"session": "new"})
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ms").alias("started"), F.max("ms").alias("ended"))


@query("join_anti_orphans")
def _orphans(spark, d):
    """Nodes that no heavy edge leads to."""
    known = view(spark, d, "v_heavy").select(c("dst").alias("id")).unionByName(rows(spark, d, "nation", "n_name id"))
    return view(spark, d, "v_nodes").select("id").join(known, "id", "left_anti")


@query("topk_complexity")
def _complexity(spark, d):
    return view(spark, d, "v_hotspots").where("complexity > 45").orderBy(F.desc("complexity"), "ord").limit(5).select("path", "complexity")


@query("topk_fanout")
def _fanout(spark, d):
    pairs, names = edge_keys(spark, d)
    n = pairs.groupBy(c("a").alias("key")).agg(F.count("*").alias("n"))
    return n.join(names, "key").select(c("name").alias("src"), "n").orderBy(F.desc("n"), "src").limit(10)


@query("str_clean_version")
def _clean_version(spark, d):
    given = F.concat(F.lit(">="), "version", F.lit(" <"), "version")
    return view(spark, d, "v_packages").select("ord", manifests.clean_version(given).alias("clean"))


@query("mth_cost_estimate")
def _estimate(spark, d):
    paid = F.to_variant_object(F.struct(c("cost").cast("double").alias("total")))
    return view(spark, d, "v_costs").select("item", "ln", "pk", "session", scalars.cost(paid, c("prompt"), c("completion")).alias("estimate"))


@query("dat_prefire")
def _prefire(spark, d):
    """An hour's burn at the end of a window of five hours, for every second user; never before a given time."""
    at = c("ms") - F.when(c("odd"), 5 * 3_600_000 - 3_600_000).otherwise(0)
    e = rows(spark, d, "events", "event_id", "user_id % 2 = 1 odd", f"{_ms('ts')} ms")
    return e.select("event_id", F.greatest(at, F.lit(1_704_844_800_000)).alias("prefire"))


@query("arr_feature_flags")
def _flags(spark, d):
    by_type = rows(spark, d, "part", "p_brand", "p_type", "p_size").groupBy("p_brand", "p_type").agg(F.min("p_size").alias("a"), F.max("p_size").alias("z"))
    return by_type.groupBy("p_brand").agg((F.count("*") > 4).alias("many_types"), (F.min("a") == 1).alias("has_small"), (F.max("z") >= 50).alias("has_large"), F.min("p_type").alias("first_type"))


@query("stm_quota_status")
def _quota_status(spark, d):
    of = rows(spark, d, "events", "user_id", f"{_ms('ts')} ms").groupBy("user_id").agg((F.max("ms") - F.min("ms")).alias("age"))
    return of.select("user_id", F.when(c("age") < 3_600_000, "active").when(c("age") < 18_000_000, "exhausted").otherwise("expired").alias("status"))


@query("setop_history_page")
def _history_page(spark, d):
    """What is live, and a page of the rest; removed ones go after the page was cut."""
    jobs = view(spark, d, "v_jobs").select("id", "status")
    live = jobs.where("id % 500 = 0").select("id", F.lit("live").alias("place"))
    page = jobs.where(c("status").isin("claimed", "running", "queued")).join(live, "id", "left_anti").orderBy(F.desc("id")).limit(50)
    return live.unionByName(page.select("id", F.lit("history").alias("place"))).where("id % 7 <> 0")
