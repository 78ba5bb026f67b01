"""Operators over code graphs: catalog matches, paths of cycles, files nobody imports, and scaffolds within a budget.

Relations carry their source order in `ord`. Every look-up by "equal, or ends in it after a slash" is an equi-join on an
id's own endings, so no join compares all rows of two sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.ordered import either_key_join, keep_first
from sparkloom.operators.ranges import checkpointed, spread
from sparkloom.operators.records import scope_paths


def endings(path: Column) -> Column:
    """A path and what remains of it behind each of its slashes, once each."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/")))


def catalog_matches(entries: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages (ord, name, bare, version) that an entry (entry, package, versions) names, with or without scope, in a
    version that begins as one of the entry's does, whose leading ^ or ~ does not count. `*`, `all` and an empty list
    mean every version. Ecosystems are not compared."""
    met = either_key_join(entries, packages, [("package", "name"), ("package", "bare")], ["entry", "ord"])
    begins = lambda v: v.isin("*", "all") | F.startswith(F.col("version"), F.regexp_replace(v, r"^[\^~]", ""))
    return met.where((F.size("versions") == 0) | F.exists("versions", begins))


def cycle_paths(cycles: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """cycle, path, importance, nth: the most important paths of each cycle (cycle, segments), from the first stage that
    has any: nodes that are a segment or end in one; both ends of edges (src, dst, ord) whose nodes are, end in, or lie in
    the module of consecutive segments, the last and the first included; the best node of each segment's module or id."""
    n = F.size("segments")
    parts = cycles.select("cycle", n.alias("n"), "segments", F.posexplode("segments").alias("i", "segment"))
    ends = checkpointed(nodes.select(F.explode(endings(F.col("id"))).alias("key"), F.col("id").alias("path"), F.col("ord").alias("at")))
    none = F.lit(0).cast("long")
    first = checkpointed(parts.join(spread(ends), F.col("segment") == F.col("key")).groupBy("cycle", "path").agg(F.min(F.struct(F.col("at").cast("long").alias("a"), none.alias("b"), none.alias("c"))).alias("ord")))
    rest = parts.join(spread(first.select("cycle").distinct()), "cycle", "left_anti")
    keys = ends.select("key", "path").unionByName(nodes.select(F.col("module").alias("key"), F.col("id").alias("path"))).distinct()
    pairs = rest.where("n >= 2").select("cycle", "i", "segment", F.expr("segments[(i + 1) % n]").alias("next"))
    # each edge once for each pair of segments that it joins, however many cycles have that pair
    wanted = pairs.select("segment", "next").distinct()
    begun = keys.join(spread(wanted.select("segment").distinct()), F.col("key") == F.col("segment")).select("segment", F.col("path").alias("src"))
    ended = keys.join(spread(wanted.select("next").distinct()), F.col("key") == F.col("next")).select("next", F.col("path").alias("dst"))
    joins = edges.select("src", "dst", F.col("ord").alias("at")).join(spread(begun), "src").join(spread(ended), "dst").join(spread(wanted), ["segment", "next"], "left_semi")
    sides = joins.select("segment", "next", "at", F.posexplode(F.array("src", "dst")).alias("side", "path")).groupBy("segment", "next", "path").agg(F.min(F.struct("at", "side")).alias("first"))
    at, side = F.col("first.at").cast("long").alias("b"), F.col("first.side").cast("long").alias("c")
    second = checkpointed(pairs.join(spread(sides), ["segment", "next"]).groupBy("cycle", "path").agg(F.min(F.struct(F.col("i").cast("long").alias("a"), at, side)).alias("ord")))
    left = rest.join(spread(second.select("cycle").distinct()), "cycle", "left_anti")
    own = nodes.select(F.explode(F.array_distinct(F.array("module", "id"))).alias("key"), "id", "importance", "ord")
    best = own.groupBy("key").agg(F.min(F.struct((-F.col("importance")).alias("x"), "ord", "id"))["id"].alias("path"))
    third = left.join(spread(best), F.col("segment") == F.col("key")).groupBy("cycle", "path").agg(F.min(F.struct(F.col("i").cast("long").alias("a"), none.alias("b"), none.alias("c"))).alias("ord"))
    found = first.unionByName(second).unionByName(third)
    return scope_paths(found, nodes, most).select("cycle", "path", "importance", "nth")


def orphan_files(hotspots: DataFrame, edges: DataFrame, scoped: DataFrame, entries: DataFrame, considered: int = 20, most: int = 5) -> DataFrame:
    """Of the first hotspots (path, ord) those that no edge (dst) leads to, no issue has scoped (path), and that neither
    are what an entry point resolves to (entry, resolved) nor share its file name."""
    first = F.broadcast(hotspots.orderBy("ord").limit(considered))  # so many rows at any scale
    taken = [edges.select(F.col("dst").alias("path")), scoped.select("path"), entries.select(F.col("resolved").alias("path"))]
    hit = None
    for known in taken:  # the large side is filtered by the few paths, and only these go on
        met = known.join(first.select("path"), "path", "left_semi").distinct()
        hit = met if hit is None else hit.unionByName(met)
    base = F.element_at(F.split("path", "/"), -1)
    names = entries.select(F.element_at(F.split("entry", "/"), -1).alias("base"))
    named = names.join(first.select(base.alias("base")), "base", "left_semi").distinct()
    out = first.withColumn("base", base).join(hit, "path", "left_anti").join(named, "base", "left_anti").drop("base")
    return out.orderBy("ord").limit(most)


def _capped(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of each unit and one more, with their number: enough to see that some were left out."""
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("unit").orderBy(*order))).where(F.col("rk") <= most + 1)


#: Caps and budget of a fix prompt, and how many edges and neighbours it prints.
PROMPT = {"max_nodes": 8, "max_edges": 10, "max_hotspots": 5}
PROMPT_BUDGET, PRINTED_EDGES, PRINTED_NEIGHBOURS = 400, 6, 5


def _fitted(units: DataFrame, nodes: DataFrame, edges: DataFrame, hotspots: DataFrame, max_nodes: int, max_edges: int, max_hotspots: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each unit with how many nodes (k), edges (e) and hotspots (g) fit, and the ranked nodes, edges and hotspots."""
    ranked = _capped(nodes, [F.desc("importance"), "ord"], max_nodes).withColumn("over", F.col("rk") > max_nodes)
    kept = ranked.where("not over").select("unit", "id", "rk")
    ends = edges.select("unit", "ord", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    # kept has a unit's cap of rows at most: it is what tasks hash, and edges, of which one may come twice, are not sorted
    held = ends.join(kept.hint("shuffle_hash"), ["unit", "id"]).groupBy("unit", "ord", "src", "dst").agg(F.min("rk").alias("need"))
    some_rows = _capped(held, ["ord"], max_edges)
    hot_rows = _capped(hotspots, [F.desc("complexity"), "ord"], max_hotspots)
    some = some_rows.groupBy("unit").agg(F.collect_list(F.when(F.col("rk") <= max_edges, F.col("need"))).alias("needs"), F.max(F.col("rk") > max_edges).alias("cut_e"))
    hot = hot_rows.groupBy("unit").agg(F.count_if(F.col("rk") <= max_hotspots).alias("h"), F.max(F.col("rk") > max_hotspots).alias("cut_h"))
    own = ranked.groupBy("unit").agg(F.count_if(~F.col("over")).alias("n"), F.max("over").alias("cut_n"))
    no = F.lit(False)
    all_ = units.select("unit", F.col("budget").cast("long").alias("budget")).join(own, "unit", "left").join(some, "unit", "left").join(hot, "unit", "left")
    all_ = all_.select("unit", "budget", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("needs", F.array().cast("array<int>")).alias("needs"), (F.coalesce("cut_n", no) | F.coalesce("cut_e", no) | F.coalesce("cut_h", no)).alias("cut"))
    within = lambda k: F.filter("needs", lambda x: x <= k)
    cost = lambda k: 40 + 4 * k + 4 * F.size(within(k))
    fits = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda k: cost(k) <= F.col("budget"))
    all_ = all_.withColumn("k", F.coalesce(F.array_max(fits), F.lit(0)).cast("long")).withColumn("e", F.size(within(F.col("k"))).cast("long"))
    room = F.floor((F.col("budget") - 40 - 4 * F.col("k") - 4 * F.col("e")) / 6)
    all_ = all_.withColumn("g", F.when(F.col("k") < F.col("n"), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("h"), room))).cast("long"))
    return all_, ranked.where("not over"), some_rows.where(F.col("rk") <= max_edges), hot_rows.where(F.col("rk") <= max_hotspots)


def scaffolds(units: DataFrame, nodes: DataFrame, edges: DataFrame, hotspots: DataFrame, max_nodes: int = 25, max_edges: int = 20, max_hotspots: int = 10) -> DataFrame:
    """unit, nodes, edges, hotspots, tokens, truncated for each unit (unit, budget): how many nodes (unit, id, importance,
    ord) by importance, edges (unit, src, dst, ord) with an end among them by ord, and hotspots (unit, complexity, ord) by
    complexity fit the budget. 40 tokens are spent at once, 4 a node and an edge, 6 a hotspot. Above the budget hotspots go
    first, then nodes, and with them edges that lose both ends; as no edge is left without a node, none goes by itself.

    The number of hotspots that fit has a closed form; nodes are tried from none to all over a unit's few kept edges.
    """
    all_, *_ = _fitted(units, nodes, edges, hotspots, max_nodes, max_edges, max_hotspots)
    tokens = 40 + 4 * F.col("k") + 4 * F.col("e") + 6 * F.col("g")
    return all_.select("unit", F.col("k").alias("nodes"), F.col("e").alias("edges"), F.col("g").alias("hotspots"), tokens.alias("tokens"), (F.col("cut") | (F.col("k") < F.col("n")) | (F.col("g") < F.col("h"))).alias("truncated"))


def scaffold_rows(units: DataFrame, nodes: DataFrame, edges: DataFrame, hotspots: DataFrame, max_nodes: int = 25, max_edges: int = 20, max_hotspots: int = 10) -> DataFrame:
    """What `scaffolds` keeps, as rows (unit, kind, nth, id, other, score, truncated): nodes by importance, edges (from id to
    other) in order, hotspots by complexity, each numbered from 1. All units go through at once, from one table of edges; a
    unit that keeps nothing has no row."""
    all_, n, e, h = _fitted(units, nodes, edges, hotspots, max_nodes, max_edges, max_hotspots)
    cut = all_.select("unit", "k", "g", (F.col("cut") | (F.col("k") < F.col("n")) | (F.col("g") < F.col("h"))).alias("truncated"))
    none = F.lit(None).cast("string")
    parts = [
        n.join(cut, "unit").where("rk <= k").select("unit", F.lit("node").alias("kind"), "rk", F.col("id").cast("string").alias("id"), none.alias("other"), F.col("importance").cast("double").alias("score"), "truncated"),
        e.join(cut, "unit").where("need <= k").select("unit", F.lit("edge").alias("kind"), "rk", F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("other"), F.lit(None).cast("double").alias("score"), "truncated"),
        h.join(cut, "unit").where("rk <= g").select("unit", F.lit("hotspot").alias("kind"), "rk", F.col("path").cast("string").alias("id"), none.alias("other"), F.col("complexity").cast("double").alias("score"), "truncated"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # a unit has at most the caps' rows of each kind
    nth = F.row_number().over(Window.partitionBy("unit", "kind").orderBy("rk"))
    return every.withColumn("nth", nth).select("unit", "kind", "nth", "id", "other", "score", "truncated")


def prompt_rows(units: DataFrame, nodes: DataFrame, edges: DataFrame, hotspots: DataFrame) -> DataFrame:
    """The rows that a fix prompt prints for each unit (unit): its own caps and budget, of the kept edges the first six, of
    the kept nodes the five most important ones."""
    rows = scaffold_rows(units.select("unit").withColumn("budget", F.lit(PROMPT_BUDGET)), nodes, edges, hotspots, **PROMPT)
    most = F.when(F.col("kind") == "edge", PRINTED_EDGES).when(F.col("kind") == "node", PRINTED_NEIGHBOURS).otherwise(PROMPT["max_hotspots"])
    return rows.where(F.col("nth") <= most)


def first_words(nodes: DataFrame, hotspots: DataFrame, most_nodes: int = 15, most_hotspots: int = 10) -> DataFrame:
    """What a planner is shown: the most important nodes, then the most complex files, in this order."""
    top = lambda rows, by, id_, kind, most: rows.orderBy(F.desc(by), "ord").limit(most).select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(by).cast("double").alias("score"))
    return top(nodes, "importance", "id", "node", most_nodes).unionByName(top(hotspots, "complexity", "path", "hotspot", most_hotspots))


def issues_recommended(ids: DataFrame, issues: DataFrame) -> DataFrame:
    """Recommended issue ids (issue_id) with the first issue of the id; an unknown one keeps nulls."""
    return ids.join(keep_first(issues, ["id"], ["ord"]).withColumnRenamed("id", "issue_id").drop("ord"), "issue_id", "left")
