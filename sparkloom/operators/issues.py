"""Issues isolated from a repository's summary: fourteen generators over its packages, graph, hotspots, modules, entry points,
readiness and mutation score, in one ranked list with the files and modules that each concerns.

Relations carry their source order in `ord`. What several generators read is stored once. Lists of findings and cycles
may be long; all other generators give a few rows, or one for a module.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.scalars import manifest
from sparkloom.operators import graph, ordered
from sparkloom.operators.ranges import checkpointed, spread

# Order of the categories, and tiers of severities.
CATEGORIES = ["security", "critical_path", "dead_code", "test_coverage", "coupling", "layer_violation", "structure", "performance", "complexity", "documentation", "naming", "style"]
SEVERITIES = {"critical": 0, "high": 1, "medium": 2, "low": 4}
# Names of modules by what they hold, and of naming styles.
UI, DATA = "(?i)^(components?|pages?|views?|ui|frontend)", "(?i)^(api|services?|hooks?|data|backend|server)"
TESTS, NO_SOURCE = "(?i)^(test|tests|spec|specs|__tests__)", "(?i)^(test|tests|spec|specs|__tests__|node_modules|dist|build|[.])"
STYLES = ["^[a-z]+(-[a-z]+)+$", "^[a-z]+[A-Z]", "^[A-Z]"]


@dataclass(frozen=True)
class Bars:
    """From where on something is an issue, and how many of a kind are reported."""

    scope: int = 3
    complexity: int = 45
    high_complexity: int = 60
    complex_files: int = 5
    files_considered: int = 20
    orphans: int = 5
    module_share: float = 0.3
    module_files: int = 20
    tested: float = 0.2
    symbols: int = 50
    documented: int = 2
    density: float = 5
    guided_files: int = 15
    mutation: float = 60
    low_mutation: float = 40


@dataclass
class Review:
    """packages (ord, name, bare, version, source_file, ecosystem), catalog (entry, package, versions, severity), cycles (cycle,
    segments), hotspots (ord, path, module, complexity, symbols), nodes (ord, id, module, importance), edges (ord, src, dst),
    modules (ord, name, files), entries (ord, entry), readiness (ord, kind, text), mutation (score, one row or none)."""

    packages: DataFrame
    catalog: DataFrame
    cycles: DataFrame
    hotspots: DataFrame
    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame
    entries: DataFrame
    readiness: DataFrame
    mutation: DataFrame
    bars: Bars = field(default_factory=Bars)


def _none() -> Column:
    return F.array().cast("array<string>")


def _issue(rows: DataFrame, gen: int, category: str, tier, title: Column, paths: Column | None = None, modules: Column | None = None, ord_: Column | None = None) -> DataFrame:
    """gen, ord, tier, category, title, paths, modules; the modules of paths are looked up later where none are given."""
    tier = F.lit(tier) if isinstance(tier, int) else tier
    return rows.select(F.lit(gen).alias("gen"), (F.lit(0) if ord_ is None else ord_).cast("long").alias("ord"), tier.cast("int").alias("tier"), F.lit(category).alias("category"), title.alias("title"), (_none() if paths is None else paths).alias("paths"), (_none() if modules is None else modules).alias("modules"))


def _found(r: Review) -> DataFrame:
    """Packages that the catalog names, whole or bare, in a version it lists."""
    met = graph.catalog_matches(F.broadcast(r.catalog), r.packages)
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), F.col("severity"))
    title = F.concat(F.when(F.col("severity") == "critical", "Remove or upgrade ").otherwise("Audit "), F.col("name"), F.lit("@"), F.col("version"))
    # one order for (entry, package): entries are few
    return _issue(met, 1, "security", tier, title, F.array(manifest(F.col("source_file"), F.col("ecosystem"))), None, F.col("entry").cast("long") * (1 << 40) + F.col("ord"))


def _cycles(r: Review) -> DataFrame:
    some = r.cycles.where(F.size("segments") > 0)
    paths = graph.cycle_paths(some, r.nodes, r.edges, r.bars.scope).groupBy("cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))
    met = some.join(spread(paths), "cycle", "left")
    return _issue(met, 2, "critical_path", 0, F.concat(F.lit("Break cycle "), F.array_join("segments", " > ")), F.coalesce("paths", _none()), F.slice(F.array_distinct("segments"), 1, r.bars.scope), F.col("cycle"))


def _complex(r: Review) -> DataFrame:
    top = r.hotspots.where(F.col("complexity") > r.bars.complexity).orderBy(F.desc("complexity"), "ord").limit(r.bars.complex_files)
    place = F.row_number().over(Window.orderBy(F.desc("complexity"), "ord"))  # so few rows at any scale
    base = F.element_at(F.split("path", "/"), -1)
    return _issue(top.withColumn("place", place), 3, "complexity", F.when(F.col("complexity") > r.bars.high_complexity, 1).otherwise(2), F.concat(F.lit("Refactor "), base, F.lit(", complexity "), F.col("complexity").cast("string")), F.array("path"), F.array("module"), F.col("place"))


def _lead(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The first few names, in one row."""
    first = F.array_sort(F.collect_list(F.struct("ord", name)))
    return F.broadcast(rows.orderBy("ord").limit(most).agg(F.transform(first, lambda x: x[name]).alias("scope")))


def _modules(r: Review) -> list[DataFrame]:
    """Generators on modules: shares, layers, sizes, tests, names and guidelines."""
    b, one = r.bars, r.modules.groupBy()
    total = r.modules.agg(F.sum("files").alias("all"), F.count("*").alias("n"))
    wide = r.modules.join(F.broadcast(total), F.lit(True))  # one row of totals
    share = _issue(wide.where((F.col("n") > 1) & (F.col("files") > F.col("all") * b.module_share)), 5, "coupling", 2, F.concat(F.lit("Take one seam out of "), F.col("name")), None, F.array("name"), F.col("ord"))
    like = lambda pattern: F.rlike("name", F.lit(pattern))
    first = lambda pattern: F.min(F.when(like(pattern), F.struct("ord", "name")))["name"]
    layers = one.agg(F.count("*").alias("n"), first(UI).alias("ui"), first(DATA).alias("data")).where("n >= 3 and ui is not null and data is not null")
    layers = _issue(layers, 7, "layer_violation", 2, F.lit("Look for imports of data from the interface"), None, F.array("ui", "data"))
    large = _issue(r.modules.where(F.col("files") > b.module_files), 8, "structure", 4, F.concat(F.lit("Split "), F.col("name")), None, F.array("name"), F.col("ord"))
    files = lambda when: F.coalesce(F.sum(F.when(when, F.col("files"))), F.lit(0))
    tests = one.agg(files(like(TESTS)).alias("tests"), files(~like(NO_SOURCE)).alias("src")).where(f"(src > 10 and tests = 0) or (src > 0 and tests > 0 and tests / src < {b.tested})")
    tests = _issue(tests, 9, "test_coverage", 3, F.when(F.col("tests") == 0, "Add tests").otherwise("Add more tests"))
    some = F.array(*[F.max(F.when(like(s), 1).otherwise(0)) for s in STYLES])
    styles = one.agg(F.count("*").alias("n"), F.aggregate(some, F.lit(0), lambda a, x: a + x).alias("styles")).where("n > 2 and styles >= 2").join(_lead(r.modules, "name", b.scope), F.lit(True))
    styles = _issue(styles, 12, "naming", 5, F.concat(F.lit("Settle on one of "), F.col("styles").cast("string"), F.lit(" naming styles")), None, F.col("scope"))
    return [share, layers, large, tests, styles]


def entry_paths(r: Review) -> DataFrame:
    """ord, entry, resolved, known: what each entry point stands for, and whether that is a node or a hotspot."""
    nodes = r.nodes.select("id", F.col("importance").alias("score"), "ord")
    files = r.hotspots.select(F.col("path").alias("id"), F.col("complexity").alias("score"), "ord")
    return ordered.cascade(r.entries, "entry", nodes, files).select("ord", "entry", "resolved", F.col("stage").isNotNull().alias("known"))


def isolated(r: Review) -> DataFrame:
    """position, tier, category, gen, title, paths, modules of all issues: by tier, category, generator and order in it."""
    b = r.bars
    r.edges, r.hotspots, r.nodes = checkpointed(r.edges), checkpointed(r.hotspots), checkpointed(r.nodes)
    entries = checkpointed(entry_paths(r))
    first = checkpointed(reduce(DataFrame.unionByName, [_found(r), _cycles(r), _complex(r)]))
    scoped = first.select(F.explode("paths").alias("path"))
    base = F.element_at(F.split("path", "/"), -1)
    orphans = _issue(graph.orphan_files(r.hotspots, r.edges, scoped, entries, b.files_considered, b.orphans), 4, "dead_code", 1, F.concat(F.lit("Remove or confirm "), base), F.array("path"), F.array("module"), F.col("ord"))
    blocker = F.col("kind") == "blocker"
    short = F.concat(F.left("text", F.lit(60)), F.when(F.length("text") > 60, "…").otherwise(""))
    ready = r.readiness.select(F.lit(6).alias("gen"), (F.when(blocker, 0).otherwise(1 << 40) + F.col("ord")).cast("long").alias("ord"), F.when(blocker, 1).otherwise(2).alias("tier"), F.when(blocker, "documentation").otherwise("structure").alias("category"), F.concat(F.when(blocker, "Setup blocker: ").otherwise("Setup warning: "), short).alias("title"), F.array(F.lit("README.md")).alias("paths"), _none().alias("modules"))

    share, layers, large, tests, styles = _modules(r)
    mutants = _issue(r.mutation.where(F.col("score") < b.mutation), 14, "test_coverage", F.when(F.col("score") < b.low_mutation, 1).otherwise(2), F.concat(F.lit("Raise the mutation score of "), F.round("score").cast("int").cast("string")))
    # the entry points that are known of the first three, else the first files
    known = entries.orderBy("ord").limit(b.scope).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("ord", "resolved")))), lambda x: x["resolved"]).alias("own"))
    about = tests.unionByName(mutants).join(F.broadcast(known), F.lit(True)).join(_lead(r.hotspots, "path", b.scope), F.lit(True))
    about = about.withColumn("paths", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("scope"))).drop("own", "scope")

    symbols = r.hotspots.agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("s")).where(F.col("s") > b.symbols)
    public = entries.where("known").orderBy("ord").limit(b.documented).join(F.broadcast(symbols), F.lit(True))
    documented = _issue(public, 10, "documentation", 3, F.concat(F.lit("Document "), F.element_at(F.split("resolved", "/"), -1)), F.array("resolved"), None, F.col("ord"))

    files = r.nodes.agg(F.count("*").alias("files"))
    dense = r.edges.agg(F.count("*").alias("n")).join(files, F.lit(True)).where(F.col("n") > F.col("files") * b.density).where("files > 0")
    fan = r.edges.groupBy("src").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).orderBy(F.desc("n"), "ord").limit(b.scope).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "ord", "src"))), lambda x: x["src"]).alias("fan")).where(F.size("fan") > 0)
    density = _issue(dense.join(fan, F.lit(True)), 11, "performance", 4, F.concat(F.lit("Look at imports: "), F.format_string("%.1f", F.col("n") / F.col("files")), F.lit(" a file")), F.col("fan"))
    guided = r.modules.agg(F.count("*").alias("m")).join(files, F.lit(True)).where(f"m > 2 and files > {b.guided_files}")
    guide = _issue(guided, 13, "style", 5, F.lit("Write guidelines"), F.array(F.lit("CONTRIBUTING.md"), F.lit("README.md")))

    every = checkpointed(reduce(DataFrame.unionByName, [first, orphans, share, ready, layers, large, about, documented, density, styles, guide]))
    # the modules of the files that an issue names, for those that say no other; a cycle's own segments only where no file has one
    module = r.hotspots.groupBy("path").agg(F.min_by("module", "ord").alias("module"))
    asked = every.where(F.col("gen").isin(1, 2, 10, 11)).select("gen", "ord", "title", F.posexplode("paths").alias("at", "path"))
    met = asked.join(spread(module), "path").groupBy("gen", "ord", "title").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "module"))), lambda x: x["module"])), 1, b.scope).alias("_own"))
    out = every.join(spread(met), ["gen", "ord", "title"], "left").withColumn("modules", F.coalesce("_own", "modules")).drop("_own")
    out = out.withColumn("rank", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("long") - 1)
    placed = ordered.positions(checkpointed(out), ["tier", "rank", "gen"], "ord", ["title"])
    return placed.select("position", F.concat(F.lit("P"), F.col("tier").cast("string")).alias("tier"), "category", "gen", "title", "paths", "modules")
