"""What a repository offers to work with: package manager, languages, frameworks, commands, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lock files in order of preference, and the managers they belong to.
LOCKS = [
    ("pnpm-lock.yaml", "pnpm"),
    ("yarn.lock", "yarn"),
    ("package-lock.json", "npm"),
    ("bun.lockb", "bun"),
    ("bun.lock", "bun"),
    ("Cargo.lock", "cargo"),
    ("poetry.lock", "poetry"),
    ("uv.lock", "uv"),
    ("go.sum", "go"),
]
# Scripts of a manifest that stand for a kind of command, in order of preference.
SCRIPTS = [
    ("test", ["test", "test:unit"]),
    ("typecheck", ["typecheck", "tsc"]),
    ("lint", ["lint"]),
    ("build", ["build"]),
    ("dev", ["dev", "start"]),
    ("e2e", ["test:e2e", "e2e"]),
]
# Languages by file ending.
LANGUAGES = [
    ("TypeScript", r"\.(ts|tsx)$"),
    ("JavaScript", r"\.(js|jsx|mjs|cjs)$"),
    ("Python", r"\.py$"),
    ("Rust", r"\.rs$"),
    ("Go", r"\.go$"),
]
# Frameworks by dependency, and by files at the root.
FRAMEWORKS = [
    ("React", "react", []),
    ("Next.js", "next", []),
    ("Vite", "vite", ["vite.config.ts", "vite.config.js"]),
    ("Fastify", "fastify", []),
    ("Express", "express", []),
    ("Vitest", "vitest", ["vitest.config.ts"]),
]
# Paths of packages within a repository, of settings and their templates, and of services.
PACKAGES, ENV, ENV_EXAMPLE, COMPOSE = r"^packages/[^/]+/package\.json$", r"(^|/)\.env$", r"(^|/)\.env(\.example|\.sample|\.template)$", "^docker-compose"
JS_MANAGERS = ["pnpm", "yarn", "bun"]
# What is said of a repository that lacks something.
NO_LOCK = "JavaScript package manifest found without a lockfile; dependency installs may be non-deterministic."
NO_ENV = "Environment file detected without a matching .env.example/.env.sample template."
NO_BUILD = "No obvious build or typecheck command was detected."
SERVICES = "Docker Compose files detected; some verification commands may require local services."
NO_TEST = "No obvious test command was detected."


def profiles(files: DataFrame, key: str = "repo") -> DataFrame:
    """One profile a repository from its files (key, path, content; content is only read of the root package.json).

    Files are reduced to flags by partial aggregation, so a repository of any number of files is no hot group; only its
    lock files are gathered. A manifest that is no JSON object counts as missing.
    """
    path = F.col("path")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    rooted = ["Cargo.toml", "go.mod", "pyproject.toml", "pytest.ini", "pnpm-workspace.yaml", "turbo.json", "nx.json", *[n for n, _ in LOCKS], *[f for _, _, fs in FRAMEWORKS for f in fs]]
    flags = {f"at {n}": some(path == n) for n in rooted} | {f"in {n}": some(path.rlike(p)) for n, p in LANGUAGES}
    flags |= {"packages": some(path.rlike(PACKAGES)), "env": some(path.rlike(ENV)), "env_example": some(path.rlike(ENV_EXAMPLE)), "compose": some(path.rlike(COMPOSE))}
    lock = r"(^|/)(" + "|".join(n.replace(".", r"\.") for n, _ in LOCKS) + ")$"
    each = files.groupBy(key).agg(*[c.alias(n) for n, c in flags.items()], F.array_sort(F.collect_set(F.when(path.rlike(lock), path))).alias("lockfiles"), F.max(F.when(path == "package.json", F.col("content"))).alias("manifest"))
    kind = "STRUCT<scripts: MAP<STRING, STRING>, dependencies: MAP<STRING, STRING>, devDependencies: MAP<STRING, STRING>>"
    valid = F.coalesce(F.expr("schema_of_variant(try_parse_json(manifest)) LIKE 'OBJECT%'"), F.lit(False))
    each = each.withColumn("js", valid).withColumn("m", F.when(valid, F.from_json("manifest", kind)))
    at = lambda n: F.col(f"`at {n}`")
    manager = F.coalesce(*[F.when(at(n), m) for n, m in LOCKS])
    each = each.withColumn("manager", manager)
    has = lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    dep = lambda k: has(F.col("m.dependencies"), k) | has(F.col("m.devDependencies"), k)
    kept = lambda *parts: F.array_compact(F.array(*parts))
    languages = kept(*[F.when(F.col(f"`in {n}`"), n) for n, _ in LANGUAGES])
    frameworks = kept(*[F.when(_any([dep(d), *[at(f) for f in fs]]), n) for n, d, fs in FRAMEWORKS])
    monorepo = at("pnpm-workspace.yaml") | at("turbo.json") | at("nx.json") | F.col("packages")
    each = each.withColumns({"languages": languages, "frameworks": frameworks, "monorepo": monorepo, "commands": _commands(at)})
    named = lambda *names: F.exists("commands", lambda c: c["name"].isin(*names))
    js_lock = F.exists("lockfiles", lambda f: f.rlike(r"pnpm-lock\.yaml|yarn\.lock|package-lock\.json|bun\.lockb|bun\.lock"))
    warnings = kept(
        F.when(F.col("js") & ~js_lock, F.lit(NO_LOCK)),
        F.when(F.col("env") & ~F.col("env_example"), F.lit(NO_ENV)),
        F.when(F.col("js") & ~named("build", "typecheck"), F.lit(NO_BUILD)),
        F.when(F.col("compose"), F.lit(SERVICES)),
    )
    language = F.when(F.array_contains("languages", "TypeScript"), "TypeScript").otherwise(F.get("languages", F.lit(0)))
    profile = F.concat_ws(" ", language, F.when(F.col("monorepo"), "monorepo").otherwise("project"), F.get("frameworks", F.lit(0)))
    return each.select(key, profile.alias("profile"), F.col("manager").alias("package_manager"), "languages", "frameworks", "monorepo", "lockfiles", "commands", kept(F.when(~named("test"), F.lit(NO_TEST))).alias("blockers"), warnings.alias("warnings"), F.when(F.col("js") | (F.size("languages") > 0), "medium").otherwise("low").alias("confidence"))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def _commands(at) -> Column:
    """name, command, confidence and source, in order of discovery; no two have both name and command in common."""

    def row(name, command, confidence, source):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(name).alias("name"), lit(command).alias("command"), lit(confidence).alias("confidence"), lit(source).alias("source"))

    own = F.col("manager").isin(*JS_MANAGERS)
    install = F.when(own, F.concat("manager", F.lit(" install"))).otherwise("npm install")
    run = F.when(own, F.concat("manager", F.lit(" "))).otherwise("npm run ")
    rows = [F.when(F.col("js"), row("install", install, F.when(F.col("manager").isNotNull(), "high").otherwise("medium"), "package.json"))]
    for name, candidates in SCRIPTS:
        script = F.coalesce(*[F.when(F.col("m.scripts")[c].isNotNull(), c) for c in candidates])
        rows.append(F.when(F.col("js") & script.isNotNull(), row(name, F.concat(run, script), "high", "package.json")))
    rows += [F.when(at("Cargo.toml"), row("test", "cargo test", "high", "Cargo.toml")), F.when(at("Cargo.toml"), row("build", "cargo build", "high", "Cargo.toml"))]
    rows += [F.when(at("go.mod"), row("test", "go test ./...", "high", "go.mod")), F.when(at("go.mod"), row("build", "go build ./...", "medium", "go.mod"))]
    rows.append(F.when(at("pyproject.toml") | at("pytest.ini"), row("test", "pytest", "medium", F.when(at("pytest.ini"), "pytest.ini").otherwise("pyproject.toml"))))
    return F.array_compact(F.array(*rows))
