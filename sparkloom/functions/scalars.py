"""Scalars of review and work-item texts, as column expressions: all stay in generated code, none is a UDF.

Nulls give nulls unless a function says otherwise; lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word patterns of work that takes longer, tried in this order, and the time limits of each in ms.
WORK_KINDS = (
    ("test", "test|vitest|jest|playwright|cypress|pytest|cargo test|go test|e2e|integration"),
    ("build", "build|compile|bundle|install|migration|codegen|generate|docker"),
    ("analysis", "analy[sz]e|inventory|measure|audit|research|map|hotspot|complexity"),
)
LIMITS_MS = {"test": 600_000, "build": 600_000, "analysis": 600_000, "simple": 300_000}
# Which manifest an ecosystem's packages stand in; the first name that is part of the ecosystem counts.
MANIFESTS = (
    ("npm", "package.json"),
    ("node", "package.json"),
    ("pypi", "requirements.txt"),
    ("python", "requirements.txt"),
    ("cargo", "Cargo.toml"),
    ("rust", "Cargo.toml"),
    ("go", "go.mod"),
    ("maven", "pom.xml"),
    ("java", "pom.xml"),
    ("nuget", "Directory.Build.props"),
)
# Failures of a start that would only fail again, and commands that may be run.
HOPELESS = r"(?i)unable to register (?:%s )?model|no such provider|requires (unitId|contractId)|model resolution failed"
SAFE_COMMAND = r'^[a-zA-Z0-9_./-]+(?: [a-zA-Z0-9_./=:"-]+)*\z'
# What is taken off a model's answer, and what begins its headings.
THOUGHTS = r"(?is)<think.*?</think>\s*"
FENCE_BEFORE, FENCE_AFTER = r"(?i)^```(?:markdown|text|plaintext)?\s*", r"\s*```\z"
HEADING = r"(?m)^#{1,6}\s+\S"
PREAMBLE = r"(?i)^(?:refined\s+mission\s+(?:description|brief)\s*:?|here\s+is[^:\n]*:?|sure!?\s*,?\s*here[^:\n]*:?)\s*\n+"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sanitized(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def without_scope(name: Column) -> Column:
    return F.regexp_replace(name, "^@[^/]+/", "")


def first_given(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def issue_id(severity: Column, package: Column, version: Column, catalog_id: Column, finding_type: Column, finding: Column) -> Column:
    """A package finding's id; an empty catalog id gives way to the finding's type, and that to a plain word."""
    kind = F.coalesce(F.nullif(catalog_id, F.lit("")), F.nullif(finding_type, F.lit("")), F.lit("finding"))
    return F.concat_ws("-", F.lit("package"), severity, *[sanitized(x) for x in (package, version, kind, finding)])


def age_ms(now: Column, ts: Column) -> Column:
    """Milliseconds since ts; a missing ts is infinitely old."""
    return F.coalesce((F.unix_millis(now) - F.unix_millis(ts)).cast("double"), F.lit(float("inf")))


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark)))


def title(text: Column, most: int = 80) -> Column:
    """The first line that is not blank, trimmed and cut; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.substring(F.get(lines, F.lit(0)), 1, most)


def context_query(text: Column, most: int = 32) -> Column:
    """The first distinct words of over two characters."""
    words = F.filter(F.split(text, "[^A-Za-z0-9_./-]+"), lambda w: F.length(w) > 2)
    return F.array_join(F.slice(F.array_distinct(words), 1, most), " ")


def provider(model: Column) -> Column:
    return F.split_part(model, F.lit("/"), F.lit(1))


def _repo(url: Column) -> Column:
    """Owner and name of a clone address; null unless it is https on the one host and has both."""
    path = F.regexp_extract(url, r"^(?i:https)://(?:[^/?#@]*@)?(?i:github\.com)(?::443)?/([^?#]*)", 1)
    parts = F.split(F.regexp_replace(path, r"\.git\z", ""), "/")
    return F.when((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != ""), F.slice(parts, 1, 2))


def clone_url(url: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), F.array_join(_repo(url), "/"), F.lit(".git"))


def clone_folder(url: Column) -> Column:
    return F.regexp_replace(F.array_join(_repo(url), "-"), "[^a-zA-Z0-9._-]", "-")


def modules(paths: Column) -> Column:
    """Distinct modules of an array of paths: what follows the last `src` without its ending, else the folder; the
    root file of a crate names none."""

    def of(path):
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        back = F.array_position(F.reverse(parts), "src").cast("int")
        at = F.size(parts) - back  # place of the last src, counted from 0
        under = F.when(back > 0, F.get(parts, at + 1))
        root = (under == "mod.rs") & F.get(parts, at + 2).isNull()
        return F.when(root, None).when(under.isNotNull(), F.regexp_replace(under, r"\.[^.]+$", "")).when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))

    return F.array_distinct(F.array_compact(F.transform(paths, of)))


def work_kind(description: Column, modules_: Column, paths: Column) -> Column:
    """test, build, analysis or simple, by the first pattern found in the unit's words."""
    text = F.lower(F.concat_ws(" ", description, modules_, paths))
    kind = F.when(F.lit(False), "")
    for name, words in WORK_KINDS:  # words end at ASCII letters, digits and underscores only, whatever Java's \b says
        kind = kind.when(text.rlike(f"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"), name)
    return kind.otherwise("simple")


def limit_ms(kind: Column, limits: dict[str, int] | None = None) -> Column:
    each = F.create_map(*[F.lit(x) for pair in (limits or LIMITS_MS).items() for x in pair])
    return each[kind].cast("long")


def most_ms(limit: Column) -> Column:
    """How far activity may extend a limit."""
    return F.greatest(limit * 4, limit + 600_000)


def manifest(source_file: Column, ecosystem: Column) -> Column:
    eco = F.lower(F.coalesce(ecosystem, F.lit("")))
    named = F.when(F.lit(False), "")
    for part, path in MANIFESTS:
        named = named.when(F.contains(eco, F.lit(part)), path)
    return F.coalesce(F.nullif(F.trim(source_file), F.lit("")), named, F.lit("package.json"))


def brief(answer: Column) -> Column:
    """A model's answer without reasoning, a fence around it, and talk before the first heading."""
    out = F.regexp_replace(answer, THOUGHTS, "")
    out = F.regexp_replace(F.regexp_replace(out, FENCE_BEFORE, ""), FENCE_AFTER, "")
    at = F.regexp_instr(out, F.lit(HEADING))
    plain = F.regexp_replace(out, PREAMBLE, "")
    return F.regexp_replace(F.when(at > 1, F.substring(out, at, F.length(out))).otherwise(plain), r"^\s+|\s+\z", "")


def lines(*parts: Column) -> Column:
    """Parts one below the other; null and empty ones leave no line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def sections(**parts: Column) -> Column:
    """Titled parts, a blank line between them; what is null or blank is left out with its title."""
    each = [F.when(F.trim(v) != "", F.concat(F.lit(f"## {k.replace('_', ' ')}\n"), v)) for k, v in parts.items()]
    return F.concat_ws("\n\n", *each)


def checks(commands: Column) -> Column:
    """Commands (array of name, command) that verify a change: test, typecheck and lint where they are known, else the
    first one of all, else none."""

    def first(name):
        return F.get(F.filter(commands, lambda c: c["name"] == name), F.lit(0))["command"]

    found = F.array_compact(F.array(*map(first, ("test", "typecheck", "lint"))))
    return F.coalesce(F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(F.get(commands, F.lit(0))["command"]))), F.array().cast("array<string>"))


def _tenths(x: Column) -> Column:
    """x >= 1 in tenths, ties of its exact value upwards: the fraction is an integer in units of 2^-52."""
    whole = F.floor(x).cast("long")
    fraction = ((x - whole) * F.lit(float(1 << 52))).cast("long")
    return whole * 10 + F.shiftright(fraction * 20 + F.lit(1 << 52), 53)


def compact_number(value: Column) -> Column:
    """Millions and thousands with one decimal, none if it is zero; smaller numbers with up to three."""
    v = value.cast("double")

    def short(x, unit):
        t = _tenths(x)
        whole, rest = F.floor(t / 10).cast("string"), (t % 10).cast("string")
        return F.concat(whole, F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), rest)), F.lit(unit))

    # thousandths of the binary value: rounding its shortest decimal form instead takes some fives up that lie below a half
    small = F.regexp_replace((F.round(v * 1000) / 1000).cast("decimal(12,3)").cast("string"), r"\.?0+$", "")
    return F.when(v >= 1_000_000, short(v / 1_000_000, "M")).when(v >= 1_000, short(v / 1_000, "K")).otherwise(small)


def elapsed(ms: Column) -> Column:
    """Hours, minutes and seconds, from the largest that is not zero; null if no time has passed."""
    s = F.floor(ms / 1000).cast("long")
    m = F.floor(s / 60).cast("long")
    h = F.floor(m / 60).cast("long")
    second, minute, hour = F.concat((s % 60).cast("string"), F.lit("s")), F.concat((m % 60).cast("string"), F.lit("m")), F.concat(h.cast("string"), F.lit("h"))
    return F.when(ms > 0, F.when(h > 0, F.concat_ws(" ", hour, minute, second)).when(m > 0, F.concat_ws(" ", minute, second)).otherwise(second))


def supply_label(total: Column, critical: Column, high: Column) -> Column:
    count = F.concat(total.cast("string"), F.when(total == 1, " supply-chain finding").otherwise(" supply-chain findings"))
    return F.concat_ws(" · ", count, F.when(critical > 0, F.concat(critical.cast("string"), F.lit(" critical"))), F.when(high > 0, F.concat(high.cast("string"), F.lit(" high"))))


def fixed(x: Column, places: int) -> Column:
    """x with so many places (1 to 6), by its exact binary value, ties away from zero: the fraction is taken as an integer
    in units of 2^-100, from its upper and lower half."""
    half, whole = F.lit(float(1 << 50)), F.floor(F.abs(x)).cast("long")
    fraction = F.abs(x) - whole
    upper = F.floor(fraction * half)
    lower = F.floor((fraction * half - upper) * half)
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    units = upper.cast("long").cast("decimal(16,0)") * F.lit(1 << 50).cast("decimal(16,0)") + lower.cast("long").cast("decimal(16,0)")
    shifted = F.call_function("div", units * F.lit(2 * 10**places).cast("decimal(8,0)") + big(1 << 100), big(1 << 101))
    carried = shifted >= 10**places
    rest = F.lpad(F.when(carried, 0).otherwise(shifted).cast("string"), places, "0")
    return F.concat(F.when(x < 0, "-").otherwise(""), (whole + F.when(carried, 1).otherwise(0)).cast("string"), F.lit("."), rest)


def rounded(x: Column, places: int = 0) -> Column:
    """Halves upwards, also below zero."""
    return F.floor(x * F.lit(10.0**places) + F.lit(0.5)) / F.lit(10.0**places)


def cost(given: Column, prompt: Column, completion: Column) -> Column:
    """A variant that is a number or holds one as `total`; a cost of zero is estimated from the tokens."""
    kind = F.schema_of_variant(given)
    number = lambda v, k: F.when(k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    total = F.try_variant_get(given, "$.total", "variant")
    paid = F.coalesce(number(given, kind), number(total, F.schema_of_variant(total)), F.lit(0.0))
    return F.when(paid == 0, prompt * F.lit(1e-7) + completion * F.lit(3e-7)).otherwise(paid)


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def burn_progress(burn_ms: Column, remaining_ms: Column) -> Column:
    """Percent of the burn time that is used; 0 without a burn time or with no end to it."""
    used = F.least(F.greatest((burn_ms - remaining_ms) * 100.0 / F.nullif(burn_ms, F.lit(0)), F.lit(0.0)), F.lit(100.0))
    return F.when((burn_ms > 0) & (F.abs(remaining_ms) < float("inf")), used).otherwise(F.lit(0.0))


def context_tokens(nodes: Column, edges: Column, hotspots: Column) -> Column:
    return nodes * 4 + edges * 4 + hotspots * 6 + 40


def backoff_ms(attempt: Column, most: int = 20) -> Column:
    """Wait before a reconnect; null once there have been too many."""
    return F.when(attempt < most, F.least(F.pow(F.lit(1.5), attempt) * 1000, F.lit(30_000.0)))


def valid_durations(window_ms: Column, burn_ms: Column) -> Column:
    finite = lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")) & (x > 0), F.lit(False))
    return finite(window_ms) & finite(burn_ms) & F.coalesce(burn_ms <= window_ms, F.lit(False))


def stamp(ms: Column, since: int = 946_684_800_000) -> Column:
    """ISO time of milliseconds; `live` where they are not a time from `since` on, which is the year 2000."""
    known = F.coalesce(ms >= since, F.lit(False))
    return F.when(known, F.date_format(F.timestamp_millis(F.when(known, ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("live")


def hopeless(message: Column, runtime: str = r"\w+") -> Column:
    """Whether a start that failed so would only fail again; `runtime` (a pattern) is what models are registered with."""
    return F.coalesce(message.rlike(HOPELESS % runtime), F.lit(False))


def safe_command(command: Column) -> Column:
    return F.coalesce(command.rlike(SAFE_COMMAND) & ~F.contains(command, F.lit("..")), F.lit(False))
