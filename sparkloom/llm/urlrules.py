"""URL filters: pattern rules indexed by their rarest literal token, fetched by the tokens of a URL.

A rule is (rule, pattern, verdict, tier). Patterns are matched against a URL's host and path, joined: `*` is any run of
characters, `^` a border (the start, the end, or a character that is no ASCII letter or digit), `|` at an end ties the
pattern to that end, and `||` at its start ties it to the host or one of its subdomains. A run of letters and digits that
the pattern closes off on both sides must stand in a matching URL as a whole token, whatever its case. Of these each rule
is indexed by the one that the fewest URLs hold; a rule without any is indexed by the empty token, which every URL has.
Only the rules that a URL's tokens fetch run their regular expression on it.

Of the rules that fit, the lowest tier decides; in tier 0 the longest rule, in later tiers a rule that allows before one
that blocks, then the longest; last the smaller name. No rule: the URL is allowed.

Edge cases: a null URL, or one without `://`, has an empty host and path, and is allowed unless a rule fits the empty
text; repeated URLs are judged once; a null page_id is kept; an empty table gives an empty result; other columns are
ignored. All steps are DataFrame functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of hosts and paths.
BASE = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words of hosts and paths that are not wanted, and what is wanted in spite of one.
UNWANTED = ["adult", "porn", "xxx", "casino", "poker", "bets", "betting", "pills", "viagra", "payday", "spam", "ads", "doubleclick", "warez", "torrent"]
WANTED = ["adult^education", "adult^literacy", "spam^filter", "torrent^river"]
#: Rules up to which the index is sent to every executor; a larger one is joined by shuffling.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BORDER = r"(?:^|[^0-9A-Za-z]|\z)"


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def rules(spark: SparkSession) -> DataFrame:
    """The default rules: those of hosts and paths first, then words."""
    rows = [(r, "||" + r, v, 0) for r, v in BASE] + [(p, p, v, 1) for v, words in (("block", UNWANTED), ("allow", WANTED)) for p in (f"^{w}^" for w in words)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("pattern"), F.lit(v).alias("verdict"), F.lit(t).alias("tier")) for r, p, v, t in rows])))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and both joined."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    host = _low(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("subject", F.concat("host", "path"))


def compiled(given: DataFrame) -> DataFrame:
    """Rules with their regular expression and the tokens that a matching URL must hold."""
    p = F.col("pattern")
    whole = F.when(F.startswith(p, F.lit("|")), p).otherwise(F.concat(F.lit("*"), p))
    whole = F.when(F.endswith(p, F.lit("|")), whole).otherwise(F.concat(whole, F.lit("*")))
    must = F.array_distinct(F.regexp_extract_all(_low(whole), F.lit(r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])"), F.lit(0)))
    body = F.regexp_replace(F.regexp_replace(p, r"^\|{1,2}", ""), r"\|$", "")
    body = F.regexp_replace(body, r"([\\.+?()\[\]{}$|])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(_BORDER))
    start = F.when(F.startswith(p, F.lit("||")), r"(?s)^(?:[^/]*\.)?").when(F.startswith(p, F.lit("|")), "(?s)^").otherwise("(?s)")
    end = F.when(F.endswith(p, F.lit("|")), r"\z").otherwise("")
    return given.select("rule", "pattern", "verdict", "tier", F.concat(start, body, end).alias("regex"), must.alias("must"))


def _tokens(subjects: DataFrame) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(_low(F.col("subject")), F.lit("[0-9a-z]+"), F.lit(0)))
    return subjects.select("subject", F.explode(F.array_append(found, F.lit(""))).alias("token"))


def indexed(made: DataFrame, subjects: DataFrame, small: bool) -> DataFrame:
    """Each rule once, under the token of its own that the fewest URLs hold."""
    own = made.select("rule", "pattern", F.explode(F.when(F.size("must") > 0, F.col("must")).otherwise(F.array(F.lit("")))).alias("token"))
    asked = own.where("token <> ''").select("token").distinct()
    held = _tokens(subjects).join(F.broadcast(asked) if small else asked, "token").groupBy("token").agg(F.count("*").alias("urls"))
    first = own.join(held, "token", "left").groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    return made.drop("must").join(first, ["rule", "pattern"])


def judged(pages: DataFrame, given: DataFrame) -> DataFrame:
    """page_id, host, path, tier, rule and verdict of every page."""
    small = given.count() <= BROADCAST_RULES
    made = compiled(given)
    known = parsed(pages)
    index = indexed(made, known.select("subject"), small)
    met = _tokens(known.select("subject")).join(F.broadcast(index) if small else index, "token").where(F.rlike("subject", F.col("regex")))
    order = F.struct("tier", ((F.col("tier") > 0) & (F.col("verdict") != "allow")).alias("late"), (-F.length("rule")).alias("size"), "rule", "verdict")
    best = met.groupBy("subject").agg(F.min(order).alias("best"))
    out = known.join(best, "subject", "left")
    return out.select("page_id", "host", "path", F.col("best.tier").alias("tier"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op12_urlrules(pages: DataFrame) -> DataFrame:
    """The base rule that decides, else the pattern of words that does."""
    out = judged(pages, rules(pages.sparkSession))
    of = lambda test: F.when(test, F.col("rule"))
    return out.select("page_id", "host", "path", of(F.col("tier") == 0).alias("rule"), "verdict", of(F.col("tier") > 0).alias("pattern"))


OP12_SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host FROM p),
q AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
base(host_end, path_start, verdict) AS (VALUES {", ".join(f"('{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in BASE)}),
words(word, verdict) AS (VALUES {", ".join([f"('{w}', 'block')" for w in UNWANTED] + [f"('{w}', 'allow')" for w in WANTED])}),
by_rule AS (
  SELECT host, path, arg_max(struct_pack(rule := host_end || path_start, verdict := verdict), length(host_end || path_start)) AS b
  FROM (SELECT DISTINCT host, path FROM q) JOIN base ON (host = host_end OR ends_with(host, '.' || host_end)) AND starts_with(path, path_start)
  GROUP BY host, path),
by_word AS (
  SELECT host, path, first(struct_pack(rule := '^' || word || '^', verdict := verdict) ORDER BY verdict, length(word) DESC, word) AS w
  FROM (SELECT DISTINCT host, path FROM q) JOIN words
  ON regexp_matches('/' || host || path || '/', '[^0-9A-Za-z]' || replace(word, '^', '[^0-9A-Za-z]') || '[^0-9A-Za-z]')
  GROUP BY host, path)
SELECT page_id, q.host, q.path, b.rule AS rule, coalesce(b.verdict, w.verdict, 'allow') AS verdict,
       CASE WHEN b IS NULL THEN w.rule END AS pattern
FROM q LEFT JOIN by_rule ON q.host = by_rule.host AND q.path = by_rule.path
LEFT JOIN by_word ON q.host = by_word.host AND q.path = by_word.path
"""
