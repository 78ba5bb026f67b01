"""Globs as columns: each is made a regular expression once, by replacements of text, and matched where it stands.

`*` is any run within a part of a path, `?` one character of it, `**` any run across parts (`**/` also none), `{a,b}` one of
several, `[abc]` and `[!abc]` one character of a set; all else stands for itself. A glob matches a whole path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make a path more than the name of one file.
MARKS = r"[*?\[]"


def regex(glob: Column) -> Column:
    """A glob's regular expression; null stays null."""
    text = F.regexp_replace(glob, r"([\\.+^$()|])", r"\\$1")
    for mark, stands in (("**/", "\x01"), ("/**", "\x02"), ("**", "\x03"), ("*", "[^/]*"), ("?", "[^/]")):  # long ones first
        text = F.replace(text, F.lit(mark), F.lit(stands))
    text = F.regexp_replace(text, r"\[!", "[^")
    braces = r"\{([^{}]*)\}"
    text = F.transform(F.split(F.regexp_replace(text, braces, "\x04$1\x05"), "\x04"), lambda s: F.when(F.contains(s, F.lit("\x05")), F.concat(F.replace(F.substring_index(s, "\x05", 1), F.lit(","), F.lit("|")), F.lit(")"), F.regexp_replace(s, "^[^\x05]*\x05", ""))).otherwise(s))
    text = F.array_join(text, "(?:")
    for stands, what in (("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", ".*")):
        text = F.replace(text, F.lit(stands), F.lit(what))
    return F.concat(F.lit("(?s)^"), F.regexp_replace(text, r"([{}])", r"\\$1"), F.lit(r"\z"))


def matches(path: Column, glob: Column) -> Column:
    return F.rlike(path, regex(glob))


def concrete(path: Column) -> Column:
    """Whether a path names one file."""
    return ~F.rlike(path, F.lit(MARKS))


def collapsed(units: Column, about: Column) -> Column:
    """Units (array of structs with description and declaredPaths) of a milestone, made one if all files that they name by
    themselves are the same one; globs don't count. The one unit says what to do step by step, and on which file."""
    named = F.array_distinct(F.filter(F.flatten(F.transform(units, lambda u: F.coalesce(u["declaredPaths"], F.array().cast("array<string>")))), concrete))
    path = F.get(named, F.lit(0))
    steps = F.array_join(F.transform(units, lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(u["description"], F.lit("")))), "\n")
    first = units[0]
    own = F.when(F.coalesce(F.size(first["declaredPaths"]), F.lit(0)) > 0, first["declaredPaths"]).otherwise(F.array(path))
    one = first.withField("description", F.concat(about, F.lit(". All in "), path, F.lit(", one after another:\n"), steps)).withField("declaredPaths", own)
    return F.when((F.size(units) > 1) & (F.size(named) == 1), F.array(one)).otherwise(units)
