"""Live sources: documents of a state service over HTTP, and commits and diffs of repositories.

Both are Spark data sources of their own. A path or a repository is a partition, so many are read side by side, each
task reading again what a lost executor had; nothing passes through the driver.
"""

from __future__ import annotations

import json
import subprocess
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Each(DataSourceReader):
    """One partition for each of `names`."""

    def __init__(self, names: list[str]):
        self.names = names

    def partitions(self):
        return [InputPartition((i, n)) for i, n in enumerate(self.names)] or [InputPartition((0, ""))]


class _StateReader(_Each):
    def __init__(self, options: dict):
        super().__init__(json.loads(options["paths"]))
        self.base, self.token, self.timeout = options["url"].rstrip("/"), options.get("token"), float(options.get("timeout", 30))
        self.query = urllib.parse.urlencode(json.loads(options.get("where", "{}")))

    def read(self, partition):
        _, path = partition.value
        if not path:
            return
        request = urllib.request.Request(f"{self.base}/{path.lstrip('/')}" + (f"?{self.query}" if self.query else ""), headers={"Accept": "application/json"})
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 404:  # a document that is not there is no row
                return
            raise
        for i, row in enumerate(found if isinstance(found, list) else [found]):
            if row is not None:
                yield path, i, json.dumps(row, ensure_ascii=False)


class StateSource(DataSource):
    """Lists and documents of a service: path, ord, value (JSON)."""

    @classmethod
    def name(cls):
        return "loom_state"

    def schema(self):
        return "path string, ord long, value string"

    def reader(self, schema):
        return _StateReader(dict(self.options))


class _GitReader(_Each):
    def __init__(self, options: dict):
        super().__init__(json.loads(options["repos"]))
        self.base, self.head = options["base"], options.get("head", "HEAD")
        for ref in (self.base, self.head):
            if ref.startswith("-"):
                raise ValueError(f"not a revision: {ref}")

    def _lines(self, repo: str, *what: str):
        with subprocess.Popen(["git", "-C", repo, *what, "--"], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as p:
            yield from (line.rstrip("\n") for line in p.stdout)
            why = p.stderr.read()
        if p.returncode:
            raise RuntimeError(f"git failed in {repo}: {why.strip()}")

    def read(self, partition):
        _, repo = partition.value
        if not repo:
            return
        for kind, what in (("commit", ("log", "--oneline", "--no-decorate", f"{self.base}..{self.head}")), ("diff", ("diff", f"{self.base}...{self.head}"))):
            for i, line in enumerate(self._lines(repo, *what)):
                yield repo, kind, i, line


class GitSource(DataSource):
    """What a head has that its base has not: repo, kind (commit or diff), ord, line. Checkouts lie where tasks run."""

    @classmethod
    def name(cls):
        return "loom_git"

    def schema(self):
        return "repo string, kind string, ord long, line string"

    def reader(self, schema):
        return _GitReader(dict(self.options))


def state(spark: SparkSession, url: str, paths: list[str], where: dict | None = None, token: str | None = None) -> DataFrame:
    """Rows of lists and single documents at `paths`, filtered by the service where it is given equalities."""
    spark.dataSource.register(StateSource)
    read = spark.read.format("loom_state").option("url", url).option("paths", json.dumps(paths)).option("where", json.dumps(where or {}))
    return (read.option("token", token) if token else read).load()


def looked_up(spark: SparkSession, url: str, index: str, document: str) -> DataFrame:
    """The documents that an index document lists: its ids are one bounded document; a missing one is no row."""
    ids = state(spark, url, [index]).selectExpr("trim(BOTH '\"' FROM value) AS id")
    return state(spark, url, [document.format(urllib.parse.quote(r["id"], safe="")) for r in ids.toLocalIterator()])


def changes(spark: SparkSession, repos: list[str], base: str, head: str = "HEAD") -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("loom_git").option("repos", json.dumps(repos)).option("base", base).option("head", head).load()
