"""URL filters: pattern rules under their rarest literal token; URL tokens fetch the rules that are then tried."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_BYTES = 32_000_000

_TOKEN = re.compile("[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains when the path starts with the rule's; `*` in the path is any run of characters."""

    host: str
    path: str
    verdict: str

    def __post_init__(self):
        # Hosts of URLs are compared in lower case.
        object.__setattr__(self, "host", self.host.lower())

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        path = ".*".join(re.escape(p) for p in self.path.split("*"))
        return rf"(?s)\A(?:[^/?#]*\.)?{re.escape(self.host)}(?=[/?#]|\Z){path}" if self.path else rf"(?s)\A(?:[^/?#]*\.)?{re.escape(self.host)}(?=/|\Z)"

    def literals(self) -> list[str]:
        """Tokens that every URL of the rule holds whole: those with a fixed sign, or the host's begin, on both sides."""
        found = _TOKEN.findall(self.host)
        for m in _TOKEN.finditer(self.path):
            before = self.path[m.start() - 1] if m.start() else ""
            after = self.path[m.end() : m.end() + 1]
            if after and after != "*" and before and before != "*":
                found.append(m.group())
        return found


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each listed token. The tokens are those of one block of rules, whose bytes are bounded, and so is
    what is broadcast and what comes back."""
    if not tokens:
        return {}
    wanted = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string"))
    found = urls.select(
        F.explode(F.array_distinct(F.split(F.concat("host", F.lit("\n"), "path"), "[^A-Za-z0-9]+"))).alias("token")
    )
    return {r["token"]: r["count"] for r in found.join(wanted, "token").groupBy("token").count().collect()}


def _better(a: Rule | None, b: Rule) -> Rule:
    """The longer rule; of equally long ones a block, then the first by name."""
    if a is None:
        return b
    return min(a, b, key=lambda r: (-len(r.name), r.verdict != "block", r.name))


class RuleIndex:
    """Rules by their rarest literal token; rules without one are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = {}
        self.always: list[tuple[re.Pattern, Rule]] = []
        for r in rules:
            entry = (re.compile(r.regex()), r)
            tokens = r.literals()
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        best, target = None, host + path
        for token in {*_TOKEN.findall(host), *_TOKEN.findall(path)} & self.by_token.keys():
            for pattern, rule in self.by_token[token]:
                if pattern.match(target):
                    best = _better(best, rule)
        for pattern, rule in self.always:
            if pattern.match(target):
                best = _better(best, rule)
        return best


def _blocks(rules: list[Rule], max_bytes: int) -> list[list[Rule]]:
    """Rule sets larger than the bound go over the URLs in blocks, each small enough to be sent to all tasks."""
    blocks, held = [[]], 0
    for r in rules:
        size = len(r.name.encode()) + 200
        if blocks[-1] and held + size > max_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(r)
        held += size
    return blocks


def url_verdicts(
    pages: DataFrame, rules: list[Rule], default: str = "allow", max_bytes: int = RULE_BYTES, columns: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """`columns` of pages plus host, path, rule and verdict; the longest fitting rule decides, else `default`.

    Each row is judged on its own, without a shuffle, so hot hosts cost nothing. A URL that is null or has no `://` has
    empty host and path. Rows that repeat stay; an empty table or rule list gives no rules. Further columns are ignored.
    """
    rules = sorted({*rules}, key=lambda r: (r.name, r.host, r.verdict))
    judged = pages.select(
        *[F.col(c) for c in columns], host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path")
    ).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    urls = judged.select("host", "path")
    for block in _blocks(rules, max_bytes) if rules else []:
        counts = token_counts(urls, sorted({t for r in block for t in r.literals()}))
        judged = _apply(judged, block, counts)
    return judged


def _apply(judged: DataFrame, rules: list[Rule], counts: dict[str, int]) -> DataFrame:
    shared = judged.sparkSession.sparkContext.broadcast((rules, counts))

    def run(batches):
        index = RuleIndex(*shared.value)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            old, said = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for i, (h, p) in enumerate(zip(hosts, paths)):
                best = index.best(h, p)
                if best is None:
                    continue
                if old[i] is not None:
                    held = Rule(old[i], "", said[i])
                    if _better(held, Rule(best.name, "", best.verdict)) == held:
                        continue
                old[i], said[i] = best.name, best.verdict
            names_ = batch.schema.names
            arrays = [
                pa.array(old, pa.string()) if n == "rule" else pa.array(said, pa.string()) if n == "verdict" else batch.column(n) for n in names_
            ]
            yield pa.RecordBatch.from_arrays(arrays, names_)

    return judged.mapInArrow(run, judged.schema)


# The rules of the query.
QUERY_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def op1_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, QUERY_RULES)


SQL = r"""
WITH u AS (
  SELECT page_id, position('://' IN coalesce(url, '')) AS place, coalesce(url, '') AS url FROM pages
), s AS (
  SELECT page_id, CASE WHEN place > 0 THEN substring(url, place + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM s
), r(h, pre, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path,
       (SELECT max_by(h || pre, length(h || pre)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS rule,
       coalesce((SELECT max_by(verdict, length(h || pre)) FROM r
                 WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)), 'allow') AS verdict
FROM p
"""
