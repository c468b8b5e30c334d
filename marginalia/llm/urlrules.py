"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is (host, path, verdict): it fits its host and all subdomains where the url's path starts with the rule's. The trie
walks a host from its last label; each node it passes may hold a second trie over path segments, whose nodes keep the
last, possibly unfinished, segment of the rules that end there. Of all rules that fit, the longest (host and path
together) decides, on equal length the one with the longer host; of one rule given twice, block.

Rules of at most `most_rules` rows and `most_bytes` characters, both counted, become one broadcast trie and the urls never
move. Larger rule tables are joined by the same keys: every host suffix with every cut of the path at a slash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"


class Trie:
    """Rules by number, found along reversed host labels, then along path segments."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.root: dict = {}
        for n, (host, path) in enumerate(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            node.setdefault("ends", {})[last] = n
        self._seen: dict[str, list[dict]] = {}

    def paths(self, host: str) -> list[dict]:
        """The path tries of the nodes that a host passes."""
        found = self._seen.get(host)
        if found is None:
            node, found = self.root, []
            for label in reversed(host.split(".")):
                node = node.get("." + label)
                if node is None:
                    break
                if "/" in node:
                    found.append(node["/"])
            if len(self._seen) > 50_000:
                self._seen.clear()
            self._seen[host] = found
        return found

    def longest(self, host: str, path: str) -> int | None:
        best, most = None, (-1, -1)
        nodes = self.paths(host)
        segments = path.split("/") if nodes else ()
        for node in nodes:
            for segment in segments:
                for last, n in node.get("ends", {}).items():
                    if segment.startswith(last):
                        h, p = self.rules[n]
                        if (len(h) + len(p), len(h)) > most:
                            best, most = n, (len(h) + len(p), len(h))
                node = node.get("/" + segment)
                if node is None:
                    break
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; empty where it is null or has no `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url_col: str = "url",
    otherwise: str = "allow",
    most_rules: int = 200_000,
    most_bytes: int = 8 << 20,
) -> DataFrame:
    """row (all columns as one), host, path, rule (host and path as one string, or null) and verdict of every row of `pages`.

    Rules with a null host, path or verdict do not count; hosts are given in lower case. A url that no rule fits gets the
    verdict `otherwise` and a null rule: null, empty and odd urls too, but for rules that fit their empty host or path.
    Very long urls are walked to the depth of the rules only. Repeated rows and ties are judged alike; no rows: no rows;
    no rules: `otherwise`. Columns of `pages` may have any names, they are kept inside `row`.
    """
    clean = rules.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict"))).dropna()
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater word
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    few = clean.limit(most_rules + 1).agg(F.count(F.lit(1)), F.sum(F.length("host") + F.length("path"))).first()
    if few[0] <= most_rules and (few[1] or 0) <= most_bytes:
        found = _by_trie(urls, clean)
    else:
        found = _by_join(urls, clean)
    return found.select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def _by_trie(urls: DataFrame, rules: DataFrame) -> DataFrame:
    known = [tuple(r) for r in rules.orderBy("host", "path").collect()]
    if not known:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    shared = urls.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("int")
    def walk(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = Trie([r[:2] for r in shared.value])
        for hosts, paths in batches:
            yield pa.array(map(trie.longest, hosts.to_pylist(), paths.to_pylist()), pa.int32())

    # the number is looked up in a map of the same bound as the trie
    at = urls.withColumn("_n", walk("host", "path"))
    table = urls.sparkSession.createDataFrame([(n, h + p, v) for n, (h, p, v) in enumerate(known)], "_n int, rule string, verdict string")
    return at.join(F.broadcast(table), "_n", "left")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by hash joins: a rule is keyed by its host and its path up to the last slash; the rest is compared."""
    keyed = rules.select(
        F.col("host").alias("_h"),
        F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("_p"),
        F.col("path").alias("_path"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    # no host suffix of more labels and no cut of more segments than the rules have can fit
    deep = keyed.agg(F.max(F.size(F.split("_h", r"\."))), F.max(F.size(F.split("_p", "/")))).first()
    one = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    from_ = F.greatest(F.lit(1), F.size(labels) - deep[0] + 1)
    suffixes = F.transform(F.sequence(from_, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    cuts = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deep[1])) - 1),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")),
    )
    at = one.select("host", "path", F.explode(suffixes).alias("_h"), cuts.alias("_cuts"))
    at = at.join(keyed.select("_h").distinct(), "_h", "left_semi").select("host", "path", "_h", F.explode("_cuts").alias("_p"))
    fits = at.join(keyed, ["_h", "_p"]).where(F.col("path").startswith(F.col("_path")))
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("_h"))).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select("row", "host", "path", "best.rule", "best.verdict")
