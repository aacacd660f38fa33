"""URL rules, indexed by their rarest literal token. Only DataFrame functions; no shuffle of the pages.

A rule is a host and a path prefix ("example.org/es/"): it fits the host and all its subdomains where the URL's path
starts with the rule's. Of the rules that fit, the longest decides (of equally long ones, the greater string); a URL
that none fits gets the default verdict.

A rule without a host ("/ads/") fits every host, one without a path every path.

Every rule names tokens that a fitting URL must hold as a whole: its host's labels and the closed segments of its path.
One pass over the urls counts those tokens, and each rule is filed under its rarest; a rule that names none is filed under a
token that every URL holds. The index is a hash table in a literal: a URL looks up its own tokens, and only the rules found
there run their regular expressions. More than MAX_RULES rules are a table instead, to which the distinct hosts and paths
are joined by their tokens; the regular expressions run on the pairs that meet there.

Defined cases: a null url, or one without "://", has an empty host and path, no rule and the default verdict; hosts
are lower-cased in A-Z only; repeated rows each give a row; an empty table gives an empty one; an empty rule fits every URL;
columns of the names of the results, in any case of letters, are replaced, all others kept.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import unused

#: Rules in the literal.
MAX_RULES = 20_000

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "array<array<struct<token:string,regex:string,size:int,rule:string,verdict:string>>>"


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


ANY = "*"


def _tokens(host: str, path: str) -> list[str]:
    """What a fitting URL has among its own tokens; the last path segment may go on in the URL."""
    return [*(f"h:{x}" for x in host.split(".") if x), *(f"p:{x}" for x in path.split("/")[1:-1])] or [ANY]


def _regex(host: str, path: str) -> str:
    plain = lambda s: "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in s)
    return (rf"^(?:[^/]*\.)?{plain(host)}" if host else "^[^/]*") + (plain(path) if path else "(?=/|$)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(ANY))))


def _counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """URLs that hold each token; as many rows as there are tokens of rules."""
    wanted = urls.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    held = urls.select(F.explode(_url_tokens("host", "path")).alias("t"))
    return dict(map(tuple, held.join(F.broadcast(wanted), "t", "left_semi").groupBy("t").count().collect()))


def _table(rules: list[tuple[str, str]], counts: dict[str, int]) -> tuple[Column, int]:
    n = 1 << max(2, len(rules).bit_length())
    slots: list[list[dict]] = [[] for _ in range(n)]
    for verdict, rule in rules:
        host, path = _parts(rule)
        token = min(_tokens(host, path), key=lambda t: (counts.get(t, 0), t))
        slots[zlib.crc32(token.encode()) % n].append({"token": token, "regex": _regex(host, path), "size": len(host + path), "rule": rule, "verdict": verdict})
    return F.from_json(F.lit(json.dumps(slots)), _ROW), n


def _best(table: Column, n: int) -> Column:
    """The longest rule of the table that fits; only rules filed under one of the URL's tokens are tried."""
    subject = F.concat("host", "path")
    fetched = F.flatten(F.transform(_url_tokens("host", "path"), lambda t: F.filter(F.element_at(table, (F.crc32(t) % n + 1).cast("int")), lambda r: r["token"] == t)))
    fitting = F.filter(fetched, lambda r: F.rlike(subject, r["regex"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _fitting(urls: DataFrame, rules: list[tuple[str, str]], counts: dict[str, int]) -> DataFrame:
    """host, path and best of the distinct hosts and paths that a rule fits. Tokens that many URLs hold have no rules unless
    these name no other, as rules are filed under their rarest."""
    rows = []
    for verdict, rule in rules:
        host, path = _parts(rule)
        rows.append((min(_tokens(host, path), key=lambda t: (counts.get(t, 0), t)), _regex(host, path), len(host + path), rule, verdict))
    filed = urls.sparkSession.createDataFrame(rows, "token string, regex string, size int, rule string, verdict string")
    places = urls.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(_url_tokens("host", "path")).alias("token")).join(filed, "token").filter(F.rlike(F.concat("host", "path"), F.col("regex")))
    return met.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", url: str = "url", most: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule and verdict after its own columns (of which those names, if there, are replaced)."""
    rules = list(dict.fromkeys(rules))
    host, path = host_and_path(F.col(url).cast("string"))
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    best = unused(pages.columns, "best")
    urls = pages.select(*own, host.alias("host"), path.alias("path"))
    wanted = {t for _, rule in rules for t in _tokens(*_parts(rule))} - {ANY}
    counts = (_counts(urls.select("host", "path"), wanted) if wanted else {}) | {ANY: 1 << 62}
    if len(rules) > most:
        out = urls.join(_fitting(urls, rules, counts).withColumnRenamed("best", best), ["host", "path"], "left")
    else:
        out = urls.withColumn(best, _best(*_table(rules, counts)) if rules else F.lit(None).cast("struct<size:int,rule:string,verdict:string>"))
    return out.select(*own, "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_HIT = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{v}' AS verdict, '{_parts(r)[0]}' AS rh, '{_parts(r)[1]}' AS rp, {len(r)} AS size" for v, r in RULES
)
OP2_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules AS ({_HIT}), fit AS (
  SELECT k, rule, verdict, row_number() OVER (PARTITION BY k ORDER BY size DESC, rule DESC) AS r
  FROM hp JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, 'allow') AS verdict
FROM hp LEFT JOIN fit ON hp.k = fit.k AND fit.r = 1
"""
