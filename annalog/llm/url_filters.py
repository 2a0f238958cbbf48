"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression together with literal tokens that every URL it fits
must hold. The rule is filed under the one of them that the given URLs hold least
often; a URL's own tokens fetch candidate rules by an equality join, and only those
run their expression. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.common import broadcast_if_small, lower_ascii

TOKEN_BREAK = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`pattern` runs on host and path, joined. Among the fitting rules the highest
    `rank`, then the longest `name`, then block before allow, then the name decides."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int = 0
    named: bool = True


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits `host` and its subdomains where the path starts with `path`. A path's last
    word counts as a token only where the path goes on with a delimiter."""
    words = [w for w in re.split(TOKEN_BREAK, re.sub("[A-Za-z0-9]+$", "", host + path)) if w]
    pattern = r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    return Rule(host + path, pattern, tuple(dict.fromkeys(words)), verdict, rank=1)


def word_rule(verdict: str, word: str) -> Rule:
    """Fits where `word` stands alone in host or path, in any case."""
    pattern = f"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)"
    return Rule(word, pattern, (word,), verdict, rank=0, named=False)


# Fixed rules of the query.
SITE_RULES = [
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
]

# What the method itself judges where no site rule fits.
WORD_RULES = [
    word_rule("block", w) for w in ("casino", "poker", "viagra", "cialis", "porn", "xxx", "escort", "payday")
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
    Path: from there up to `?`, `#` or the end. Both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_index(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, name, pattern, verdict, rank, named): each rule under the token of its
    own that is rarest in `tokens` (column `token`, lower case); ties go to the
    smaller token."""
    spark = tokens.sparkSession
    rows = [
        (t.lower(), r.name, r.pattern, r.verdict, r.rank, r.named) for r in rules for t in r.tokens
    ]
    given = spark.createDataFrame(
        rows, "token string, name string, pattern string, verdict string, rank int, named boolean"
    )
    asked = broadcast_if_small(given.select("token").distinct(), len(rows))
    counts = tokens.join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    counted = given.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = F.struct("n", "token")
    return counted.groupBy("name", "pattern", "verdict", "rank", "named").agg(
        F.min(key)["token"].alias("token")
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule, matched, verdict.

    `matched` names the deciding rule; `rule` does so for rules with `named` only.
    A null or odd url has an empty host and path and gets `default`; repeated rows are
    judged each; null ids stay; other columns are not read. Without pages or rules the
    result is empty or all `default`.

    A page's tokens and its end marker are exploded and grouped again by a row number
    of the scan, so the rows of a page meet before the only shuffle, which carries one
    row a page."""
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(
        F.col(id_column).alias("id"),
        host.alias("host"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    site = F.concat("host", "path")
    words = F.array_distinct(F.split(F.lower(site), TOKEN_BREAK, -1))
    tokens = rows.select(F.explode(words).alias("token")).where("token <> ''")
    index = broadcast_if_small(rule_index(tokens, rules), len(rules))

    # The empty token is in no rule: it keeps pages without candidates.
    asked = rows.select(
        "row", "id", "host", "path", F.explode(F.array_union(words, F.array(F.lit("")))).alias("token")
    )
    fits = (asked["token"] == index["token"]) & F.regexp_like(
        F.concat(asked["host"], asked["path"]), index["pattern"]
    )
    found = asked.join(index, fits, "left")
    order = F.when(
        F.col("name").isNotNull(),
        F.struct("rank", F.length("name").alias("len"), "verdict", "name", "named"),
    )
    best = found.groupBy("row", "id", "host", "path").agg(F.max(order.alias("o")).alias("best"))
    return best.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.when(F.col("best.named"), F.col("best.name")).alias("rule"),
        F.col("best.name").alias("matched"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
