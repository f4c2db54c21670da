"""URL filtering against a list of (host, path) rules.

A rule fits its host and all subdomains when the URL's path starts with the rule's path. Every URL is expanded
into host-suffix and path-prefix expressions, but only of the shapes (labels in the host, characters in the
path) that some rule has, so that any path prefix can be a rule and long URLs cost no more than short ones.
Expressions meet rules on the first four bytes of a SHA-256; the full digest and then the texts themselves
confirm. The longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from broadloom.llm.common import ascii_lower

PREFIX_HEX = 8
ADDED = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))),
                      F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    tail = F.regexp_replace(_rest(url), "^[^/?#]*", "")
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(tail, "^[^?#]*", 0)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.locate("://", url) + 3, F.length(url))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` plus host, path, rule (or NULL) and verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict; rules with a NULL in any of them are void. The longest host plus path
    wins, ties go to the greater rule text and then the greater verdict. Repeated rows stay repeated; a NULL URL
    or one without ``://`` has an empty host and path and gets the default. Columns of ``df`` that bear one of
    the four added names are replaced. An empty rule table allows everything.

    The rows never leave their task before the final one-row-per-URL aggregate. A rule table that Spark can
    see to be small is broadcast by its own size rule, a larger one is joined by hash prefix, where adaptive
    execution splits prefixes shared by very many URLs.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                         F.col("verdict").alias("r_verdict")).dropna().filter("r_host <> ''")
    # One small row per shape: at most (labels in a host) x (characters in a path).
    shapes = rules.select(F.size(F.split("r_host", "\\.")).alias("l"), F.length("r_path").alias("p")).distinct().collect()
    keep = [c for c in df.columns if c not in ADDED]
    rows = df.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                     host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    shape_list = F.array(*[F.struct(F.lit(s["l"]).alias("l"), F.lit(s["p"]).alias("p")) for s in shapes]) if shapes \
        else F.lit(None).cast("array<struct<l:int,p:int>>")
    labels, length = F.size(F.split("host", "\\.")), F.length("path")
    expressions = rows.withColumn("s", F.explode_outer(
        F.filter(shape_list, lambda s: (s["l"] <= labels) & (s["p"] <= length)))).select(
        "id", "row", "host", "path",
        F.expr("substring_index(host, '.', -s.l)").alias("x_host"), F.expr("left(path, s.p)").alias("x_path"))
    expressions = expressions.withColumn("x", _digest(F.col("x_host"), F.col("x_path"))).withColumn(
        "x_key", F.substring("x", 1, PREFIX_HEX))
    rules = rules.withColumn("r", _digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "r_key", F.substring("r", 1, PREFIX_HEX))
    met = expressions.join(rules, (F.col("x_key") == F.col("r_key")) & (F.col("x") == F.col("r"))
                           & (F.col("x_host") == F.col("r_host")) & (F.col("x_path") == F.col("r_path")), "left")
    text = F.concat("r_host", "r_path")
    best = met.groupBy("id").agg(
        F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("r").isNotNull(), F.struct(F.length(text).alias("n"), text.alias("rule"),
                                                      F.col("r_verdict").alias("verdict")))).alias("best"))
    return best.select(*[F.col(f"row.`{c}`") for c in keep], "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
