"""Allow and block rules on URL prefixes, by a sort-merge range join.

A rule names a host and a path prefix; it holds for the host, all its
subdomains and every path that begins with its own. With the host's labels
reversed, a rule's canonical key (``com.example./en/``) turns "begins with"
into an interval of keys. A host lies below at most as many rule hosts as it
has labels, so a URL becomes one point per enclosing rule host (equal-key
semi-join), and within each rule host the path intervals are nested or
disjoint. Rule starts, rule ends and points are then sorted together by key
and swept once: a start puts its rule on top of the stack of active rules, an
end gives the top back to the rule that encloses it, and a point takes the
top, the longest active rule of that host. The longest over the rule hosts
wins; of equally long ones the one with the longer host.

The rule that encloses another is the longest rule equal to a proper prefix of
its key (an equal-key join on the rules alone), so the sweep needs no state
but "the last boundary's top", a window function. Points are distinct (host,
path) pairs, so a popular URL is one point, and each rule host's points are
dealt over ``SALTS`` sweeps, each with that host's boundaries, so that a rule
on a whole top-level domain is not one task's work.

Only DataFrame functions are used. Defined results: null or a text without
``://`` has an empty host and path and takes the default verdict, as every URL
that no rule fits; an empty rule table leaves all URLs to the default; of
rules repeated with several verdicts block wins; extra columns pass through,
and columns named like an output are replaced; a very long URL is compared
whole; an empty table of pages gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Sorts after every path character.
_END = "\U0010ffff"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _suffixes(host: Column) -> Column:
    """The host and all hosts it is a subdomain of."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _with_parents(rules: DataFrame) -> DataFrame:
    """Rules with the enclosing rule of the same host: its path and verdict."""
    prefixes = rules.select(
        F.col("r_host").alias("p_host"),
        F.col("r_path").alias("p_child"),
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length("r_path")), lambda i: F.col("r_path").substr(F.lit(1), i))
        ).alias("p_path"),
    ).filter(F.col("p_path") != F.col("p_child"))
    enclosing = (
        prefixes.join(
            rules, (F.col("r_host") == F.col("p_host")) & (F.col("r_path") == F.col("p_path")), "inner"
        )
        .groupBy("p_host", "p_child")
        .agg(F.max(F.struct(F.length("p_path").alias("n"), F.col("p_path").alias("path"), "r_verdict")).alias("up"))
    )
    return rules.join(
        enclosing, (F.col("r_host") == F.col("p_host")) & (F.col("r_path") == F.col("p_child")), "left"
    ).select(
        "r_host", "r_path", "r_verdict", F.col("up.path").alias("up_path"), F.col("up.r_verdict").alias("up_verdict")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", salts: int = SALTS) -> DataFrame:
    """``pages`` with host, path, rule (``host + path`` or null) and verdict.

    ``rules`` has the columns host, path and verdict."""
    made = ("host", "path", "rule", "verdict")
    base = pages.select(
        *[c for c in pages.columns if c not in made], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    clean = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max(F.col("verdict")).alias("r_verdict"))  # 'block' > 'allow'
    )
    nested = _with_parents(clean)
    points = (
        base.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(_suffixes(F.col("host"))).alias("r_host"))
        .join(clean.select("r_host").distinct(), "r_host", "left_semi")
    )
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    key = F.concat(reversed_host(F.col("r_host")), F.col("path"))
    nothing = F.lit(None).cast("string")
    top = "struct<path:string,verdict:string>"
    starts = nested.select(
        "r_host",
        salt.alias("salt"),
        F.concat(reversed_host(F.col("r_host")), F.col("r_path")).alias("key"),
        F.lit(0).alias("kind"),
        F.struct(F.col("r_path").alias("path"), F.col("r_verdict").alias("verdict")).alias("top"),
        nothing.alias("host"),
        nothing.alias("path"),
    )
    ends = nested.select(
        "r_host",
        salt.alias("salt"),
        F.concat(reversed_host(F.col("r_host")), F.col("r_path"), F.lit(_END)).alias("key"),
        # of ends at one place the inner rule's would be first; ends at one key cannot be of two rules
        F.lit(0).alias("kind"),
        F.struct(F.col("up_path").alias("path"), F.col("up_verdict").alias("verdict")).alias("top"),
        nothing.alias("host"),
        nothing.alias("path"),
    )
    marks = points.select(
        "r_host",
        F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
        key.alias("key"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(top).alias("top"),
        "host",
        "path",
    )
    sweep = Window.partitionBy("r_host", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        starts.unionByName(ends)
        .unionByName(marks)
        .withColumn("active", F.last("top", ignorenulls=True).over(sweep))
        .filter((F.col("kind") == 1) & F.col("active.path").isNotNull())
    )
    best = swept.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("r_host") + F.length("active.path")).alias("n"),
                F.length("r_host").alias("h"),
                F.concat("r_host", "active.path").alias("rule"),
                F.col("active.verdict").alias("verdict"),
            )
        ).alias("best")
    )
    found = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "best")
    joined = base.join(found, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return joined.select(
        *base.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
