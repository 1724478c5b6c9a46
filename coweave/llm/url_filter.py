"""URL filters as sort-merge range joins over reversed-host keys, in DataFrame operations only.

A host's labels are reversed, so a rule's host and all its subdomains are one interval of keys; the paths that a rule's path
starts are one as well. Intervals of either kind nest or are disjoint, and a sorted sweep knows which are open.

1. Hosts: openings bring the stack of the rule hosts then open, the host's own and those around it (at most one for each label);
   closings bring back the stack around it. A URL takes the stack that the sweep carries and goes on once for each host in it.
2. Paths of one rule host: an opening brings its rule, a closing the rule around it. A URL takes the innermost, so no list of
   rules is carried or searched, however many a host has.
3. Of its hosts' rules a URL takes the longest.

A sweep runs in independent parts. URLs are dealt to them by a hash of the whole row, so one host's URLs spread over all parts,
and each part meets all rule events in sorted order. There are as many parts as shuffle partitions, or more where that leaves a part
at least as many URLs as there are rule events; so the copies of the rules stay below the rows. Rows that are equal in all of id,
host and path are judged once and given back as often as they occur.

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no rule; URLs of any length are used whole;
empty tables of URLs give no rows, of rules only default verdicts; rules with null host, path or verdict are left out; of equal
rules the greatest verdict wins (``block`` over ``allow``); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Sorts behind every string that continues a key.
_LAST = "\U0010ffff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.when(at > 0, path).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def clean_rules(rules: DataFrame) -> DataFrame:
    """key (of the host), host, path, verdict: each host and path once."""
    r = rules.select(*[F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict")]).dropna()
    return r.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))


def host_events(rules: DataFrame) -> DataFrame:
    """key, kind (0 opening, 2 closing), stack: the keys of the rule hosts open from there on."""
    nodes = rules.select("key").distinct().withColumn("l", F.split(F.expr("substring(key, 1, length(key) - 1)"), "\\."))
    outer = F.transform(F.sequence(F.lit(1), F.size("l")), lambda n: F.concat(F.array_join(F.slice("l", 1, n), "."), F.lit(".")))
    around = nodes.select("key", F.explode(outer).alias("outer")).join(nodes.select(F.col("key").alias("outer")), "outer")
    stacks = around.groupBy("key").agg(F.collect_list("outer").alias("stack"))
    closing = stacks.select(F.concat("key", F.lit(_LAST)).alias("key"), F.lit(2).alias("kind"), F.filter("stack", lambda x: x != F.col("key")).alias("stack"))
    return stacks.select("key", F.lit(0).alias("kind"), "stack").unionByName(closing)


def path_events(rules: DataFrame) -> DataFrame:
    """node (key of a rule host), path, kind, inner: the innermost rule open from there on; one without a name if there is none."""
    inner = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    r = rules.select(F.col("key").alias("node"), "path", inner.alias("inner"))
    starts = r.filter("path <> ''").select("node", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))).alias("outer"))
    around = starts.join(r.select("node", F.col("path").alias("outer"), F.col("inner").alias("outside")), ["node", "outer"]).groupBy("node", "path").agg(F.max("outside").alias("outside"))
    none = F.struct(F.lit(-1).alias("size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    closing = r.join(around, ["node", "path"], "left").select("node", F.concat("path", F.lit(_LAST)).alias("path"), F.lit(2).alias("kind"), F.coalesce("outside", none).alias("inner"))
    return r.select("node", "path", F.lit(0).alias("kind"), "inner").unionByName(closing)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict of each row."""
    rules = clean_rules(rules)
    if parts is None:
        parts = max(shuffle_partitions(pages.sparkSession), pages.count() // max(2 * rules.count(), 20_000))
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(parts)).cast("int"))

    def swept(rows: DataFrame, events: DataFrame, order: list[str], carried: str) -> DataFrame:
        sweep = Window.partitionBy("salt").orderBy(*order, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = rows.withColumn("kind", F.lit(1)).unionByName(events.select("*", salts), allowMissingColumns=True)
        return both.withColumn(carried, F.last(carried, ignorenulls=True).over(sweep)).filter("kind = 1").drop("kind")

    by_host = swept(rows.withColumn("key", host_key(F.col("host"))), host_events(rules), ["key"], "stack")
    open_ = F.filter(F.coalesce("stack", F.array().cast("array<string>")), lambda x: F.startswith(F.col("key"), x))
    by_host = by_host.groupBy("salt", "page_id", "host", "path").agg(F.count(F.lit(1)).alias("times"), F.first(open_).alias("stack"))
    by_node = by_host.select("salt", "page_id", "host", "path", "times", F.explode_outer("stack").alias("node"))
    by_path = swept(by_node, path_events(rules), ["node", "path"], "inner")
    found = F.when(F.col("node").isNotNull() & F.col("inner.rule").isNotNull(), F.col("inner"))
    best = by_path.groupBy("salt", "page_id", "host", "path", "times").agg(F.max(found).alias("best"))
    each = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), each.alias("_each"))
    return out.drop("_each")
