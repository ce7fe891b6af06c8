"""URL allow and block rules by a sort-merge range join, in DataFrame operations only.

A rule (host, path) holds for its host and all subdomains of it where the url's path starts with the rule's.  With hosts written
from the last label to the first, every rule is one interval of the sorted keys (reversed host, path): all keys that start
with the rule's own.  A page has one key for each of its host's suffixes, as many as the deepest rule host has labels.

Pages are dealt by their hash to buckets, rules to every bucket; one sort of a bucket's keys, rules before pages, then is a
sweep.  Each rule start carries the stack of rules that are open there (itself and those it is nested in), and a page needs
only the stack of the last start before it: a rule open at the page was open there too.  The longest open rule wins.

A hot host or url spreads over all buckets.  Copies of rules are rules x buckets rows, as a broadcast would make, but on disk.

Null urls, and those without ``://``, have the empty host and path.  Of rules with the same host and path a block wins.  Repeated
pages give repeated rows.  Without rules every page gets the default.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING = "array<struct<total:int,depth:int,verdict:string,rule:string,rhost:string,rpath:string>>"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def open_rules(rules: DataFrame) -> DataFrame:
    """(rhost, path, stack): each rule start with the rules that are open there; ``rules`` has host, path, verdict."""
    own = (rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" after "allow"
           .withColumn("rhost", F.array_join(_reversed(F.col("host")), ".")))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("total"), F.length("host").alias("depth"), "verdict",
        F.concat("host", "path").alias("rule"), "rhost", F.col("path").alias("rpath")).alias("entry")
    outer = own.select(F.col("rhost").alias("orhost"), F.col("path").alias("opath"), entry)
    return (own.select("rhost", "path").join(outer, (F.col("rhost") == F.col("orhost")) & F.col("path").startswith(F.col("opath")))
            .groupBy("rhost", "path").agg(F.collect_list("entry").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow",
          buckets: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of every page; the rule is null where none holds and the default applies."""
    spark = pages.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    deepest = rules.agg(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")))).first()[0] or 1
    page = (pages.select(pages[key].alias("key"), pages[url].alias("url"))
            .select("key", F.pmod(F.xxhash64("key", "url"), F.lit(buckets)).cast("int").alias("bucket"),
                    F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    labels = _reversed(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))),
                           lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    keys = page.select("bucket", F.explode(suffixes).alias("rhost"), "path", F.lit(1).alias("kind"),
                       F.lit(None).cast(NOTHING).alias("stack"), "key", "row", "host")
    starts = open_rules(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "rhost", "path", F.lit(0).alias("kind"), "stack",
        F.lit(None).cast(keys.schema["key"].dataType).alias("key"), F.lit(None).cast("long").alias("row"),
        F.lit(None).cast("string").alias("host"))
    sweep = Window.partitionBy("bucket").orderBy("rhost", "path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (keys.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
             .filter("kind = 1")
             .select("bucket", "key", "row", "host", "path", F.array_max(F.filter(
                 "open", lambda x: (x["rhost"] == F.col("rhost")) & F.col("path").startswith(x["rpath"]))).alias("best")))
    return (swept.groupBy("bucket", "row", "key", "host", "path").agg(F.max("best").alias("best"))
            .select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
