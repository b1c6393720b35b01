"""URL filters by a temporal join: dated list entries become validity intervals, captures meet those in force.

A list is a table of dated changes: from ``day`` on, ``rule`` (a host or a domain) is ``added`` or removed. The
latest change of a rule at or before a capture decides. A capture is looked up under its host and under each
domain above it. The interval join runs on the rule, so a host with very many captures would meet in one task;
captures are therefore spread over ``SALTS`` slices of each rule, and the short list is repeated for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard.llm.common import fresh

SALTS = 16
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The lower-cased host of a URL, empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 2)), F.lit("."))


def intervals(changes: DataFrame) -> DataFrame:
    """``list, rule, category, valid_from, valid_to`` from dated changes ``list, rule, category, day, added``.

    An entry holds from the day it is added to the rule's next change (open if there is none). Of changes on
    one day an addition wins; repeats merge. Rows without list, rule or day are ignored.
    """
    known = changes.where("list IS NOT NULL AND rule IS NOT NULL AND day IS NOT NULL")
    daily = known.groupBy("list", "rule", "day").agg(
        F.max(F.coalesce("added", F.lit(False))).alias("added"), F.max(F.when(F.col("added"), F.col("category"))).alias("category")
    )
    following = F.lead("day").over(Window.partitionBy("list", "rule").orderBy("day"))
    return daily.withColumn("valid_to", following).where("added").select("list", "rule", "category", F.col("day").alias("valid_from"), "valid_to")


def rules_of(name: Column) -> Column:
    """The host *name* and all domains above it; no domain for an empty name."""
    labels = F.split(name, r"\.")
    each = F.sequence(F.lit(1), F.size(labels))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.transform(each, lambda k: F.array_join(F.slice(labels, -k, k), "."))
    )


def active_entries(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched", salts: int = SALTS) -> DataFrame:
    """*captures* with ``host, hits, lists, blocked``: the entries in force when each was fetched.

    ``lists`` holds the distinct names, sorted. A null or hostless URL and a null day have no hits. Every capture stays, once
    for each row; names that *captures* has already get underscores in front. What applies depends on host and day only, so
    the interval join works on their distinct pairs.
    """
    names = {n: fresh(captures, n) for n in ("host", "hits", "lists", "blocked")}
    keyed = captures.withColumn(names["host"], host(F.col(url_col)))
    pairs = keyed.select(F.col(names["host"]).alias("__host"), F.col(day_col).alias("__day")).where("__host <> '' AND __day IS NOT NULL").distinct()
    looked = pairs.select("__host", "__day", F.explode(rules_of(F.col("__host"))).alias("rule"))
    looked = looked.withColumn("salt", F.pmod(F.xxhash64("__host", "__day"), F.lit(salts)))
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    in_force = (F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    hits = looked.join(salted, ["rule", "salt"]).where(in_force).groupBy("__host", "__day").agg(
        F.count("*").alias("__hits"), F.array_sort(F.collect_set("list")).alias("__lists")
    )
    joined = keyed.join(hits, (keyed[names["host"]] == hits["__host"]) & (keyed[day_col] == hits["__day"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *[keyed[c] for c in keyed.columns],
        F.coalesce(hits["__hits"], F.lit(0)).cast("long").alias(names["hits"]),
        F.coalesce(hits["__lists"], none).alias(names["lists"]),
        hits["__hits"].isNotNull().alias(names["blocked"]),
    )
