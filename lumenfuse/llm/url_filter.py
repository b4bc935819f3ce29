"""URL filters by a temporal list join: each capture is judged by the list as it stood at fetch time.

Dated list entries (key, listed_at, action 'block' / 'allow' / 'drop') become validity intervals: an entry
holds from its date until the next entry of the same key.  A capture is looked up under its host, the
host's parent domains, and host plus leading path segments; an equi-join on the key with the fetch time
inside the interval is the as-of join.  The most specific active entry decides; 'drop' ends an entry.

The captures' side of the join may have one host on a third of the rows: it is a plain equi-join whose large
partitions AQE splits, and the list side is broadcast only after a check of its rows and bytes.  Paths are looked
up as deep as the deepest entry of the list.  Verdicts meet again
by capture through an aggregation with map-side combine.

DataFrame functions only.  Edge cases: a null or unparsable URL, a null fetch time and a key without
entries give verdict 'keep' with no rule; of several entries of one key and instant the strictest holds
(block, allow, drop); repeated captures are judged one by one; null keys or dates in the list are no entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfuse.llm.common import checked_broadcast, materialize

def host_of(url) -> F.Column:
    """Lower-case host without user, port and leading www; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    h = F.regexp_replace(h, r"^www\.|\.+$", "")
    return F.when(h != "", h)


def path_of(url) -> F.Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def lookup_keys(url, depth: int) -> F.Column:
    """array<struct<key, weight>>: host and parent domains (weight: number of labels), then host + path prefixes (weight: 1000 + segments)."""
    host, segments = host_of(url), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (F.size(labels) - i + 1).alias("weight")))
    deep = F.least(F.size(segments), F.lit(depth))
    paths = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("key"), (i + 1000).alias("weight"))))
    return F.when(host.isNotNull(), F.concat(domains, F.coalesce(paths, F.array().cast("array<struct<key:string,weight:int>>"))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): the list's history; valid_to null is still open."""
    strict = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    one = entries.where(F.col("key").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isNotNull())
    one = one.groupBy("key", "listed_at").agg(F.min_by("action", F.struct(strict, "action")).alias("action"))
    w = W.partitionBy("key").orderBy("listed_at")  # the entries of one key only
    return one.select("key", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(w).alias("valid_to")).where(F.col("action") != "drop")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", names: tuple[str, str] = ("verdict", "rule")) -> DataFrame:
    """``captures`` with verdict ('keep', 'block', 'allow') and rule (the key that decided) for each row, under ``names``.

    Columns of these names must not be there yet.
    """
    if clash := {c.lower() for c in captures.columns} & {c.lower() for c in names}:
        raise ValueError(f"there are columns {sorted(clash)} already")
    spans = materialize(validity_intervals(entries))
    # paths are looked up as deep as the deepest entry of the list
    depth = spans.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    # judged once for each distinct (url, time): copies of a capture cost nothing
    seen = captures.select(F.col(url).alias("u"), F.col(fetched).alias("t")).where("u is not null and t is not null").distinct()
    probe = seen.select("u", "t", F.explode(lookup_keys(F.col("u"), depth)).alias("k")).select("u", "t", F.col("k.key").alias("key"), F.col("k.weight").alias("weight"))
    hits = probe.join(checked_broadcast(spans), "key").where((F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    best = hits.groupBy("u", "t").agg(F.max(F.struct("weight", "key", "action")).alias("b")).select("u", "t", F.col("b.action").alias("_action"), F.col("b.key").alias("_key"))
    out = captures.alias("c").join(best.alias("b"), (F.col(f"c.`{url}`") == F.col("b.u")) & (F.col(f"c.`{fetched}`") == F.col("b.t")), "left")
    return out.select(*[F.col(f"c.`{c}`") for c in captures.columns], F.coalesce("b._action", F.lit("keep")).alias(names[0]), F.col("b._key").alias(names[1]))
