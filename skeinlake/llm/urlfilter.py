"""URL filters by temporal list join.

A list changes over time: dated entries add a key (a host suffix such as ``example.org``, or
a host with the first directories of a path such as ``a.example.org/ads``) or remove it.
Entries become validity intervals, half open, by the next entry of the same key; the as-of
join evaluates every capture against the entries active when it was fetched. The most
specific active key decides: the longest, then the one listed last.

Intervals are cut at the turns of months, so the join is an equi-join on (key, month) with
two comparisons, whatever the number of entries of a key. Captures are first reduced to
distinct (url, time) with their number; on a hot host the rows of a key differ in url and
time, and Spark splits such partitions of a plain equi-join (adaptive skew join). Neither
side is collected or forced into a broadcast.

Defined cases: a null url or time matches nothing and is allowed; entries without key or
date are ignored; of entries with the same key and date the removal wins; a removal without
an addition does nothing; repeated captures stay repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directories of a path that an entry may name.
DEPTH = 2
#: End of an interval that is still open.
OPEN = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and a final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def keys_of(url: Column) -> Column:
    """All keys that could list a url: its host's suffixes, and the host with its first directories."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    deep = F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), lambda k: F.when(F.size(parts) >= k, F.concat_ws("/", host, F.array_join(F.slice(parts, 1, k), "/"))))
    return F.when(host.isNotNull(), F.array_compact(F.concat(suffixes, deep)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, since, until from dated entries (key, action, listed_at); action is 'add' or 'remove'."""
    known = entries.where(F.col("key").isNotNull() & F.col("listed_at").isNotNull()).groupBy(F.lower("key").alias("key"), "listed_at").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    following = Window.partitionBy("key").orderBy("listed_at")
    spans = known.withColumn("until", F.coalesce(F.lead("listed_at").over(following), F.lit(OPEN).cast("timestamp")))
    return spans.where("gone = 0").select("key", F.col("listed_at").alias("since"), "until")


def filtered(captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetched_at", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns, url and time of each capture, with host, blocked, the rule and since when it was listed.

    An open interval is cut at the month after the latest capture, so it has as many pieces
    as the captures have months.
    """
    columns = [*keep, url, time]
    distinct = captures.select(*columns).groupBy(*columns).agg(F.count("*").alias("_n"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = captures.agg(F.max(time)).first()[0]
    rules = intervals(entries).where(F.col("since") <= F.lit(last)) if last is not None else intervals(entries).limit(0)
    ends = F.least(month("until"), month(F.lit(last).cast("timestamp")))
    cut = rules.select(F.col("key").alias("_rule"), F.col("since").alias("_since"), F.col("until").alias("_until"), F.explode(F.sequence(month("since"), F.greatest(ends, month("since")))).alias("_month"))
    asked = distinct.select(*columns, "_n", F.explode_outer(keys_of(F.col(url))).alias("_key"), F.col(time).alias("_at"))
    hit = asked.join(cut, (F.col("_key") == F.col("_rule")) & (month("_at") == F.col("_month")) & (F.col("_since") <= F.col("_at")) & (F.col("_at") < F.col("_until")), "left")
    best = F.max(F.when(F.col("_rule").isNotNull(), F.struct(F.length("_rule").alias("size"), F.col("_since"), F.col("_rule")))).alias("_best")
    told = hit.groupBy(*columns, "_n").agg(best)
    return told.select(*columns, host_of(F.col(url)).alias("host"), F.col("_best").isNotNull().alias("blocked"), F.col("_best._rule").alias("rule"), F.col("_best._since").alias("since"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")).drop("_k")
