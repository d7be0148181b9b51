"""URL filters that change over time: dated list entries become validity intervals, and each capture is judged by those at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm.common import query, table


def host_of(url):
    """Lower-case host of a URL without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def suffixes(host):
    """The host and all its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, start, end, listed) from dated entries (domain, day, listed); an entry holds until the next of its domain.

    Of equal days the listing wins. Entries without domain or day are left out; the last interval has a null end.
    """
    one = entries.filter("domain is not null and day is not null").groupBy(F.lower("domain").alias("domain"), F.col("day").alias("start")).agg(
        F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    return one.withColumn("end", F.lead("start").over(W.partitionBy("domain").orderBy("start")))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with `blocked`: the host or a parent domain is on the list at the capture's day.

    Distinct (host, day) pairs are judged once, so a host with a third of the captures is one small group per day. Null
    or hostless URLs and null days are not blocked. Input columns named blocked are replaced.
    """
    rows = captures.drop("blocked").withColumns({"_host": host_of(F.col(url)), "_day": F.col(day)})
    asked = rows.select("_host", "_day").filter("_host is not null and _day is not null").distinct()
    valid = intervals(entries)
    each = asked.withColumn("domain", F.explode(suffixes(F.col("_host"))))
    hits = each.join(valid.filter("listed"), (each["domain"] == valid["domain"]) & (F.col("_day") >= F.col("start")) & (F.col("end").isNull() | (F.col("_day") < F.col("end"))))
    blocked = hits.select("_host", "_day").distinct().withColumn("_b", F.lit(True))
    return rows.join(blocked, ["_host", "_day"], "left").withColumn("blocked", F.coalesce("_b", F.lit(False))).drop("_host", "_day", "_b")


@query(r"""
WITH p AS (SELECT page_id, url, page_id % 30 AS day, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host FROM pages),
e AS (SELECT host AS domain, day, bool_or(page_id % 2 = 0) AS listed FROM p WHERE page_id % 7 < 2 AND host IS NOT NULL GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day) AS nxt FROM e)
SELECT page_id, url, day, EXISTS (SELECT 1 FROM v WHERE listed AND (p.host = domain OR ends_with(p.host, '.' || domain)) AND p.day >= v.day AND (nxt IS NULL OR p.day < nxt)) AS blocked FROM p""")
def op4_url_filter(spark, sf):
    """The list comes from the pages themselves: two of seven list or unlist their host on their day."""
    pages = table(spark, sf, "pages").select("page_id", "url").withColumn("day", F.col("page_id") % 30)
    entries = pages.filter("page_id % 7 < 2").select(host_of(F.col("url")).alias("domain"), "day", (F.col("page_id") % 2 == 0).alias("listed"))
    return judge(pages, entries).select("page_id", "url", "day", "blocked")
