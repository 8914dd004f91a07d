"""URL filters by a temporal list join, in DataFrame operations only.

Dated entries of a list (block, allow, remove a domain) become validity intervals; every capture is judged by the
entries that were active when it was fetched. A domain covers its subdomains, and the longest active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Entries of one domain and date: the last of these in force.
_ORDER = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) of entries (domain, action, dated): valid_to is exclusive, null if open.

    An entry holds until the next one of its domain; a removal only ends the one before. Entries with a null domain,
    date or an unknown action are left out; of several on one date the later of block, allow, remove holds.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in _ORDER]), F.col("action"))
    known = entries.where(F.col("domain").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin(*_ORDER))
    daily = known.groupBy("domain", "dated").agg(F.max_by("action", rank).alias("action"))
    following = F.lead("dated").over(Window.partitionBy("domain").orderBy("dated"))
    return (daily.withColumn("valid_to", following).where("action <> 'remove'")
            .select("domain", "action", F.col("dated").alias("valid_from"), "valid_to"))


def _suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, fetched_on) with host, kept, entry_domain, entry_action, entry_from.

    The as-of join: each distinct (host, date) is judged once and meets its domains' intervals by (domain, month),
    so neither a host with a third of all captures nor a long history makes one task large. Captures without an
    entry, a host or a date are kept, with nulls; repeated captures are judged each; no captures, no rows.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    pages = captures.select("page_id", "url", "fetched_on", host_of(F.col("url")).alias("host"))
    asked = pages.where(F.col("host").isNotNull() & F.col("fetched_on").isNotNull()).select("host", "fetched_on").distinct()
    last = F.lit(asked.agg(F.max("fetched_on")).first()[0]).cast("date")
    spans = intervals(entries).where(F.col("valid_from") <= last)
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    monthly = spans.withColumn("m", F.explode(F.sequence(month(F.col("valid_from")), month(until))))
    probes = asked.withColumn("domain", F.explode(_suffixes(F.col("host")))).withColumn("m", month(F.col("fetched_on")))
    active = probes.join(monthly, ["domain", "m"]).where(
        (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))))
    decided = active.groupBy("host", "fetched_on").agg(
        F.max_by(F.struct("domain", "action", "valid_from"), F.length("domain")).alias("x"))
    verdict = decided.select("host", "fetched_on", F.col("x.domain").alias("entry_domain"), F.col("x.action").alias("entry_action"),
                             F.col("x.valid_from").alias("entry_from"))
    return pages.join(verdict, ["host", "fetched_on"], "left").select(
        "page_id", "url", "fetched_on", "host", F.coalesce(F.col("entry_action") != "block", F.lit(True)).alias("kept"),
        "entry_domain", "entry_action", "entry_from")


# -- the registered query: fetch dates and a list log derived from the pages themselves -------------------------------
def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date in 2024 by their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")).alias("fetched_on"))


def list_of(pages: DataFrame) -> DataFrame:
    """A log of dated entries for the pages' sites: blocks, removals, renewed blocks, and exceptions for hosts."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = (pages.select("page_id", host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull())
             .groupBy("host").agg(F.min("page_id").alias("h")))
    site = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    sites = hosts.withColumn("site", site).where("site <> ''").groupBy("site").agg(F.min("h").alias("h"))
    h = F.col("h")
    log = F.array(
        F.struct(F.lit("block").alias("action"), day(h * 31 % 200).alias("dated"), (h % 3 == 0).alias("made")),
        F.struct(F.lit("remove").alias("action"), day(h * 31 % 200 + 45).alias("dated"), (h % 6 == 0).alias("made")),
        F.struct(F.lit("block").alias("action"), day(h * 31 % 200 + 90).alias("dated"), (h % 12 == 0).alias("made")))
    blocks = sites.select(F.col("site").alias("domain"), F.explode(log).alias("e")).where("e.made").select("domain", "e.action", "e.dated")
    allows = hosts.where((h % 5 == 0) & (F.size(F.split("host", r"\.")) > 3)).select(
        F.col("host").alias("domain"), F.lit("allow").alias("action"), day(h * 17 % 250).alias("dated"))
    return blocks.unionByName(allows)


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS DATE) AS fetched_on,
         nullif(lower(regexp_replace(regexp_replace(regexp_replace(
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')), '') AS host
  FROM pages),
hosts AS (SELECT host, min(page_id) AS h FROM c WHERE host IS NOT NULL GROUP BY host),
sites AS (SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS site, min(h) AS h FROM hosts GROUP BY 1),
log AS (
  SELECT site AS domain, 'block' AS action, DATE '2024-01-01' + CAST(h * 31 % 200 AS INTEGER) AS dated FROM sites WHERE site <> '' AND h % 3 = 0
  UNION ALL SELECT site, 'remove', DATE '2024-01-01' + CAST(h * 31 % 200 + 45 AS INTEGER) FROM sites WHERE site <> '' AND h % 6 = 0
  UNION ALL SELECT site, 'block', DATE '2024-01-01' + CAST(h * 31 % 200 + 90 AS INTEGER) FROM sites WHERE site <> '' AND h % 12 = 0
  UNION ALL SELECT host, 'allow', DATE '2024-01-01' + CAST(h * 17 % 250 AS INTEGER) FROM hosts
    WHERE h % 5 = 0 AND length(host) - length(replace(host, '.', '')) > 2),
daily AS (SELECT domain, dated, CASE WHEN max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) = 1 THEN 'remove'
                                     WHEN max(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) = 1 THEN 'allow' ELSE 'block' END AS action
          FROM log GROUP BY domain, dated),
spans AS (SELECT domain, action, dated AS valid_from, lead(dated) OVER (PARTITION BY domain ORDER BY dated) AS valid_to FROM daily),
hit AS (
  SELECT c.page_id, s.domain, s.action, s.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC) AS n
  FROM c JOIN spans s ON (c.host = s.domain OR c.host LIKE '%.' || s.domain)
   AND s.action <> 'remove' AND s.valid_from <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to))
SELECT c.page_id, c.url, c.fetched_on, c.host, coalesce(h.action <> 'block', TRUE) AS kept,
       h.domain AS entry_domain, h.action AS entry_action, CAST(h.valid_from AS DATE) AS entry_from
FROM c LEFT JOIN hit h ON c.page_id = h.page_id AND h.n = 1
"""
