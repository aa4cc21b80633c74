"""URL filters (operator 7): a temporal list join.

A block list is a log of dated entries (domain, at, action, list): from its date on, a domain is blocked, allowed or no
longer listed. The entries of a domain and list become validity intervals by the date of the next entry. A capture is
matched with the entries of its host and all parent domains, the last label included, that were active when it was fetched; of those, the most
specific domain decides, and at equal domains `allow` wins over `block`.

The as-of join is an equi-join: an interval is repeated for each calendar month that it touches, and a capture joins on
(domain, month) before its date is compared. A long history thus costs a capture only the entries of its month. The
join key is as hot as the hottest domain; the capture side is the large one, and Spark splits it where it is skewed.
Nothing is broadcast unless Spark measures that it is small. The html column is never read.

Defined results. A null or unparsable url has no host: verdict 'none', no entry. A null capture date matches no entry.
Hosts are compared in lower case, without port and user. What is longer than a host name can be (HOST characters) is no host,
however it is made up, so a url of any length asks for a bounded number of domains. Entries with a null domain or date are
ignored; entries of the same domain, list and date apply in the order of their action (the later in code point order stays).
Rows that repeat a page_id are evaluated by themselves and come out once each. Tables without captures give no rows; without entries each
verdict is 'none'. Columns of pages other than page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import table

#: Days after EPOCH over which the captures of the pages table are dated, by their id.
EPOCH, DAYS = "2024-01-01", 360
#: Characters that a host name has at most.
HOST = 253
#: Entries that hold for whole networks: domain, day, action.
FIXED_ENTRIES = (
    ("spam-farm.example.org", "2023-06-01", "block"),
    ("ads-track.example.com", "2023-11-15", "block"),
    ("ads-track.example.com", "2024-05-01", "unlist"),
    ("ads-track.example.com", "2024-09-10", "block"),
    ("example.net", "2024-03-01", "block"),
    ("example.net", "2024-04-01", "unlist"),
)


def host_of(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(found) <= HOST, F.lower(found)).otherwise(F.lit(""))


def fetched_on(page_id: Column) -> Column:
    """The pages table has no capture date; its ids are spread over DAYS days."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.pmod(page_id, F.lit(DAYS)).cast("int"))


def feed(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of the captures: one host in five is blocked for a while, and one in ten of those is
    later allowed. Its size follows the number of hosts."""
    draw = F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")
    hosts = captures.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n")).withColumn("draw", draw).where("draw % 5 = 0")
    day = F.date_add(F.lit(EPOCH).cast("date"), F.pmod(F.shiftright("draw", 4), F.lit(200)).cast("int"))
    until = F.date_add(day, (F.pmod(F.shiftright("draw", 12), F.lit(90)) + 20).cast("int"))
    action = F.when(F.col("draw") % 50 == 0, "allow").otherwise("unlist")
    entries = F.array(
        F.struct(day.alias("at"), F.lit("block").alias("action")), F.struct(until.alias("at"), action.alias("action"))
    )
    return hosts.select(F.col("host").alias("domain"), F.explode(entries).alias("e")).select("domain", "e.at", "e.action", F.lit("feed").alias("list"))


def fixed_entries(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(FIXED_ENTRIES), "domain string, day string, action string")
    return rows.select("domain", F.col("day").cast("date").alias("at"), "action", F.lit("fixed").alias("list"))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, list, action, valid_from and valid_to (exclusive, null: open) of entries that block or allow."""
    clean = (
        entries.where(F.col("domain").isNotNull() & F.col("at").isNotNull())
        .groupBy(F.lower("domain").alias("domain"), "list", "at")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("at").over(Window.partitionBy("domain", "list").orderBy("at"))
    return clean.withColumn("valid_to", following).where(F.col("action").isin("block", "allow")).withColumnRenamed("at", "valid_from")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, host, fetched) with verdict ('block', 'allow' or 'none'), matched domain, list and start."""
    key = lambda day: F.trunc(day, "month")
    # intervals are repeated for the months up to the last capture, so one without an end is not repeated for ever
    horizon = F.lit(captures.agg(F.max(key(F.col("fetched")))).first()[0]).cast("date")
    months = F.sequence(key(F.col("valid_from")), F.least(key(F.coalesce(F.date_sub("valid_to", 1), horizon)), horizon), F.expr("interval 1 month"))
    spans = intervals(entries).where(key(F.col("valid_from")) <= horizon).withColumn("month", F.explode(months))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = captures.select("capture", "fetched", key(F.col("fetched")).alias("month"), F.explode(domains).alias("domain"))
    rank = F.struct(F.length("domain").alias("size"), (F.col("action") == "allow").alias("allowed"), "domain", "action", "list", "valid_from")
    hits = (
        asked.join(spans, ["domain", "month"])
        .where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
        .groupBy("capture")
        .agg(F.max(rank).alias("hit"))
    )
    return captures.join(hits, "capture", "left").select(
        *[c for c in captures.columns if c != "capture"],
        F.coalesce("hit.action", F.lit("none")).alias("verdict"),
        F.col("hit.domain").alias("matched_domain"),
        F.col("hit.list").alias("matched_list"),
        F.col("hit.valid_from").alias("active_since"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), fetched_on(F.col("page_id")).alias("fetched"))
    captures = pages.withColumn("capture", F.struct("page_id", "host"))
    entries = feed(pages).unionByName(fixed_entries(spark))
    return evaluate(captures, entries)


OP7_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN length(name) <= 253 THEN lower(name) ELSE '' END AS host,
         DATE '2024-01-01' + CAST(((page_id % 360) + 360) % 360 AS INTEGER) AS fetched
  FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS name FROM pages)
), h AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS draw FROM p WHERE host <> ''
), f AS (
  SELECT host AS domain, draw, DATE '2024-01-01' + CAST((draw >> 4) % 200 AS INTEGER) AS day FROM h WHERE draw % 5 = 0
), entries AS (
  SELECT domain, day AS since, 'block' AS action, 'feed' AS list FROM f
  UNION ALL
  SELECT domain, day + CAST((draw >> 12) % 90 + 20 AS INTEGER), CASE WHEN draw % 50 = 0 THEN 'allow' ELSE 'unlist' END, 'feed' FROM f
  UNION ALL
  SELECT v.domain, CAST(v.day AS DATE), v.action, 'fixed' FROM (VALUES
    ('spam-farm.example.org', '2023-06-01', 'block'), ('ads-track.example.com', '2023-11-15', 'block'),
    ('ads-track.example.com', '2024-05-01', 'unlist'), ('ads-track.example.com', '2024-09-10', 'block'),
    ('example.net', '2024-03-01', 'block'), ('example.net', '2024-04-01', 'unlist')) v(domain, day, action)
), spans AS (
  SELECT domain, list, action, since AS valid_from, lead(since) OVER (PARTITION BY domain, list ORDER BY since) AS valid_to FROM entries
), hits AS (
  SELECT p.page_id, p.host, p.fetched, s.*,
         row_number() OVER (PARTITION BY p.page_id, p.host ORDER BY length(s.domain) DESC, (s.action = 'allow') DESC, s.domain DESC,
                            s.action DESC, s.list DESC, s.valid_from DESC) AS best
  FROM p JOIN spans s ON (p.host = s.domain OR ends_with(p.host, '.' || s.domain))
    AND s.action IN ('block', 'allow') AND p.fetched >= s.valid_from AND (s.valid_to IS NULL OR p.fetched < s.valid_to)
)
SELECT p.page_id, p.host, p.fetched, coalesce(action, 'none') AS verdict, domain AS matched_domain, list AS matched_list, valid_from AS active_since
FROM p LEFT JOIN hits ON p.page_id = hits.page_id AND p.host = hits.host AND best = 1
"""
