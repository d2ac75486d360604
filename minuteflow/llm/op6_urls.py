"""URL filters with a temporal list join, in DataFrame functions.

A list is a history: dated entries add or remove a host (and all its subdomains) or a URL prefix.
Each pattern's history becomes disjoint validity intervals [valid_from, valid_to), and an as-of
join holds every capture against the entries that were active when it was fetched: the host's
suffixes and the URL's path prefixes are the join keys, the fetch date lies in the interval.

The captures are the large side and keep their partitions where the intervals are few (counted, at
most BROADCAST_INTERVALS); beyond that both sides shuffle on the key, and adaptive execution
splits a host that holds a large part of the captures.

Defined cases: a null or unparsable URL and a null fetch date match no entry; repeated adds and
removes of one pattern change nothing; of several entries on one date the removal counts last;
repeated captures are kept; of several active entries the longest pattern, then the first list
by name, is reported; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_INTERVALS = 200_000


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, pattern, action 'add' or 'remove', entry_date) -> (list, pattern, valid_from, valid_to); an open end is null."""
    own = Window.partitionBy("list", "pattern").orderBy("entry_date")
    changes = (
        entries.where("pattern is not null and entry_date is not null")
        .groupBy("list", "pattern", "entry_date")
        .agg(F.min(F.when(F.col("action") == "add", True).otherwise(False)).alias("active"))
        .withColumn("was", F.coalesce(F.lag("active").over(own), F.lit(False)))
        .where("active <> was")
        .withColumn("valid_to", F.lead("entry_date").over(own))
    )
    return changes.where("active").select("list", "pattern", F.col("entry_date").alias("valid_from"), "valid_to")


def url_keys(url: str = "url") -> str:
    """SQL for the patterns that can match a URL: its host, every parent domain, and host/path prefixes at each slash."""
    rest = f"regexp_replace(`{url}`, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?', '')"
    host = f"lower(regexp_extract({rest}, '^([^/:?#]+)', 1))"
    labels = f"split({host}, '[.]')"
    path = f"filter(split(regexp_extract({rest}, '^[^/?#]+(/[^?#]*)', 1), '/'), x -> x <> '')"
    return (
        f"case when `{url}` rlike '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+' then array_distinct(concat("
        f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels}) - i + 1), '.')), "
        f"transform({path}, (x, i) -> concat({host}, '/', array_join(slice({path}, 1, i + 1), '/'))))) else cast(array() as array<string>) end"
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetch_date) with blocked and the entry that blocks: list, pattern, valid_from, valid_to."""
    spans = intervals(entries)
    if spans.count() <= BROADCAST_INTERVALS:
        spans = F.broadcast(spans)
    keyed = captures.select("page_id", "url", "fetch_date").withColumn("_id", F.monotonically_increasing_id())
    keyed = keyed.withColumn("_key", F.explode_outer(F.expr(url_keys())))
    active = (F.col("_key") == F.col("pattern")) & (F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to")))
    hit = F.when(F.col("pattern").isNotNull(), F.struct((-F.length("pattern")).alias("shortness"), "list", "pattern", "valid_from", "valid_to"))
    best = keyed.join(spans, active, "left").groupBy("_id", "page_id", "url", "fetch_date").agg(F.min(hit).alias("hit"))
    return best.select("page_id", "url", "fetch_date", F.col("hit").isNotNull().alias("blocked"), "hit.list", "hit.pattern", "hit.valid_from", "hit.valid_to")


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch dates: page_id spreads the captures over two years."""
    return pages.select("page_id", "url", F.expr("date_add(date '2023-01-01', cast(page_id % 730 as int))").alias("fetch_date"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list of the hosts and first path folders of the pages table: each is added, removed and added again on dates from its hash."""
    host = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
    folder = f"concat({host}, '/', regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)/', 1))"
    patterns = pages.select(F.explode(F.expr(f"array(named_struct('list', 'hosts', 'pattern', {host}), named_struct('list', 'folders', 'pattern', {folder}))")).alias("p")).select("p.*").where("pattern <> '' and pattern not like '%/'").distinct()
    code = patterns.withColumn("c", F.expr("cast(conv(substring(md5(pattern), 1, 6), 16, 10) as int)")).where("c % 3 <> 0")
    dated = "array(named_struct('action', 'add', 'd', c % 300), named_struct('action', 'remove', 'd', 300 + c % 200), named_struct('action', 'add', 'd', 500 + c % 150))"
    return code.select("list", "pattern", F.explode(F.expr(dated)).alias("e")).select("list", "pattern", "e.action", F.expr("date_add(date '2023-01-01', e.d)").alias("entry_date"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every capture with its verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_captures(derived_captures(pages), derived_entries(pages))


ORACLE_SQL = """
with cap as (select page_id, url, (date '2023-01-01' + (page_id % 730)::int)::date as fetch_date from pages),
h as (select *, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) as host, string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^?#]*)', 1), '/') as path from cap),
pat as (select distinct list, pattern from (
  select 'hosts' as list, host as pattern from h
  union all select 'folders', host || '/' || regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)/', 1) from h) where pattern <> '' and pattern not like '%/'),
code as (select *, ('0x' || substring(md5(pattern), 1, 6))::int as c from pat),
spans as (
  select list, pattern, (date '2023-01-01' + c % 300)::date as valid_from, (date '2023-01-01' + 300 + c % 200)::date as valid_to from code where c % 3 <> 0
  union all select list, pattern, (date '2023-01-01' + 500 + c % 150)::date, null from code where c % 3 <> 0),
hits as (select h.page_id, s.*, row_number() over (partition by h.page_id order by length(s.pattern) desc, s.list, s.pattern, valid_from) as r
  from h join spans s on (h.host = s.pattern or h.host like '%.' || s.pattern or h.host || '/' || array_to_string(path, '/') || '/' like s.pattern || '/%')
  and fetch_date >= valid_from and (valid_to is null or fetch_date < valid_to))
select cap.page_id, cap.url, cap.fetch_date, hits.pattern is not null as blocked, list, pattern, valid_from, valid_to
from cap left join hits on hits.page_id = cap.page_id and r = 1
"""
