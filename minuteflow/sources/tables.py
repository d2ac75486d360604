"""The test tables as canonical meetings, items, clicks, logs and vectors, with the same views in SQL.

Order lines have no unique key: item_id numbers the lines of equal (order, line) by a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minuteflow.session import listing, materialize, table


def iso(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer and nation as meetings."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("meeting_id"),
        F.concat(F.lit("doc_"), F.col("o_orderkey") % 50).alias("document_id"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.lower("c_mktsegment"), F.lit("review")).alias("meeting_name"),
        iso("o_orderdate").alias("meeting_date"),
        F.col("n_name").alias("responsible_unit"),
        F.col("c_name").alias("chairperson"),
        F.concat(F.lit("Recorder#"), F.col("o_custkey") % 7).alias("recorder"),
        F.array(F.col("c_name"), F.concat(F.lit("Guest#"), F.col("o_orderkey") % 11)).alias("attendees"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Room "), F.col("o_orderkey") % 5)).alias("location"),
        F.when(F.col("o_orderstatus") == "O", F.lit("needs_ocr")).otherwise(F.lit("parsed")).alias("status"),
    )


ITEM_SOURCES = ("lineitem", "part", "supplier")
#: Canonical item tables written in this application, by application and source folder, with the files they were made of.
_STORED: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical item table: written once in an application, so that later reads prune columns and push filters down.

    Numbering repeated lines shuffles and sorts them all; no filter passes that window. The table is
    written anew when a source's files have changed or its own are gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    files = tuple(listing(spark, f"{sf_dir}/{name}.parquet") for name in ITEM_SOURCES)
    known = _STORED.get(key)
    if known is None or known[0] != files or not listing(spark, known[1].__dict__["written_to"]):
        _STORED[key] = files, materialize(numbered_items(spark, sf_dir))
    return _STORED[key][1]


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with part and supplier as meeting items."""
    lines, part, supplier = (table(spark, sf_dir, t) for t in ITEM_SOURCES)
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    return (
        lines.withColumn("n", F.row_number().over(order))
        .join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "n").alias("item_id"),
            F.col("l_orderkey").cast("string").alias("meeting_id"),
            F.concat(F.lit("doc_"), F.col("l_orderkey") % 50).alias("document_id"),
            F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("item_no"),
            F.concat_ws(" ", F.lit("Check the"), "p_name", F.lit("for"), "p_brand", F.lower("p_type")).alias("content"),
            F.when(F.col("l_suppkey") % 10 == 0, F.lit("--")).otherwise(F.col("s_name")).alias("owner"),
            F.when(F.col("l_linenumber") == 7, F.lit("- -")).otherwise(iso("l_shipdate")).alias("planned_date"),
            F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), iso("l_shipdate")).otherwise(F.lit("--")).alias("actual_completed_date"),
            F.when(F.col("l_linenumber") == 1, F.lit("Final report"))
            .when(F.col("l_returnflag") == "A", F.lit("Closed at review"))
            .when(F.col("l_returnflag") == "N", F.lit("in  progress"))
            .when(F.col("l_linenumber") == 2, F.lit("—"))
            .alias("tracking_result"),
            F.col("p_name").alias("product"),
            F.col("p_brand").alias("regulation"),
            (F.col("l_linenumber") % 3 + 1).alias("page_number"),
        )
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events as search clicks: k names the meeting, the user's number the query."""
    k = F.get_json_object("props", "$.k")
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'click'")
        .select(
            F.col("event_id").cast("string").alias("click_id"),
            F.concat(F.lit("s"), F.col("user_id")).alias("search_id"),
            F.expr("element_at(array('red ring', 'red  Ring check', 'blue bolt', 'gear', 'machinery review'), cast(user_id % 5 as int) + 1)").alias("query"),
            k.alias("meeting_id"),
            F.concat(k, F.lit("-1-1")).alias("item_id"),
            F.col("ts").alias("created_at"),
        )
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as search logs."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'view'")
        .select(
            F.concat(F.lit("s"), F.col("event_id")).alias("search_id"),
            F.expr("element_at(array('red ring', 'blue bolt', 'gear', ' ', 'machinery review'), cast(event_id % 5 as int) + 1)").alias("query"),
            F.col("ts").alias("created_at"),
        )
    )


MEETINGS_SQL = """meetings as (
  select o_orderkey::varchar as meeting_id, 'doc_' || (o_orderkey % 50) as document_id, o_orderpriority || ' ' || lower(c_mktsegment) || ' review' as meeting_name,
    strftime(o_orderdate, '%Y-%m-%d') as meeting_date, n_name as responsible_unit, c_name as chairperson, 'Recorder#' || (o_custkey % 7) as recorder,
    [c_name, 'Guest#' || (o_orderkey % 11)] as attendees, case when o_orderkey % 5 > 0 then 'Room ' || (o_orderkey % 5) end as location,
    case when o_orderstatus = 'O' then 'needs_ocr' else 'parsed' end as status
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

ITEMS_SQL = """items as (
  select l_orderkey || '-' || l_linenumber || '-' || n as item_id, l_orderkey::varchar as meeting_id, 'doc_' || (l_orderkey % 50) as document_id, lpad(l_linenumber::varchar, 2, '0') as item_no,
    'Check the ' || p_name || ' for ' || p_brand || ' ' || lower(p_type) as content, case when l_suppkey % 10 = 0 then '--' else s_name end as owner,
    case when l_linenumber = 7 then '- -' else strftime(l_shipdate, '%Y-%m-%d') end as planned_date,
    case when l_linestatus = 'F' and l_returnflag = 'R' then strftime(l_shipdate, '%Y-%m-%d') else '--' end as actual_completed_date,
    case when l_linenumber = 1 then 'Final report' when l_returnflag = 'A' then 'Closed at review' when l_returnflag = 'N' then 'in  progress' when l_linenumber = 2 then '—' end as tracking_result,
    p_name as product, p_brand as regulation, l_linenumber % 3 + 1 as page_number
  from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax) as n from lineitem)
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""

CLICKS_SQL = """clicks as (
  select event_id::varchar as click_id, 's' || user_id as search_id, ['red ring', 'red  Ring check', 'blue bolt', 'gear', 'machinery review'][user_id % 5 + 1] as query,
    json_extract_string(props, '$.k') as meeting_id, json_extract_string(props, '$.k') || '-1-1' as item_id, ts as created_at
  from events where event_type = 'click')"""

SEARCHES_SQL = """searches as (
  select 's' || event_id as search_id, ['red ring', 'blue bolt', 'gear', ' ', 'machinery review'][event_id % 5 + 1] as query, ts as created_at
  from events where event_type = 'view')"""
