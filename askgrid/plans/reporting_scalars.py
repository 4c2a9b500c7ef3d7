"""Predicates, scalar functions and type semantics of the reporting surface."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from askgrid.functions import tsql
from askgrid.plans.registry import query


@query("null_safe_filters", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
                  nullif(o_orderkey % 7, 3) AS code, o_orderpriority FROM orders)
SELECT o_orderkey, status, code FROM o
WHERE coalesce(code, -1) <> 5 AND (status IS NULL OR status <> 'F')
  AND (code IS NULL OR code = 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))
  AND o_orderpriority NOT IN ('5-LOW')""")
def null_safe_filters(t):
    """ISNULL(x, -1) <> v, NULL-or-zero, IN and NOT IN."""
    o = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif(F.col("o_orderkey") % 7, F.lit(3)).alias("code"), "o_orderpriority")
    code, status, priority = F.col("code"), F.col("status"), F.col("o_orderpriority")
    return o.where(
        (tsql.isnull(code, -1) != 5) & (status.isNull() | (status != "F"))
        & (code.isNull() | (code == 0) | priority.isin("1-URGENT", "2-HIGH"))
        & ~priority.isin("5-LOW")).select("o_orderkey", "status", "code")


@query("between_ranges", """
SELECT p_partkey, p_size, 20 BETWEEN p_size AND p_size * 2 AS spans_twenty FROM part
WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 905 AND 1050""")
def between_ranges(t):
    """BETWEEN constants and a constant between two columns."""
    return (t.part.where(F.col("p_size").between(10, 30) & F.col("p_retailprice").between(905, 1050))
            .select("p_partkey", "p_size",
                    F.lit(20).between(F.col("p_size"), F.col("p_size") * 2).alias("spans_twenty")))


@query("half_open_day", """
SELECT event_id, user_id, event_type FROM events
WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-11'""")
def half_open_day(t):
    """One calendar day as a half-open range, with a typed named parameter."""
    return t.spark.sql(
        "SELECT event_id, user_id, event_type FROM {events} "
        "WHERE ts >= :report_date AND ts < date_add(:report_date, 1)",
        args={"report_date": datetime.date(2024, 1, 10)}, events=t.events)


@query("minute_diff_boundary", """
SELECT event_id, datediff('minute', ts, ts + INTERVAL 59 SECOND) AS minutes,
       datediff('minute', CAST(CAST(ts AS DATE) AS TIMESTAMP), ts) AS since_midnight,
       CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day
FROM events""")
def minute_diff_boundary(t):
    """DATEDIFF(minute) counts boundaries: 59 seconds may be one minute."""
    midnight = F.to_date("ts").cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        tsql.minute_boundaries(F.col("ts"), F.col("ts") + F.expr("interval 59 seconds"))
        .alias("minutes"),
        tsql.minute_boundaries(midnight, F.col("ts")).alias("since_midnight"),
        tsql.minutes_of_day(F.col("ts")).alias("minute_of_day"))


@query("average_elapsed_minutes", """
WITH last_event AS (SELECT user_id, max(ts) AS done FROM events WHERE event_type = 'purchase'
                    GROUP BY user_id),
first_event AS (SELECT user_id, min(ts) AS started FROM events GROUP BY user_id)
SELECT f.user_id % 5 AS department, count(*) AS users,
  CAST(sum(CASE WHEN done IS NOT NULL THEN datediff('minute', started, done) END) AS DOUBLE)
  / count(done) AS average_minutes
FROM first_event f LEFT JOIN last_event l ON l.user_id = f.user_id GROUP BY ALL""")
def average_elapsed_minutes(t):
    """AVG over a CASE on a minute difference."""
    spans = t.events.groupBy("user_id").agg(
        F.min("ts").alias("started"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("done"))
    minutes = tsql.minute_boundaries(F.col("started"), F.col("done"))
    return spans.groupBy((F.col("user_id") % 5).alias("department")).agg(
        F.count(F.lit(1)).alias("users"),
        (F.sum(minutes).cast("double") / F.count("done")).alias("average_minutes"))


@query("int_vs_decimal_div", """
SELECT o_orderkey, o_custkey // 60 AS whole_hours, o_custkey / 60.0::DOUBLE AS hours,
       (o_custkey - 750) // 60 AS signed_hours
FROM orders""")
def int_vs_decimal_div(t):
    """Integer division truncates towards zero; ``/ 60.0`` does not."""
    return t.orders.select(
        "o_orderkey", tsql.integer_divide(F.col("o_custkey"), 60).alias("whole_hours"),
        (F.col("o_custkey") / 60.0).alias("hours"),
        tsql.integer_divide(F.col("o_custkey") - 750, 60).alias("signed_hours"))


@query("weekday_and_day_diff", """
SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday,
  CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) AS days_left,
  CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due_day,
  CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m
FROM orders""")
def weekday_and_day_diff(t):
    """DATEPART(weekday), DATEDIFF(day), DATEADD(day), YEAR, MONTH."""
    at = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", F.dayofweek(at).alias("weekday"),
        F.datediff(F.lit("2001-12-31").cast("date"), at).alias("days_left"),
        F.date_add(at, 30).cast("string").alias("due_day"),
        F.year(at).alias("y"), F.month(at).alias("m"))


@query("round_and_ceiling", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) / 7.3::DOUBLE, 1) AS DOUBLE) AS share,
  CAST(ceil(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT) AS rounded_up,
  CAST(floor(l_quantity / 12) AS BIGINT) AS dozens
FROM lineitem""")
def round_and_ceiling(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(price.cast("double") / 7.3, 1).alias("share"),
        F.ceil(price).cast("bigint").alias("rounded_up"),
        F.floor(F.col("l_quantity") / 12).alias("dozens"))


@query("text_functions", """
SELECT p_partkey, left(p_name, 4) || '/' || substr(p_brand, 7, 2) AS code,
  CASE WHEN nullif(trim(CASE WHEN p_size % 5 = 0 THEN '   ' ELSE p_name END), '') IS NOT NULL
       THEN 'named' ELSE 'blank' END AS name_state,
  CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS type_code,
  p_brand || CASE WHEN p_size > 40 THEN NULL ELSE '-' || p_size END AS padded
FROM part""")
def text_functions(t):
    """LEFT, SUBSTRING, TRIM, simple CASE and NULL-propagating concatenation."""
    shown = F.when(F.col("p_size") % 5 == 0, F.lit("   ")).otherwise(F.col("p_name"))
    return t.part.select(
        "p_partkey",
        F.concat(F.left("p_name", F.lit(4)), F.lit("/"), F.substring("p_brand", 7, 2)).alias("code"),
        F.when(~tsql.is_blank(shown), "named").otherwise("blank").alias("name_state"),
        F.when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_type") == "SMALL", 2).otherwise(0)
        .alias("type_code"),
        F.concat("p_brand", F.when(F.col("p_size") <= 40, F.concat(F.lit("-"), "p_size")))
        .alias("padded"))


@query("collation_equality", """
SELECT a.p_partkey, b.n AS same_name_parts FROM part a
JOIN (SELECT lower(rtrim(p_name)) AS k, count(*) AS n FROM part GROUP BY ALL) b
ON b.k = lower(rtrim(upper(a.p_name) || '  '))""")
def collation_equality(t):
    """Equality that ignores case and trailing spaces, as an equi-join on the collated key."""
    counted = t.part.groupBy(F.collate("p_name", "UTF8_LCASE_RTRIM").alias("k")).agg(
        F.count(F.lit(1)).alias("same_name_parts"))
    shouted = t.part.select("p_partkey", F.collate(F.concat(F.upper("p_name"), F.lit("  ")),
                                                   "UTF8_LCASE_RTRIM").alias("s"))
    return shouted.join(counted, F.col("s") == F.col("k")).select("p_partkey", "same_name_parts")


@query("casts_and_bits", """
SELECT o_orderkey, o_orderstatus = 'F' AS is_final, CAST(o_orderkey AS VARCHAR) AS key_text,
  CAST(CAST(o_totalprice AS DECIMAL(19,4)) AS DOUBLE) AS price_money,
  CAST(o_orderkey AS DOUBLE) / 4 AS quarter,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day,
  CASE WHEN coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END, false)
       THEN 1 ELSE 0 END AS shipped_bit
FROM orders""")
def casts_and_bits(t):
    """bit, money, float, date and text conversions."""
    final = F.col("o_orderstatus") == "F"
    return t.orders.select(
        "o_orderkey", final.alias("is_final"), F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_totalprice").cast(tsql.MONEY).cast("double").alias("price_money"),
        (F.col("o_orderkey").cast("double") / 4).alias("quarter"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_day"),
        F.when(tsql.isnull(F.when(F.col("o_orderstatus") != "P", final), False), 1).otherwise(0)
        .alias("shipped_bit"))


@query("star_plus_computed", """
SELECT *, s_acctbal < 0 AS overdrawn FROM supplier""")
def star_plus_computed(t):
    """``alias.*`` with a computed column."""
    return t.supplier.select("*", (F.col("s_acctbal") < 0).alias("overdrawn"))


@query("jalali_style_period", """
SELECT left(period, 4) AS y, count(*) AS order_count FROM (
  SELECT strftime(o_orderdate, '%Y/%m/%d') AS period FROM orders)
WHERE period >= '1996/05/01' AND substr(period, 6, 2) <> '02' GROUP BY ALL""")
def jalali_style_period(t):
    """Dates kept as sortable text (``1403/05/01``): compared and cut as strings."""
    period = F.date_format("o_orderdate", "yyyy/MM/dd")
    return (t.orders.select(period.alias("period"))
            .where((F.col("period") >= "1996/05/01") & (F.substring("period", 6, 2) != "02"))
            .groupBy(F.left("period", F.lit(4)).alias("y")).agg(
        F.count(F.lit(1)).alias("order_count")))
