"""Reporting shapes built on joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.functions import tsql
from askgrid.operators.ordered import asof_join, range_join_by_month
from askgrid.plans.registry import query


def day(name: str):
    return F.col(name).cast("date")


def text(column, alias: str):
    return column.cast("string").alias(alias)


@query("header_detail_inner", """
SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def header_detail_inner(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey", "l_quantity")


@query("lookup_left", """
SELECT l_orderkey, l_linenumber, p_name, p_brand,
       coalesce(p_name, 'unknown') AS part_label
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey""")
def lookup_left(t):
    parts = t.part.where("p_size <= 25").select("p_partkey", "p_name", "p_brand")
    return t.lineitem.join(parts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "l_orderkey", "l_linenumber", "p_name", "p_brand",
        F.coalesce("p_name", F.lit("unknown")).alias("part_label"))


@query("five_hop_chain", """
SELECT r_name, n_name, o_orderpriority, count(*) AS line_count,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
GROUP BY ALL""")
def five_hop_chain(t):
    """Lines are combined per order, orders per customer, before the next table is met."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    per_customer = (per_order.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
                    .groupBy("o_custkey", "o_orderpriority")
                    .agg(F.sum("lines").alias("lines"), F.sum("price").alias("price")))
    return (per_customer.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
            .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
            .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
            .groupBy("r_name", "n_name", "o_orderpriority")
            .agg(F.sum("lines").alias("line_count"),
                 F.sum("price").cast("double").alias("amount")))


@query("role_self_join", """
SELECT l_orderkey, l_linenumber, l_suppkey, cn.n_name AS customer_nation,
       sn.n_name AS supplier_nation
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation cn ON cn.n_nationkey = c_nationkey
JOIN nation sn ON sn.n_nationkey = s_nationkey
WHERE cn.n_name <> sn.n_name""")
def role_self_join(t):
    """The nation dimension in two roles; headers meet their buyers before the lines."""
    buyers = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", F.col("n_name").alias("customer_nation"))
    sellers = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("supplier_nation"))
    headers = t.orders.join(buyers, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "customer_nation")
    return (t.lineitem.join(headers, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(sellers, F.col("s_suppkey") == F.col("l_suppkey"))
            .where("customer_nation <> supplier_nation")
            .select("l_orderkey", "l_linenumber", "l_suppkey", "customer_nation",
                    "supplier_nation"))


@query("typed_reference_join", """
SELECT event_id, 'customer' AS ref_type, c_name AS ref_name
FROM events JOIN customer ON event_type = 'purchase' AND user_id = c_custkey
UNION ALL
SELECT event_id, 'supplier', s_name
FROM events JOIN supplier ON event_type = 'view' AND user_id = s_suppkey
UNION ALL
SELECT event_id, 'part', p_name
FROM events JOIN part ON event_type = 'click' AND user_id = p_partkey""")
def typed_reference_join(t):
    """Polymorphic reference: the type says which table the id belongs to."""
    targets = ((t.customer, "purchase", "customer", "c_custkey", "c_name"),
               (t.supplier, "view", "supplier", "s_suppkey", "s_name"),
               (t.part, "click", "part", "p_partkey", "p_name"))
    branches = [
        t.events.where(F.col("event_type") == kind)
        .join(target, F.col("user_id") == F.col(key))
        .select("event_id", F.lit(label).alias("ref_type"), F.col(name).alias("ref_name"))
        for target, kind, label, key, name in targets]
    return branches[0].unionByName(branches[1]).unionByName(branches[2])


def month_periods(orders):
    """Month calendar from the first to the last order."""
    span = orders.agg(F.trunc(F.min("o_orderdate"), "MM").alias("first"),
                      F.trunc(F.max("o_orderdate"), "MM").alias("last"))
    start = F.explode(F.sequence("first", "last", F.expr("interval 1 month")))
    return span.select(start.alias("from_date")).select(
        (F.year("from_date") * 100 + F.month("from_date")).alias("period_id"),
        "from_date", F.last_day("from_date").alias("to_date"))


MONTH_PERIODS_SQL = """
periods AS (
  SELECT CAST(year(d) * 100 + month(d) AS INTEGER) AS period_id, CAST(d AS DATE) AS from_date,
         last_day(d) AS to_date
  FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)),
        date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS d FROM orders))"""


@query("range_join_month", f"""
WITH {MONTH_PERIODS_SQL}
SELECT o_orderkey, period_id, CAST(from_date AS VARCHAR) AS from_date,
       CAST(to_date AS VARCHAR) AS to_date
FROM orders JOIN periods ON CAST(o_orderdate AS DATE) BETWEEN from_date AND to_date""")
def range_join_month(t):
    """Date into period."""
    facts = t.orders.select("o_orderkey", day("o_orderdate").alias("order_day"))
    return range_join_by_month(facts, month_periods(t.orders), "order_day", "from_date",
                               "to_date").select(
        "o_orderkey", "period_id", text(F.col("from_date"), "from_date"),
        text(F.col("to_date"), "to_date"))


@query("range_group_count", f"""
WITH {MONTH_PERIODS_SQL}
SELECT o_custkey, period_id, count(*) AS order_count
FROM orders JOIN periods ON CAST(o_orderdate AS DATE) BETWEEN from_date AND to_date
GROUP BY ALL""")
def range_group_count(t):
    """Facts are combined per day before they meet the periods."""
    daily = t.orders.groupBy("o_custkey", day("o_orderdate").alias("order_day")).agg(
        F.count(F.lit(1)).alias("n"))
    return (range_join_by_month(daily, month_periods(t.orders), "order_day", "from_date",
                                "to_date")
            .groupBy("o_custkey", "period_id").agg(F.sum("n").alias("order_count")))


@query("param_period_join", f"""
WITH {MONTH_PERIODS_SQL},
f AS (SELECT from_date FROM periods WHERE period_id = 199603),
u AS (SELECT to_date FROM periods WHERE period_id = 199808)
SELECT o_orderkey, period_id
FROM orders JOIN periods p ON CAST(o_orderdate AS DATE) BETWEEN p.from_date AND p.to_date
JOIN f ON p.from_date >= f.from_date JOIN u ON p.to_date <= u.to_date""")
def param_period_join(t):
    """Two parameter rows of the period table supply the bounds.

    Each parameter row is one row of a calendar; it becomes a scalar subquery,
    so the bound is known before the facts are scanned.
    """
    periods = month_periods(t.orders)
    first = periods.where("period_id = 199603").select("from_date")
    last = periods.where("period_id = 199808").select("to_date")
    chosen = periods.where((F.col("from_date") >= first.scalar())
                           & (F.col("to_date") <= last.scalar()))
    facts = t.orders.select("o_orderkey", day("o_orderdate").alias("order_day"))
    return range_join_by_month(facts, chosen, "order_day", "from_date", "to_date").select(
        "o_orderkey", "period_id")


@query("cross_inline_values", """
SELECT o_orderkey, band, CAST(o_totalprice AS DECIMAL(18,2)) >= lower_bound AS reached
FROM orders CROSS JOIN (VALUES ('small', 0), ('medium', 100000), ('large', 300000))
AS v(band, lower_bound)""")
def cross_inline_values(t):
    """CROSS JOIN with an inline VALUES relation: a fixed array exploded per row."""
    bands = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(bound).alias("lower_bound"))
                      for name, bound in (("small", 0), ("medium", 100000), ("large", 300000))])
    return t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
                           F.inline(bands)).select(
        "o_orderkey", "band", (F.col("total") >= F.col("lower_bound")).alias("reached"))


@query("left_join_on_condition", """
SELECT c_custkey, count(o_orderkey) AS urgent_orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
GROUP BY ALL""")
def left_join_on_condition(t):
    """The condition on the right side stays in ON, so unmatched customers remain."""
    urgent = (t.orders.where("o_orderpriority = '1-URGENT'")
              .groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")))
    return t.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("urgent_orders"))


@query("case_join_key", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 's' ELSE 'c' END AS party_type,
       n_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = CASE WHEN l_returnflag = 'R' THEN s_nationkey ELSE c_nationkey END""")
def case_join_key(t):
    """Join key computed by CASE, then an equality join."""
    headers = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "c_nationkey")
    lines = (t.lineitem.join(headers, F.col("o_orderkey") == F.col("l_orderkey"))
             .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
             .select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_returnflag") == "R", "s").otherwise("c").alias("party_type"),
                     F.when(F.col("l_returnflag") == "R", F.col("s_nationkey"))
                     .otherwise(F.col("c_nationkey")).alias("party_nation")))
    return lines.join(t.nation, F.col("n_nationkey") == F.col("party_nation")).select(
        "l_orderkey", "l_linenumber", "party_type", "n_name")


@query("exists_semi", """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'
              AND l_quantity > 45)""")
def exists_semi(t):
    lines = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select("l_orderkey")
    return t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(
        "o_orderkey", "o_orderstatus")


@query("exists_residual", """
SELECT o_orderkey FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
              AND l_shipdate < o_orderdate)""")
def exists_residual(t):
    """EXISTS with a non-equality residual: only the earliest ship date matters."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    return t.orders.join(first, (F.col("l_orderkey") == F.col("o_orderkey"))
                         & (F.col("first_ship") < F.col("o_orderdate")), "left_semi").select(
        "o_orderkey")


@query("exists_flag_case", """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
       AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') THEN true ELSE false END
       AS has_urgent_final
FROM customer""")
def exists_flag_case(t):
    """EXISTS as a value."""
    holders = (t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
               .select("o_custkey").distinct().withColumn("found", F.lit(True)))
    return t.customer.join(holders, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("found", F.lit(False)).alias("has_urgent_final"))


@query("not_exists_anti", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'
                  AND o_orderpriority = '1-URGENT')""")
def not_exists_anti(t):
    final = t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(
        "o_custkey")
    return t.customer.join(final, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(
        "c_custkey", "c_name")


@query("not_exists_joined", """
SELECT p_partkey, p_name FROM part
WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_partkey = p_partkey AND o_orderpriority = '1-URGENT' AND l_returnflag = 'R'
  AND o_orderstatus = 'F')""")
def not_exists_joined(t):
    """NOT EXISTS over a subquery that has a join of its own."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(
        "o_orderkey")
    returned = (t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
                .join(urgent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"))
    return t.part.join(returned, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(
        "p_partkey", "p_name")


@query("not_in_null_safe", """
SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (
  SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity = 50
  AND l_discount = 0.1 AND l_returnflag = 'A')""")
def not_in_null_safe(t):
    used = t.lineitem.where("l_suppkey IS NOT NULL AND l_quantity = 50 AND l_discount = 0.1 "
                            "AND l_returnflag = 'A'").select("l_suppkey")
    return t.supplier.join(used, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select(
        "s_suppkey")


@query("asof_latest_order", """
SELECT c_custkey, o.o_orderkey, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS order_day
FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_orderdate FROM orders
  WHERE o_custkey = c_custkey AND o_orderdate <= DATE '1998-06-30'
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true""")
def asof_latest_order(t):
    """OUTER APPLY (SELECT TOP (1) … ORDER BY …) as of a parameter date."""
    latest = (t.orders.where(F.col("o_orderdate") <= F.lit("1998-06-30").cast("date"))
              .groupBy("o_custkey")
              .agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o")))
    return t.customer.join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", "o.o_orderkey", text(F.col("o.o_orderdate").cast("date"), "order_day"))


@query("asof_row_join", """
WITH visits AS (
  SELECT event_id, user_id,
         ts - INTERVAL 9500 DAY AS visit_time FROM events)
SELECT event_id, user_id, o.o_orderkey, o.o_orderstatus
FROM visits ASOF LEFT JOIN (
  SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey,
         arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
  FROM orders GROUP BY ALL) o
ON user_id = o_custkey AND visit_time >= o_orderdate""")
def asof_row_join(t):
    """Latest effective row per fact row, with the fact's own time as the bound.

    Events are 26 years younger than orders; the shift lets the two overlap.
    """
    visits = t.events.select("event_id", "user_id",
                             (F.col("ts") - F.expr("interval 9500 days")).alias("visit_time"))
    orders = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey",
                             "o_orderstatus")
    return asof_join(visits, orders, ["user_id"], "visit_time", "o_orderdate", ["o_orderkey"],
                     ["o_orderkey", "o_orderstatus"]).select(
        "event_id", "user_id", "o_orderkey", "o_orderstatus")


@query("lateral_agg", """
SELECT c_custkey, a.open_orders, CAST(a.open_amount AS DOUBLE) AS open_amount
FROM customer LEFT JOIN LATERAL (
  SELECT count(*) AS open_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS open_amount
  FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'
  AND o_orderpriority = '2-HIGH') a ON true""")
def lateral_agg(t):
    """OUTER APPLY aggregate: COUNT over nothing is 0, SUM over nothing stays NULL."""
    sums = (t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
            .groupBy("o_custkey").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount")))
    return t.customer.join(sums, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"),
        F.col("amount").cast("double").alias("open_amount"))


@query("lateral_distinct_rewrite", """
WITH visits AS (SELECT event_id, user_id, ts - INTERVAL 9500 DAY AS visit_time FROM events),
latest AS (
  SELECT event_id, max(o_orderdate) AS from_date FROM visits JOIN orders
  ON o_custkey = user_id AND o_orderdate <= visit_time AND o_orderstatus <> 'P'
  GROUP BY event_id)
SELECT DISTINCT v.event_id, o.o_orderpriority AS previous_priority
FROM visits v LEFT JOIN latest l ON l.event_id = v.event_id
LEFT JOIN orders o ON o.o_custkey = v.user_id AND o.o_orderdate = l.from_date
 AND o.o_orderstatus <> 'P'""")
def lateral_distinct_rewrite(t):
    """OUTER APPLY DISTINCT with a doubly nested latest-date condition.

    The as-of join gives the latest effective date; an equality join on
    (key, date) then fetches the distinct values of that date.
    """
    visits = t.events.select("event_id", "user_id",
                             (F.col("ts") - F.expr("interval 9500 days")).alias("visit_time"))
    eligible = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("from_date"),
        "o_orderpriority")
    steps = eligible.distinct()
    dated = asof_join(visits, steps.select("user_id", "from_date").distinct(), ["user_id"],
                      "visit_time", "from_date", [], ["from_date"])
    return dated.join(steps, ["user_id", "from_date"], "left").select(
        "event_id", F.col("o_orderpriority").alias("previous_priority"))


@query("cross_apply_scalar", """
SELECT l_orderkey, l_linenumber, CAST(CAST(due AS DATE) AS VARCHAR) AS due_day,
       CAST(datediff('day', CAST(l_shipdate AS DATE), CAST(due AS DATE)) AS INTEGER) AS days_left
FROM (SELECT *, l_shipdate + INTERVAL 1 DAY * CASE WHEN dayofweek(l_shipdate) = 5 THEN 2 ELSE 1 END
      AS due FROM lineitem)""")
def cross_apply_scalar(t):
    """CROSS APPLY of a scalar expression; Friday is day 6 of a Sunday-first week."""
    due = F.date_add(day("l_shipdate"),
                     F.when(F.dayofweek("l_shipdate") == 6, 2).otherwise(1))
    return t.lineitem.withColumn("due", due).select(
        "l_orderkey", "l_linenumber", text(F.col("due"), "due_day"),
        F.datediff("due", day("l_shipdate")).alias("days_left"))


@query("interval_overlap", """
WITH spans AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_day,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS to_day FROM orders)
SELECT o_orderkey, CAST(from_day AS VARCHAR) AS from_day, CAST(to_day AS VARCHAR) AS to_day
FROM spans
WHERE from_day BETWEEN DATE '1997-03-01' AND DATE '1997-04-15'
   OR (from_day < DATE '1997-03-01' AND to_day >= DATE '1997-03-01')""")
def interval_overlap(t):
    """Starts inside the window, or spans its start."""
    spans = t.orders.select(
        "o_orderkey", day("o_orderdate").alias("from_day"),
        F.date_add(day("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("to_day"))
    start, end = F.lit("1997-03-01").cast("date"), F.lit("1997-04-15").cast("date")
    inside = F.col("from_day").between(start, end)
    spanning = (F.col("from_day") < start) & (F.col("to_day") >= start)
    return spans.where(inside | spanning).select(
        "o_orderkey", text(F.col("from_day"), "from_day"), text(F.col("to_day"), "to_day"))


@query("open_ended_validity", """
WITH spans AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS from_day,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS to_day
  FROM orders)
SELECT o_orderkey, o_custkey, CAST(to_day AS VARCHAR) AS to_day FROM spans
WHERE from_day <= DATE '1998-01-31' AND (to_day IS NULL OR to_day >= DATE '1998-01-31')""")
def open_ended_validity(t):
    to_day = F.when(F.col("o_orderstatus") != "O", F.date_add(
        day("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")))
    return (t.orders.withColumn("to_day", to_day)
            .where(tsql.valid_on(day("o_orderdate"), F.col("to_day"),
                                 F.lit("1998-01-31").cast("date")))
            .select("o_orderkey", "o_custkey", text(F.col("to_day"), "to_day")))
