"""Reporting shapes built on aggregation, windows, set operations and CTE chains."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from askgrid.functions import tsql
from askgrid.operators.bounded import cut
from askgrid.operators.ordered import latest_per_key, running_sum
from askgrid.operators.skew import attach_by_key, group_values_over
from askgrid.plans.registry import query

AMOUNT = "decimal(18,2)"


def amount(name: str):
    return F.col(name).cast(AMOUNT)


@query("correlated_max", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F'
  THEN (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey)
  ELSE (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey
        AND l_returnflag = 'R') END AS last_line
FROM orders""")
def correlated_max(t):
    """Two correlated MAX subqueries in a CASE, computed in one pass over the lines."""
    tops = t.lineitem.groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("any_line"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("returned_line"))
    return t.orders.join(tops, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("any_line"))
        .otherwise(F.col("returned_line")).alias("last_line"))


@query("corr_max_leq_date", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey
                     AND i.o_orderdate <= DATE '1999-01-01')""")
def corr_max_leq_date(t):
    """Rows at the latest date not after a day; the per-key maximum is attached by key."""
    bound = F.lit("1999-01-01").cast("timestamp_ntz")
    eligible = t.orders.where(F.col("o_orderdate") <= bound).select(
        "o_orderkey", "o_custkey", "o_orderdate")
    latest = group_values_over(eligible, ["o_custkey"], {"latest": F.max("o_orderdate")})
    return latest.where("o_orderdate = latest").select("o_orderkey", "o_custkey")


@query("latest_row_per_key", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
  FROM orders) WHERE rn = 1""")
def latest_row_per_key(t):
    """ROW_NUMBER() = 1 as a combinable maximum."""
    return latest_per_key(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus",
                        "o_orderpriority"),
        ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("rank_then_filter", """
SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
  FROM orders) WHERE rn = 1 AND o_orderstatus = 'F'""")
def rank_then_filter(t):
    """The status is tested after ranking: keys whose latest row fails disappear."""
    return latest_per_key(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"),
        ["o_custkey"], ["o_orderdate", "o_orderkey"]).where("o_orderstatus = 'F'").select(
        "o_custkey", "o_orderkey")


@query("top_rows_per_key", """
SELECT c_mktsegment, o_orderkey, rn FROM (
  SELECT c_mktsegment, o_orderkey, CAST(row_number() OVER (PARTITION BY c_mktsegment
    ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey) AS INTEGER) AS rn
  FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn <= 5""")
def top_rows_per_key(t):
    """Five largest orders of each segment; ranks are cut before the shuffle."""
    w = Window.partitionBy("c_mktsegment").orderBy(amount("o_totalprice").desc(), "o_orderkey")
    return (t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
            .withColumn("rn", F.row_number().over(w)).where("rn <= 5")
            .select("c_mktsegment", "o_orderkey", "rn"))


@query("dup_count_window", """
SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem)
WHERE copies > 1""")
def dup_count_window(t):
    """COUNT(*) OVER: duplicated keys with their rows."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    repeated = cut(lines.groupBy("l_orderkey", "l_linenumber")
                   .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    return attach_by_key(lines, repeated, ["l_orderkey", "l_linenumber"], "copies").where(
        "copies IS NOT NULL")


@query("group_total_window", """
SELECT o_orderkey, o_custkey,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE)
  AS customer_total
FROM orders""")
def group_total_window(t):
    """SUM OVER (PARTITION BY): the group total next to each detail row."""
    return group_values_over(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"],
        {"customer_total": F.sum(amount("o_totalprice")).cast("double")}).drop("o_totalprice")


@query("running_sum", """
SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  AS running_total
FROM orders""")
def running_sum_query(t):
    """Running total with a unique order, cut into one bucket per day and key."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate",
                           amount("o_totalprice").alias("price"))
    return running_sum(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                       F.to_date("o_orderdate"), "price", "running").select(
        "o_orderkey", "o_custkey", F.col("running").cast("double").alias("running_total"))


@query("pivot_line_numbers", """
WITH lines AS (
  SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty
  FROM lineitem GROUP BY ALL),
turns AS (
  SELECT l_orderkey, qty, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_partkey) AS turn FROM lines)
SELECT l_orderkey, max(qty) FILTER (turn = 1) AS t1, max(qty) FILTER (turn = 2) AS t2,
       max(qty) FILTER (turn = 3) AS t3, max(qty) FILTER (turn = 4) AS t4,
       max(qty) FILTER (turn = 5) AS t5
FROM turns WHERE turn <= 5 GROUP BY ALL""")
def pivot_line_numbers(t):
    """ROW_NUMBER feeding PIVOT; the fixed list of turns bounds the ranks."""
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("qty"))
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    turns = lines.withColumn("turn", F.row_number().over(w)).where("turn <= 5")
    wide = turns.groupBy("l_orderkey").pivot("turn", [1, 2, 3, 4, 5]).agg(F.max("qty"))
    return wide.select("l_orderkey", *[F.col(str(i)).alias(f"t{i}") for i in range(1, 6)])


@query("unpivot_amounts", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, CAST(amount AS DOUBLE) AS amount
FROM lineitem, LATERAL (VALUES
  ('net', CAST(l_extendedprice AS DECIMAL(18,2))),
  ('quantity', CAST(l_quantity AS DECIMAL(18,2))),
  ('discount', -CAST(l_discount AS DECIMAL(18,2))),
  ('tax', CAST(l_tax AS DECIMAL(18,2)))) AS v(kind, amount)
WHERE amount <> 0""")
def unpivot_amounts(t):
    """CROSS APPLY (VALUES …)."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        amount("l_extendedprice").alias("net"), amount("l_quantity").alias("quantity"),
        (-amount("l_discount")).cast(AMOUNT).alias("discount"), amount("l_tax").alias("tax"))
    long = rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                        ["net", "quantity", "discount", "tax"], "kind", "amount")
    return long.where("amount <> 0").withColumn("amount", F.col("amount").cast("double"))


@query("proj_tagged_union", """
SELECT 'order' AS source, o_orderkey AS ref_id, o_orderpriority AS detail,
       CAST(NULL AS INTEGER) AS line_no, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
FROM orders
UNION ALL
SELECT 'line', l_orderkey, NULL, l_linenumber,
       CAST(-CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) FROM lineitem
UNION ALL
SELECT 'supplier', s_suppkey, s_name, NULL, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE)
FROM supplier""")
def proj_tagged_union(t):
    """UNION ALL of branches padded with typed NULLs and tagged by a constant."""
    none = F.lit(None)
    orders = t.orders.select(
        F.lit("order").alias("source"), F.col("o_orderkey").alias("ref_id"),
        F.col("o_orderpriority").alias("detail"), none.cast("int").alias("line_no"),
        amount("o_totalprice").cast("double").alias("amount"))
    lines = t.lineitem.select(
        F.lit("line").alias("source"), F.col("l_orderkey").alias("ref_id"),
        none.cast("string").alias("detail"), F.col("l_linenumber").alias("line_no"),
        (-amount("l_extendedprice")).cast("double").alias("amount"))
    suppliers = t.supplier.select(
        F.lit("supplier").alias("source"), F.col("s_suppkey").alias("ref_id"),
        F.col("s_name").alias("detail"), none.cast("int").alias("line_no"),
        amount("s_acctbal").cast("double").alias("amount"))
    return orders.unionByName(lines).unionByName(suppliers)


@query("union_distinct", """
SELECT o_custkey AS party, 'customer' AS role FROM orders
UNION SELECT l_suppkey, 'supplier' FROM lineitem
UNION SELECT user_id, 'customer' FROM events""")
def union_distinct(t):
    return (t.orders.select(F.col("o_custkey").alias("party"), F.lit("customer").alias("role"))
            .union(t.lineitem.select("l_suppkey", F.lit("supplier")))
            .union(t.events.select("user_id", F.lit("customer"))).distinct())


@query("partition_identity", """
SELECT CAST(count(*) FILTER (has_f) AS BIGINT) AS with_final,
       CAST(count(*) FILTER (NOT has_f) AS BIGINT) AS without_final,
       CAST(count(*) AS BIGINT) AS customers,
       bool_and(CAST(has_f AS INTEGER) + CAST(lacks_f AS INTEGER) = 1) AS is_partition
FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f,
             c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS lacks_f
      FROM customer)""")
def partition_identity(t):
    """Paired ∪ queued = all and paired ∩ queued = ∅, checked with one semi and one anti join."""
    final = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    everyone = t.customer.select("c_custkey")
    paired = everyone.join(final, "c_custkey", "left_semi").withColumn("side", F.lit("paired"))
    queued = everyone.join(final, "c_custkey", "left_anti").withColumn("side", F.lit("queued"))
    sides = paired.unionByName(queued).groupBy("c_custkey").agg(
        F.sum(F.when(F.col("side") == "paired", 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("side") == "queued", 1).otherwise(0)).alias("q"))
    joined = everyone.join(sides, "c_custkey", "full")
    return joined.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("with_final"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("without_final"),
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.bool_and(F.coalesce(F.col("p") + F.col("q") == 1, F.lit(False))),
                   F.lit(True)).alias("is_partition"))


@query("conditional_aggs", """
SELECT l_returnflag, l_linestatus, count(*) AS line_count,
  count(*) FILTER (l_discount > 0.05) AS discounted,
  CAST(sum(CASE WHEN l_tax > 0.04 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE)
    AS taxed_amount,
  CAST(sum(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE)
    / count(CASE WHEN l_quantity > 25 THEN 1 END) AS avg_large_qty,
  max(CASE WHEN l_discount = 0 THEN l_quantity END) AS max_full_price_qty,
  min(l_quantity) AS min_qty
FROM lineitem GROUP BY ALL""")
def conditional_aggs(t):
    large = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("bigint"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.sum(F.when(F.col("l_tax") > 0.04, amount("l_extendedprice"))).cast("double")
        .alias("taxed_amount"),
        (F.sum(large).cast("double") / F.count(large)).alias("avg_large_qty"),
        F.max(F.when(F.col("l_discount") == 0, F.col("l_quantity"))).alias("max_full_price_qty"),
        F.min("l_quantity").alias("min_qty"))


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
       AS DOUBLE) AS sum_disc_price,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_qty,
  count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""")
def pricing_summary(t):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    net = price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    quantity = F.sum(amount("l_quantity")).cast("double")
    return (t.lineitem.where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
            .groupBy("l_returnflag", "l_linestatus").agg(
        quantity.alias("sum_qty"),
        F.sum(amount("l_extendedprice")).cast("double").alias("sum_base_price"),
        F.sum(net).cast("double").alias("sum_disc_price"),
        (quantity / F.count(F.lit(1))).alias("avg_qty"),
        F.count(F.lit(1)).alias("count_order")))


@query("having_count", """
SELECT l_partkey, l_suppkey, count(*) AS line_count,
       CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM lineitem GROUP BY ALL HAVING count(*) > 1 AND sum(l_quantity) >= 60""")
def having_count(t):
    """HAVING on a count and on a sum."""
    return (t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("l_quantity").alias("quantity"))
        .where("line_count > 1 AND quantity >= 60"))


@query("distinct_count", """
SELECT s_nationkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def distinct_count(t):
    """Two COUNT(DISTINCT)s per group, each deduplicated before it is counted.

    Deduplicating on (group, value) first spreads a heavy group over all tasks.
    """
    lines = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey").join(
        t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    long = lines.select("s_nationkey", F.inline(F.array(
        F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")),
        F.struct(F.lit("order").alias("kind"), F.col("l_orderkey").alias("id")))))
    return long.distinct().groupBy("s_nationkey").agg(
        F.count_if(F.col("kind") == "part").alias("parts"),
        F.count_if(F.col("kind") == "order").alias("orders"))


@query("agg_of_agg", """
WITH per_order AS (
  SELECT l_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS qty
  FROM lineitem GROUP BY l_orderkey),
per_customer AS (
  SELECT o_custkey, count(*) AS orders, max(lines) AS most_lines, sum(qty) AS qty
  FROM per_order JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_mktsegment, CAST(sum(orders) AS BIGINT) AS orders, max(most_lines) AS most_lines,
       CAST(sum(qty) AS DOUBLE) / count(*) AS mean_customer_quantity
FROM per_customer JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def agg_of_agg(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("bigint").alias("qty"))
    per_customer = (per_order.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
                    .groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.max("lines").alias("most_lines"),
        F.sum("qty").alias("qty")))
    return (per_customer.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
            .groupBy("c_mktsegment").agg(
        F.sum("orders").alias("orders"), F.max("most_lines").alias("most_lines"),
        (F.sum("qty").cast("double") / F.count(F.lit(1))).alias("mean_customer_quantity")))


@query("groupby_dedup", """
SELECT o_custkey, s_nationkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_custkey, s_nationkey""")
def groupby_dedup(t):
    """GROUP BY without an aggregate: duplicate removal, started before the join."""
    pairs = (t.lineitem.select("l_orderkey", "l_suppkey")
             .join(t.supplier.select("s_suppkey", "s_nationkey"),
                   F.col("s_suppkey") == F.col("l_suppkey"))
             .select("l_orderkey", "s_nationkey").distinct())
    return (pairs.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
            .select("o_custkey", "s_nationkey").distinct())


@query("signed_movement_balance", """
WITH movements AS (
  SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty FROM lineitem
  WHERE l_returnflag IN ('N', 'R')
  UNION ALL
  SELECT l_partkey, l_suppkey, -CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_returnflag = 'A')
SELECT l_partkey, CAST(sum(qty) AS BIGINT) AS balance FROM movements
GROUP BY l_partkey HAVING sum(qty) <> 0""")
def signed_movement_balance(t):
    """Receipts plus, issues minus.

    Both branches read the same table, so the sign becomes a CASE and the
    table is scanned once.
    """
    sign = F.when(F.col("l_returnflag") == "A", -1).otherwise(1)
    return (t.lineitem.where(F.col("l_returnflag").isin("A", "N", "R")).withColumn("sign", sign)
            .groupBy("l_partkey")
            .agg(F.sum(F.col("l_quantity").cast("bigint") * F.col("sign")).alias("balance"))
            .where("balance <> 0"))


@query("stock_by_period", """
WITH moves AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL
  SELECT s_suppkey, CAST(year(o_orderdate) AS INTEGER), -o_orderkey % 50
  FROM orders JOIN supplier ON s_suppkey = o_custkey)
SELECT l_suppkey AS suppkey, y, CAST(sum(qty) AS BIGINT) AS balance FROM moves GROUP BY ALL""")
def stock_by_period(t):
    """Signed movements from two different tables, unioned and summed."""
    received = t.lineitem.where("l_linestatus = 'O'").select(
        F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("y"),
        F.col("l_quantity").cast("bigint").alias("qty"))
    issued = (t.orders.join(t.supplier, F.col("s_suppkey") == F.col("o_custkey"))
              .select(F.col("s_suppkey").alias("suppkey"), F.year("o_orderdate").alias("y"),
                      (-F.col("o_orderkey") % 50).alias("qty")))
    return received.unionByName(issued).groupBy("suppkey", "y").agg(
        F.sum("qty").alias("balance"))


@query("null_group_sum", """
SELECT o_orderpriority, o_orderstatus,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE)
  AS final_amount
FROM orders GROUP BY ALL""")
def null_group_sum(t):
    """A group with only NULLs sums to NULL, not to zero."""
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", amount("o_totalprice"))).cast("double")
        .alias("final_amount"))


@query("ratio_nullif", """
SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)
  AS DOUBLE) / nullif(sum(CASE WHEN l_discount > 0.09 AND l_returnflag = 'N' AND l_tax = 0
  THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 0) AS return_ratio
FROM lineitem GROUP BY l_suppkey""")
def ratio_nullif(t):
    """Ratio guarded by NULLIF, since division by zero raises."""
    quantity = F.col("l_quantity").cast("bigint")
    returned = F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0))
    base = F.sum(F.when((F.col("l_discount") > 0.09) & (F.col("l_returnflag") == "N")
                        & (F.col("l_tax") == 0), quantity).otherwise(0))
    return t.lineitem.groupBy("l_suppkey").agg(returned.alias("r"), base.alias("b")).select(
        "l_suppkey", tsql.ratio(F.col("r").cast("double"), F.col("b")).alias("return_ratio"))


@query("scalar_subquery", """
SELECT o_orderkey, CAST(datediff('day', CAST(o_orderdate AS DATE),
  CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS INTEGER) AS age_days
FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""")
def scalar_subquery(t):
    """Uncorrelated scalar subqueries in the list and in the predicate."""
    newest = t.orders.select(F.max("o_orderdate").cast("date"))
    mean = t.orders.select(F.avg("o_totalprice"))
    return t.orders.where(F.col("o_totalprice") > mean.scalar()).select(
        "o_orderkey", F.datediff(newest.scalar(), F.col("o_orderdate").cast("date"))
        .alias("age_days"))


@query("single_value_guard", """
SELECT n_nationkey, n_name, r.r_name FROM nation JOIN region r ON r_regionkey = n_regionkey""")
def single_value_guard(t):
    """Deliberate failure when a lookup that must be unique is ambiguous."""
    regions = t.region.groupBy("r_regionkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("r_name").alias("r_name"))
    checked = regions.select("r_regionkey", F.when(
        F.col("n") == 1, F.col("r_name")).otherwise(
        F.raise_error(F.lit("Ambiguous region key"))).alias("r_name"))
    return t.nation.join(checked, F.col("r_regionkey") == F.col("n_regionkey")).select(
        "n_nationkey", "n_name", "r_name")


@query("chained_ctes", """
WITH per_day AS (
  SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v
  FROM events GROUP BY ALL),
active AS (SELECT user_id, count(*) AS active_days, sum(n) AS events, sum(v) AS total
           FROM per_day GROUP BY user_id),
errors AS (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error'
           GROUP BY user_id),
scored AS (SELECT a.user_id, a.active_days, a.events, a.total, coalesce(e.errors, 0) AS errors
           FROM active a LEFT JOIN errors e ON e.user_id = a.user_id),
classed AS (SELECT *, CASE WHEN errors * 4 > events THEN 'noisy'
            WHEN active_days >= 25 THEN 'regular' ELSE 'casual' END AS class FROM scored)
SELECT class, count(*) AS users, CAST(sum(events) AS BIGINT) AS events,
       CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(total) AS DOUBLE) AS total
FROM classed GROUP BY class""")
def chained_ctes(t):
    """Five chained steps: day, user, error lookup, class, report."""
    per_day = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount("value")).alias("v"),
        F.count_if(F.col("event_type") == "error").alias("e"))
    scored = per_day.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("active_days"), F.sum("n").alias("events"),
        F.sum("v").alias("total"), F.sum("e").alias("errors"))
    classed = scored.withColumn("class", F.when(F.col("errors") * 4 > F.col("events"), "noisy")
                                .when(F.col("active_days") >= 25, "regular")
                                .otherwise("casual"))
    return classed.groupBy("class").agg(
        F.count(F.lit(1)).alias("users"), F.sum("events").alias("events"),
        F.sum("errors").alias("errors"), F.sum("total").cast("double").alias("total"))


@query("credit_request_delivery", """
WITH credits AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS entitled
                 FROM orders GROUP BY ALL),
requests AS (SELECT o_custkey AS k, CAST(year(l_shipdate) AS INTEGER) AS y,
             CAST(sum(l_quantity) AS BIGINT) AS requested
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
deliveries AS (SELECT o_custkey AS k, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS delivered
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'
               GROUP BY ALL)
SELECT c.k AS custkey, c.y AS order_year, entitled, coalesce(requested, 0) AS requested,
       coalesce(delivered, 0) AS delivered, entitled - coalesce(delivered, 0) AS remaining
FROM credits c LEFT JOIN requests r ON r.k = c.k AND r.y = c.y
LEFT JOIN deliveries d ON d.k = c.k AND d.y = c.y""")
def credit_request_delivery(t):
    """Three aggregates per key and period side by side; the two line-based ones share a pass."""
    credits = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("entitled"))
    per_order = t.lineitem.groupBy("l_orderkey", F.year("l_shipdate").alias("sy")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"),
        F.count_if(F.col("l_linestatus") == "F").alias("f"))
    lines = (per_order.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
             .groupBy(F.col("o_custkey").alias("k"), "sy")
             .agg(F.sum("q").alias("q"), F.sum("f").alias("f")))
    joined = credits.join(lines, (F.col("k") == F.col("o_custkey")) & (F.col("sy") == F.col("y")),
                          "left")
    delivered = F.coalesce("f", F.lit(0))
    return joined.select(
        F.col("o_custkey").alias("custkey"), F.col("y").alias("order_year"), "entitled",
        F.coalesce("q", F.lit(0)).alias("requested"), delivered.alias("delivered"),
        (F.col("entitled") - delivered).alias("remaining"))


@query("top_customers_report", """
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey
LIMIT 20""")
def top_customers_report(t):
    """TOP (n) … ORDER BY with a total order."""
    return (t.orders.groupBy("o_custkey").agg(F.sum(amount("o_totalprice")).alias("total"))
            .orderBy(F.desc("total"), "o_custkey").limit(20)
            .select("o_custkey", F.col("total").cast("double").alias("total")))
