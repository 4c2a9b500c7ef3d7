"""Guarded execution: validated SQL, bound parameters, result comparison, hash chains."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from askgrid.operators import compare
from askgrid.operators.execute import column_profile, guarded_frame
from askgrid.operators.guard import collated
from askgrid.operators.journal import chained, verify_chain
from askgrid.plans.registry import query
from askgrid.sources.tables import TABLE_NAMES

KNOWN = list(TABLE_NAMES)

SEGMENT_REVENUE = """```sql
SELECT c.[c_mktsegment] AS segment, COUNT_BIG(*) AS order_count,
       CAST(SUM(CAST(o.o_totalprice AS decimal(18,2))) AS double) AS revenue
FROM [orders] AS o INNER JOIN [customer] AS c ON c.c_custkey = o.o_custkey
WHERE ISNULL(o.o_orderstatus, N'-') <> N'P'
GROUP BY c.c_mktsegment;
```"""

PERIOD_ORDERS = """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderdate >= @FromDate AND o_orderdate < date_add(@ThroughDate, 1)
  AND o_orderpriority = @Priority"""


def guarded(t, text, values=None):
    t.register_views()
    return guarded_frame(t.spark, text, KNOWN, values)


@query("guarded_segment_revenue", """
SELECT c_mktsegment AS segment, count(*) AS order_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON c_custkey = o_custkey WHERE coalesce(o_orderstatus, '-') <> 'P'
GROUP BY c_mktsegment""")
def guarded_segment_revenue(t):
    """A fenced T-SQL answer, validated, respelled and run."""
    return guarded(t, SEGMENT_REVENUE)


@query("guarded_parameters", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01'
AND o_orderdate < DATE '1998-07-01' AND o_orderpriority = '1-URGENT'""")
def guarded_parameters(t):
    """Typed named parameters bound by name."""
    return guarded(t, PERIOD_ORDERS, {"FromDate": datetime.date(1997, 1, 1),
                                      "ThroughDate": datetime.date(1998, 6, 30),
                                      "Priority": "1-URGENT"})


@query("parameter_selector", """
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS order_day FROM orders
WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY o_custkey
                   ORDER BY count(*) DESC, o_custkey LIMIT 1)""")
def parameter_selector(t):
    """A one-row query supplies the example value of a parameter."""
    chosen = (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "o_custkey").limit(1).select("o_custkey"))
    value = chosen.first()
    return guarded(t, "SELECT o_orderkey, CAST(CAST(o_orderdate AS date) AS string) AS order_day "
                      "FROM orders WHERE o_custkey = @Customer", {"Customer": value[0]})


@query("guarded_outer_apply", """
SELECT c.c_custkey, c.c_name, x.o_orderkey AS last_order, x.o_totalprice AS last_price, y.n AS lines, y.top_quantity
FROM customer c
LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey
                   ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true
CROSS JOIN LATERAL (SELECT count(*) AS n, max(l_quantity) AS top_quantity FROM lineitem l
                    WHERE l.l_orderkey = x.o_orderkey) y""")
def guarded_outer_apply(t):
    """OUTER APPLY of the latest row and CROSS APPLY of an aggregate over it, as accepted text."""
    return guarded(t, """
SELECT c.c_custkey, c.c_name, x.o_orderkey AS last_order, x.o_totalprice AS last_price, y.n AS lines, y.top_quantity
FROM [customer] AS c
OUTER APPLY (SELECT TOP (1) o.o_orderkey, o.o_totalprice FROM [orders] AS o WHERE o.o_custkey = c.c_custkey
             ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS x
CROSS APPLY (SELECT COUNT_BIG(*) AS n, MAX(l.l_quantity) AS top_quantity FROM [lineitem] AS l
             WHERE l.l_orderkey = x.o_orderkey) AS y""")


@query("guarded_pivot", """
SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS first_line,
       max(l_quantity) FILTER (l_linenumber = 2) AS second_line,
       max(l_quantity) FILTER (l_linenumber = 3) AS third_line FROM lineitem GROUP BY l_orderkey""")
def guarded_pivot(t):
    """PIVOT over line numbers as accepted text."""
    return guarded(t, """
SELECT p.l_orderkey, p.[1] AS first_line, p.[2] AS second_line, p.[3] AS third_line
FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM [lineitem]) AS s
PIVOT (MAX(l_quantity) FOR l_linenumber IN ([1], [2], [3])) AS p""")


@query("guarded_values_unpivot", """
SELECT l_orderkey, l_linenumber, kind, amount FROM (
  SELECT l_orderkey, l_linenumber, 'price' AS kind, l_extendedprice AS amount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_extendedprice * l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'quantity', l_quantity FROM lineitem) WHERE amount > 0""")
def guarded_values_unpivot(t):
    """CROSS APPLY (VALUES …) turns columns into rows, as accepted text and without a join."""
    return guarded(t, """
SELECT l.l_orderkey, l.l_linenumber, v.kind, v.amount FROM [lineitem] AS l
CROSS APPLY (VALUES (N'price', l.l_extendedprice), (N'discount', l.l_extendedprice * l.l_discount),
                    (N'quantity', l.l_quantity)) AS v (kind, amount)
WHERE v.amount > 0""")


@query("guarded_typed_meaning", """
SELECT o_orderpriority, (sum(o_custkey) // count(o_custkey))::BIGINT AS mean_customer,
       left(o_orderpriority, 3) || '/' || max(CAST(year(o_orderdate) AS VARCHAR)) AS tag,
       strpos(o_orderpriority, '-')::INTEGER AS dash, max(strftime(o_orderdate, '%Y%m%d')) AS last_day,
       min(month(o_orderdate))::INTEGER AS first_month, max(length(rtrim(o_orderstatus)))::INTEGER AS width
FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 3 OFFSET 1""")
def guarded_typed_meaning(t):
    """AVG of integers, CONVERT, text sums, CHARINDEX, DATEPART, LEN and OFFSET as T-SQL means them."""
    return guarded(t, """
SELECT o_orderpriority, AVG(o_custkey) AS mean_customer,
       CONVERT(nvarchar(3), o_orderpriority) + N'/' + MAX(CAST(YEAR(o_orderdate) AS nvarchar(4))) AS tag,
       CHARINDEX(N'-', o_orderpriority) AS dash, MAX(CONVERT(varchar(8), o_orderdate, 112)) AS last_day,
       MIN(DATEPART(month, o_orderdate)) AS first_month, MAX(LEN(o_orderstatus)) AS width
FROM [orders] GROUP BY o_orderpriority ORDER BY o_orderpriority
OFFSET 1 ROWS FETCH NEXT 3 ROWS ONLY""")


@query("guarded_collation", """
WITH spelled AS (
  SELECT o_custkey, o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority)
         WHEN 1 THEN o_orderpriority || '  ' ELSE o_orderpriority END AS priority FROM orders),
urgent AS (SELECT DISTINCT upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 100000)
SELECT lower(rtrim(s.priority)) AS priority, count(*) AS n, max(o_totalprice) AS top_price,
       count(DISTINCT lower(rtrim(s.priority))) AS spellings
FROM spelled s JOIN urgent u ON lower(rtrim(u.priority)) = lower(rtrim(s.priority))
WHERE lower(rtrim(s.priority)) <> '5-low' GROUP BY lower(rtrim(s.priority))""")
def guarded_collation(t):
    """Grouping, joining and comparing texts that differ in case and trailing blanks, as a server collates them."""
    priority = F.col("o_orderpriority")
    spelled = t.orders.select(
        "o_custkey", "o_totalprice",
        F.when(F.col("o_orderkey") % 3 == 0, F.lower(priority))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(priority, F.lit("  "))).otherwise(priority).alias("priority"))
    urgent = t.orders.where("o_totalprice > 100000").select(F.upper(priority).alias("priority")).distinct()
    collated(spelled).createOrReplaceTempView("spelled")
    collated(urgent).createOrReplaceTempView("urgent")
    found = guarded_frame(t.spark, """
SELECT LOWER(RTRIM(MIN(s.priority))) AS priority, COUNT_BIG(*) AS n, MAX(s.o_totalprice) AS top_price,
       COUNT_BIG(DISTINCT s.priority) AS spellings
FROM [spelled] AS s INNER JOIN [urgent] AS u ON u.priority = s.priority
WHERE s.priority <> N'5-low ' GROUP BY s.priority""", ["spelled", "urgent"])
    return found.withColumn("priority", F.collate("priority", "UTF8_BINARY"))


@query("sample_profile", """
WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN '  ' ELSE o_orderpriority END AS priority,
  CAST(NULL AS VARCHAR) AS note FROM orders)
SELECT 'o_orderkey' AS column_name, count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS nulls,
       0::BIGINT AS blanks, false AS entirely_null FROM o
UNION ALL SELECT 'status', count(*), count(*) FILTER (status IS NULL), 0, false FROM o
UNION ALL SELECT 'priority', count(*), 0, count(*) FILTER (trim(priority) = ''), false FROM o
UNION ALL SELECT 'note', count(*), count(*), 0, true FROM o""")
def sample_profile(t):
    """NULL and blank counts per result column, all in one pass."""
    result = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_orderkey") % 10 == 0, "  ").otherwise(F.col("o_orderpriority"))
        .alias("priority"), F.lit(None).cast("string").alias("note"))
    return column_profile(result)


@query("compare_equal_results", """
WITH gold AS (SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
              WHERE l_returnflag = 'R'),
predicted AS (SELECT o_custkey, l_partkey FROM lineitem, orders WHERE o_orderkey = l_orderkey
              AND NOT (l_returnflag IN ('A', 'N'))),
differing AS (SELECT count(*) AS n FROM (
  SELECT o_custkey, l_partkey FROM (
    SELECT *, 1 AS side FROM gold UNION ALL SELECT *, -1 FROM predicted)
  GROUP BY ALL HAVING sum(side) <> 0))
SELECT (SELECT count(*) FROM gold) AS gold_rows, (SELECT count(*) FROM predicted) AS predicted_rows,
       n AS differing_rows, CASE WHEN n = 0 THEN 'EXECUTION_CORRECT' ELSE 'RESULT_MISMATCH' END AS status
FROM differing""")
def compare_equal_results(t):
    """Two spellings of one question give the same multiset, whatever the column names."""
    gold = guarded(t, "SELECT o_custkey AS customer, l_partkey AS part FROM orders "
                      "JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
    predicted = guarded(t, "SELECT o.o_custkey, l.l_partkey FROM lineitem l, orders o "
                           "WHERE o.o_orderkey = l.l_orderkey AND NOT (l.l_returnflag IN ('A','N'))")
    return compare.verdict(gold, predicted)


@query("compare_mismatch", """
WITH g AS (SELECT o_custkey AS c0, nullif(o_orderstatus, 'P') AS c1, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT o_custkey AS c0, nullif(o_orderstatus, 'P') AS c1, count(*) AS n FROM (
  SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY ALL)
SELECT g.c0, g.c1, g.n - coalesce(p.n, 0) AS surplus
FROM g LEFT JOIN p ON p.c0 = g.c0 AND p.c1 IS NOT DISTINCT FROM g.c1
WHERE g.n <> coalesce(p.n, 0)""")
def compare_mismatch(t):
    """A DISTINCT too many loses copies; NULL values match each other."""
    status = F.nullif("o_orderstatus", F.lit("P")).alias("status")
    gold = t.orders.select("o_custkey", status)
    predicted = (t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()
                 .select("o_custkey", status))
    return compare.differences(gold, predicted)


@query("journal_chain_verify", """
WITH RECURSIVE e AS (SELECT event_id, event_id // 50 AS run, event_id % 50 AS position,
  event_type || ':' || CAST(user_id AS VARCHAR) AS record FROM events),
chain AS (
  SELECT run, position, record, sha256('run ' || run) AS previous_sha,
         sha256(sha256('run ' || run) || record) AS sha FROM e WHERE position = 0
  UNION ALL
  SELECT e.run, e.position, e.record, c.sha, sha256(c.sha || e.record)
  FROM chain c JOIN e ON e.run = c.run AND e.position = c.position + 1)
SELECT run, count(*) AS entries,
       bool_and(sha256(previous_sha || CASE WHEN run % 7 = 0 AND position = 3 THEN record || '!' ELSE record END)
                = sha) AS intact,
       arg_max(sha, position) AS last_sha FROM chain GROUP BY run""")
def journal_chain_verify(t):
    """Chains of at most fifty entries per run, verified in parallel; every seventh run was tampered with."""
    entries = t.events.select(
        F.floor(F.col("event_id") / 50).alias("run"), (F.col("event_id") % 50).alias("position"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("record"))
    tampered = chained(entries).withColumn("record", F.when(
        (F.col("run") % 7 == 0) & (F.col("position") == 3), F.concat("record", F.lit("!"))).otherwise(
            F.col("record")))
    return verify_chain(tampered).groupBy("run").agg(
        F.count(F.lit(1)).alias("entries"), F.bool_and("linked").alias("intact"),
        F.max_by("sha", "position").alias("last_sha"))


@query("unchanged_sql_reuse", """
SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (
  SELECT 1 FROM conversations p WHERE p.turn < 2 AND p.conv_id = c.conv_id
  AND p.turn = c.turn AND sha256(p.text) = sha256(c.text))""")
def unchanged_sql_reuse(t):
    """Cases whose text hash is already recorded are skipped."""
    hashed = t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("sha"))
    recorded = hashed.where("turn < 2")
    return hashed.join(recorded, ["conv_id", "turn", "sha"], "left_anti").select("conv_id", "turn")
