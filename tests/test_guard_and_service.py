import pytest

from askgrid.operators import compare, guard
from askgrid.operators.execute import column_profile, execute, guarded_frame, sample
from askgrid.operators.journal import chained, verify_chain
from askgrid.service import QuestionService, RankedTable, SparkExecutor, FrameSchemaProvider
from pyspark.sql import functions as F

KNOWN = ["product", "sale"]


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    spark.createDataFrame([(1, "تهران"), (2, "b")], "ProductID int, ProductName string"
                          ).createOrReplaceTempView("product")
    spark.createDataFrame([(1, 5), (1, 7), (2, None)], "ProductID int, Quantity int"
                          ).createOrReplaceTempView("sale")


@pytest.mark.parametrize("sql", [
    "SELECT ProductName FROM product",
    "```sql\nSELECT p.[ProductName], SUM(s.Quantity) AS total FROM [product] p JOIN sale s "
    "ON s.ProductID = p.ProductID GROUP BY p.ProductName ORDER BY total;\n```",
    "WITH t AS (SELECT ProductID FROM sale) SELECT * FROM t",
    "SELECT x.n FROM (SELECT count(*) AS n FROM sale) x",
    "SELECT TOP (1) ProductID FROM product ORDER BY ProductID DESC",
    "SELECT ProductName FROM product WHERE EXISTS (SELECT 1 FROM sale WHERE sale.ProductID = product.ProductID)",
    "SELECT N'it''s; fine' AS v, ISNULL(Quantity, 0) AS q FROM sale -- DELETE FROM sale",
])
def test_valid(spark, sql):
    result = guard.validate(spark, sql, KNOWN)
    assert result.valid, result.errors
    spark.sql(result.cleaned_sql).collect()


@pytest.mark.parametrize("sql, error", [
    ("", "SQL is empty."),
    ("DELETE FROM product", "Forbidden SQL operation detected: DELETE."),
    ("DROP TABLE product", "Only SELECT queries are allowed."),
    ("INSERT INTO product SELECT 3, 'c'", "Only SELECT queries are allowed."),
    ("SELECT 1; DELETE FROM product", "Exactly one SQL statement is allowed."),
    ("SELECT * FROM nowhere", "Unknown table: nowhere."),
    ("SELECT * FROM parquet.`/etc`", "Unknown table: parquet./etc."),
    ("SELECT Missing FROM product", "Unknown column: Missing."),
    ("SELECT p.Missing FROM product p", "Unknown column: p.Missing."),
    ("SELECT reflect('java.lang.System', 'exit', 1) FROM product", "Forbidden function: reflect."),
    ("SELECT (SELECT max(x) FROM hidden) FROM product", "Unknown table: hidden."),
    ("SELECT TRANSFORM (ProductID) USING 'cat' FROM product", "Only SELECT queries are allowed."),
    ("SELECT FROM WHERE", None),
    ("SET spark.x = 1", "Only SELECT queries are allowed."),
    ("SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS a) SELECT * FROM secret)",
     "Unknown table: secret."),
    ("SELECT * FROM (WITH t AS (SELECT 1 AS a) SELECT * FROM t) x JOIN t ON true", "Unknown table: t."),
    ("WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "Unknown table: b."),
    ("SELECT leak(ProductID) FROM product", "Forbidden function: leak."),
    ("SELECT current_user() FROM product", "Forbidden function: current_user."),
    ("SELECT upper(ProductName) FROM product WHERE 1 / ProductID > 0",
     "Integers are divided; write DIV or a decimal."),
    ("SELECT (SELECT max(Quantity / 2) FROM sale) AS x FROM product",
     "Integers are divided; write DIV or a decimal."),
    ("SELECT TOP 10 PERCENT ProductID FROM product", "TOP with PERCENT or TIES is not supported."),
    ("SELECT * FROM (SELECT TOP 1 ProductID FROM product UNION SELECT 3) x",
     "TOP beside a set operator is not supported."),
    ("SELECT p.ProductID FROM product p CROSS APPLY (SELECT TOP 1 * FROM hidden) x", "Unknown table: hidden."),
    ("SELECT p.ProductID FROM product p CROSS APPLY leak(p.ProductID) x",
     "APPLY is only supported over a subquery or VALUES."),
    ("SELECT CONVERT(varchar(20), ProductID, 131) AS v FROM product", "This style of CONVERT is not supported."),
    ("SELECT CAST(ProductID AS xml) AS v FROM product", "The type xml is not supported."),
    ("SELECT DATEDIFF(week, a, b) FROM product", "DATEDIFF is not supported in this form."),
])
def test_rejected(spark, sql, error):
    result = guard.validate(spark, sql, KNOWN)
    assert result.status == "rejected" and not result.valid
    if error:
        assert error in result.errors, result.errors
    assert len(result.errors) == len(set(result.errors))


def test_abstention_and_tables(spark):
    assert guard.validate(spark, "I do not know", KNOWN).status == "abstained"
    joined = guard.validate(spark, "SELECT 1 AS x FROM SALE s JOIN Product p ON true", KNOWN)
    assert joined.referenced_tables == ["sale", "product"]


def test_unqualified_names_must_be_unique():
    known = ["a.t", "b.t", "b.u"]
    assert guard.resolve("t", known) is None
    assert guard.resolve("U", known) == "b.u"
    assert guard.resolve("A.T", known) == "a.t"


def test_binding(spark):
    assert guard.parameter_names("SELECT @a, :b, '@c' FROM t WHERE x = @a") == ["a", "b"]
    with pytest.raises(ValueError, match="b"):
        guard.bind("SELECT @a, @b", {"a": 1})
    rows = guarded_frame(spark, "SELECT ProductID FROM product WHERE ProductID = @p", KNOWN, {"p": 2}).collect()
    assert [r[0] for r in rows] == [2]


@pytest.mark.parametrize("sql, value", [
    (r"SELECT 'C:\new' AS v", r"C:\new"), (r"SELECT N'it''s \t' AS v", r"it's \t"),
    ("SELECT DATEDIFF(minute, TIMESTAMP'2020-01-01 00:00:59', TIMESTAMP'2020-01-01 00:01:00') AS v", 1),
    ("SELECT DATEDIFF(day, CAST('2020-01-01 23:59:00' AS timestamp), CAST('2020-01-02' AS timestamp)) AS v", 1),
    ("SELECT DATEDIFF(mi, DATE'2020-01-01', date_add(DATE'2020-01-01', 1)) AS v", 1440),
    ("SELECT 'DATEDIFF(minute, a)' AS v", "DATEDIFF(minute, a)"),
    ("SELECT 7 / 2.0 AS v", None), ("SELECT CAST(7 AS float) / 2 AS v", 3.5), ("SELECT 7 DIV 2 AS v", 3)])
def test_same_value_as_the_dialect(spark, sql, value):
    rows = guarded_frame(spark, sql, KNOWN).collect()
    assert value is None or rows[0][0] == value


@pytest.mark.parametrize("sql, rows", [
    ("SELECT AVG(Quantity) AS v FROM sale", [(6,)]),
    ("SELECT AVG(n) AS v FROM (SELECT 1 AS n UNION ALL SELECT 2) x", [(1,)]),
    ("SELECT AVG(n) AS v FROM (SELECT -1 AS n UNION ALL SELECT -2) x", [(-1,)]),
    ("SELECT AVG(n * 1.0) AS v FROM (SELECT 1 AS n UNION ALL SELECT 2) x", [(1.5,)]),
    ("SELECT (SELECT AVG(Quantity) FROM sale) AS v", [(6,)]),
    ("SELECT AVG(Quantity) OVER () AS v FROM sale WHERE Quantity = 7", [(7,)]),
    ("SELECT 'a+' + N'b' + CAST(ProductID AS nvarchar(5)) + '(+)' AS v FROM product ORDER BY v", [("a+b1(+)",), ("a+b2(+)",)]),
    ("SELECT ProductID + 1 AS v FROM product ORDER BY v", [(2,), (3,)]),
    ("SELECT CONVERT(nvarchar(2), 'abc') AS v, CAST('xyz' AS varchar(max)) AS w, CONVERT(int, 7.9) AS k", [("ab", "xyz", 7)]),
    ("SELECT CONVERT(varchar(8), CAST('2020-03-04' AS date), 112) AS v", [("20200304",)]),
    ("SELECT CHARINDEX('b', 'abcb') AS v, CHARINDEX('b', 'abcb', 3) AS w, LEN('ab  ') AS n", [(2, 4, 2)]),
    ("SELECT DATEPART(month, CAST('2020-03-04' AS date)) AS v, DATEADD(dd, 2, CAST('2020-03-04' AS date)) > "
     "CAST('2020-03-05' AS date) AS w", [(3, True)]),
    ("SELECT Quantity AS v FROM sale ORDER BY Quantity OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", [(5,)]),
    ("SELECT Quantity AS v FROM sale ORDER BY Quantity DESC OFFSET 1 ROW", [(5,), (None,)]),
    ("SELECT p.ProductID, x.Quantity FROM product p OUTER APPLY (SELECT TOP (1) s.Quantity FROM sale s WHERE "
     "s.ProductID = p.ProductID AND s.Quantity > 0 ORDER BY s.Quantity DESC) AS x ORDER BY p.ProductID", [(1, 7), (2, None)]),
    ("SELECT p.ProductID, x.Quantity FROM product p CROSS APPLY (SELECT TOP 1 s.Quantity FROM sale s WHERE "
     "s.ProductID = p.ProductID AND s.Quantity > 0 ORDER BY s.Quantity) x", [(1, 5)]),
    ("SELECT p.ProductID, x.n, y.m FROM product p CROSS APPLY (SELECT COUNT(*) AS n FROM sale s WHERE s.ProductID = "
     "p.ProductID) x OUTER APPLY (SELECT MAX(s.Quantity) AS m FROM sale s WHERE s.ProductID = p.ProductID AND x.n > 1) y "
     "ORDER BY p.ProductID", [(1, 2, 7), (2, 1, None)]),
    ("SELECT p.ProductID, v.k, v.q FROM product p CROSS APPLY (VALUES ('a', p.ProductID), ('b', p.ProductID * 10)) AS v(k, q) "
     "WHERE p.ProductID = 2 ORDER BY v.k", [(2, "a", 2), (2, "b", 20)]),
    ("SELECT q.[5], q.[7] FROM (SELECT ProductID, Quantity, Quantity AS v FROM sale) AS s PIVOT (MAX(v) FOR Quantity IN "
     "([5], [7])) AS q WHERE q.ProductID = 1", [(5, 7)]),
    ("SELECT (SELECT TOP (1) s.Quantity FROM sale s WHERE s.ProductID = p.ProductID ORDER BY s.Quantity DESC) AS v "
     "FROM product p WHERE p.ProductID = 1", [(7,)]),
    ("WITH t AS (SELECT TOP 2 Quantity FROM sale ORDER BY Quantity DESC) SELECT SUM(Quantity) AS v FROM t", [(12,)]),
    ("SELECT 'CROSS APPLY (x) TOP 1 + PIVOT' AS v", [("CROSS APPLY (x) TOP 1 + PIVOT",)]),
])
def test_forms_answer_as_the_dialect(spark, sql, rows):
    checked = guard.validate(spark, sql, KNOWN)
    assert checked.valid, checked.errors
    assert [tuple(float(v) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in row)
            for row in guarded_frame(spark, sql, KNOWN).collect()] == rows


def test_registered_functions_are_refused_under_any_name(spark):
    spark.udf.register("leak", lambda x: x)
    assert guard.validate(spark, "SELECT leak(1) AS x", KNOWN).errors == ["Forbidden function: leak."]


def test_a_cut_result_is_marked(spark):
    assert not execute(spark, "SELECT ProductID FROM sale", KNOWN, max_rows=2).complete
    assert execute(spark, "SELECT ProductID FROM sale", KNOWN, max_rows=3).complete


def test_too_many_candidates_fail(spark):
    provider = FrameSchemaProvider(spark, lambda q: spark.range(101).select(F.col("id").cast("string")), None)
    with pytest.raises(ValueError, match="More candidates"):
        provider.retrieve("x")


def test_lint():
    assert guard.lint("SELECT TOP 5 x FROM t") == ["TOP"]
    assert guard.lint("SELECT DISTINCT x FROM t WHERE y = 'LIMIT'", allow_distinct=False) == ["WHERE", "DISTINCT"]


def test_bounded_execution(spark):
    result = execute(spark, "SELECT ProductID FROM sale", KNOWN, max_rows=2)
    assert (result.status, result.row_count, result.columns) == ("success", 2, ["ProductID"])
    assert execute(spark, "DELETE FROM sale", KNOWN).status == "rejected"
    failed = execute(spark, "SELECT 1 DIV (ProductID - ProductID) AS x FROM sale", KNOWN)
    assert failed.status == "execution_error" and failed.rows == []


def test_timeout(spark):
    slow = F.udf(lambda v: __import__("time").sleep(5) or v, "bigint")
    spark.udf.register("slow_value", slow)
    spark.range(4).select(slow("id").alias("id")).createOrReplaceTempView("slow_table")
    with pytest.raises(TimeoutError):
        execute(spark, "SELECT id FROM slow_table", ["slow_table"], timeout=0.5)


def test_sample_knows_whether_it_is_complete(spark):
    frame = spark.range(5)
    assert sample(frame, 5)[1] is True and sample(frame, 4)[1] is False


def test_profile(spark):
    frame = spark.createDataFrame([("a", None), (" ", None)], "x string, y string")
    got = {r.column_name: (r.nulls, r.blanks, r.entirely_null) for r in column_profile(frame).collect()}
    assert got == {"x": (0, 1, False), "y": (2, 0, True)}


def frame(spark, rows, schema="a int, b string"):
    return spark.createDataFrame(rows, schema)


def test_comparison_is_a_multiset(spark):
    left = frame(spark, [(1, None), (1, None), (2, "x")])
    same = frame(spark, [(2, "x"), (1, None), (1, None)], "other int, names string")
    assert compare.verdict(left, same).first().status == "EXECUTION_CORRECT"
    fewer = frame(spark, [(2, "x"), (1, None)])
    assert compare.verdict(left, fewer).first().status == "RESULT_MISMATCH"
    assert [tuple(r) for r in compare.differences(left, fewer).collect()] == [(1, None, 1)]
    empty = left.limit(0)
    assert compare.verdict(empty, empty).first().status == "BOTH_EMPTY"
    with pytest.raises(ValueError, match="WIDTH"):
        compare.differences(left, left.select("a"))
    with pytest.raises(Exception, match="NONFINITE"):
        bad = frame(spark, [(float("nan"),)], "v double")
        compare.differences(bad, bad).collect()


def test_broken_chain_is_found(spark):
    entries = spark.createDataFrame([(1, i, f"r{i}") for i in range(5)], "run bigint, position bigint, record string")
    journal = chained(entries)
    assert verify_chain(journal).where("NOT linked").count() == 0
    forged = journal.withColumn("record", F.when(F.col("position") == 2, "forged").otherwise(F.col("record")))
    assert [r.position for r in verify_chain(forged).where("NOT linked").collect()] == [2]
    cut = journal.where("position <> 1")
    assert [r.position for r in verify_chain(cut).where("NOT linked").collect()] == [2]


class Provider:
    is_demo = True

    def retrieve(self, question):
        return [RankedTable(1, "product")]

    def rerank(self, question, candidates):
        return candidates


class Text:
    is_demo = True

    def __init__(self, text):
        self.text = text

    def generate(self, question, tables):
        if isinstance(self.text, Exception):
            raise self.text
        return self.text


class Runner:
    is_demo = True

    def __init__(self, inner):
        self.inner = inner

    def __call__(self, sql):
        return self.inner(sql)


def service(spark, text):
    return QuestionService(Provider(), Text(text), Runner(SparkExecutor(spark, KNOWN)),
                           lambda sql: guard.validate(spark, sql, KNOWN), mode="demo")


@pytest.mark.parametrize("text, status, steps", [
    ("SELECT ProductName FROM product WHERE ProductID = 1", "SUCCESS", ["success"] * 5),
    ("INSUFFICIENT_SCHEMA", "INSUFFICIENT_SCHEMA", ["success"] * 2 + ["abstained"] + ["skipped"] * 2),
    ("DELETE FROM product", "VALIDATION_REJECTED", ["success"] * 3 + ["rejected", "skipped"]),
    (RuntimeError("secret detail"), "GENERATION_ERROR", ["success"] * 2 + ["error"] + ["skipped"] * 2),
    (TimeoutError(), "TIMEOUT", ["success"] * 2 + ["timeout"] + ["skipped"] * 2),
    ("SELECT 1 DIV (ProductID - ProductID) AS x FROM sale", "EXECUTION_ERROR", ["success"] * 4 + ["error"]),
])
def test_service_outcomes(spark, text, status, steps):
    answer = service(spark, text).ask("Which products?")
    assert answer.status == status and list(answer.steps.values()) == steps
    assert "secret" not in (answer.error or "")
    if status == "SUCCESS":
        assert answer.rows == [["تهران"]] and answer.row_count == 1


def test_service_input_bounds_and_modes(spark):
    assert service(spark, "x").ask("  ").status == "INPUT_ERROR"
    assert service(spark, "x").ask("q" * 2001).status == "INPUT_ERROR"
    with pytest.raises(ValueError, match="mode"):
        QuestionService(Provider(), Text("x"), SparkExecutor(spark, KNOWN), None, mode="demo")
    with pytest.raises(ValueError, match="Unknown mode"):
        QuestionService(Provider(), Text("x"), None, None, mode="other")


def test_user_messages_hide_details():
    message = guard.user_message(["Unknown table: x.", "Unknown column: y.", "SQL parsing failed: at 'secret'"])
    assert "secret" not in message and "unrecognized column" in message


def test_frame_provider_orders_and_checks(spark):
    names = [f"s.t{i:02d}" for i in range(12)]
    provider = FrameSchemaProvider(
        spark, lambda q: q.join(spark.createDataFrame([(n,) for n in names], "id string")),
        lambda q, c: c.withColumn("pair_score", F.when(F.col("id") == "s.t07", 2.0).otherwise(1.0)).withColumn(
            "summary", F.col("id")))
    found = provider.retrieve("x")
    assert [t.name for t in found] == names
    top = provider.rerank("x", found)
    assert [t.name for t in top[:3]] == ["s.t07", "s.t00", "s.t01"] and len(top) == 10
    with pytest.raises(ValueError, match="Fewer"):
        provider.rerank("x", found[:9])
    with pytest.raises(ValueError, match="duplicates"):
        provider.rerank("x", found + found[:1])
