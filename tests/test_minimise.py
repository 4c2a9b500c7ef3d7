from pyspark.sql import functions as F

from askgrid.functions.unicode import joined_form
from askgrid.operators.minimise import business_text, minimise, redact_secrets


CASES = [
    ("Keep this line", "Keep this line"),
    ("a\n\n\n\nb\n\n", "a\n\nb"),
    ("\n\nfirst", "first"),
    ("see https://example.com/x?y=1 now", "see [removed URL] now"),
    ("mail a.b+c@mail.example.org please", "mail [removed email] please"),
    ("call 09123456789 or 1091234567890", "call [removed phone] or 1091234567890"),
    ("password: secret\nkept", "kept"),
    ("[username]: joe\nkept", "kept"),
    ("Traceback (most recent call last)\nkept", "kept"),
    ("at Foo.Bar.Baz(line 3)\nkept", "kept"),
    ("at\tFoo.Bar(x)\nkept", "kept"),
    ("message:\nkept", "kept"),
    ("x" * 60, "[removed encoded value]"),
    ("id 123e4567-e89b-12d3-a456-426614174000 end", "id [removed diagnostic id] end"),
    ("ID: 42 total", "[removed record id] total"),
    ("order (ID: 42) total", "order total"),
    ("آقای احمدی رضایی درخواست", "[removed person] درخواست"),
    ("wait ..... here   now", "wait here now"),
    (" - trimmed : ", "trimmed"),
    ("ﬁxed", "fixed"),
    ("a\r\nb\rc", "a\nb\nc"),
]

PAYLOAD = '{"a": "' + "x y " * 80 + '"}'


def test_rules(spark):
    cases = CASES + [(PAYLOAD + "\nkept", "kept")]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in frame.select("i", minimise(F.col("t")).alias("v")).collect()}
    wrong = [(text, got[i], expected) for i, (text, expected) in enumerate(cases) if got[i] != expected]
    assert wrong == []


def test_whole_field_is_withheld(spark):
    frame = spark.createDataFrame([("server = db1",), ("plain text",), ("Bearer abc",)], "t string")
    assert [r.v for r in frame.select(redact_secrets(F.col("t")).alias("v")).collect()] == [
        "[REDACTED_SENSITIVE_TEXT]", "plain text", "[REDACTED_SENSITIVE_TEXT]"]


def test_business_text_and_selection_form(spark):
    cases = [("فرم سفارش:", "message: undefined", ""), ("گزارش فروش", None, ""), ("فرم سفارش", "x", "فرم سفارش x"),
             ("Title", "a message: String q is not a valid TimeSpan. b", "Title a b"), (None, "message: null", "")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.t for r in frame.select("i", business_text(F.col("a"), F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == [c for *_, c in cases]
    one = spark.range(1).select(joined_form(F.lit("می\u200cخواهم  STRASSE ß")).alias("t")).first().t
    assert one == "می خواهم strasse ss"
