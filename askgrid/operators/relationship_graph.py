"""Directed relationship graph of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.documents import outgoing_targets


def outgoing_edges(documents: DataFrame) -> DataFrame:
    """(src, dst) from document text: distinct, indexed targets only, no self edges."""
    indexed = documents.select(F.col("full_name").alias("dst"))
    return (documents.select(F.col("full_name").alias("src"),
                             F.explode(outgoing_targets(F.col("text"))).alias("dst"))
            .where("src <> dst").distinct().join(indexed, "dst", "left_semi").select("src", "dst"))


def table_roles(mappings: DataFrame) -> DataFrame:
    """(form_id, table, role, form_roles): role of each mapped table, and all roles of its form.

    ``mappings``: (form_id, table, is_primary); an unknown flag gives no role.
    """
    role = F.when(F.col("is_primary"), "primary").when(~F.col("is_primary"), "detail_or_member")
    roles = mappings.select("form_id", "table", role.alias("role")).distinct()
    per_form = roles.groupBy("form_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("form_roles"))
    return roles.join(per_form, "form_id").select("form_id", "table", "role", "form_roles")


def form_edges(mappings: DataFrame) -> DataFrame:
    """(src, dst) both ways between the single primary table of a form and its other tables.

    ``mappings``: (form_id, table, is_primary). A form counts only when every
    table has one role and exactly one table is primary.
    """
    roles = mappings.groupBy("form_id", "table").agg(
        F.count_distinct(F.coalesce(F.col("is_primary").cast("int"), F.lit(-1))).alias("roles"),
        F.max("is_primary").alias("primary"), F.count_if(F.col("is_primary").isNull()).alias("unknown"))
    forms = roles.groupBy("form_id").agg(
        F.bool_and((F.col("roles") == 1) & (F.col("unknown") == 0)).alias("clear"),
        F.count_if("primary").alias("primaries"),
        F.max(F.when(F.col("primary"), F.col("table"))).alias("primary_table"))
    valid = forms.where("clear AND primaries = 1").select("form_id", "primary_table")
    members = roles.join(valid, "form_id").where("table <> primary_table")
    both = F.array(F.struct(F.col("primary_table").alias("src"), F.col("table").alias("dst")),
                   F.struct(F.col("table").alias("src"), F.col("primary_table").alias("dst")))
    return members.select(F.inline(both)).distinct()


def build(fk_pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(src, dst, families): every directed pair with the families that support it."""
    pairs = fk_pairs.where("src <> dst").distinct()
    families = (pairs.select("src", "dst", F.lit("outgoing_physical_fk").alias("family"))
                .unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                          F.lit("reverse_physical_fk").alias("family")))
                .unionByName(form_edges(forms).withColumn(
                    "family", F.lit("explicit_form_association"))))
    return families.groupBy("src", "dst").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


def degrees(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Adjacency distribution over all tables, with nearest-rank percentiles."""
    counted = edges.groupBy(F.col("src").alias("full_name")).agg(F.count(F.lit(1)).alias("degree"))
    every = tables.select("full_name").join(counted, "full_name", "left").select(
        F.coalesce("degree", F.lit(0)).alias("degree"))
    return every.agg(
        F.count(F.lit(1)).alias("tables"), F.min("degree").alias("minimum"),
        F.median("degree").alias("median"),
        (F.sum("degree").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY degree)").cast("bigint").alias("p95"),
        F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY degree)").cast("bigint").alias("p99"),
        F.max("degree").alias("maximum"))
