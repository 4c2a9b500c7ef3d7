"""Searchable table documents and what can be read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import humanize
from askgrid.sources.catalog import Catalog, foreign_keys, full_name, shown_type

KEY = ["schema", "name"]


def _listed(columns: str) -> Column:
    return F.array_join(columns, ", ")


def column_lines(catalog: Catalog) -> DataFrame:
    """(schema, name, ordinal, line): one line per column, description line included."""
    keys = catalog.pk.select(*KEY, "column", F.lit(True).alias("is_key"))
    references = catalog.fk.groupBy(*KEY, "column").agg(F.array_sort(F.collect_list(F.struct(
        "constraint", "ordinal", F.concat(
            F.lit("FOREIGN KEY REFERENCES "), F.concat_ws(".", "ref_schema", "ref_name", "ref_column")
        ).alias("text")))).alias("refs"))
    attributes = F.concat(
        F.array_compact(F.array(
            F.when(F.col("is_key"), "PRIMARY KEY"), F.when(F.col("identity"), "IDENTITY"),
            F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"))),
        F.coalesce("refs.text", F.array().cast("array<string>")))
    kind = shown_type(F.col("data_type"), F.col("max_length"), F.col("precision"), F.col("scale"))
    line = F.concat(F.lit("- "), "column", F.lit(" ("), humanize(F.col("column")), F.lit(") "), kind,
                    F.lit(" ["), F.array_join(attributes, ", "), F.lit("]"))
    described = F.trim("description") != ""
    note = F.when(described, F.concat(F.lit("\n  Description: "), F.trim("description")))
    return (catalog.columns.join(keys, [*KEY, "column"], "left")
            .join(references, [*KEY, "column"], "left")
            .select(*KEY, "ordinal", F.concat(line, F.coalesce(note, F.lit(""))).alias("line")))


def relationship_lines(catalog: Catalog) -> DataFrame:
    """(schema, name, place, line): outgoing constraints, then incoming ones."""
    constraints = foreign_keys(catalog.fk)
    outgoing = constraints.select(
        *KEY, F.struct(F.lit(0), F.lit(""), F.lit(""), "constraint").alias("place"),
        F.concat(F.lit("- "), "constraint", F.lit(": FOREIGN KEY ("), _listed("columns"),
                 F.lit(") REFERENCES "), "ref_schema", F.lit("."), "ref_name", F.lit(" ("),
                 _listed("ref_columns"), F.lit(").")).alias("line"))
    incoming = constraints.select(
        F.col("ref_schema").alias("schema"), F.col("ref_name").alias("name"),
        F.struct(F.lit(1), F.col("schema"), F.col("name"), "constraint").alias("place"),
        F.concat(F.lit("- "), "constraint", F.lit(": "), F.col("schema"), F.lit("."), F.col("name"),
                 F.lit(" ("), _listed("columns"), F.lit(") references "), "ref_schema", F.lit("."),
                 "ref_name", F.lit(" ("), _listed("ref_columns"), F.lit(").")).alias("line"))
    return outgoing.union(incoming)


def render(catalog: Catalog) -> DataFrame:
    """(schema, table_name, full_name, text): one document per table.

    Lines are built row by row and only the finished lines of one table are
    brought together; a catalogue bounds them by its columns and constraints.
    """
    columns = column_lines(catalog).groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))),
                                 lambda item: item["line"]), "\n").alias("column_text"))
    relations = relationship_lines(catalog).groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))),
                                 lambda item: item["line"]), "\n").alias("relation_text"))
    keys = catalog.pk.groupBy(*KEY).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda item: item["column"]),
        ", ").alias("key_text"))
    described = F.when(F.trim("description") != "", F.concat(
        F.lit("Description: "), F.trim("description")))
    parts = F.array_compact(F.array(
        F.concat(F.lit("Table: "), full_name()),
        F.concat(F.lit("Table words: "), humanize(F.col("name"))), described,
        F.concat(F.lit("PRIMARY KEY ("), "key_text", F.lit(")")), F.lit("\nColumns:"), "column_text",
        F.lit("\nRelationships:"),
        F.coalesce("relation_text", F.lit("- No foreign-key relationships."))))
    return (catalog.tables.join(columns, KEY, "left").join(relations, KEY, "left")
            .join(keys, KEY, "left")
            .select("schema", F.col("name").alias("table_name"), full_name().alias("full_name"),
                    F.array_join(parts, "\n").alias("text")))


def chunk_records(catalog: Catalog) -> DataFrame:
    """(schema, name, kind, label, text): the records a table's chunks are packed from.

    One per column, with its type, attributes, description and the targets of
    its foreign keys, and one per foreign key of several columns.
    """
    keys = catalog.pk.select(*KEY, "column", F.lit(True).alias("is_key"))
    target = F.concat(F.lit("FK -> "), F.concat_ws(".", "ref_schema", "ref_name", "ref_column"))
    targets = catalog.fk.groupBy(*KEY, "column").agg(F.array_sort(F.collect_list(
        F.struct("constraint", "ordinal", target.alias("text")))).alias("targets"))
    attributes = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_key"), "PRIMARY KEY"), F.when(F.col("identity"), "IDENTITY"),
        F.when(F.col("nullable"), "NULL").otherwise("NOT NULL"))), ", ")
    kind = shown_type(F.col("data_type"), F.col("max_length"), F.col("precision"), F.col("scale"))
    lines = F.concat(
        F.array_compact(F.array(
            F.concat(F.lit("Column: "), "column"), F.concat(F.lit("Type: "), kind),
            F.concat(F.lit("Attributes: "), attributes),
            F.when(F.trim("description") != "", F.concat(F.lit("Description: "), F.trim("description"))))),
        F.coalesce("targets.text", F.array().cast("array<string>")))
    columns = (catalog.columns.join(keys, [*KEY, "column"], "left").join(targets, [*KEY, "column"], "left")
               .select(*KEY, F.lit("column").alias("kind"), F.col("column").alias("label"),
                       F.array_join(lines, "\n").alias("text")))
    pairs = F.zip_with("columns", "ref_columns", lambda own, other: F.concat(
        own, F.lit(" -> "), F.concat_ws(".", "ref_schema", "ref_name", other)))
    composite = foreign_keys(catalog.fk).where(F.size("columns") > 1).select(
        *KEY, F.lit("composite key").alias("kind"), F.col("constraint").alias("label"),
        F.concat(F.lit("Constraint: "), "constraint", F.lit("\nComposite FK: "),
                 F.array_join(pairs, "; ")).alias("text"))
    return columns.unionByName(composite)


def own_columns(text: Column) -> Column:
    """Column names listed in a document's own Columns section."""
    section = F.regexp_extract(text, r"(?s)(?:^|\n)Columns:\s*\n(.*?)(?:\n\nRelationships:|\z)", 1)
    return F.regexp_extract_all(section, F.lit(r"(?m)^\s*-\s+([^\s(]+)"), F.lit(1))


def outgoing_targets(text: Column) -> Column:
    """Tables named by explicit FOREIGN KEY declarations of the Relationships section."""
    section = F.try_element_at(F.split(text, r"(?:^|\n)Relationships:\s*\n", 2), F.lit(2))
    found = F.regexp_extract_all(section, F.lit(
        r"(?i)FOREIGN\s+KEY\s*\([^)]*\)\s+REFERENCES\s+([A-Za-z0-9_]+\.[A-Za-z0-9_]+)"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))
