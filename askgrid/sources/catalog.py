"""Catalogue frames: tables, columns, primary keys, foreign keys.

Working form, one row per item:
  tables   (schema, name, description)
  columns  (schema, name, ordinal, column, data_type, max_length, precision,
            scale, nullable, identity, description)
  pk       (schema, name, ordinal, column)
  fk       (constraint, schema, name, ordinal, column, ref_schema, ref_name, ref_column)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types whose length or precision is shown.
LENGTH_TYPES = ("varchar", "nvarchar", "char", "nchar", "binary", "varbinary")
PRECISION_TYPES = ("decimal", "numeric")
UNICODE_TYPES = ("nvarchar", "nchar")


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    pk: DataFrame
    fk: DataFrame

    def with_prefix(self, prefixes: list[str]) -> "Catalog":
        """Only tables whose schema starts with one of the prefixes, ignoring case."""
        keep = F.lit(False)
        for prefix in prefixes:
            keep = keep | F.lower("schema").startswith(prefix.lower())
        return Catalog(self.tables.where(keep), self.columns.where(keep), self.pk.where(keep),
                       self.fk.where(keep))


def character_length(data_type: Column, stored: Column) -> Column:
    """Stored byte length in characters: two bytes each for Unicode types, -1 for MAX."""
    return F.when(data_type.isin(*UNICODE_TYPES) & (stored > 0), F.floor(stored / 2).cast("int")
                  ).otherwise(stored)


def shown_type(data_type: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """``NVARCHAR(50)``, ``VARCHAR(MAX)``, ``DECIMAL(18,2)``, ``INT``."""
    kind = F.lower(data_type)
    length = F.when(max_length == -1, "MAX").otherwise(max_length.cast("string"))
    return (F.when(kind.isin(*LENGTH_TYPES), F.concat(F.upper(kind), F.lit("("), length, F.lit(")")))
            .when(kind.isin(*PRECISION_TYPES), F.concat(
                F.upper(kind), F.lit("("), precision.cast("string"), F.lit(","),
                scale.cast("string"), F.lit(")")))
            .otherwise(F.upper(kind)))


def full_name() -> Column:
    return F.concat_ws(".", "schema", "name")


def from_frames(spark: SparkSession, frames: dict[str, DataFrame], schema: str) -> Catalog:
    """Catalogue of Spark frames, read from their schemas; keys are not declared there."""
    sizes = {"string": -1}
    tables = [(schema, name, None) for name in frames]
    columns = []
    for name, frame in frames.items():
        for ordinal, item in enumerate(frame.schema.fields, start=1):
            kind = item.dataType
            columns.append((schema, name, ordinal, item.name, kind.simpleString().split("(")[0],
                            sizes.get(kind.simpleString()), getattr(kind, "precision", None),
                            getattr(kind, "scale", None), item.nullable, False,
                            (item.metadata or {}).get("comment")))
    key = "schema string, name string, ordinal int, column string"
    return Catalog(
        spark.createDataFrame(tables, "schema string, name string, description string"),
        spark.createDataFrame(columns, key + ", data_type string, max_length int, precision int, "
                              "scale int, nullable boolean, identity boolean, description string"),
        spark.createDataFrame([], key),
        spark.createDataFrame([], "constraint string, " + key
                              + ", ref_schema string, ref_name string, ref_column string"))


def foreign_keys(fk: DataFrame) -> DataFrame:
    """One row per constraint, with its column lists in key order."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "column", "ref_column")))
    grouped = fk.groupBy("schema", "name", "constraint", "ref_schema", "ref_name").agg(
        pairs.alias("pairs"))
    return grouped.select(
        "schema", "name", "constraint", "ref_schema", "ref_name",
        F.col("pairs.column").alias("columns"), F.col("pairs.ref_column").alias("ref_columns"))


def assemble(catalog: Catalog) -> DataFrame:
    """Nested records: one row per table with its columns, primary key and foreign keys."""
    key = ["schema", "name"]
    columns = catalog.columns.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "ordinal", F.col("column").alias("name"), "data_type", "max_length", "precision", "scale",
        "nullable", "identity", "description"))).alias("columns"))
    pk = catalog.pk.groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct("ordinal", "column"))).alias("pairs")).select(
        *key, F.col("pairs.column").alias("primary_key"))
    fk = foreign_keys(catalog.fk).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("constraint").alias("constraint_name"), "columns",
        F.struct(F.col("ref_schema").alias("schema"), F.col("ref_name").alias("table"),
                 F.col("ref_columns").alias("columns")).alias("references")))).alias("foreign_keys"))
    return (catalog.tables.join(columns, key, "left").join(pk, key, "left").join(fk, key, "left"))


def read_json(spark: SparkSession, path: str) -> Catalog:
    """Catalogue from a nested JSON document ``{"tables": [...]}``.

    A foreign key may carry one scalar ``column`` instead of ``columns``.
    """
    reference = ("struct<schema:string,table:string,columns:array<string>,column:string>")
    item = ("struct<schema:string,name:string,description:string,"
            "columns:array<struct<name:string,data_type:string,max_length:int,precision:int,scale:int,"
            "nullable:boolean,identity:boolean,description:string>>,primary_key:array<string>,"
            "foreign_keys:array<struct<constraint_name:string,columns:array<string>,column:string,"
            f"references:{reference}>>>")
    table = (spark.read.schema(f"tables array<{item}>").json(path, multiLine=True)
             .select(F.inline("tables")))
    columns = table.select("schema", "name", F.posexplode("columns").alias("p", "c")).select(
        "schema", "name", (F.col("p") + 1).alias("ordinal"), F.col("c.name").alias("column"),
        "c.data_type", "c.max_length", "c.precision", "c.scale", "c.nullable", "c.identity",
        "c.description")
    pk = table.select("schema", "name", F.posexplode("primary_key").alias("p", "column")).select(
        "schema", "name", (F.col("p") + 1).alias("ordinal"), "column")
    keys = table.select("schema", "name", F.explode("foreign_keys").alias("f")).select(
        F.col("f.constraint_name").alias("constraint"), "schema", "name",
        F.col("f.references.schema").alias("ref_schema"),
        F.col("f.references.table").alias("ref_name"),
        F.posexplode(F.arrays_zip(
            F.coalesce("f.columns", F.array("f.column")).alias("a"),
            F.coalesce("f.references.columns", F.array("f.references.column")).alias("b"))).alias("p", "z"))
    fk = keys.select("constraint", "schema", "name", (F.col("p") + 1).alias("ordinal"),
                     F.col("z.a").alias("column"), "ref_schema", "ref_name",
                     F.col("z.b").alias("ref_column"))
    return Catalog(table.select("schema", "name", "description"), columns, pk, fk)


def write_json(catalog: Catalog, path: str) -> None:
    """Nested records as JSON lines; never replaces existing output."""
    assemble(catalog).write.mode("errorifexists").json(path)
