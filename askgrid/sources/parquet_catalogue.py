"""The catalogue of a folder of parquet tables as a data source.

Only footers are read: ``spark.read.format("parquet_catalogue").load(folder)``
gives one row per file, after :func:`register`. A table is an entry
``name.parquet`` of the folder, a file or a folder of part files. The folder may
be any that pyarrow opens by its address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SUFFIX = ".parquet"
FILES_PER_TASK = 256


class TableFiles(InputPartition):
    """Some files of one table: (path, bytes) pairs."""

    def __init__(self, name: str, files: list[tuple[str, int]]):
        self.name = name
        self.files = files


def spark_type(kind) -> str:
    """The Spark name of an Arrow type; Arrow's own where Spark has none."""
    from pyspark.sql.pandas.types import from_arrow_type

    try:
        return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()
    except Exception:
        return str(kind)


class FooterReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        """Equality and IN on the table's name choose what is listed; Spark applies the rest."""
        for item in filters:
            if isinstance(item, (EqualTo, In)) and item.attribute == ("name",):
                wanted = {item.value} if isinstance(item, EqualTo) else set(item.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield item

    def partitions(self):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        files, root = FileSystem.from_uri(self.folder)
        out = []
        for entry in sorted(files.get_file_info(FileSelector(root)), key=lambda info: info.path):
            name = entry.base_name.removesuffix(SUFFIX)
            if not entry.base_name.endswith(SUFFIX) or (self.names is not None and name not in self.names):
                continue
            found = ([entry] if entry.type == FileType.File
                     else files.get_file_info(FileSelector(entry.path, recursive=True)))
            listed = sorted((info.path, info.size) for info in found if info.type == FileType.File
                            and info.path.endswith(SUFFIX) and not info.base_name.startswith(("_", ".")))
            out += [TableFiles(name, listed[begin:begin + FILES_PER_TASK])
                    for begin in range(0, len(listed), FILES_PER_TASK)]
        # Spark wants one partition at least.
        return out or [TableFiles("", [])]

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        files, _ = FileSystem.from_uri(self.folder)
        for path, size in partition.files:
            with files.open_input_file(path) as handle:
                footer = pq.ParquetFile(handle)
                columns = [(place, field.name, spark_type(field.type), field.nullable)
                           for place, field in enumerate(footer.schema_arrow, start=1)]
                yield partition.name, path, size, footer.metadata.num_rows, columns


class ParquetCatalogue(DataSource):
    @classmethod
    def name(cls):
        return "parquet_catalogue"

    def schema(self):
        return ("name string, file string, bytes long, row_count long, columns "
                "array<struct<ordinal:int,column_name:string,data_type:string,nullable:boolean>>")

    def reader(self, schema):
        return FooterReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ParquetCatalogue)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("parquet_catalogue").load(folder)


def table_columns(files: DataFrame) -> DataFrame:
    """One row per table and column, over all files of the table.

    Files may disagree: the ordinal is the least one, different types are
    listed together (``bigint | int``), ``files`` says how many hold the column
    and ``row_count`` how many rows those files have.
    """
    return (files.select("name", "row_count", F.inline("columns")).groupBy("name", "column_name").agg(
        F.min("ordinal").alias("ordinal"),
        F.array_join(F.array_sort(F.collect_set("data_type")), " | ").alias("data_type"),
        F.bool_or("nullable").alias("nullable"), F.count(F.lit(1)).alias("files"),
        F.sum("row_count").alias("row_count")))
