"""Reading a SQL Server database through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOGIN_TIMEOUT = 5
QUERY_TIMEOUT = 10


def options(host: str, database: str, auth: str, user: str | None = None,
            password: str | None = None) -> dict[str, str]:
    """Read-only connection with login and query timeouts; ``auth`` is sql or windows."""
    url = (f"jdbc:sqlserver://{host};databaseName={database};applicationIntent=ReadOnly;"
           f"loginTimeout={LOGIN_TIMEOUT};encrypt=true;trustServerCertificate=true")
    result = {"queryTimeout": str(QUERY_TIMEOUT), "fetchsize": "10000"}
    if auth == "windows":
        url += ";integratedSecurity=true"
    elif auth == "sql":
        if not user or not password:
            raise ValueError("SQL authentication needs a user and a password")
        result.update(user=user, password=password)
    else:
        raise ValueError("auth must be 'sql' or 'windows'")
    return {"url": url, **result}


def read(spark: SparkSession, connection: dict[str, str], table: str,
         split_column: str | None = None, bounds: tuple[int, int] | None = None,
         partitions: int = 1) -> DataFrame:
    """A table, read in parallel over ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").options(**connection).option("dbtable", table)
    if split_column:
        reader = (reader.option("partitionColumn", split_column).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return reader.load()
