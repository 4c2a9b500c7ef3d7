"""The catalogue data source: footers of files and folders, drift, push-down, empty folders."""

from askgrid.sources.parquet_catalogue import FooterReader, read_files, table_columns


def write(spark, path, sql, parts=1):
    spark.sql(sql).repartition(parts).write.mode("append").parquet(path)


def test_columns_over_all_files(spark, tmp_path):
    write(spark, str(tmp_path / "a.parquet"), "SELECT id AS k, CAST(id AS string) AS s FROM range(10)", 2)
    write(spark, str(tmp_path / "a.parquet"), "SELECT CAST(id AS int) AS k, DATE'2024-01-01' AS d FROM range(5)")
    write(spark, str(tmp_path / "b.parquet"),
          "SELECT CAST(1.5 AS decimal(9,2)) AS p, array(1.0D) AS v, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t WHERE false")
    (tmp_path / "notes.txt").write_text("no table")
    files = read_files(spark, str(tmp_path))
    found = {(r.name, r.column_name): (r.ordinal, r.data_type, r.files, r.row_count)
             for r in table_columns(files).collect()}
    assert found == {("a", "k"): (1, "bigint | int", 3, 15), ("a", "s"): (2, "string", 2, 10),
                     ("a", "d"): (2, "date", 1, 5), ("b", "p"): (1, "decimal(9,2)", 1, 0),
                     ("b", "v"): (2, "array<double>", 1, 0), ("b", "t"): (3, "timestamp_ntz", 1, 0)}
    assert files.where("name = 'a'").count() == 3
    assert files.where("name IN ('b', 'x') AND bytes > 0").count() == 1
    assert files.where("name = 'a' AND name = 'b'").count() == 0


def test_filters_choose_what_is_listed(tmp_path, spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    write(spark, str(tmp_path / "a.parquet"), "SELECT 1 AS k")
    write(spark, str(tmp_path / "b.parquet"), "SELECT 1 AS k")
    reader = FooterReader(str(tmp_path))
    left = [GreaterThan(("bytes",), 3), EqualTo(("file",), "f")]
    assert list(reader.pushFilters([In(("name",), ("b", "c")), *left])) == left
    assert [part.name for part in reader.partitions()] == ["b"]


def test_empty_folder(spark, tmp_path):
    files = read_files(spark, str(tmp_path))
    assert files.count() == 0 and table_columns(files).count() == 0
