"""Catalogue, documents, graph, chunks and captions.

The catalogue is profiled from the sales data: one table per supplier nation
and part brand, its columns are the kinds of part sold there. Its size is
bounded by nations, brands and part kinds, while the profiling pass grows with
``lineitem``. Chunking and truncation run over ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from askgrid.functions import fixed_values as fixed
from askgrid.operators import captions as cap
from askgrid.operators import chunks as ch
from askgrid.operators import documents as docs
from askgrid.operators import relationship_graph as rg
from askgrid.operators.bounded import cut, spread
from askgrid.operators.candidates import summary
from askgrid.operators.key_paths import Claim, verify_paths
from askgrid.plans.registry import query
from askgrid.sources.catalog import (
    Catalog, assemble, character_length, foreign_keys, full_name, shown_type)
from askgrid.sources.parquet_catalogue import read_files, table_columns
from askgrid.sources.tables import TABLE_NAMES

PREFIXES = ["nation_1", "NATION_2"]

CATALOG_CTES = """
sold AS (
  SELECT lower(n_name) AS schema, replace(p_brand, '#', '') || 'Supply' AS name,
    array_to_string(list_transform(string_split(p_name, ' '),
                                   lambda w: upper(left(w, 1)) || substr(w, 2)), '')
    || left(p_type, 1) || lower(substr(p_type, 2)) AS column_name,
    p_type, max(p_size) AS size, max(l_returnflag) AS flag, r_name
  FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey
  GROUP BY ALL),
cols AS (
  SELECT schema, name, CAST(row_number() OVER (PARTITION BY schema, name ORDER BY column_name) AS INTEGER)
    AS ordinal, column_name,
    CASE p_type WHEN 'ECONOMY' THEN 'nvarchar' WHEN 'SMALL' THEN 'decimal' WHEN 'LARGE' THEN 'varchar'
      WHEN 'MEDIUM' THEN 'int' WHEN 'PROMO' THEN 'datetime' ELSE 'nchar' END AS data_type,
    CASE WHEN size = 50 THEN -1 ELSE size * 2 END AS stored_length, size AS precision,
    size % 4 AS scale, flag = 'R' AS nullable, size % 3 AS odd, r_name FROM sold),
columns AS (
  SELECT schema, name, ordinal, column_name, data_type,
    CAST(CASE WHEN data_type IN ('nvarchar', 'nchar') AND stored_length > 0 THEN stored_length // 2
         ELSE stored_length END AS INTEGER) AS max_length, precision, scale, nullable,
    ordinal = 1 AS identity, CASE odd WHEN 0 THEN 'Kind of ' || lower(column_name) WHEN 1 THEN '  ' END
    AS description, r_name FROM cols),
tables AS (SELECT schema, name, any_value(r_name) AS r_name,
           CASE WHEN length(name) > 12 THEN 'Supply of ' || any_value(r_name) END AS description
           FROM columns GROUP BY schema, name),
pk AS (SELECT schema, name, ordinal, column_name FROM columns WHERE ordinal <= 2),
homes AS (SELECT r_name, name, min(schema) AS home FROM tables GROUP BY ALL),
leads AS (SELECT schema, min(name) AS lead FROM tables GROUP BY ALL),
fk AS (
  SELECT 'FK_' || t.schema || '_' || t.name || '_home' AS constraint_name, t.schema, t.name, c.ordinal,
         c.column_name, h.home AS ref_schema, t.name AS ref_name, r.column_name AS ref_column
  FROM tables t JOIN homes h ON h.r_name = t.r_name AND h.name = t.name
  JOIN pk c ON c.schema = t.schema AND c.name = t.name
  JOIN pk r ON r.schema = h.home AND r.name = t.name AND r.ordinal = c.ordinal
  UNION ALL
  SELECT 'FK_' || t.schema || '_' || t.name || '_lead', t.schema, t.name, 1, c.column_name,
         t.schema, l.lead, r.column_name
  FROM tables t JOIN leads l ON l.schema = t.schema
  JOIN pk c ON c.schema = t.schema AND c.name = t.name AND c.ordinal = 1
  JOIN pk r ON r.schema = t.schema AND r.name = l.lead AND r.ordinal = 1),
fks AS (
  SELECT schema, name, constraint_name, ref_schema, ref_name,
         string_agg(column_name, ', ' ORDER BY ordinal) AS cols,
         string_agg(ref_column, ', ' ORDER BY ordinal) AS refs FROM fk GROUP BY ALL)"""


def camel(value):
    return F.concat(F.upper(F.left(value, F.lit(1))), F.substr(value, F.lit(2)))


def profiled(t) -> Catalog:
    """Catalogue frames from one pass over the sales lines."""
    lines = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    column = F.concat(F.array_join(F.transform(F.split("p_name", " "), camel), ""), F.left("p_type", F.lit(1)),
                      F.lower(F.substr("p_type", F.lit(2))))
    sold = (lines.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
            .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
            .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
            .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
            .groupBy(F.lower("n_name").alias("schema"),
                     F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("Supply")).alias("name"),
                     column.alias("column"), "p_type", "r_name")
            .agg(F.max("p_size").alias("size"), F.max("flag").alias("flag")))
    sold = cut(sold)
    w = Window.partitionBy("schema", "name").orderBy("column")
    kind = F.lit("nchar")
    for part_type, name in (("ECONOMY", "nvarchar"), ("SMALL", "decimal"), ("LARGE", "varchar"),
                            ("MEDIUM", "int"), ("PROMO", "datetime")):
        kind = F.when(F.col("p_type") == part_type, name).otherwise(kind)
    stored = F.when(F.col("size") == 50, -1).otherwise(F.col("size") * 2)
    columns = (sold.withColumn("ordinal", F.row_number().over(w)).withColumn("data_type", kind)
               .select("schema", "name", "ordinal", "column", "data_type",
                       character_length(F.col("data_type"), stored).alias("max_length"),
                       F.col("size").alias("precision"), (F.col("size") % 4).alias("scale"),
                       (F.col("flag") == "R").alias("nullable"),
                       (F.col("ordinal") == 1).alias("identity"),
                       F.when(F.col("size") % 3 == 0, F.concat(F.lit("Kind of "), F.lower("column")))
                       .when(F.col("size") % 3 == 1, "  ").alias("description")))
    base = sold.groupBy("schema", "name").agg(F.max("r_name").alias("r_name"))
    tables = base.select("schema", "name", F.when(F.length("name") > 12, F.concat(
        F.lit("Supply of "), "r_name")).alias("description"))
    pk = columns.where("ordinal <= 2").select("schema", "name", "ordinal", "column")
    homes = base.groupBy("r_name", "name").agg(F.min("schema").alias("ref_schema"))
    leads = base.groupBy("schema").agg(F.min("name").alias("ref_name"))
    parents = pk.select(F.col("schema").alias("ref_schema"), F.col("name").alias("ref_name"),
                        "ordinal", F.col("column").alias("ref_column"))

    def constraint(targets, suffix, keys):
        return (pk.join(targets, ["schema", "name"]).where(F.col("ordinal") <= keys)
                .join(parents, ["ref_schema", "ref_name", "ordinal"])
                .select(F.concat(F.lit("FK_"), "schema", F.lit("_"), "name", F.lit(suffix))
                        .alias("constraint"), "schema", "name", "ordinal", "column", "ref_schema",
                        "ref_name", "ref_column"))

    to_home = base.join(homes, ["r_name", "name"]).select(
        "schema", "name", "ref_schema", F.col("name").alias("ref_name"))
    to_lead = base.join(leads, "schema").select(
        "schema", "name", F.col("schema").alias("ref_schema"), "ref_name")
    fk = constraint(to_home, "_home", 2).unionByName(constraint(to_lead, "_lead", 1))
    return Catalog(tables, columns, pk, fk)


def catalog_sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join((CATALOG_CTES, *parts)) + "\n" + select


SHOWN_SQL = """CASE WHEN data_type IN ('varchar', 'nvarchar', 'char', 'nchar', 'binary', 'varbinary')
  THEN upper(data_type) || '(' || CASE WHEN max_length = -1 THEN 'MAX' ELSE CAST(max_length AS VARCHAR) END || ')'
  WHEN data_type IN ('decimal', 'numeric') THEN upper(data_type) || '(' || precision || ',' || scale || ')'
  ELSE upper(data_type) END"""


def human_sql(name: str) -> str:
    return f"ltrim(regexp_replace({name}, '([A-Z])', ' \\1', 'g'))"


@query("catalog_columns", catalog_sql(select=f"""
SELECT schema, name, ordinal, column_name, {human_sql('column_name')} AS words, {SHOWN_SQL} AS shown_type,
       max_length, nullable, identity, description FROM columns"""))
def catalog_columns(t):
    """Column scan with the character-length rule, shown type and humanised name."""
    return profiled(t).columns.select(
        "schema", "name", "ordinal", F.col("column").alias("column_name"),
        docs.humanize(F.col("column")).alias("words"),
        shown_type(F.col("data_type"), F.col("max_length"), F.col("precision"), F.col("scale"))
        .alias("shown_type"), "max_length", "nullable", "identity", "description")


@query("catalog_foreign_keys", catalog_sql(select="""
SELECT schema, name, constraint_name, ref_schema, ref_name, cols, refs FROM fks"""))
def catalog_foreign_keys(t):
    """Composite foreign keys, one row per constraint, columns in key order."""
    return foreign_keys(profiled(t).fk).select(
        "schema", "name", F.col("constraint").alias("constraint_name"), "ref_schema", "ref_name",
        F.array_join("columns", ", ").alias("cols"), F.array_join("ref_columns", ", ").alias("refs"))


@query("catalog_assembly", catalog_sql(select="""
SELECT t.schema, t.name, t.description,
  (SELECT count(*) FROM columns c WHERE c.schema = t.schema AND c.name = t.name) AS column_count,
  (SELECT string_agg(column_name, ',' ORDER BY ordinal) FROM pk WHERE pk.schema = t.schema
   AND pk.name = t.name) AS primary_key,
  (SELECT string_agg(constraint_name || '(' || cols || ')', ',' ORDER BY constraint_name) FROM fks
   WHERE fks.schema = t.schema AND fks.name = t.name) AS foreign_keys
FROM tables t"""))
def catalog_assembly(t):
    """Nested table records, shown as counts and lists."""
    nested = assemble(profiled(t))
    return nested.select(
        "schema", "name", "description", F.size("columns").cast("bigint").alias("column_count"),
        F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(F.transform("foreign_keys", lambda key: F.concat(
            key["constraint_name"], F.lit("("), F.array_join(key["columns"], ", "), F.lit(")"))), ",")
        .alias("foreign_keys"))


@query("catalog_stats", catalog_sql(select="""
SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS columns, CAST((SELECT count(*) FROM fks) AS BIGINT)
  AS foreign_keys, count(*) FILTER (trim(description) <> '') AS described_tables,
  CAST((SELECT count(*) FROM columns WHERE trim(description) <> '') AS BIGINT) AS described_columns,
  count(*) FILTER (n > 50) AS over_50, count(*) FILTER (n > 100) AS over_100
FROM (SELECT t.schema, t.name, t.description, count(*) AS n FROM tables t
      JOIN columns c ON c.schema = t.schema AND c.name = t.name GROUP BY ALL)"""))
def catalog_stats(t):
    catalog = profiled(t)
    per_table = catalog.columns.groupBy("schema", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim("description") != "").alias("d"))
    keys = foreign_keys(catalog.fk).groupBy("schema", "name").agg(F.count(F.lit(1)).alias("k"))
    joined = (catalog.tables.join(per_table, ["schema", "name"], "left")
              .join(keys, ["schema", "name"], "left"))
    return joined.agg(
        F.count(F.lit(1)).alias("tables"), F.sum("n").alias("columns"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("foreign_keys"),
        F.count_if(F.trim("description") != "").alias("described_tables"),
        F.sum("d").alias("described_columns"), F.count_if(F.col("n") > 50).alias("over_50"),
        F.count_if(F.col("n") > 100).alias("over_100"))


@query("catalog_widest", catalog_sql(select="""
SELECT schema, name, count(*) AS columns FROM columns GROUP BY ALL
ORDER BY count(*) DESC, schema, name LIMIT 10"""))
def catalog_widest(t):
    """Ten widest tables."""
    return (profiled(t).columns.groupBy("schema", "name").agg(F.count(F.lit(1)).alias("columns"))
            .orderBy(F.desc("columns"), "schema", "name").limit(10))


@query("prefix_statistics", catalog_sql(select="""
SELECT count(*) FILTER (keep) AS included_tables, count(*) FILTER (NOT keep) AS excluded_tables,
  string_agg(DISTINCT CASE WHEN keep THEN schema END, ',' ORDER BY CASE WHEN keep THEN schema END)
  AS included_schemas
FROM (SELECT *, starts_with(lower(schema), 'nation_1') OR starts_with(lower(schema), 'nation_2') AS keep
      FROM tables)"""))
def prefix_statistics(t):
    """Tables in and out of the configured schema prefixes, ignoring case."""
    catalog = profiled(t)
    kept = catalog.with_prefix(PREFIXES).tables.select("schema", "name", F.lit(True).alias("keep"))
    joined = catalog.tables.join(kept, ["schema", "name"], "left")
    return joined.agg(
        F.count_if("keep").alias("included_tables"),
        F.count_if(F.col("keep").isNull()).alias("excluded_tables"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("keep"), F.col("schema")))), ",")
        .alias("included_schemas"))


DOCUMENT_CTES = f"""
attrs AS (
  SELECT c.*, list_filter([CASE WHEN c.ordinal <= 2 THEN 'PRIMARY KEY' END,
      CASE WHEN c.identity THEN 'IDENTITY' END, CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END],
      lambda x: x IS NOT NULL) AS own,
    (SELECT list('FOREIGN KEY REFERENCES ' || ref_schema || '.' || ref_name || '.' || ref_column
                 ORDER BY constraint_name, ordinal) FROM fk
     WHERE fk.schema = c.schema AND fk.name = c.name AND fk.column_name = c.column_name) AS refs
  FROM columns c),
column_text AS (
  SELECT schema, name, string_agg('- ' || column_name || ' (' || {human_sql('column_name')} || ') '
    || {SHOWN_SQL} || ' [' || array_to_string(list_concat(own, coalesce(refs, [])), ', ') || ']'
    || CASE WHEN trim(description) <> '' THEN chr(10) || '  Description: ' || trim(description) ELSE '' END,
    chr(10) ORDER BY ordinal) AS body FROM attrs GROUP BY ALL),
relation_lines AS (
  SELECT schema, name, 0 AS side, '' AS s, '' AS n, constraint_name AS c, '- ' || constraint_name
    || ': FOREIGN KEY (' || cols || ') REFERENCES ' || ref_schema || '.' || ref_name || ' (' || refs || ').'
    AS line FROM fks
  UNION ALL
  SELECT ref_schema, ref_name, 1, schema, name, constraint_name, '- ' || constraint_name || ': ' || schema
    || '.' || name || ' (' || cols || ') references ' || ref_schema || '.' || ref_name || ' (' || refs || ').'
  FROM fks),
relation_text AS (SELECT schema, name, string_agg(line, chr(10) ORDER BY side, s, n, c) AS body
                  FROM relation_lines GROUP BY ALL),
docs AS (
  SELECT t.schema, t.name AS table_name, t.schema || '.' || t.name AS full_name,
    'Table: ' || t.schema || '.' || t.name || chr(10) || 'Table words: ' || {human_sql('t.name')}
    || CASE WHEN t.description IS NOT NULL THEN chr(10) || 'Description: ' || t.description ELSE '' END
    || chr(10) || 'PRIMARY KEY (' || (SELECT string_agg(column_name, ', ' ORDER BY ordinal) FROM pk
       WHERE pk.schema = t.schema AND pk.name = t.name) || ')'
    || chr(10) || chr(10) || 'Columns:' || chr(10) || c.body
    || chr(10) || chr(10) || 'Relationships:' || chr(10)
    || coalesce(r.body, '- No foreign-key relationships.') AS text
  FROM tables t JOIN column_text c ON c.schema = t.schema AND c.name = t.name
  LEFT JOIN relation_text r ON r.schema = t.schema AND r.name = t.name)"""


@query("table_documents", catalog_sql(DOCUMENT_CTES, select="""
SELECT schema, table_name, full_name, text FROM docs"""))
def table_documents(t):
    """One searchable document per table."""
    return docs.render(profiled(t))


@query("chunk_records", catalog_sql(DOCUMENT_CTES, """
targets AS (
  SELECT schema, name, column_name, string_agg(chr(10) || 'FK -> ' || ref_schema || '.' || ref_name || '.'
         || ref_column, '' ORDER BY constraint_name, ordinal) AS lines FROM fk GROUP BY ALL)""", select=f"""
SELECT a.schema, a.name, 'column' AS kind, a.column_name AS label,
  'Column: ' || a.column_name || chr(10) || 'Type: ' || {SHOWN_SQL} || chr(10) || 'Attributes: '
  || array_to_string(own, ', ')
  || CASE WHEN trim(description) <> '' THEN chr(10) || 'Description: ' || trim(description) ELSE '' END
  || coalesce(t.lines, '') AS text
FROM attrs a LEFT JOIN targets t ON t.schema = a.schema AND t.name = a.name AND t.column_name = a.column_name
UNION ALL
SELECT schema, name, 'composite key', constraint_name, 'Constraint: ' || constraint_name || chr(10)
  || 'Composite FK: ' || string_agg(column_name || ' -> ' || ref_schema || '.' || ref_name || '.' || ref_column,
                                    '; ' ORDER BY ordinal)
FROM fk GROUP BY schema, name, constraint_name HAVING count(*) > 1"""))
def chunk_records(t):
    """Column and composite-key records of every table."""
    return docs.chunk_records(profiled(t))


@query("document_summaries", catalog_sql("""
flat AS (SELECT schema || '.' || name AS full_name, 'Identity: ' || schema || '.' || name || ' · Columns: '
                || string_agg(column_name, ', ' ORDER BY ordinal) AS s FROM columns GROUP BY schema, name)""", select=f"""
SELECT full_name, CASE WHEN length(s) <= {fixed.SUMMARY_LIMIT} THEN s
  ELSE rtrim(left(s, {fixed.SUMMARY_LIMIT - 1})) || '…' END AS summary FROM flat"""))
def document_summaries(t):
    """Identity and columns of each table, shortened to one line."""
    listed = F.array_join(docs.own_columns(F.col("text")), ", ")
    representation = F.concat(F.lit("Identity:  "), "full_name", F.lit("\nColumns: "), listed,
                              F.lit("\n"), "text")
    return docs.render(profiled(t)).select("full_name", summary(representation).alias("summary"))


@query("document_columns", catalog_sql(select="""
SELECT schema || '.' || name AS full_name, CAST(ordinal - 1 AS INTEGER) AS position, column_name FROM columns"""))
def document_columns(t):
    """Column names read back from the document text."""
    return docs.render(profiled(t)).select(
        "full_name", F.posexplode(docs.own_columns(F.col("text"))).alias("position", "column_name"))


EDGE_CTES = """
fk_pairs AS (SELECT DISTINCT schema || '.' || name AS src, ref_schema || '.' || ref_name AS dst FROM fk
             WHERE schema || '.' || name <> ref_schema || '.' || ref_name)"""


@query("fk_adjacency", catalog_sql(EDGE_CTES, select="SELECT src, dst FROM fk_pairs"))
def fk_adjacency(t):
    """Outgoing adjacency parsed from document text."""
    return rg.outgoing_edges(docs.render(profiled(t)))


FORM_CTES = """
forms AS (
  SELECT r_name || '/' || name AS form_id, schema || '.' || name AS table_name,
    CASE WHEN length(name) % 2 = 0 THEN schema = home ELSE schema <= home || '1' END AS is_primary
  FROM tables JOIN homes USING (r_name, name)),
valid AS (SELECT form_id, max(CASE WHEN is_primary THEN table_name END) AS primary_table FROM forms
          GROUP BY form_id HAVING count(*) FILTER (is_primary) = 1),
form_pairs AS (
  SELECT primary_table AS src, table_name AS dst FROM forms JOIN valid USING (form_id)
  WHERE table_name <> primary_table
  UNION SELECT table_name, primary_table FROM forms JOIN valid USING (form_id)
  WHERE table_name <> primary_table),
graph AS (
  SELECT src, dst, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM (
    SELECT src, dst, 'outgoing_physical_fk' AS family FROM fk_pairs
    UNION ALL SELECT dst, src, 'reverse_physical_fk' FROM fk_pairs
    UNION ALL SELECT src, dst, 'explicit_form_association' FROM form_pairs) GROUP BY ALL)"""


def form_mappings(t, catalog):
    """Tables of one brand and region share a form; some forms have two primaries."""
    regions = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.lower("n_name").alias("schema"), "r_name")
    base = catalog.tables.join(regions, "schema")
    homes = base.groupBy("r_name", "name").agg(F.min("schema").alias("home"))
    primary = F.when(F.length("name") % 2 == 0, F.col("schema") == F.col("home")).otherwise(
        F.col("schema") <= F.concat("home", F.lit("1")))
    return base.join(homes, ["r_name", "name"]).select(
        F.concat_ws("/", "r_name", "name").alias("form_id"), full_name().alias("table"),
        primary.alias("is_primary"))


def graph_of(t):
    catalog = profiled(t)
    pairs = catalog.fk.select(full_name().alias("src"),
                              F.concat_ws(".", "ref_schema", "ref_name").alias("dst"))
    return catalog, rg.build(pairs, form_mappings(t, catalog))


@query("table_roles", catalog_sql(EDGE_CTES, FORM_CTES, """
roles AS (SELECT DISTINCT form_id, table_name, CASE WHEN is_primary THEN 'primary' WHEN NOT is_primary
          THEN 'detail_or_member' END AS role FROM forms)""", select="""
SELECT form_id, table_name AS "table", role, form_roles FROM roles JOIN (
  SELECT form_id, string_agg(DISTINCT role, ',' ORDER BY role) AS form_roles FROM roles GROUP BY form_id)
USING (form_id)"""))
def table_roles(t):
    """Primary and detail tables of each form."""
    return rg.table_roles(form_mappings(t, profiled(t)))


@query("relationship_graph", catalog_sql(EDGE_CTES, FORM_CTES, select="SELECT src, dst, families FROM graph"))
def relationship_graph(t):
    """Foreign keys both ways and form associations, merged per directed pair."""
    return graph_of(t)[1]


@query("degree_distribution", catalog_sql(EDGE_CTES, FORM_CTES, select="""
SELECT count(*) AS tables, min(d) AS minimum, CAST(median(d) AS DOUBLE) AS median,
  CAST(sum(d) AS DOUBLE) / count(*) AS mean, quantile_disc(d, 0.95) AS p95, quantile_disc(d, 0.99) AS p99,
  max(d) AS maximum
FROM (SELECT t.schema, t.name, count(g.dst) AS d FROM tables t
      LEFT JOIN graph g ON g.src = t.schema || '.' || t.name GROUP BY ALL)"""))
def degree_distribution(t):
    catalog, edges = graph_of(t)
    return rg.degrees(catalog.tables.select(full_name().alias("full_name")), edges)


@query("fk_path_check", catalog_sql(select="""
SELECT DISTINCT l_linenumber, s.schema || '.' || s.name AS child, ref_schema || '.' || ref_name AS parent
FROM (SELECT DISTINCT l_linenumber FROM lineitem) JOIN fk s ON s.ordinal = l_linenumber"""))
def fk_path_check(t):
    """Claimed key paths kept only where the catalogue declares them."""
    claimed = t.lineitem.select("l_linenumber").distinct()
    declared = profiled(t).fk.select(
        F.col("ordinal").alias("l_linenumber"), full_name().alias("child"),
        F.concat_ws(".", "ref_schema", "ref_name").alias("parent"))
    return claimed.join(declared, "l_linenumber").distinct()


def document_records(t):
    header = F.concat(F.lit("Document: "), F.col("doc_id").cast("string"), F.lit("\nSection: Lines"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("id"), header.alias("header"), lines.alias("records"))


CHUNK_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line,
    unnest(range(0, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS place
  FROM documents),
sized AS (SELECT doc_id, place, len(regexp_extract_all(line, '\S+')) AS n FROM lines),
units AS (
  SELECT doc_id, place, n, 0 AS part, false AS alone FROM sized WHERE n <= 236
  UNION ALL
  SELECT doc_id, place, CASE WHEN p < (n + 233) // 234 THEN 234 ELSE n - 234 * (p - 1) END, p, true
  FROM (SELECT *, unnest(range(1, (n + 233) // 234 + 1)) AS p FROM sized WHERE n > 236)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, part) AS i FROM units),
walk AS (
  SELECT doc_id, i, place, n, alone, 1 AS chunk_no, n AS used FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, o.place, o.n, o.alone,
    CASE WHEN o.alone OR w.alone OR w.used + o.n > 236 THEN w.chunk_no + 1 ELSE w.chunk_no END,
    CASE WHEN o.alone OR w.alone OR w.used + o.n > 236 THEN o.n ELSE w.used + o.n END
  FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.i = w.i + 1)"""


@query("chunk_packing", CHUNK_SQL + """
SELECT CAST(doc_id AS VARCHAR) AS id, chunk_no, CAST(min(place) AS INTEGER) AS first_record,
  CAST(max(place) AS INTEGER) AS last_record,
  CAST(sum(n) + 4 + CASE WHEN bool_or(alone) THEN 2 ELSE 0 END AS INTEGER) AS token_count
FROM walk GROUP BY ALL""")
def chunk_packing(t):
    """Greedy packing of document lines into chunks of 240 words, long lines split loss-free."""
    return ch.pack_chunks(document_records(t)).select(
        "id", "chunk_no", "first_record", "last_record", "token_count")


@query("chunk_validation", CHUNK_SQL + """
, c AS (SELECT doc_id, chunk_no, sum(n) + 4 + CASE WHEN bool_or(alone) THEN 2 ELSE 0 END AS n
        FROM walk GROUP BY ALL)
SELECT 'all chunks' AS chunk_set, 'budget exceeded' AS problem, count(*) FILTER (n > 240) AS violations FROM c
UNION ALL SELECT 'all chunks', 'record not represented', count(*) FROM (
  SELECT DISTINCT doc_id, place FROM units WHERE (doc_id, place) NOT IN (SELECT (doc_id, place) FROM walk))
UNION ALL SELECT 'without second chunks', 'budget exceeded', count(*) FILTER (n > 200) FROM c WHERE chunk_no <> 2
UNION ALL SELECT 'without second chunks', 'record not represented', count(*) FROM (
  SELECT DISTINCT doc_id, place FROM walk WHERE chunk_no = 2
  EXCEPT SELECT doc_id, place FROM walk WHERE chunk_no <> 2)
UNION ALL SELECT 'without second chunks', 'text differs', count(DISTINCT doc_id) FROM walk WHERE alone AND chunk_no = 2
UNION ALL SELECT 'all chunks', 'text differs', 0::BIGINT
UNION ALL SELECT 'third chunks altered', 'budget exceeded', count(*) FILTER (n > 240) FROM c
UNION ALL SELECT 'third chunks altered', 'record not represented', 0::BIGINT
UNION ALL SELECT 'third chunks altered', 'text differs', count(DISTINCT doc_id) FROM walk WHERE chunk_no = 3""")
def chunk_validation(t):
    """Records no chunk represents, chunks over the budget, texts that are not their records.

    Once as packed, once with chunks lost and a lower budget, once with altered texts.
    """
    records = document_records(t)
    packed = cut(ch.pack_chunks(records))
    cases = {"all chunks": ch.chunk_violations(records, packed),
             "without second chunks": ch.chunk_violations(records, packed.where("chunk_no <> 2"), 200),
             "third chunks altered": ch.chunk_violations(records, packed.withColumn("text", F.when(
                 F.col("chunk_no") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))}
    problems = ("budget exceeded", "record not represented", "text differs")
    parts = [found.agg(*[F.count_if(F.col("problem") == name).alias(name) for name in problems])
             .select(F.lit(case).alias("chunk_set"), F.inline(F.array(*[
                 F.struct(F.lit(name).alias("problem"), F.col(name).alias("violations")) for name in problems])))
             for case, found in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chunk_lengths", CHUNK_SQL + """
, c AS (SELECT doc_id, chunk_no, sum(n) + 4 + CASE WHEN bool_or(alone) THEN 2 ELSE 0 END AS n
        FROM walk GROUP BY ALL)
SELECT count(*) AS chunks, CAST(min(n) AS INTEGER) AS minimum, CAST(median(n) AS DOUBLE) AS median,
  CAST(sum(n) AS DOUBLE) / count(*) AS mean, CAST(max(n) AS INTEGER) AS maximum FROM c""")
def chunk_lengths(t):
    """Length distribution; at most budget-many distinct lengths exist, so the median is cheap."""
    return ch.pack_chunks(document_records(t)).agg(
        F.count(F.lit(1)).alias("chunks"), F.min("token_count").alias("minimum"),
        F.median("token_count").alias("median"),
        (F.sum("token_count").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.max("token_count").alias("maximum"))


@query("compact_columns", catalog_sql("""
entries AS (SELECT schema || '.' || name AS id, ordinal - 1 AS i, count(*) OVER (PARTITION BY schema, name)
            AS total, column_name || ' [' || lower(regexp_replace(column_name, '([A-Z])', ' \\1', 'g')) || ']'
            AS entry FROM columns),
sizes AS (SELECT *, len(regexp_extract_all(entry, '\\S+')) AS n FROM entries),
tries AS (SELECT id, total, unnest(range(0, total + 1)) AS m FROM (SELECT DISTINCT id, total FROM sizes)),
picks AS (SELECT id, total, m, unnest(range(0, m)) AS k FROM tries WHERE m > 0),
placed AS (SELECT id, total, m, k, CASE WHEN m = 1 THEN 0 ELSE CAST(floor(k * (total - 1) / (m - 1)) AS BIGINT)
           END AS i FROM picks),
sums AS (SELECT p.id, p.total, m, sum(n) AS words FROM placed p JOIN sizes s ON s.id = p.id AND s.i = p.i
         GROUP BY ALL),
best AS (SELECT id, max(m) AS m FROM sums WHERE words <= 120 GROUP BY id)""", select="""
SELECT b.id, string_agg(entry, '; ' ORDER BY k) AS columns, CAST(b.m AS INTEGER) AS chosen,
       CAST(any_value(p.total) AS INTEGER) AS total
FROM best b JOIN placed p ON p.id = b.id AND p.m = b.m JOIN sizes s ON s.id = b.id AND s.i = p.i
GROUP BY b.id, b.m"""))
def compact_columns(t):
    """Largest evenly spaced column subset within 120 words."""
    entry = F.concat("column", F.lit(" ["), F.lower(F.regexp_replace(
        "column", "([A-Z])", " $1")), F.lit("]"))
    rows = profiled(t).columns.groupBy(full_name().alias("id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("e")))),
        lambda item: item["e"]).alias("entries"))
    return ch.spaced_columns(rows, 120)


@query("compact_representation", catalog_sql("""
labels AS (
  SELECT schema || '.' || name AS id, label, row_number() OVER (PARTITION BY schema, name ORDER BY label) AS i
  FROM (SELECT DISTINCT lower(n_name) AS schema, replace(p_brand, '#', '') || 'Supply' AS name, p_name AS label
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
        JOIN part ON p_partkey = l_partkey)),
kept AS (SELECT id, string_agg(label, '; ' ORDER BY i) FILTER (i <= 9) AS body, least(9, count(*)) AS included,
         count(*) - least(9, count(*)) AS omitted FROM labels GROUP BY id),
reps AS (SELECT id, included, omitted, 'Identity: fully-qualified table ' || id || '; physical table '
  || split_part(id, '.', 2) || '; schema ' || split_part(id, '.', 1) || chr(10) || 'Table labels: ' || body
  AS text FROM kept)""", select="""
SELECT id, included, omitted, text, sha256(text) AS text_sha256 FROM reps"""))
def compact_representation(t):
    """Identity and labels within a word budget, with what was kept, left out, and a hash.

    Labels per table are bounded by the distinct part names.
    """
    pairs = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    named = (pairs.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
             .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
             .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
             .select(F.lower("n_name").alias("schema"), F.concat(
                 F.regexp_replace("p_brand", "#", ""), F.lit("Supply")).alias("name"), "p_name")
             .groupBy("schema", "name").agg(F.collect_set("p_name").alias("labels")))
    banned = F.array(full_name(), F.col("name"), F.col("schema"))
    unique = named.withColumn("labels", ch.normalized_unique(F.col("labels"), banned))
    kept = unique.withColumn("kept", ch.fitting(F.col("labels"), 2, 20))
    text = F.concat(F.lit("Identity: fully-qualified table "), full_name(), F.lit("; physical table "),
                    "name", F.lit("; schema "), "schema", F.lit("\nTable labels: "),
                    F.when(F.size("kept") > 0, F.array_join("kept", "; ")).otherwise("None"))
    return kept.select(
        full_name().alias("id"), F.size("kept").cast("bigint").alias("included"),
        (F.size("labels") - F.size("kept")).cast("bigint").alias("omitted"), text.alias("text"),
        F.sha2(text, 256).alias("text_sha256"))


@query("truncation_coverage", r"""
SELECT doc_id, tokens, retained, CAST(e AS INTEGER) AS retained_end, tokens > 254 AS truncated,
  round(100.0::DOUBLE * e / nullif(length(text), 0), 4) AS covered_percent,
  CAST(e2 - e AS INTEGER) AS newly_retained
FROM (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS tokens,
  CAST(least(254, len(regexp_extract_all(text, '\S+'))) AS INTEGER) AS retained,
  length(regexp_extract(text, '^(?:\s*\S+){0,254}')) AS e,
  length(regexp_extract(text, '^(?:\s*\S+){0,512}')) AS e2 FROM documents)""")
def truncation_coverage(t):
    """What a 254-token encoding keeps of each whole text, and what 512 tokens would add."""
    end, longer = (ch.retained_end(F.col("text"), n) for n in (fixed.TRUNCATION_BOUNDARY, 512))
    sized = spread(t.documents, "doc_id").select(
        "doc_id", F.length("text").alias("size"), ch.word_count(F.col("text")).alias("tokens"),
        end.alias("retained_end"), longer.alias("longer"))
    return sized.select(
        "doc_id", "tokens", F.least("tokens", F.lit(fixed.TRUNCATION_BOUNDARY)).alias("retained"),
        "retained_end", (F.col("tokens") > fixed.TRUNCATION_BOUNDARY).alias("truncated"),
        F.round(100.0 * F.col("retained_end") / F.nullif("size", F.lit(0)), 4).alias("covered_percent"),
        (F.col("longer") - F.col("retained_end")).alias("newly_retained"))


@query("late_field_positions", r"""
SELECT doc_id, line_no, CAST(1 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_position,
  1 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 254 AS beyond_boundary
FROM (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
        len(regexp_extract_all(unnest(string_split(text, chr(10))), '\S+')) AS n FROM documents)""")
def late_field_positions(t):
    """Token position at which each line starts, against the truncation boundary."""
    lines = spread(t.documents, "doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "doc_id", "line_no", ch.word_count(F.col("line")).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    position = F.lit(1) + F.coalesce(F.sum("n").over(w), F.lit(0))
    return lines.select("doc_id", "line_no", position.cast("bigint").alias("token_position"),
                        (position > fixed.TRUNCATION_BOUNDARY).alias("beyond_boundary"))


CAPTION_CTES = r"""
raw AS (
  SELECT conv_id AS table_id, turn // 2 AS exchange, turn, CASE role WHEN 'user' THEN 'form' ELSE 'module' END
    AS level, trim(regexp_replace(unnest(string_split_regex(text, '[\n.]')), '\s+', ' ', 'g')) AS caption
  FROM conversations),
caps AS (
  SELECT *, CASE WHEN regexp_matches(caption, '[À-ɏ]') THEN 'accented' ELSE 'plain' END AS language
  FROM raw WHERE caption <> ''),
pairs AS (
  SELECT DISTINCT e.table_id, e.exchange, e.caption AS plain, o.caption AS accented
  FROM caps e JOIN caps o ON o.table_id = e.table_id AND o.exchange = e.exchange
  WHERE e.language = 'plain' AND o.language = 'accented')"""


def caption_rows(t):
    """Captions with the identity that makes a pair defensible: conversation and exchange."""
    # Every sentence of every line is a caption.
    return cap.classified(t.conversations.select(
        F.col("conv_id").alias("table_id"), F.floor(F.col("turn") / 2).alias("exchange"), "turn",
        F.when(F.col("role") == "user", "form").otherwise("module").alias("level"),
        F.explode(F.split("text", "[\n.]")).alias("caption")), "[À-ɏ]", "accented", "plain")


@query("caption_languages", "WITH" + CAPTION_CTES + """
SELECT table_id, turn, level, caption, language FROM caps""")
def caption_languages(t):
    """Cleaned captions with the script they are written in."""
    return caption_rows(t).select("table_id", "turn", "level", "caption", "language")


@query("caption_dedup", "WITH" + CAPTION_CTES + """
SELECT table_id, level, language, caption, count(DISTINCT turn) AS provenance_count, min(turn) AS first_turn
FROM caps GROUP BY ALL""")
def caption_dedup(t):
    """One row per caption with its distinct provenance merged."""
    return cap.deduplicated(caption_rows(t), ["table_id", "level", "language", "caption"], "turn")


@query("caption_ambiguity", "WITH" + CAPTION_CTES + """
SELECT level, language, count(*) AS groups, count(*) FILTER (n > 1) AS ambiguous, max(n) AS most FROM (
  SELECT table_id, level, language, count(DISTINCT caption) AS n FROM caps GROUP BY ALL) GROUP BY ALL""")
def caption_ambiguity(t):
    """Tables with more than one caption per level and language."""
    return cap.ambiguity(caption_rows(t))


@query("bilingual_pairs", "WITH" + CAPTION_CTES + """
SELECT table_id, exchange, plain, accented FROM pairs""")
def bilingual_pairs(t):
    """Captions of two languages paired only by a shared identity."""
    return cap.bilingual_pairs(caption_rows(t), ["table_id", "exchange"], "plain", "accented")


@query("translation_queue", "WITH" + CAPTION_CTES + """
SELECT caption, count(*) AS occurrences, count(DISTINCT table_id) AS affected_tables,
  string_agg(DISTINCT level, ',' ORDER BY level) AS levels, min(level) AS priority_level
FROM caps WHERE language = 'accented' AND caption NOT IN (SELECT accented FROM pairs) GROUP BY caption""")
def translation_queue(t):
    """Unpaired captions with occurrences, affected tables and priority level."""
    captions = caption_rows(t)
    pairs = cap.bilingual_pairs(captions, ["table_id", "exchange"], "plain", "accented")
    return cap.queue(captions, pairs, "accented")


@query("caption_partition", "WITH" + CAPTION_CTES + """
SELECT language, count(DISTINCT caption) AS captions,
  count(DISTINCT CASE WHEN caption IN (SELECT accented FROM pairs UNION SELECT plain FROM pairs)
    THEN caption END) AS paired,
  count(DISTINCT CASE WHEN caption NOT IN (SELECT accented FROM pairs UNION SELECT plain FROM pairs)
    THEN caption END) AS queued
FROM caps GROUP BY language""")
def caption_partition(t):
    """Paired and queued captions partition all captions of a language."""
    captions = caption_rows(t)
    pairs = cap.bilingual_pairs(captions, ["table_id", "exchange"], "plain", "accented")
    paired = pairs.select(F.explode(F.array("plain", "accented")).alias("caption")).distinct().withColumn(
        "p", F.lit(1))
    distinct = captions.select("language", "caption").distinct()
    return distinct.join(paired, "caption", "left").groupBy("language").agg(
        F.count(F.lit(1)).alias("captions"), F.count("p").alias("paired"),
        F.count_if(F.col("p").isNull()).alias("queued"))


# The claimed paths, as (child, column, parent, key) per hop.
CLAIMED_PATHS = {
    "order to region": [("orders", "o_custkey", "customer", "c_custkey"),
                        ("customer", "c_nationkey", "nation", "n_nationkey"),
                        ("nation", "n_regionkey", "region", "r_regionkey")],
    "line to nation": [("lineitem", "l_suppkey", "supplier", "s_suppkey"),
                       ("supplier", "s_nationkey", "nation", "n_nationkey")],
    "line to part": [("lineitem", "l_partkey", "part", "p_partkey")],
    "part taken for supplier": [("lineitem", "l_partkey", "supplier", "s_suppkey")],
    "label to document": [("labels", "doc_id", "documents", "doc_id")],
    "order taken for line": [("orders", "o_orderkey", "lineitem", "l_orderkey")],
}

_HOP_SQL = """(SELECT '{path}' AS path, {hop} AS hop, '{child}({column}) -> {parent}({key})' AS claim, count(*) AS rows,
 count(*) FILTER ({column} IS NULL) AS null_rows,
 count(*) FILTER ({column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)) AS orphan_rows,
 count(DISTINCT {column}) FILTER ({column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)) AS orphan_keys,
 count(DISTINCT {column}) FILTER ({column} IN (SELECT {key} FROM {parent} GROUP BY {key} HAVING count(*) > 1)) AS ambiguous_keys
 FROM {child})"""
_HOPS_SQL = " UNION ALL ".join(
    _HOP_SQL.format(path=path, hop=number, child=child, column=column, parent=parent, key=key)
    for path, hops in CLAIMED_PATHS.items() for number, (child, column, parent, key) in enumerate(hops, 1))


@query("key_path_verification", f"""
WITH hops AS ({_HOPS_SQL}),
judged AS (SELECT *, CASE WHEN orphan_rows > 0 THEN 'orphans' WHEN ambiguous_keys > 0 THEN 'ambiguous'
                     ELSE 'holds' END AS verdict FROM hops)
SELECT *, bool_and(verdict = 'holds') OVER (PARTITION BY path) AS path_holds FROM judged""")
def key_path_verification(t):
    """Every hop of the claimed key paths against the rows: orphans, ambiguous parents, whole paths."""
    paths = {path: [Claim(child, (column,), parent, (key,)) for child, column, parent, key in hops]
             for path, hops in CLAIMED_PATHS.items()}
    names = {name for claims in paths.values() for claim in claims for name in (claim.child, claim.parent)}
    return verify_paths({name: getattr(t, name) for name in names}, paths)


@query("parquet_catalogue", "WITH counts AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS row_count FROM {name}" for name in TABLE_NAMES) + """),
columns AS (SELECT DISTINCT table_name AS name, column_name, ordinal_position, data_type
            FROM information_schema.columns)
SELECT name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal,
       CASE WHEN data_type LIKE '%[]' THEN 'array<' || replace(replace(lower(replace(data_type, '[]', '')),
              'varchar', 'string'), 'integer', 'int') || '>'
            WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'INTEGER' THEN 'int'
            WHEN data_type = 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
       row_count
FROM columns JOIN counts USING (name)""")
def parquet_catalogue(t):
    """Tables, columns, types and row counts of the given folder, from the footers of its files."""
    return table_columns(read_files(t.spark, t.directory)).where(F.col("name").isin(*TABLE_NAMES)).select(
        "name", "column_name", "ordinal", "data_type", "row_count")
