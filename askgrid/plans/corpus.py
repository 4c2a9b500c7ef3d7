"""Corpus preparation: minimisation, duplicate review, clusters, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from askgrid.operators import minimise as rules
from askgrid.operators import near_duplicates as dup
from askgrid.operators.bounded import cut, materialise, spread
from askgrid.operators.components import cluster_ids, connected_components
from askgrid.operators.minimise import business_text, minimise, redact_secrets
from askgrid.operators.sampling import allocate, first_match, hash_positions
from askgrid.plans.registry import query
from askgrid.sources.artifacts import changed

SALT = "askgrid-sample-v1 | "
TARGET = 24

SETS = r"""
WITH base AS (
  SELECT doc_id AS id, source AS label,
         trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal,
         list_sort(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')))
         AS words FROM documents),
grouped AS (SELECT *, min(id) OVER (PARTITION BY words) AS node FROM base WHERE normal <> ''),
nodes AS (SELECT DISTINCT node, words, len(words) AS size FROM grouped),
w AS (SELECT node, size, unnest(words) AS word FROM nodes),
overlap AS (
  SELECT a.node AS left_node, b.node AS right_node, count(*) AS shared,
         any_value(a.size) AS ls, any_value(b.size) AS rs
  FROM w a JOIN w b ON a.word = b.word AND a.node < b.node
   AND least(a.size, b.size) >= greatest(a.size, b.size) * 0.5 GROUP BY ALL),
measured AS (SELECT *, CAST(shared AS DOUBLE) / (ls + rs - shared) AS jaccard FROM overlap),
flagged AS (
  SELECT left_node, right_node, jaccard, jaccard >= 0.85 - 1e-12 AS close,
    EXISTS (SELECT 1 FROM grouped x JOIN grouped y ON x.label = y.label
            WHERE x.node = left_node AND y.node = right_node) AS labelled
  FROM measured WHERE jaccard >= 0.5 - 1e-12),
links AS (SELECT * FROM flagged WHERE close OR labelled)"""

CLUSTERS = """,
edges AS (SELECT left_node AS a, right_node AS b FROM links
          UNION SELECT right_node, left_node FROM links),
walk AS (
  SELECT node AS start, node AS reached FROM nodes
  UNION SELECT start, b FROM walk JOIN edges ON a = reached),
roots AS (SELECT start AS node, min(reached) AS root FROM walk GROUP BY start),
clusters AS (
  SELECT root, 'rc-' || left(sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)), 16) AS cluster_id,
         count(*) AS member_count FROM grouped JOIN roots USING (node) GROUP BY root)"""

RECURSIVE_SETS = SETS.replace("WITH base", "WITH RECURSIVE base", 1)


def texts(t):
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("label"), "text")


def word_sets(t):
    """The words of every document, written once."""
    return materialise(dup.word_sets(texts(t)), "word-sets")


def clustered(t):
    """(id, root) of every document."""
    sets = word_sets(t)
    nodes, members, labels = dup.nodes_and_members(sets)
    links = dup.node_links(nodes, labels, texts=sets)
    roots = connected_components(nodes.select(F.col("node").alias("id")), links)
    members = members.withColumnRenamed("node", "n")
    return members.join(roots.select(F.col("id").alias("n"), "root"), "n").select("id", "root")


@query("exact_duplicates", """
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY normal) AS representative,
       count(*) OVER (PARTITION BY normal) AS copies
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normal FROM documents)
WHERE normal <> ''""")
def exact_duplicates(t):
    """Each document with the first document of the same normalised text."""
    return dup.exact_groups(dup.prepared_texts(texts(t)))


@query("near_duplicate_links", SETS + """
SELECT left_node, right_node, round(jaccard, 6) AS jaccard,
  CASE WHEN close AND labelled THEN 'jaccard,same_label' WHEN close THEN 'jaccard' ELSE 'same_label' END
  AS reasons FROM links""")
def near_duplicate_links(t):
    """Review links between distinct word sets, each named by its least document id."""
    sets = word_sets(t)
    nodes, _, labels = dup.nodes_and_members(sets)
    return dup.node_links(nodes, labels, complete=True, texts=sets).select(
        F.col("left").alias("left_node"), F.col("right").alias("right_node"),
        F.round("jaccard", 6).alias("jaccard"), "reasons")


@query("duplicate_clusters", RECURSIVE_SETS + CLUSTERS + """
SELECT id, root, cluster_id, member_count FROM grouped JOIN roots USING (node)
JOIN clusters USING (root)""")
def duplicate_clusters(t):
    """Connected components of the links, with content-derived cluster ids."""
    members = cut(clustered(t))
    return members.join(cluster_ids(members), "root").select(
        "id", "root", "cluster_id", "member_count")


@query("contamination_filter", RECURSIVE_SETS + CLUSTERS + """
SELECT root, cluster_id, member_count FROM clusters c WHERE NOT EXISTS (
  SELECT 1 FROM grouped JOIN roots USING (node) JOIN labels ON doc_id = id
  WHERE roots.root = c.root AND toxic = 1)""")
def contamination_filter(t):
    """Clusters without any inspected member: one inspected member removes its whole cluster."""
    members = cut(clustered(t))
    inspected = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))
    tainted = members.join(inspected, "id", "left_semi").select("root").distinct()
    return cluster_ids(members).join(tainted, "root", "left_anti").select(
        "root", "cluster_id", "member_count")


DOMAIN_SQL = """
CASE WHEN text LIKE '%@%' THEN 'contact' WHEN regexp_matches(text, '[0-9]{13,}') THEN 'payment'
  WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'legal' WHEN lang = 'de' THEN 'german desk'
  WHEN lang = 'fr' AND source IN ('src1', 'src2', 'src3') THEN 'french desk'
  WHEN source LIKE 'src1%' THEN 'north' ELSE 'other/unclear' END"""


def domains(t):
    text = F.col("text")
    rules = [("contact", text.contains("@")), ("payment", text.rlike("[0-9]{13,}")),
             ("legal", text.rlike("(?i)licen[sc]e|copyright")), ("german desk", F.col("lang") == "de"),
             ("french desk", (F.col("lang") == "fr") & F.col("source").isin("src1", "src2", "src3")),
             ("north", F.col("source").startswith("src1"))]
    return t.documents.select(F.col("doc_id").alias("id"),
                              first_match(rules, "other/unclear").alias("domain"))


@query("domain_classes", f"SELECT doc_id AS id, {DOMAIN_SQL} AS domain FROM documents")
def domain_classes(t):
    """Ordered rules: text patterns first, then metadata; the first match wins."""
    return domains(t)


@query("stratified_allocation", f"""
WITH c AS (SELECT {DOMAIN_SQL} AS domain, count(*) AS n FROM documents GROUP BY ALL),
q AS (SELECT *, ({TARGET} - count(*) OVER ()) * n / CAST(sum(n) OVER () AS DOUBLE) AS quota,
             {TARGET} - count(*) OVER () AS remaining FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY quota - floor(quota) DESC, domain) AS place,
             remaining - sum(floor(quota)) OVER () AS left_over FROM q)
SELECT domain, n, CAST(1 + floor(quota) + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS BIGINT)
       AS allocated FROM r""")
def stratified_allocation(t):
    """Largest-remainder allocation of a fixed number of cases."""
    counts = domains(t).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return allocate(counts, "domain", TARGET)


@query("hash_ordered_sample", f"""
SELECT id, domain, order_sha256, row_number() OVER (PARTITION BY domain ORDER BY order_sha256, id)
       AS position
FROM (SELECT doc_id AS id, {DOMAIN_SQL} AS domain,
             sha256('{SALT}' || doc_id) AS order_sha256 FROM documents)""")
def hash_ordered_sample(t):
    """Candidate order inside each stratum by the hash of the salted id."""
    return hash_positions(domains(t), "domain", SALT)


@query("numeric_cross_references", r"""
SELECT DISTINCT least(page_id, other) AS left_id, greatest(page_id, other) AS right_id
FROM (SELECT page_id, TRY_CAST(unnest(regexp_extract_all(url, '/(?:[a-z]{2})/([0-9]+)', 1)) AS BIGINT)
      AS other FROM pages)
WHERE other <> page_id AND other IN (SELECT page_id FROM pages)""")
def numeric_cross_references(t):
    """Numbers after a reference word that are ids of other records; digits may be Persian or Arabic."""
    western = F.translate("url", "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all(
        western, F.lit("/(?:[a-z]{2})/([0-9]+)"), F.lit(1))).alias("number"))
    numbered = found.select("page_id", F.col("number").try_cast("bigint").alias("other"))
    ids = t.pages.select(F.col("page_id").alias("other"))
    return (numbered.where("other <> page_id").join(ids, "other", "left_semi")
            .select(F.least("page_id", "other").alias("left_id"),
                    F.greatest("page_id", "other").alias("right_id")).distinct())


def _re2(pattern: str) -> str:
    """A rule in the SQL engine's dialect: Unicode word characters, no look-around."""
    spelled = pattern.replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w.-]", r"[\p{L}\p{N}_.-]")
    spelled = spelled.replace(r"(?<!\d)", "(^|[^0-9])").replace(r"(?!\d)", "($|[^0-9])")
    return spelled.replace("'", "''")


def _minimised_sql(text: str) -> str:
    dropped = " OR ".join(f"regexp_matches(x, '{_re2(p)}')" for p in rules.DROPPED_LINES)
    payload = (f"length(x) > {rules.PAYLOAD_LENGTH} AND (" + " OR ".join(
        f"starts_with(x, '{start}')" for start in rules.PAYLOAD_STARTS)
        + f" OR regexp_matches(x, '{rules.PAYLOAD_RUN}') OR (length(x) - length(replace(x, '\\\"', ''))) / 2 > 3)")
    cleaned = "x"
    for pattern, replacement in rules.REPLACEMENTS:
        if "(?<!" in pattern:
            replacement = rf"\1{replacement}\2"
        cleaned = f"regexp_replace({cleaned}, '{_re2(pattern)}', '{replacement}', 'g')"
    ends = rf"^[{rules.TRIMMED}]+|[{rules.TRIMMED}]+$"
    lines = (f"list_transform(string_split(regexp_replace({text}, '\\r\\n|\\r', chr(10), 'g'), chr(10)), "
             r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))")
    kept = f"list_filter({lines}, lambda x: x = '' OR NOT ({dropped} OR ({payload})))"
    marked = (f"list_filter(list_transform({kept}, lambda x: CASE WHEN x = '' THEN chr(1) ELSE "
              f"regexp_replace({cleaned}, '{ends}', '', 'g') END), lambda x: x <> '')")
    joined = f"replace(array_to_string({marked}, chr(10)), chr(1), '')"
    return (r"regexp_replace(regexp_replace(" + joined
            + r", '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')")


@query("minimise_text", f"SELECT doc_id, {_minimised_sql('text')} AS text FROM documents")
def minimise_text(t):
    """Minimised text of every document."""
    return spread(t.documents, "doc_id").select("doc_id", minimise(F.col("text")).alias("text"))


@query("minimisation_changes", f"""
SELECT doc_id, 'text' AS field, sha256(text) AS before_sha256, sha256(m) AS after_sha256
FROM (SELECT doc_id, text, {_minimised_sql('text')} AS m FROM documents) WHERE text <> m""")
def minimisation_changes(t):
    """Change log: one row per (id, field) whose text changed."""
    once = F.inline(F.array(F.struct(minimise(F.col("text")).alias("minimised"))))
    return (spread(t.documents, "doc_id").select("doc_id", "text", once)
            .where(~F.col("text").eqNullSafe(F.col("minimised")))
            .select("doc_id", F.lit("text").alias("field"),
                    F.sha2("text", 256).alias("before_sha256"),
                    F.sha2("minimised", 256).alias("after_sha256")))


@query("protected_changes", """
SELECT doc_id, doc_id % 11 = 0 AS is_missing FROM documents
WHERE doc_id % 11 = 0 OR (doc_id % 7 = 0 AND lang <> 'xx')""")
def protected_changes(t):
    """Documents that differ from their protected copy, or are missing from it."""
    copy = (t.documents.where("doc_id % 11 <> 0")
            .withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))))
    return changed(t.documents, copy, ["doc_id"]).select(
        "doc_id", F.col("after_sha256").isNull().alias("is_missing"))


@query("business_texts", rf"""
WITH parts AS (
  SELECT turns.conv_id, turns.turn, trim(regexp_replace(role, '\s+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_replace(trim(regexp_replace(text || CASE WHEN turn % 2 = 0
      THEN ' message: undefined' ELSE ' message: String x was not recognized as a valid DateTime.' END,
      '\s+', ' ', 'g')), '{rules.MACHINE_MESSAGE}', ' ', 'g'), '\s+', ' ', 'g')) AS description
  FROM conversations turns)
SELECT conv_id, turn, sha256(trim(title || ' ' || description)) AS text_sha256 FROM parts""")
def business_texts(t):
    """Wording of every turn without the machine messages a log adds."""
    added = F.when(F.col("turn") % 2 == 0, " message: undefined").otherwise(
        " message: String x was not recognized as a valid DateTime.")
    return t.conversations.select("conv_id", "turn", F.sha2(business_text(
        F.col("role"), F.concat("text", added)), 256).alias("text_sha256"))


@query("redact_secrets", r"""
SELECT doc_id, sha256(CASE WHEN regexp_matches(text,
  '(?i)(?:password|pwd|uid|user\s*id|username|connection\s*string|access[_ -]?token|api[_ -]?key|authorization|server|data\s+source)\s*[:=]|(?:postgres(?:ql)?|mssql|mysql)://|\bBearer\s+\S+')
  THEN '[REDACTED_SENSITIVE_TEXT]' ELSE text END) AS text_sha256 FROM documents""")
def redact_secrets_query(t):
    """Whole-field suppression of texts with credentials."""
    return spread(t.documents, "doc_id").select("doc_id", F.sha2(redact_secrets(F.col("text")), 256).alias("text_sha256"))
