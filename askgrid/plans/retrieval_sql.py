"""Reference SQL fragments of the retrieval queries."""

from __future__ import annotations

from askgrid.functions import fixed_values as fixed


def words(value: str) -> str:
    return (f"string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace({value}, "
            r"'([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), "
            "'[^A-Za-z0-9]+', ' ', 'g'))), ' ')")


def singular(token: str) -> str:
    return (f"CASE WHEN length({token}) > 4 AND {token} LIKE '%ies' "
            f"THEN left({token}, length({token}) - 3) || 'y' "
            f"WHEN length({token}) > 4 AND {token} LIKE '%ses' "
            f"THEN left({token}, length({token}) - 2) "
            f"WHEN length({token}) > 3 AND {token} LIKE '%s' AND {token} NOT LIKE '%ss' "
            f"THEN left({token}, length({token}) - 1) ELSE {token} END")


def spelled(token: str) -> str:
    cases = " ".join(f"WHEN '{short}' THEN '{full}'" for short, full in fixed.ABBREVIATIONS.items())
    return f"CASE {token} {cases} ELSE {token} END"


def quoted(items) -> str:
    return ", ".join(f"'{item}'" for item in items)


def weight(token: str) -> str:
    cases = " ".join(f"WHEN '{word}' THEN {value}" for word, value in fixed.TOKEN_WEIGHTS.items())
    return f"CAST(CASE {token} {cases} ELSE 1.0 END AS DOUBLE)"


def stemmed(source: str, keep: str, value: str) -> str:
    """SELECT keep, term FROM source with one row per token occurrence."""
    return (f"SELECT {keep}, term FROM (SELECT {keep}, {spelled('base')} AS term FROM ("
            f"SELECT {keep}, {singular('raw')} AS base FROM (SELECT {keep}, "
            f"unnest({words(value)}) AS raw FROM {source}) WHERE raw <> '')) "
            f"WHERE term NOT IN ({quoted(fixed.STRUCTURAL_TOKENS)})")


QUESTION_TERMS = f"""
q_terms AS (
  SELECT question_id, term, count(*) AS query_frequency FROM (
    {stemmed("(SELECT item_id AS question_id, text FROM benchmark)", "question_id", "text")})
  WHERE term NOT IN ({quoted(fixed.QUERY_STOP_WORDS)}) GROUP BY ALL)"""

FIELDS = """
fields AS (
  SELECT doc_id AS id, 'schema' AS field, 1 AS position, source || ' ' || lang AS value FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN i = 1 THEN 'table' ELSE 'column' END, CASE WHEN i = 1 THEN 0 ELSE i END, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""

DOC_TOKENS = f"""
doc_tokens AS ({stemmed("fields", "id, field, position", "value")})"""


def lexical(tokens: str = "doc_tokens", name: str = "lexical") -> str:
    columns = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(fixed.COLUMN_WEIGHTS, start=1))
    return f"""
{name}_hits AS (
  SELECT question_id, id, field, position, least(1.0, sum({weight('term')})) AS m
  FROM (SELECT DISTINCT id, field, position, term FROM {tokens}) JOIN q_terms USING (term)
  GROUP BY ALL),
{name} AS (
  SELECT question_id, id, round(least(1.0,
    {fixed.TABLE_PART} * coalesce(max(m) FILTER (field = 'table'), 0)
    + {fixed.COLUMN_PART} * coalesce(sum(m * CAST(CASE n {columns} ELSE 0 END AS DOUBLE))
      FILTER (field = 'column'), 0)
    + {fixed.SCHEMA_PART} * coalesce(max(m) FILTER (field = 'schema'), 0)), 9) AS lexical
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id, id, field ORDER BY m DESC) AS n
        FROM {name}_hits) GROUP BY ALL)"""


def bm25(tokens: str = "doc_tokens", name: str = "bm25") -> str:
    return f"""
{name}_length AS (
  SELECT doc_id AS id, coalesce(n, 0) AS length FROM documents
  LEFT JOIN (SELECT id, count(*) AS n FROM {tokens} GROUP BY id) t ON t.id = doc_id),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM {tokens} GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df,
  ln(1.0 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM {name}_tf GROUP BY term),
{name}_parts AS (
  SELECT question_id, id, term, query_frequency, tf, df, idf,
    query_frequency * idf * (tf * {fixed.BM25_K1 + 1} / (tf + {fixed.BM25_K1} * (1 - {fixed.BM25_B}
      + {fixed.BM25_B} * length / (SELECT CAST(sum(length) AS DOUBLE) / count(*) FROM {name}_length)
      ))) AS contribution
  FROM {name}_tf JOIN q_terms USING (term) JOIN {name}_df USING (term)
  JOIN {name}_length USING (id)),
{name}_raw AS (SELECT question_id, id, round(sum(contribution), 9) AS bm25_raw
               FROM {name}_parts GROUP BY ALL),
{name} AS (SELECT *, round(bm25_raw / max(bm25_raw) OVER (PARTITION BY question_id), 9) AS lexical
           FROM {name}_raw)"""


DENSE = """
q AS (SELECT item_id AS question_id, CAST(embedding AS DOUBLE[]) AS qv
      FROM benchmark JOIN embeddings ON vec_id = item_id),
c AS (SELECT doc_id AS id, CAST(embedding AS DOUBLE[]) AS v
      FROM documents JOIN embeddings ON vec_id = doc_id),
dense AS (
  SELECT question_id, id, cosine, round(least(1.0, greatest(0.0, (cosine + 1.0) / 2.0)), 12) AS dense
  FROM (SELECT question_id, id, round(list_dot_product(v, qv), 9) AS cosine FROM q, c))"""


def hybrid(lexical_name: str = "lexical", name: str = "hybrid") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dense DESC, id DESC) AS rank
  FROM (SELECT d.question_id, d.id, d.dense, coalesce(l.lexical, 0) AS lexical,
          round({fixed.DENSE_WEIGHT}::DOUBLE * d.dense
                + {fixed.LEXICAL_WEIGHT}::DOUBLE * coalesce(l.lexical, 0), 12) AS score
        FROM dense d LEFT JOIN {lexical_name} l ON l.question_id = d.question_id AND l.id = d.id
        UNION ALL
        SELECT question_id, id, 0.0::DOUBLE, lexical, round({fixed.LEXICAL_WEIGHT}::DOUBLE * lexical, 12)
        FROM {lexical_name}
        WHERE id NOT IN (SELECT id FROM c) AND question_id IN (SELECT question_id FROM q)))"""


DENSE_AS_HYBRID = """
hybrid AS (SELECT question_id, id, dense, 0.0::DOUBLE AS lexical, dense AS score,
  row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, dense DESC, id DESC) AS rank
  FROM dense)"""

EDGES = """
edges AS (
  SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem
  WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT id FROM c) AND l_suppkey IN (SELECT id FROM c))"""


def expansion(reached: str = "direct", name: str = "graph", base: str = "hybrid") -> str:
    return f"""
{name}_signals AS (
  SELECT question_id, id, max(signal) AS graph_signal, count(*) AS source_count,
         first(seed_rank ORDER BY signal DESC, seed_rank, source) AS best_rank,
         first(source ORDER BY signal DESC, seed_rank, source) AS best_source
  FROM {reached} GROUP BY ALL),
{name}_pool AS (
  SELECT question_id, id FROM {name}_signals UNION SELECT question_id, id FROM {base} WHERE rank <= 10),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, score DESC, id DESC)
    AS rank
  FROM (SELECT p.question_id, p.id, h.score, coalesce(s.graph_signal, 0) AS graph_signal,
          round({fixed.FK_BONUS} * coalesce(s.graph_signal, 0), 12) AS bonus,
          round(h.score + round({fixed.FK_BONUS} * coalesce(s.graph_signal, 0), 12), 12) AS final_score,
          h.rank <= 10 AS is_seed, coalesce(s.source_count, 0) AS source_count, s.best_rank, s.best_source
        FROM {name}_pool p JOIN {base} h ON h.question_id = p.question_id AND h.id = p.id
        LEFT JOIN {name}_signals s ON s.question_id = p.question_id AND s.id = p.id))"""


def reached(edges: str = "edges", name: str = "direct", base: str = "hybrid") -> str:
    return f"""
{name} AS (
  SELECT question_id, dst AS id, src AS source, CAST(h.rank AS INTEGER) AS seed_rank,
         round(score / log2(h.rank + 1), 9) AS signal
  FROM {base} h JOIN {edges} ON src = h.id WHERE h.rank <= 10)"""


ALIASES = f"""
alias_text AS (SELECT conv_id AS id, turn, text AS value FROM conversations WHERE role = 'user'),
alias_first AS (SELECT id, turn, value FROM alias_text),
alias_tokens AS (
  SELECT DISTINCT id, term FROM ({stemmed("alias_first", "id", "value")})
  WHERE id IN (SELECT doc_id FROM documents)),
enriched_tokens AS (
  SELECT id, field, position, term FROM doc_tokens
  UNION ALL SELECT id, 'table', 0, term FROM alias_tokens),
enriched_bag AS (
  SELECT id, field, position, term FROM doc_tokens WHERE field <> 'table'
  UNION ALL
  SELECT DISTINCT id, 'table', 0, term FROM enriched_tokens WHERE field = 'table')"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
