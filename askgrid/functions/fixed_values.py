"""Fixed values of the retrieval and corpus rules.

Everything in this file is a constant that results depend on: word lists,
weights, depths, budgets and text patterns.
"""

# Hybrid score weights.
DENSE_WEIGHT = 0.70
LEXICAL_WEIGHT = 0.30

# Lexical score parts and the weights of the five best columns.
TABLE_PART = 0.65
COLUMN_PART = 0.30
SCHEMA_PART = 0.05
COLUMN_WEIGHTS = (0.50, 0.25, 0.15, 0.07, 0.03)

# Token rules.
ABBREVIATIONS = {
    "amt": "amount",
    "desc": "description",
    "num": "number",
    "no": "number",
    "qty": "quantity",
}
STRUCTURAL_TOKENS = ("tbl", "table", "id", "ig", "l")
TOKEN_WEIGHTS = {
    "code": 0.20,
    "date": 0.20,
    "description": 0.35,
    "name": 0.25,
    "number": 0.25,
    "sequence": 0.35,
    "type": 0.25,
}
QUERY_STOP_WORDS = (
    "a", "all", "an", "and", "at", "by", "each", "for", "from", "in", "is", "it", "of", "on",
    "or", "report", "show", "summarize", "the", "their", "to", "whether", "with",
)

# BM25.
BM25_K1 = 1.5
BM25_B = 0.75

# Graph expansion, candidates and reranking.
SEED_COUNT = 10
FK_BONUS = 0.20
ADDITIONAL_NEIGHBOR_CAP = 10
CANDIDATE_DEPTH = 50
FINAL_DEPTH = 10
COVERAGE_DEPTHS = (10, 20, 50, 100, 200)
SUMMARY_LIMIT = 360
PAIR_TOKEN_BUDGET = 1024

# Score saturation.
SATURATION_SHARE = 0.95
SATURATION_TOLERANCE = 1e-12
SPREAD_DEPTH = 20

# Token budgets of chunks and truncated encodings.
CHUNK_CONTENT_BUDGET = 240
TRUNCATION_BOUNDARY = 254

# Near-duplicate thresholds.
NEAR_DUPLICATE_JACCARD = 0.85
SAME_LABEL_JACCARD = 0.50

# Abstention answers.
ABSTENTIONS = ("INSUFFICIENT_SCHEMA", "I DO NOT KNOW")
