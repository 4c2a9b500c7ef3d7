"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a logistic model over
the presence of vocabulary terms and the probabilities of all earlier
categories. In training those probabilities are out-of-fold predictions, so a
later model sees them as uncertain as they will be on new text: the models that
predict a fold use terms, and categories derived from terms, which were chosen
without the rows of that fold.

Terms are words and word beginnings of four to six characters, which catch
inflected and compounded forms. The vocabulary are all terms whose presence
depends on the label, with a signed root of Pearson's statistic of at least
``LEAST_Z``; they are counted with Spark over the training rows. Their number
has no cap, so frequent languages leave room for rare ones. A word and its
beginnings that stand in the same training rows are one input of the models, and
a text has it by the share of those terms that it holds. Labels name only
``toxic``; the two categories before it are derived from it: ``insult`` (toxic,
with at least one term that hardly occurs elsewhere) and ``abuse`` (toxic, with
at least ``ABUSE_TERMS`` such terms, which takes several words). Any other 0/1
columns can be chained with :func:`fit_chain`.

Training uses at most ``TRAIN_ROWS`` labelled rows, those with the least
seeded hash of their id. Scoring is one pass over the documents.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.common import fresh, materialise
from askgrid.llm.decontaminate import words_of
from askgrid.llm.quality import training_rows

TRAIN_ROWS = 10_000
LEAST_Z = 4.0
PREFIXES = (4, 5, 6)
STRONG = 0.9
ABUSE_TERMS = 8
FOLDS = 5
CATEGORIES = ("insult", "abuse", "toxic")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms_of(raw: bytes) -> set[str]:
    """Distinct words in lower case (A-Z), and their beginnings marked with a star."""
    words = set(WORD.findall(raw.lower().decode("utf-8", "replace")))
    return words.union(*({f"{word[:n]}*" for word in words if len(word) >= n} for n in PREFIXES))


def terms_column(text: Column) -> Column:
    """The same as :func:`terms_of`, as a column."""
    words = F.array_distinct(words_of(text))

    def starts(n):  # a second parameter of these lambdas would be the position
        return F.transform(F.filter(words, lambda word: F.length(word) >= n),
                           lambda word: F.concat(F.substring(word, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(starts, PREFIXES)))


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Presence:
    """A rows-by-terms matrix of shares from 0 to 1, mostly 0, by its other entries."""

    rows: np.ndarray
    columns: np.ndarray
    shares: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, matrix: np.ndarray) -> Presence:
        at = np.nonzero(matrix)
        return cls(*at, matrix[at].astype(float), matrix.shape)

    def only(self, mask: np.ndarray) -> Presence:
        """The rows of ``mask``, numbered anew."""
        kept, number = mask[self.rows], np.cumsum(mask) - 1
        return Presence(number[self.rows[kept]], self.columns[kept], self.shares[kept],
                        (int(mask.sum()), self.shape[1]))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.shares * v[self.columns], self.shape[0])

    def back(self, v: np.ndarray, power: int = 1) -> np.ndarray:
        return np.bincount(self.columns, self.shares ** power * v[self.rows], self.shape[1])


def fit_logistic(presence: Presence, dense: np.ndarray, y: np.ndarray, ridge: float = 0.5,
                 rounds: int = 12) -> np.ndarray:
    """Weights (the last one is the intercept) by penalised Newton steps.

    ``dense`` has the few other inputs. The steps are solved by conjugate
    gradients, which only visit the entries of ``presence``.
    """
    n, terms = presence.shape
    dense = np.c_[dense, np.ones(n)]
    penalty = np.full(terms + dense.shape[1], ridge)
    penalty[-1] = 1e-3
    weights = np.zeros(len(penalty))

    def times(v):
        return presence.times(v[:terms]) + dense @ v[terms:]

    def back(v):
        return np.r_[presence.back(v), v @ dense]

    for _ in range(rounds):
        p = sigmoid(times(weights))
        spread = np.maximum(p * (1 - p), 1e-6)
        scale = np.r_[presence.back(spread, 2), spread @ dense ** 2] + penalty
        left = back(y - p) - penalty * weights
        move, along = np.zeros(len(weights)), left / scale
        size = left @ along
        enough = 1e-4 * size
        for _ in range(200):
            if size <= enough or size < 1e-18:
                break
            curved = back(spread * times(along)) + penalty * along
            step = size / (along @ curved)
            move += step * along
            left = left - step * curved
            before, size = size, left @ (left / scale)
            along = left / scale + size / before * along
        weights += move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-5:
            break
    return weights


@dataclass
class Chain:
    """Fitted models in order; each takes term presence and all earlier probabilities."""

    categories: tuple[str, ...]
    terms: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, raws: list[bytes]) -> np.ndarray:
        """(texts, categories) probabilities."""
        terms = [[self.terms[word] for word in self.terms.keys() & terms_of(raw)] for raw in raws]
        out = np.zeros((len(raws), len(self.categories)))
        for k, weights in enumerate(self.weights):
            linear = np.array([weights[found].sum() for found in terms]).reshape(len(raws))
            out[:, k] = sigmoid(linear + out[:, :k] @ weights[len(self.terms):-1] + weights[-1])
        return out


def fit_chain(presence: Presence | np.ndarray, targets: np.ndarray, folds: np.ndarray, terms: list[str],
              categories: tuple[str, ...] = CATEGORIES,
              of_fold: dict[int, tuple[Presence, np.ndarray]] | None = None) -> Chain:
    """Fit the chain; ``targets`` has one 0/1 column per category, ``folds`` a fold per row.

    ``of_fold`` gives inputs and targets of all rows as they are known without
    a fold; for folds that it leaves out they are those of the whole.
    """
    presence = Presence.of(presence) if isinstance(presence, np.ndarray) else presence
    models, earlier = [], np.zeros((len(targets), 0))
    for k in range(len(categories)):
        out_of_fold = np.zeros(len(targets))
        for fold in np.unique(folds):
            known, wanted = (of_fold or {}).get(int(fold), (presence, targets))
            inside, width = folds == fold, known.shape[1]
            weights = fit_logistic(known.only(~inside), earlier[~inside], wanted[~inside, k].astype(float))
            out_of_fold[inside] = sigmoid(known.only(inside).times(weights[:width])
                                          + earlier[inside] @ weights[width:-1] + weights[-1])
        models.append(fit_logistic(presence, earlier, targets[:, k].astype(float)))
        earlier = np.c_[earlier, out_of_fold]
    return Chain(tuple(categories), {term: i for i, term in enumerate(terms)}, models)


def choose_terms(rows: DataFrame, least: float = LEAST_Z) -> list[tuple[list[str], bool]]:
    """Groups of terms that depend on the label, and whether each is strongly toxic.

    ``rows`` has doc_id, label and terms. A term is chosen if the signed root of
    Pearson's statistic of presence and label is at least ``least`` away from
    zero. A word and its beginnings in the same rows (same counts and hash sums
    of the rows) are one group. Groups and their terms are in order.
    """
    sizes = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = float(sizes["t"]), float(sizes["n"])
    held = F.col("t") + F.col("o")
    z = F.try_divide(F.col("t") * n - held * toxic,
                     F.sqrt(F.lit(toxic * (n - toxic)) * held * (1 - held / max(n, 1.0))))
    # 40 bits each, so that the sums of many rows stay within a long.
    marks = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "terms"), 24).alias(f"m{seed}") for seed in (0, 1)]
    # Hashed below the explode, once for each row and not for each of its terms.
    seen = (rows.select("label", *marks, "terms").select("label", "m0", "m1", F.explode("terms").alias("term"))
            .groupBy("term").agg(F.sum("label").cast("double").alias("t"),
                                 F.sum(1 - F.col("label")).cast("double").alias("o"),
                                 F.sum("m0").alias("m0"), F.sum("m1").alias("m1"))
            .where((held >= 3) & (held < n)))
    groups: dict[tuple, list[str]] = {}
    for row in seen.where(F.abs(z) >= least).orderBy("term").collect():
        groups.setdefault((row["term"][:min(PREFIXES)], row["t"], row["o"], row["m0"], row["m1"]), []).append(row["term"])
    return [(terms, t >= STRONG * (t + o)) for (_, t, o, _, _), terms in groups.items()]


def inputs_of(words: list[list[str]], label: np.ndarray,
              groups: list[tuple[list[str], bool]]) -> tuple[Presence, np.ndarray]:
    """Share of each group's terms in each row, and the categories that follow from label and terms."""
    group = {term: k for k, (terms, _) in enumerate(groups) for term in terms}
    sizes = np.array([len(terms) for terms, _ in groups], int)
    strong = np.array([is_strong for _, is_strong in groups], bool)
    rows = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), int, len(words)))
    columns = np.fromiter((group.get(word, -1) for row in words for word in row), int, len(rows))
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    cells, counts = np.unique(rows * max(len(groups), 1) + columns, return_counts=True)
    lines, places = np.divmod(cells, max(len(groups), 1))
    hits = np.bincount(rows, strong[columns], len(words)) if groups else np.zeros(len(words))
    return (Presence(lines, places, counts / sizes[places], (len(words), len(groups))),
            np.c_[label * (hits >= 1), label * (hits >= ABUSE_TERMS), label])


def shared_words(column: pa.ChunkedArray) -> list[list[str]]:
    """The lists of an Arrow column; a word that many of them hold is one object."""
    known: dict[str, str] = {}
    return [[known.setdefault(word, word) for word in row.as_py() or ()] for row in column]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Chain:
    """Fit on the bounded sample of labelled rows; without any, every probability is one half.

    The driver receives the vocabulary terms of at most ``limit`` rows. Null
    texts count as empty, repeated rows count as often as they occur.
    """
    rows = materialise(training_rows(docs, labels, "toxic", limit).select(
        "doc_id", "label", terms_column(F.col("text")).alias("terms")), "toxic-training")
    groups = choose_terms(rows)
    without = {fold: choose_terms(rows.where(F.pmod("doc_id", F.lit(FOLDS)) != fold)) for fold in range(FOLDS)}
    wanted = sorted({term for chosen in (groups, *without.values()) for terms, _ in chosen for term in terms})
    data = rows.select("doc_id", "label", F.array_intersect(
        "terms", F.from_json(F.lit(json.dumps(wanted)), "array<string>")).alias("words")
        ).orderBy("doc_id", "label", "words").limit(limit).toArrow()
    words = shared_words(data["words"])
    label = data["label"].to_numpy().astype(int)
    folds = data["doc_id"].to_numpy() % FOLDS
    fitted = fit_chain(*inputs_of(words, label, groups), folds, [terms[0] for terms, _ in groups],
                       of_fold={fold: inputs_of(words, label, chosen) for fold, chosen in without.items()})
    sizes = np.array([len(terms) for terms, _ in groups], int)
    return Chain(fitted.categories, {term: i for i, term in enumerate(term for terms, _ in groups for term in terms)},
                 [np.r_[np.repeat(weights[:len(groups)] / sizes, sizes), weights[len(groups):]]
                  for weights in fitted.weights])


def with_toxicity(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with one probability per category.

    Null texts count as empty, texts are read whole, repeated rows each get
    their probabilities and an empty table gives none. Columns of the same
    names are replaced, all others stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)  # terms of the training rows and a few vectors
    names = [f"{prefix}{name}" for name in chain.categories]
    (struct,) = fresh(["chain"], docs.columns, names)

    @F.pandas_udf(", ".join(f"`{name}` double" for name in names))
    def predict(texts):
        import pandas as pd
        found = model.value.predict([(text or "").encode() for text in texts])
        return pd.DataFrame(found, columns=names)

    kept = [name for name in docs.columns if name not in names]
    return (docs.withColumn(struct, predict(F.col("text")))
            .select(*[F.col(f"`{name}`") for name in kept], F.col(f"{struct}.*")))


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``docs`` whose last category is less likely than ``threshold``; all columns stay.

    Rows are judged one by one: repeated rows go or stay together, null and
    empty texts get the chance of a text without any term.
    """
    prefix = "p_"
    while any(name.startswith(prefix) for name in docs.columns):
        prefix = f"_{prefix}"
    scored = with_toxicity(docs, chain, prefix)
    return scored.where(F.col(f"{prefix}{chain.categories[-1]}") < threshold).select(*docs.columns)
