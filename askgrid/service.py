"""Question to answer: retrieve, rerank, generate, validate, execute.

Adapters are plain objects: a schema provider with ``retrieve`` and
``rerank``, a generator with ``generate``, an executor and a validator. No
adapter is replaced silently: each declares whether it is a demonstration and
the mode says which ones may be.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators import guard
from askgrid.operators.execute import Execution, execute

STAGES = ("retrieval", "reranking", "generation", "validation", "execution")
MAX_QUESTION = 2000

# Which of (schema provider, generator, executor) are demonstrations, per mode.
MODES = {"demo": (True, True, True), "real_retrieval": (False, True, True),
         "live": (False, False, False)}

FAILURES = {
    "retrieval": ("SCHEMA_ERROR", "Schema preparation is unavailable. Please try again."),
    "reranking": ("SCHEMA_ERROR", "Schema preparation is unavailable. Please try again."),
    "generation": ("GENERATION_ERROR", "SQL generation is unavailable. Please try again."),
    "validation": ("VALIDATION_ERROR", "SQL safety validation is unavailable. Execution was blocked."),
    "execution": ("EXECUTION_ERROR", "The query could not be completed."),
}
TIMEOUT = ("TIMEOUT", "The operation timed out. Please try again.")


@dataclass(frozen=True)
class RankedTable:
    rank: int
    name: str
    score: float | None = None
    summary: str = ""


class SchemaProvider(Protocol):
    is_demo: bool

    def retrieve(self, question: str) -> list[RankedTable]: ...

    def rerank(self, question: str, candidates: list[RankedTable]) -> list[RankedTable]: ...


class Generator(Protocol):
    is_demo: bool

    def generate(self, question: str, tables: list[RankedTable]) -> str:
        """SQL, optionally fenced, or an abstention."""


@dataclass
class Answer:
    question: str
    mode: str
    status: str = "WAITING"
    tables: list[RankedTable] = field(default_factory=list)
    sql: str = ""
    message: str = ""
    error: str | None = None
    columns: list[str] = field(default_factory=list)
    rows: list[list[Any]] = field(default_factory=list)
    steps: dict[str, str] = field(default_factory=lambda: dict.fromkeys(STAGES, "waiting"))
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def row_count(self) -> int:
        return len(self.rows)


class _Stop(Exception):
    """Ends a run early with a final status and the mark of the stage."""

    def __init__(self, status: str, mark: str, message: str = ""):
        super().__init__(status)
        self.status, self.mark, self.message = status, mark, message


class QuestionService:
    def __init__(self, schema: SchemaProvider, generator: Generator, executor, validator,
                 mode: str = "live"):
        if mode not in MODES:
            raise ValueError(f"Unknown mode: {mode}")
        declared = tuple(getattr(part, "is_demo", None) for part in (schema, generator, executor))
        if declared != MODES[mode]:
            raise ValueError(f"Adapters do not match mode {mode}")
        self.schema, self.generator = schema, generator
        self.executor, self.validator, self.mode = executor, validator, mode

    def ask(self, question: str, on_progress: Callable[[dict], None] | None = None) -> Answer:
        answer = Answer(question.strip(), self.mode)
        started = time.perf_counter()
        if not 0 < len(answer.question) <= MAX_QUESTION:
            answer.status = "INPUT_ERROR"
            answer.error = f"Enter a question of 1 to {MAX_QUESTION} characters."
        else:
            self._run(answer, on_progress or (lambda steps: None))
        answer.timings["total"] = time.perf_counter() - started
        return answer

    def _run(self, answer: Answer, notify) -> None:
        work = {"retrieval": self._retrieve, "reranking": self._rerank, "generation": self._generate,
                "validation": self._validate, "execution": self._execute}
        carried: Any = None
        for place, stage in enumerate(STAGES):
            answer.steps[stage] = "running"
            notify(dict(answer.steps))
            tick = time.perf_counter()
            try:
                carried = work[stage](answer, carried)
                answer.steps[stage] = "success"
            except _Stop as stop:
                answer.status, answer.steps[stage] = stop.status, stop.mark
                answer.message = stop.message
            except TimeoutError:
                (answer.status, answer.error), answer.steps[stage] = TIMEOUT, "timeout"
            except Exception:
                (answer.status, answer.error), answer.steps[stage] = FAILURES[stage], "error"
            finally:
                answer.timings[stage] = time.perf_counter() - tick
            if answer.steps[stage] != "success":
                answer.steps.update(dict.fromkeys(STAGES[place + 1:], "skipped"))
                break
        else:
            answer.status = "SUCCESS"
        notify(dict(answer.steps))

    def _retrieve(self, answer, _):
        return self.schema.retrieve(answer.question)

    def _rerank(self, answer, candidates):
        answer.tables = list(self.schema.rerank(answer.question, candidates))
        if len(answer.tables) > fixed.FINAL_DEPTH:
            raise ValueError("More tables than the final depth")
        return answer.tables

    def _generate(self, answer, tables):
        text = guard.clean_answer(self.generator.generate(answer.question, tables))
        if guard.is_abstention(text):
            raise _Stop("INSUFFICIENT_SCHEMA", "abstained")
        answer.sql = text
        return text

    def _validate(self, answer, text):
        checked = self.validator(text)
        if not checked.valid:
            raise _Stop("VALIDATION_REJECTED", "rejected", guard.user_message(checked.errors))
        answer.message = "Passed the SQL validator."
        answer.sql = checked.cleaned_sql
        return answer.sql

    def _execute(self, answer, sql):
        result: Execution = self.executor(sql)
        if result.status == "rejected":
            raise _Stop("VALIDATION_REJECTED", "rejected",
                        guard.user_message(result.validation_errors))
        if result.status != "success":
            raise RuntimeError("Execution failed")
        answer.columns, answer.rows = result.columns, result.rows


class SparkExecutor:
    """Runs validated SQL on the session, with the row cap and the timeout."""

    is_demo = False

    def __init__(self, spark: SparkSession, known_tables: list[str], max_rows: int = 100,
                 timeout: float = 10.0):
        self.spark, self.known = spark, known_tables
        self.max_rows, self.timeout = max_rows, timeout

    def __call__(self, sql: str) -> Execution:
        return execute(self.spark, sql, self.known, max_rows=self.max_rows, timeout=self.timeout)


class FrameSchemaProvider:
    """Candidates and final ranking from frame-valued functions of a question frame.

    ``candidates(questions)`` returns (question_id, id) and ``scores`` adds
    (pair_score, summary); at most depth-many rows are fetched.
    """

    is_demo = False

    def __init__(self, spark: SparkSession, candidates: Callable[[DataFrame], DataFrame],
                 scores: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.candidates, self.scores = spark, candidates, scores

    def _asked(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([(0, question)], "question_id bigint, text string")

    def retrieve(self, question: str) -> list[RankedTable]:
        most = 2 * fixed.CANDIDATE_DEPTH
        found = self.candidates(self._asked(question)).select("id").distinct().orderBy("id").limit(
            most + 1).collect()
        if len(found) > most:
            raise ValueError("More candidates than two sources of the candidate depth can give")
        return [RankedTable(rank, row["id"]) for rank, row in enumerate(found, start=1)]

    def rerank(self, question: str, candidates: list[RankedTable]) -> list[RankedTable]:
        names = [item.name for item in candidates]
        if len(set(names)) != len(names):
            raise ValueError("Candidates contain duplicates")
        if len(names) < fixed.FINAL_DEPTH:
            raise ValueError("Fewer candidates than the final depth")
        frame = self.spark.createDataFrame([(0, name) for name in names],
                                           "question_id bigint, id string")
        top = (self.scores(self._asked(question), frame)
               .orderBy(F.desc("pair_score"), "id").limit(fixed.FINAL_DEPTH).collect())
        return [RankedTable(rank, row["id"], row["pair_score"], row["summary"])
                for rank, row in enumerate(top, start=1)]
