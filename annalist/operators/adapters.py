"""Systems under test behind one surface: ingest into a clean scope, query as of a time, answer through a guarded client, tear down."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.operators import calls, evaluation, merging, retrieval
from annalist.sources.scopes import Scopes

log = logging.getLogger(__name__)
ARTIFACTS = "slot_id bigint, text string, valid_at date, invalid_at date"


class Adapter:
    """A system: subclasses say how it finds (`search`) and what it can (`capabilities`). All questions of a run are one frame.

    Stored are rows of ARTIFACTS by scope; phases (name, rows) of an ingest go in one after the other under one record, so that
    an ingest that was cut off is not taken for a whole one.
    """

    name, capabilities, pinned_version = "adapter", frozenset(), None

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Scopes(spark, path, ARTIFACTS)

    def resolve_version(self) -> str:
        return "unknown"

    def version(self) -> str:
        """The running version; "unknown" if it cannot be told. A version that differs from the pinned one is warned of."""
        try:
            found = self.resolve_version()
        except Exception as failed:
            log.warning("%s: its version cannot be told: %s", self.name, failed)
            return "unknown"
        if self.pinned_version and "unknown" not in found.lower() and found != self.pinned_version:
            log.warning("%s runs in version %s, pinned is %s: results may not be comparable", self.name, found, self.pinned_version)
        return found

    def ingest(self, scope: str, *phases: DataFrame, reuse: bool = True) -> str:
        rows = phases[0]
        for more in phases[1:]:
            rows = rows.unionByName(more)
        return self.store.ingest(rows, scope, self.version(), reuse)

    def search(self, rows: DataFrame, questions: DataFrame) -> DataFrame:
        """query_id, id, rank of rows (ARTIFACTS) for questions (query_id, text)."""
        raise NotImplementedError

    def query(self, scope: str, questions: DataFrame, as_of=None) -> DataFrame:
        """query_id, cited (ids by rank), context (their texts by rank). as_of (a date) is for systems with the temporal capability; others see all."""
        rows = self.store.rows().where(F.col("scope") == scope).drop("scope")
        if as_of is not None and "temporal" in self.capabilities:
            at = F.lit(as_of).cast("date")
            rows = rows.where((F.col("valid_at").isNull() | (F.col("valid_at") <= at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))
        found = self.search(rows, questions).join(rows.select(F.col("slot_id").alias("id"), "text"), "id")
        listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("l"))
        own = listed.select("query_id", F.transform("l", lambda x: x["id"]).alias("cited"), F.array_join(F.transform("l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("context"))
        return questions.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce("cited", F.array().cast("array<bigint>")).alias("cited"), F.coalesce("context", F.lit("")).alias("context"))

    def teardown(self, scope: str) -> bool:
        return self.store.wipe(scope)


class KeywordAdapter(Adapter):
    """Finds by shared tokens."""

    name, capabilities, pinned_version = "keyword", frozenset({"provenance", "temporal"}), "1"

    def __init__(self, spark: SparkSession, path: str, k: int = 3) -> None:
        super().__init__(spark, path)
        self.k = k

    def resolve_version(self) -> str:
        return "1"

    def search(self, rows: DataFrame, questions: DataFrame) -> DataFrame:
        found = retrieval.keyword_topk(questions.withColumnRenamed("query_id", "item_id"), rows.select(F.col("slot_id").alias("doc_id"), "text"), self.k)
        return found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), "rank")


def answered(contexts: DataFrame, questions: DataFrame, make: Callable[[], Callable[[str], str]] | None = None, guard: calls.Guard = calls.Guard(), lanes: int = 8) -> DataFrame:
    """query_id, answer_text, status: what a neutral answerer says to each question and its context. Without a client, a dry run: no answer, status dry_run.

    The client is asked through `calls`: its failures are outcomes of rows, and no answer is an empty one.
    """
    if make is None:
        return contexts.select("query_id", F.lit("").alias("answer_text"), F.lit("dry_run").alias("status"))
    rows = questions.select("query_id", "text").join(contexts.select("query_id", "context"), "query_id", "left")
    prompt = F.concat(F.lit("Question:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nContext:\n"), evaluation.answer_context("context"))
    said = calls.called(rows, ["query_id"], ["query_id"], prompt, make, guard, lanes)
    return said.select("query_id", F.col("reply").alias("answer_text"), "status")


def judged(questions: DataFrame, answers: DataFrame, make: Callable[[], Callable[[str], str]] = calls.dry, guard: calls.Guard = calls.Guard(), lanes: int = 8) -> DataFrame:
    """question_id, score, failure_mode: verdicts on the answers that have a question. questions: id, text, truth, rubric, emergent; answers: question_id, answer_text.

    Without a client it is a dry run, which takes the same way: score 0, mode dry_run.
    """
    rows = questions.join(answers.select(F.col("question_id").alias("id"), "answer_text"), "id")
    said = calls.called(rows, ["id"], ["id"], merging.judge_prompt("text", "truth", F.col("rubric"), "answer_text", F.col("emergent")), make, guard, lanes)
    return calls.verdicts(said, ["id"]).withColumnRenamed("id", "question_id")
