"""What was run and asked: append-only tables of runs, tasks, questions and calls."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import metrics
from quire.sources.provider import Provider, Request, Response, prompt_hash
from quire.sources.store import Store

RUN = "run_id string, kind string, layer string, status string, started_at string, finished_at string, error string"
TASK = (
    "run_id string, task_id string, task_type string, record_id string, status string, error string, started_at string, finished_at string,"
    " duration_ms long, prompt_tokens long, output_tokens long, prompt_hash string, prompt string, response string"
)


def now() -> str:
    """The time as RFC 3339 text in UTC."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Recorder:
    """A provider that notes what it was asked and what came back; for calls of the driver."""

    inner: Provider
    run_id: str
    calls: list[tuple] = field(default_factory=list)

    def generate(self, request: Request) -> Response:
        began, clock = now(), time.monotonic()
        r = self.inner.generate(request)
        spent = int((time.monotonic() - clock) * 1000)
        status = "failed" if r.error else "completed"
        self.calls.append((
            self.run_id, f"task-{len(self.calls) + 1:04d}", request.task_type, None, status, r.error, began, now(), spent, r.prompt_tokens, r.output_tokens,
            prompt_hash(request.system, request.user), request.user, r.content,
        ))
        return r


class Audit:
    """Runs and tasks beside a manuscript; every entry is appended, none is changed."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    @contextmanager
    def run(self, kind: str, layer: str = "") -> Iterator[str]:
        """A run's id; its row is written when it ends, whether well or not."""
        run_id, began = f"{kind}-{uuid.uuid4().hex[:26]}", now()
        try:
            yield run_id
        except Exception as problem:
            self._append("runs", [(run_id, kind, layer, "failed", began, now(), str(problem))], RUN)
            raise
        self._append("runs", [(run_id, kind, layer, "completed", began, now(), "")], RUN)

    def calls(self, recorder: Recorder) -> None:
        if recorder.calls:
            self._append("tasks", recorder.calls, TASK)

    def answers(self, run_id: str, task_type: str, rows: DataFrame, record: str) -> None:
        """Tasks of an answers frame (columns of ``generate``), written where the rows are."""
        failed = F.coalesce("error", F.lit("")) != ""
        done = rows.select(
            F.lit(run_id).alias("run_id"), F.concat_ws(":", F.lit(task_type), F.col(record)).alias("task_id"), F.lit(task_type).alias("task_type"), F.col(record).cast("string").alias("record_id"),
            F.when(failed, "failed").otherwise("completed").alias("status"), F.coalesce("error", F.lit("")).alias("error"), F.lit(None).cast("string").alias("started_at"),
            F.lit(now()).alias("finished_at"), F.col("duration_ms"), F.col("prompt_tokens"), F.col("output_tokens"), F.sha2("user", 256).alias("prompt_hash"), F.col("user").alias("prompt"), F.col("content").alias("response"),
        )
        self.store.append({"tasks": done})

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.store.append({name: self.spark.createDataFrame(rows, schema)})

    def summary(self, run_id: str) -> DataFrame:
        """Tasks, failures, tokens and time of a run by task type."""
        return metrics.task_totals(self.store.read("tasks").where(F.col("run_id") == run_id))
