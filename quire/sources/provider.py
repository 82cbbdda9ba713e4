"""Language models as an external function over rows of prompts.

A provider turns a request to a response.  ``generate`` runs one over a
DataFrame in ``mapInPandas``; ``attempt`` adds checks, retries and fallbacks as
frames: rows that fail a check are asked again, those that fail again take what
is derived from the text itself.  The answers of each try are written before
anything reads them, so a row is asked once in a try, however often its answer
is looked at (but again if its task is lost).
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.aside import Aside


@dataclass(frozen=True)
class Request:
    task_type: str
    system: str
    user: str
    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 2000
    json_mode: bool = True


@dataclass(frozen=True)
class Response:
    content: str
    prompt_tokens: int = 0
    output_tokens: int = 0
    finish_reason: str = "stop"
    error: str = ""


class Provider(Protocol):
    def generate(self, request: Request) -> Response: ...


@dataclass(frozen=True)
class FakeProvider:
    """Answers by the first script entry whose key occurs in the prompt; picklable, the same everywhere."""

    script: tuple[tuple[str, str], ...] = ()
    default: str = "{}"

    def generate(self, request: Request) -> Response:
        answer = next((a for k, a in self.script if k in request.user), self.default)
        if answer.startswith("!"):
            return Response("", finish_reason="error", error=answer[1:])
        return Response(answer, len(request.user) // 4, len(answer) // 4)


@dataclass(frozen=True)
class HttpProvider:
    """A chat-completions server; falls back from a JSON schema to plain JSON where it has none."""

    base_url: str
    api_key: str = ""
    timeout_s: float = 300.0
    schema: dict = field(default_factory=dict)

    def body(self, request: Request, with_schema: bool) -> dict:
        out = {
            "model": request.model,
            "messages": [{"role": "system", "content": request.system}, {"role": "user", "content": request.user}],
            "temperature": request.temperature,
            "max_tokens": request.max_tokens,
        }
        if request.json_mode:
            named = {"type": "json_schema", "json_schema": {"name": request.task_type, "schema": self.schema}}
            out["response_format"] = named if with_schema and self.schema else {"type": "json_object"}
        return out

    def post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        call = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), head)
        with urllib.request.urlopen(call, timeout=self.timeout_s) as answer:
            return json.loads(answer.read())

    def generate(self, request: Request) -> Response:
        try:
            data = self.post("/chat/completions", self.body(request, True))
        except urllib.error.HTTPError as problem:
            if problem.code != 400 or "response_format" not in problem.read().decode(errors="replace"):
                return Response("", finish_reason="error", error=str(problem))
            data = self.post("/chat/completions", self.body(request, False))
        except OSError as problem:
            return Response("", finish_reason="error", error=f"timeout: {problem}")
        choice, used = data["choices"][0], data.get("usage", {})
        return Response(choice["message"]["content"] or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0), choice.get("finish_reason", ""))

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        return [d["embedding"] for d in self.post("/embeddings", {"model": model, "input": texts})["data"]]

    def models(self) -> list[str]:
        with urllib.request.urlopen(self.base_url.rstrip("/") + "/models", timeout=self.timeout_s) as answer:
            return [m["id"] for m in json.loads(answer.read())["data"]]


def generate(prompts: DataFrame, provider: Provider, task_type: str, system: str, model: str = "", user_col: str = "user") -> DataFrame:
    """``prompts`` with the model's answer and what it cost, asked in batches on the executors."""
    extra = "content string, prompt_tokens long, output_tokens long, finish_reason string, error string, duration_ms long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", " + extra

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for user in pdf[user_col]:
                began = time.monotonic()
                r = provider.generate(Request(task_type, system, user or "", model))
                rows.append((r.content, r.prompt_tokens, r.output_tokens, r.finish_reason, r.error, int((time.monotonic() - began) * 1000)))
            yield pdf.assign(**dict(zip(("content", "prompt_tokens", "output_tokens", "finish_reason", "error", "duration_ms"), map(list, zip(*rows)) if rows else [[]] * 6)))

    return prompts.mapInPandas(run, schema)


def attempt(
    items: DataFrame,
    key: list[str],
    ask: Callable[[DataFrame, int, DataFrame | None], DataFrame],
    valid: Column,
    fallback: Callable[[DataFrame], DataFrame],
    tries: int = 2,
    actions: tuple[str, ...] = ("none", "retry"),
) -> DataFrame:
    """(key, answer columns, action): first valid answers, then retried ones, then fallbacks.

    ``ask`` turns items, the try's number and the answers of the try before to
    answers, one for each item, which may say their ``action`` themselves;
    ``valid`` judges an answer row.  An item without an answer is left for the
    next try; with several, all of them count.
    """
    aside = Aside(items.sparkSession, "answers")
    done, left, last = None, items, None
    for number in range(1, tries + 1):
        asked = ask(left, number, last)
        named = asked if "action" in asked.columns else asked.withColumn("action", F.lit(actions[min(number, len(actions)) - 1]))
        last = aside.keep(named.withColumn("_valid", F.coalesce(valid, F.lit(False))))
        good = last.where("_valid").drop("_valid")
        done = good if done is None else done.unionByName(good, allowMissingColumns=True)
        left = left.join(good.select(*key), key, "left_anti")
        if number < tries and left.isEmpty():
            return done
    return done.unionByName(fallback(left).withColumn("action", F.lit("fallback")), allowMissingColumns=True)


def prompt_hash(system: str, user: str) -> str:
    return hashlib.sha256(f"{system}\u0000{user}".encode()).hexdigest()
