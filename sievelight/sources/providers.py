"""Embedding and language models behind one interface, with a cache.

A provider maps a batch of inputs to outputs and is sent to the executors.  Failures give
null outputs and an error, never an exception; only inputs that the cache doesn't have
are sent.  The stand-ins here are deterministic and need no network.
"""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.hashing import cache_key
from sievelight.sources.calls import Log, as_completed
from sievelight.sources.storage import settled


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Unit vectors of hashed character trigrams."""

    dim: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            codes = np.pad(codes, (0, max(0, 3 - len(codes))))
            h = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            out[k] = np.bincount((h % np.uint64(self.dim)).astype(np.int64), weights=sign, minlength=self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def post(url: str, body: dict, key_variable: str | None, seconds: float) -> dict:
    """The JSON answer to a JSON request; the key, if any, is read where the request is made."""
    headers = {"Content-Type": "application/json"}
    if key_variable and os.environ.get(key_variable):
        headers["Authorization"] = f"Bearer {os.environ[key_variable]}"
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors of a server with the usual embeddings interface: {model, input} gives {data: [{index, embedding}]}."""

    url: str
    model: str
    dim: int
    instruction: str = ""
    key_variable: str | None = None
    seconds: float = 90.0

    def embed(self, texts: list[str]) -> np.ndarray:
        said = [f"Instruct: {self.instruction}\nQuery: {t}" for t in texts] if self.instruction else texts
        answer = post(self.url, {"model": self.model, "input": said}, self.key_variable, self.seconds)
        rows = sorted(answer["data"], key=lambda r: r["index"])
        out = np.array([r["embedding"] for r in rows], float)
        if out.shape != (len(texts), self.dim):
            raise ValueError(f"{out.shape} for {len(texts)} texts")
        return out


@dataclass(frozen=True)
class HttpModel:
    """Answers of a server with the usual chat interface, as JSON by a schema if it takes one."""

    url: str
    model: str
    key_variable: str | None = None
    seconds: float = 90.0

    def __call__(self, prompt: str, system: str | None = None) -> tuple[str, int, int]:
        messages = [{"role": "system", "content": system}] if system else []
        messages.append({"role": "user", "content": prompt})
        body = {"model": self.model, "messages": messages, "response_format": {"type": "json_object"}}
        answer = post(self.url, body, self.key_variable, self.seconds)
        used = answer.get("usage", {})
        return answer["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0)


def embed(
    texts: DataFrame,
    embedder: Embedder,
    key: str = "text_id",
    text: str = "text",
    batch: int = 128,
    attempts: int = 5,
    concurrency: int | None = None,
    in_flight: int = 1,
    seconds: float | None = None,
) -> DataFrame:
    """key, embedding and error of each text; a batch that fails is tried again row by row.

    ``concurrency`` bounds the tasks that run at a time, ``in_flight`` the calls of each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(keys: list, vectors: list, errors: list) -> pd.DataFrame:
            return pd.DataFrame({key: keys, "embedding": vectors, "error": errors})

        def batches() -> Iterator[tuple]:
            for frame in frames:
                for lo in range(0, len(frame), batch):
                    part = frame.iloc[lo : lo + batch]
                    values = part[text].fillna("").tolist()
                    yield (part[key].tolist(), values), lambda v=values: list(embedder.embed(v))

        for (keys, values), vectors, error in as_completed(batches(), in_flight, attempts, seconds):
            if error is None:
                yield of(keys, vectors, [None] * len(keys))
                continue
            single = iter([(k, lambda v=v: embedder.embed([v])[0]) for k, v in enumerate(values)])
            vectors, errors = [None] * len(keys), [None] * len(keys)
            for k, vector, failed in as_completed(single, in_flight, 1, seconds):
                vectors[k], errors[k] = vector, None if failed is None else str(failed)[:500]
            yield of(keys, vectors, errors)

    rows = texts.select(key, text)
    rows = rows.repartition(concurrency) if concurrency else rows
    return rows.mapInPandas(
        run, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>, error string"
    )


def embed_missing(
    texts: DataFrame, done: DataFrame | None, embedder: Embedder, key: str = "text_id", **options
) -> DataFrame:
    """Embeddings of the texts whose key isn't done, each once."""
    todo = texts.dropDuplicates([key])
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    return embed(todo, embedder, key, **options)


#: Answers that a task hands on together.
ROWS = 1000
#: Fixed value: seconds after which a call counts as failed.
CALL_SECONDS = 90.0
#: A task's answer to a rendered prompt, and to a system's part if there is one: JSON, tokens in and out.
Answer = Callable[..., tuple[str, int, int]]


#: The catalogue of model tasks: name and the fields of the answer.
TASKS = {
    "cluster_card": "label string, clinical_relevance string, urgency_potential string, emotional_potential string",
    "cluster_picker": "picks array<struct<query:string,mu_grade:string,pu_grade:string,et_grade:string>>, skip_reason string",
    "blind_verifier": "mu_grade string, mu_applicable boolean, pu_grade string, pu_applicable boolean, et_grade string, et_applicable boolean, confidence int",
    "backfill": "generated array<struct<query:string,mu_grade:string,pu_grade:string,et_grade:string>>",
    "reference": "mu_grade string, mu_applicable boolean, pu_grade string, pu_applicable boolean, et_grade string, et_applicable boolean, confidence int",
    "variants": "variants array<struct<text:string,target_grade:int>>",
    "axis_judge": "grade int, confidence int",
    "triage": "mu int, pu int, et int",
    "counterfactual": "paraphrase string, up string, down string",
}


#: Session setting that names the folder of the log, where a call doesn't.
LOG_SETTING = "spark.sievelight.calls.log"
_LOGGED = [("cache_key", pa.string()), ("response", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64())]
_ANSWER = ["cache_key", "response", "prompt_tokens", "completion_tokens"]


def logged(spark: SparkSession, folder: str) -> DataFrame | None:
    """The answers in a log, each key once; None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run=*/part=*/*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return None
    schema = "cache_key string, response string, prompt_tokens long, completion_tokens long"
    return spark.read.schema(schema).parquet(folder).select(*_ANSWER).dropDuplicates(["cache_key"])


def call_model(
    prompts: DataFrame,
    answer: Answer,
    model: str,
    task: str,
    key: str,
    prompt: str = "prompt",
    cache: DataFrame | None = None,
    attempts: int = 3,
    concurrency: int | None = None,
    seconds: float | None = CALL_SECONDS,
    in_flight: int = 8,
    log: str | None = None,
    log_every: int = 100,
    system: str | None = None,
) -> DataFrame:
    """key, cache_key, response, prompt_tokens, completion_tokens, cached and error of each prompt.

    The cache (cache_key, response, tokens) is joined first; what it lacks is sent once
    for each distinct prompt.  ``concurrency`` bounds the tasks that run at a time,
    ``in_flight`` the calls of each; a call that takes longer than ``seconds`` counts as failed and is made
    again, too.

    ``system`` names a column that the model gets beside the prompt, as its second argument.

    ``log`` is a folder that all executors reach (unset: the one that LOG_SETTING names, if any).  Answers
    are written there, ``log_every`` at a time and the rest as a task ends well; a task that takes
    another's place, and a later run, ask only for those that aren't there.
    """
    spark = prompts.sparkSession
    log = log or spark.conf.get(LOG_SETTING, None)
    told = F.col(system) if system else F.lit(None).cast("string")
    rows = prompts.select(key, F.col(prompt).alias("_p"), told.alias("_s"))
    parts = {"prompt": F.col("_p")} | ({"system": F.col("_s")} if system else {})
    rows = rows.withColumn("cache_key", cache_key(model=F.lit(model), task=F.lit(task), **parts))
    earlier = logged(spark, log) if log else None
    if earlier is not None:
        earlier = settled(earlier)
        own = earlier if cache is None else earlier.join(cache.select("cache_key"), "cache_key", "left_anti")
        cache = own if cache is None else cache.select(*_ANSWER).unionByName(own)
    todo = rows.select("cache_key", "_p", "_s").dropDuplicates(["cache_key"])
    if cache is not None:
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")
    run_name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, kept = None, {}
        if log:
            held = Log(log, run_name, TaskContext.get().partitionId(), pa.schema(_LOGGED), log_every)
            kept = {r["cache_key"]: r for r in held.held()}
        out: list[tuple] = []

        def jobs() -> Iterator[tuple[str, Callable]]:
            for frame in frames:
                for k, text, part in zip(frame["cache_key"], frame["_p"], frame["_s"], strict=True):
                    if k in kept:
                        yield (k, True), lambda r=kept[k]: tuple(r[c] for c in _ANSWER[1:])
                    else:
                        yield (k, False), lambda said=(text, part) if system else (text,): answer(*said)

        def full() -> Iterator[pd.DataFrame]:
            if out:
                yield pd.DataFrame(out, columns=[*_ANSWER, "error"])
                out.clear()

        for (k, known), found, error in as_completed(jobs(), in_flight, attempts, seconds):
            if error is not None:
                out.append((k, None, 0, 0, str(error)[:500]))
            else:
                out.append((k, *found, None))
                if held and not known:
                    held.add(dict(zip(_ANSWER, (k, *found), strict=True)))
            if len(out) >= ROWS:
                yield from full()
        if held:
            held.write()
        yield from full()

    todo = todo.repartition(concurrency, "cache_key") if concurrency else todo
    schema = "cache_key string, response string, prompt_tokens long, completion_tokens long, error string"
    new = todo.mapInPandas(run, schema).withColumn("cached", F.lit(False))
    if cache is not None:
        new = new.unionByName(
            cache.select(*_ANSWER, F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
        )
    return rows.drop("_p", "_s").join(new, "cache_key")


def parsed(answers: DataFrame, task: str, keep: list[str]) -> DataFrame:
    """The answers' fields by the task's schema; an answer that doesn't have them gives nulls."""
    return answers.select(*keep, F.from_json("response", TASKS[task]).alias("_r")).select(*keep, "_r.*")


def usage(answers: DataFrame) -> DataFrame:
    """Calls, failures, cached answers and tokens of a run."""
    new = ~F.col("cached")
    return answers.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.count_if("cached").alias("n_cached"),
        F.coalesce(F.sum(F.when(new, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(new, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
    )


def same_inputs(manifest: DataFrame, task: str, digest: str) -> bool:
    """Whether a run may go on: its recorded inputs (task, digest) are these, or none."""
    rows = manifest.filter(F.col("task") == task).select("digest").limit(1).collect()
    return not rows or rows[0]["digest"] == digest
