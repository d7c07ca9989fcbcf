"""Clients of external services, plugged in as functions: batches, retries, each distinct input once.

No service is called from here: a caller gives a function from a list of inputs to a list of answers, which runs in
the executors, and the answers become a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

#: Inputs of a request, attempts, and seconds that the pauses between attempts start from.
BATCH, ATTEMPTS, PAUSE = 100, 3, 1.0


class ServiceError(RuntimeError):
    """A service failed in all attempts, or gave another number of answers than it was asked for."""


def answers(inputs: list[str], call: Callable[[list[str]], list], batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Iterator:
    """The answers to ``inputs``, asked in batches; a batch that fails is asked again after 1, 2, 4, ... pauses."""
    for at in range(0, len(inputs), batch):
        some = inputs[at : at + batch]
        for attempt in range(attempts):
            try:
                got = call(some)
            except Exception as error:
                if attempt + 1 == attempts:
                    raise ServiceError(f"no answer in {attempts} attempts: {error}") from error
                time.sleep(pause * 2**attempt)
                continue
            if len(got) != len(some):
                raise ServiceError(f"{len(got)} answers to {len(some)} inputs")
            yield from got
            break


def ask(rows: DataFrame, name: str, call: Callable[[list[str]], list], kind: str, tasks: int = 8, batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """(``name``, answer) for each distinct, not blank value of the column ``name``; ``tasks`` requests run at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inputs = frame[name].tolist()
            yield pd.DataFrame({name: inputs, "answer": list(answers(inputs, call, batch, attempts, pause))})

    distinct = rows.select(name).where(F.trim(name) != "").distinct()
    return distinct.repartition(tasks, name).mapInPandas(run, f"`{name}` string, answer {kind}")


#: Inputs of a task: what a lost executor may make to be asked again.
TASK_INPUTS = 1_000


def ask_stored(
    rows: DataFrame, name: str, call: Callable[[list[str]], list], kind: str, folder: str,
    tasks: int = 8, batch: int = BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE, per_second: float | None = None, per_task: int = TASK_INPUTS,
) -> DataFrame:
    """As ``ask``, with answers kept in ``folder`` by the hash of their input, so that no later call asks for them again.

    Inputs are asked in waves of ``tasks`` tasks with about ``per_task`` inputs each.  A task puts its answers in their
    place as it ends, not when its wave or the job does: what fails on the way loses the answers of the tasks under way and
    no others.  All tasks together make at most ``per_second`` requests.  Inputs of a request that fails in all attempts,
    or gets a wrong number of answers, and inputs whose answer is None, are left out of the result and are asked again
    by the next call.
    """
    spark = rows.sparkSession
    schema = f"`{name}` string, answer {kind}, hash string"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    read = lambda: spark.read.schema(schema).option("mergeSchema", "false").parquet(folder)
    wanted = rows.select(name).where(F.trim(name) != "").distinct().withColumn("hash", F.sha2(name, 256))
    missing = store(wanted.join(read().select("hash"), "hash", "left_anti") if there else wanted)
    left = missing.count()
    wait = tasks / per_second if per_second else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                began = time.monotonic()
                try:
                    got = list(answers(some[name].tolist(), call, batch, attempts, pause))
                except ServiceError:
                    got = [None] * len(some)
                kept = [i for i, x in enumerate(got) if x is not None]
                if kept:
                    yield pd.DataFrame({name: some[name].iloc[kept].tolist(), "answer": [got[i] for i in kept], "hash": some["hash"].iloc[kept].tolist()})
                time.sleep(max(0.0, wait - (time.monotonic() - began)))

    waves = max(1, -(-left // (tasks * per_task)))
    for wave in range(waves if left else 0):
        own = missing.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == wave) if waves > 1 else missing
        asked = own.repartition(tasks, "hash").select(name, "hash").mapInPandas(run, schema)
        asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    if not there and not left:
        return spark.createDataFrame([], schema).select(name, "answer")
    return wanted.join(read().dropDuplicates(["hash"]).select("hash", "answer"), "hash").select(name, "answer")


def embedded(rows: DataFrame, text: str, vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """``rows`` with the vector of their text from ``vectors`` (text, answer); null where there is none."""
    known = vectors.select(F.col(vectors.columns[0]).alias("__text"), F.col("answer").alias(name))
    return rows.join(known, F.col(text) == F.col("__text"), "left").drop("__text")


# ---- answers of public services -------------------------------------------------------------------------------


def person_hits(answer: Column) -> Column:
    """(rank, candidate, name) of the JSON that a search for people by ORCID iD answers with."""
    found = F.from_json(answer, "`expanded-result` array<struct<`orcid-id`:string,`given-names`:string,`family-names`:string>>")["expanded-result"]
    return F.transform(found, lambda x, i: F.struct(i.alias("rank"), x["orcid-id"].alias("candidate"), F.trim(F.concat_ws(" ", x["given-names"], x["family-names"])).alias("name")))


def entity_hits(answer: Column) -> Column:
    """(rank, candidate, name) of the JSON that a search for Wikidata entities answers with."""
    found = F.from_json(answer, "search array<struct<id:string,label:string>>")["search"]
    return F.transform(found, lambda x, i: F.struct(i.alias("rank"), x["id"].alias("candidate"), x["label"].alias("name")))


def completed(rows: DataFrame, prompt: str, call: Callable[[list[str]], list], folder: str, name: str = "completion", **limits) -> DataFrame:
    """``rows`` with the completion of their prompt by a language model's client, each distinct prompt asked once and its
    answer kept (``ask_stored``); blank prompts, and those that got no answer, have none."""
    return embedded(rows, prompt, ask_stored(rows, prompt, call, "string", folder, **limits), name)
