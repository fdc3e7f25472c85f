"""Lookups by external services as a stage over distinct keys, with an injectable client.

No client is built in: a client is a function from a key to a JSON text (or None where nothing is
found). Failures are typed, and answers are kept as a table, so a later run asks for new keys only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = "key string, success boolean, body string, error string"


@dataclass(frozen=True)
class Policy:
    """Seconds between two requests of a task, retries after a failure, and tasks that may ask at once."""

    pause: float = 0.5
    retries: int = 2
    tasks: int = 1


def _wanted(keys: DataFrame, key: str, known: DataFrame | None) -> DataFrame:
    wanted = keys.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull()).distinct()
    return wanted if known is None else wanted.join(known.where("success").select("key"), "key", "left_anti")


def _answer(call: Callable[[], str | None], policy: Policy) -> tuple[bool, str | None, str | None]:
    """(success, body, error) of a request, with its pauses and retries."""
    error = ""
    for _ in range(policy.retries + 1):
        if policy.pause:
            time.sleep(policy.pause)
        try:
            body = call()
            return body is not None, body, None if body is not None else "not found"
        except Exception as x:  # a service's failure is a result of its key
            error = f"{type(x).__name__}: {x}"
    return False, None, error


def fetch(keys: DataFrame, key: str, client: Callable[[str], str | None], policy: Policy = Policy(), known: DataFrame | None = None) -> DataFrame:
    """Answers for the different keys of a table that aren't known yet."""
    wanted = _wanted(keys, key, known)

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *_answer(lambda k=k: client(k), policy)) for k in part["key"]]
            yield pd.DataFrame(rows, columns=["key", "success", "body", "error"])

    return wanted.repartition(policy.tasks).mapInPandas(ask, ANSWERS)


def flatten_hits(answers: DataFrame, schema: str, path: str = "results") -> DataFrame:
    """One row for each element of an array in the answers' JSON; keys without any are left out."""
    parsed = answers.where("success").select("key", F.from_json("body", f"struct<{path}:array<{schema}>>").alias("j"))
    return parsed.select("key", F.explode(f"j.{path}").alias("hit")).select("key", "hit.*")


def fetch_pages(keys: DataFrame, key: str, client: Callable[[str, int, int], str | None], rows: int = 10, limit: int = 10, path: str = "result_set", policy: Policy = Policy(), known: DataFrame | None = None) -> DataFrame:
    """Answers page by page: the client gets the key, the first row and the number of rows, until a page isn't full or ``limit`` rows are asked for.

    One answer for each key, with the pages' arrays at ``path`` as one. A page that fails after its
    retries fails the key, so that it is asked again as a whole.
    """
    wanted = _wanted(keys, key, known)

    def all_pages(k: str) -> tuple[bool, str | None, str | None]:
        found: list = []
        while len(found) < limit:
            ask = min(rows, limit - len(found))
            ok, body, error = _answer(lambda: client(k, len(found), ask), policy)
            if not ok and not (error == "not found" and found):
                return False, None, error
            page = json.loads(body).get(path) or [] if ok else []
            found += page[:ask]
            if len(page) < ask:
                break
        return True, json.dumps({path: found}), None

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(k, *all_pages(k)) for k in part["key"]], columns=["key", "success", "body", "error"])

    return wanted.repartition(policy.tasks).mapInPandas(work, ANSWERS)


def sequence_query(sequence: Column, identity_cutoff: float = 0.9, evalue_cutoff: float = 1.0, start: int | Column = 0, rows: int = 10) -> Column:
    """The JSON body of a structure search by sequence, best hits first, one page of it."""
    lit = lambda v: F.lit(v) if not isinstance(v, Column) else v
    # Names of the service's query language.
    parameters = F.struct(lit(evalue_cutoff).alias("evalue_cutoff"), lit(identity_cutoff).alias("identity_cutoff"), F.lit("pdb_protein_sequence").alias("target"), sequence.alias("value"))
    query = F.struct(F.lit("terminal").alias("type"), F.lit("sequence").alias("service"), parameters.alias("parameters"))
    options = F.struct(F.lit("sequence").alias("scoring_strategy"), F.struct(lit(start).alias("start"), F.lit(rows).alias("rows")).alias("paginate"))
    return F.to_json(F.struct(query.alias("query"), options.alias("request_options"), F.lit("polymer_entity").alias("return_type")))


def sequence_hits(answers: DataFrame, least_score: float = 0.0) -> DataFrame:
    """(key, identifier, score, similarity in percent to two decimals) of the hits that have an identifier and at least that score; a missing score is 0."""
    hits = flatten_hits(answers, "struct<identifier:string,score:double>", "result_set").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return hits.where((F.coalesce("identifier", F.lit("")) != "") & (F.col("score") >= least_score)).withColumn("similarity", F.round(F.col("score") * 100, 2))


def last_compounds(answers: DataFrame, schema: str, path: str = "compounds") -> DataFrame:
    """One row for each key with compounds: of several under a name the last one counts."""
    parsed = answers.where("success").select("key", F.from_json("body", f"struct<{path}:array<{schema}>>")[path].alias("c")).where(F.size("c") > 0)
    return parsed.select("key", F.element_at("c", -1).alias("hit")).select("key", "hit.*")
