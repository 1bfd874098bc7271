"""Model operators behind small interfaces, with cached calls and deterministic defaults.

Calls to a model go through a cache: known keys are answered from it, and the misses are
called once per distinct key, under a cap. In read-only mode a miss is an error, and
empty or truncated output is never cached.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<abstention: boolean, reponse: string, citations: array<struct<record_id: string, extrait: string>>>"
NOTE = "struct<note: int, sur: int, par_critere: array<struct<critere: string, acquis: boolean, justification: string>>>"


class ModelError(ValueError):
    """What a model returned can't be used."""


def cache_key(*parts: object) -> str:
    return json.dumps(parts, ensure_ascii=False, sort_keys=True)


@dataclass
class CachedModel:
    """``call`` behind a cache with a cap on new calls."""

    call: Callable[[str], str]
    cap: int = 400
    read_only: bool = False
    known: dict[str, str] = field(default_factory=dict)
    made: int = 0

    def __call__(self, key: str) -> str:
        if key in self.known:
            return self.known[key]
        if self.read_only:
            raise ModelError(f"not in the cache: {key[:80]}")
        if self.made >= self.cap:
            raise ModelError(f"more than {self.cap} calls")
        self.made += 1
        value = self.call(key)
        if not value or not value.strip():
            raise ModelError("empty output")
        self.known[key] = value
        return value


def parsed_answer(raw: str, stop_reason: str = "end_turn") -> dict:
    """A generated answer, or an error: truncated, no JSON, or blank without abstaining."""
    if stop_reason != "end_turn":
        raise ModelError(f"stopped by {stop_reason}")
    try:
        answer = json.loads(raw)
    except json.JSONDecodeError as e:
        raise ModelError("no JSON") from e
    if not answer.get("abstention") and not answer.get("reponse", "").strip():
        raise ModelError("blank answer")
    return answer


def checked_note(note: dict, rubric: list[str]) -> dict:
    """A judge's note that fits its rubric."""
    if note["sur"] != len(rubric) or not 0 <= note["note"] <= note["sur"] or len(note["par_critere"]) != len(rubric):
        raise ModelError("the note doesn't fit the rubric")
    return note


def context(record_id, path, article, text):
    """A passage as a prompt shows it."""
    return F.concat(F.lit("["), record_id, F.lit("] ("), path, F.lit(", article "), F.coalesce(article, F.lit("-")), F.lit(")\n"), text)


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """The offline embedder: signed hashed words, normalised."""
    v = np.zeros(dim)
    for word in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, column: str, model: str = "hashed", dim: int = 64) -> DataFrame:
    """``df`` with ``embedding``; models named e5 get the prefix they were trained with."""
    prefix = "passage: " if "e5" in model else ""

    @F.pandas_udf("array<double>")
    def encoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_embedding(prefix + (t or ""), dim))

    return df.withColumn("embedding", encoded(column))


def through_cache(keys: DataFrame, cache: DataFrame, model: Callable[[str], str], read_only: bool = False) -> DataFrame:
    """key -> value: cached ones by a join, the distinct misses by the model where they are."""
    known = keys.select("key").distinct().join(cache.select("key", "value"), "key", "left")
    missing = known.filter("value is null").select("key")
    if read_only:
        missing = missing.select(F.raise_error(F.concat(F.lit("not in the cache: "), "key")).cast("string").alias("key"))

    def called(batches):
        for batch in batches:
            batch["value"] = batch["key"].map(model)
            yield batch

    return known.filter("value is not null").unionByName(missing.mapInPandas(called, "key string, value string"))
