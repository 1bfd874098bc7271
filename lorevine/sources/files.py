"""Inputs: question files, JSON caches, checked downloads, settings, and guards."""

from __future__ import annotations

import hashlib
import os
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, categorie string, citations array<string>, notes string, gold_fiscal string, attendu string, raison string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL file of questions; blank lines are dropped."""
    return spark.read.schema(QUESTION).json(path).filter(F.col("id").isNotNull())


def cache_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON file that is one object, as rows of key and value."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def answers_by_question(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Cached answers whose composite key (a JSON array, the question first) names a question (id, question)."""
    keyed = cache.withColumn("question", F.element_at(F.from_json("key", "array<string>"), 1))
    return keyed.join(asked.select("id", "question"), "question").select("id", "question", "value")


def missing_or_seed(source: DataFrame, asked: DataFrame, target: str) -> bool:
    """Write the cache entries of these questions to ``target`` unless it is there; whether it was written."""
    if Path(target).exists():
        return False
    source.join(asked.select(F.col("question").alias("key")), "key", "left_semi").write.json(target)
    return True


def checksum(path: str | Path, block: int = 1 << 16) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def download(url: str, target: str | Path, sha256: str) -> Path:
    """Fetch a file unless it is there; what doesn't have the checksum is deleted and refused."""
    target = Path(target)
    if not target.exists():
        urllib.request.urlretrieve(url, target)  # noqa: S310
    if checksum(target) != sha256:
        target.unlink()
        raise ValueError(f"{target} doesn't have the expected checksum")
    return target


def load_settings(path: str | Path) -> None:
    """KEY=value lines into the environment; what is set there already stays, and no file is no error."""
    if not Path(path).exists():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.partition("=")
        if eq and not key.strip().startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("'\""))


def required(path: str | Path, *scripts: str) -> Path:
    """The path, or an error that says what makes it."""
    if not Path(path).exists():
        raise FileNotFoundError(f"{path} is missing; run {' and '.join(scripts)} first")
    return Path(path)


def write_json_result(df: DataFrame, target: str, complete: bool, to: str | None = None) -> str:
    """Write a campaign's rows; a partial one never replaces a published result."""
    if not complete and to is None:
        raise ValueError("a partial campaign needs a target of its own")
    place = to or target
    df.write.mode("overwrite").json(place)
    return place
