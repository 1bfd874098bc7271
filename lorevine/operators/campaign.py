"""Campaigns: grids of configurations, freshness control and control of published figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.operators import evaluation
from lorevine.operators.lexical import SearchConfig

#: What a lever must reach to be adopted.
LEAST_P, WORST_CATEGORY = 0.95, -0.05

Measure = Callable[[SearchConfig], DataFrame]


def grid(levers: dict[str, list], neutral: SearchConfig | None = None) -> dict[str, SearchConfig]:
    """Each lever alone, at each value but the neutral one; the reference is measured once."""
    neutral = neutral or SearchConfig()
    out = {"reference": neutral}
    for lever, values in levers.items():
        out |= {f"{lever}={v}": replace(neutral, **{lever: v}) for v in values if v != getattr(neutral, lever)}
    return out


def run_grid(configs: dict[str, SearchConfig], measure: Measure, category: DataFrame, value: str = "recall_10", n_boot: int = 10_000) -> DataFrame:
    """config, n, delta, low, high, p, worst, adopted: every configuration against the reference.

    ``measure`` gives scores per question (item_id, value) of a batch of questions.
    """
    base = measure(configs["reference"]).cache()
    every = None
    for name, config in configs.items():
        if name == "reference":
            continue
        pairs = evaluation.paired(base, measure(config), value).cache()
        worst = evaluation.worst_category(pairs, category).agg(F.coalesce(F.min("delta"), F.lit(0.0)).alias("worst"))
        row = evaluation.paired_bootstrap(pairs, n_boot=n_boot).crossJoin(worst).select(F.lit(name).alias("config"), "n", "delta", "low", "high", "p", "worst")
        every = row if every is None else every.unionByName(row)
    return every.withColumn("adopted", (F.col("p") >= LEAST_P) & (F.col("worst") >= WORST_CATEGORY))


def assert_fresh(published: DataFrame, scores: DataFrame, value: str = "recall_10") -> None:
    """Published values (item_id, value) must come out again exactly, question by question."""
    missing = published.join(scores, "item_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} published questions are missing")
    moved = published.select("item_id", F.col(value).alias("then")).join(scores.select("item_id", F.col(value).alias("now")), "item_id").filter("not (then <=> now)").count()
    if moved:
        raise ValueError(f"{moved} published values don't come out again")


def renderings(x: float, digits: int = 4) -> set[str]:
    """How a report may write a figure: with point or comma, hyphen or minus sign, with or without trailing zeros."""
    plain = {f"{x:.{digits}f}", f"{x:.{digits}f}".rstrip("0").rstrip("."), f"{x:g}"}
    return {s.replace("-", m).replace(".", d) for s in plain for m in "-−" for d in ".,"}


def unreported(figures: DataFrame, report: str, digits: int = 4) -> list[str]:
    """Names of figures (name, value) that the report doesn't state; a handful of rows by nature."""
    return [r.name for r in figures.toLocalIterator() if not any(s in report for s in renderings(r.value, digits))]
