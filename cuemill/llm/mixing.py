"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until each of the three marginals meets its target; a document's
probability is its cell's calibrated weight, scaled so that the expected tokens meet the budget, and a hash of the document decides.

All expressions are built-in functions. Raking and scaling work on the table of cells by one method: rounds until the marginals stop
moving, then the exact scale by fixing capped cells until no more are capped. Up to `CELLS` cells (checked by a count) the driver does the
sums, beyond that the same sums are aggregations over the distributed table. Probabilities are rounded to `DIGITS` places, which is above
the noise of summing in another order, so both ways draw the same documents. The join of cells to documents is a broadcast under the same
check, else a shuffle join that adaptive execution splits where a cell is hot.

Without a topic column the topic is one of form (`form_topic`), by shares of digits and line ends and by length.

Defined results: null source, language or topic form a category of their own; a null or empty text has no tokens and topic `empty`,
its cell has weight 0 unless texts with tokens share it, and rows of weight 0 are not drawn; repeated rows are drawn together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.common import cut_lineage, read_table, useful_partitions

#: Cells that the driver rakes itself.
CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, DIGITS = 60, 1e-9, 9
NONE = "\x00none"


def form_topic(text: Column, tokens: Column) -> Column:
    """empty; figures (a tenth of the characters or more are digits); lines (a line end for every ten tokens or more); short, medium, long."""
    t = F.coalesce(text, F.lit(""))
    digits = F.regexp_count(t, F.lit("[0-9]"))
    ends = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (
        F.when(tokens == 0, "empty")
        .when(10 * digits >= F.length(t), "figures")
        .when(10 * ends >= tokens, "lines")
        .when(tokens < 64, "short")
        .when(tokens < 512, "medium")
        .otherwise("long")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    known = docs.select(
        "*",
        name("source").alias("__source"),
        name("lang").alias("__lang"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("__tokens"),
    )
    return known.withColumn("__topic", name("topic") if "topic" in docs.columns else form_topic(F.col("text"), F.col("__tokens")))


def softened(shares: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to the observed ones to a power below 1, which lifts small categories."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights, of sum 1, whose marginals meet the targets as far as the cells allow."""
    w = tokens / max(tokens.sum(), 1)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, weights=w, minlength=len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            worst = max(worst, np.abs(now - target)[now > 0].max(initial=0))
            w = w * factor[code]
        if worst < TOLERANCE:
            break
    return w / max(w.sum(), 1e-300)


def scale_for(sums: Callable[[float], tuple[float, float]], wanted: float) -> float:
    """The factor f at which sum(tokens * min(1, f * ratio)) is the wanted number; infinite if all rows are too few.

    sums(f): the tokens of cells with f * ratio >= 1, and the sum of tokens * ratio over the others. Each step fixes the cells that are
    capped at the factor so far, which only grows, so it ends where no further cell is capped.
    """
    factor, capped = 0.0, -1.0
    while True:
        now, rest = sums(factor)
        if now == capped:
            return factor
        if now >= wanted:
            return factor
        if rest <= 0:
            return float("inf")
        capped, factor = now, (wanted - now) / rest


def _on_driver(cells: DataFrame, targets: dict, power: float, budget: float, spark: SparkSession, rounds: int) -> DataFrame:
    rows = cells.orderBy("__source", "__lang", "__topic").collect()  # at most CELLS
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, goals = [], []
    for d in DIMENSIONS:
        names, code = np.unique(np.array([r[f"__{d}"] for r in rows], dtype=object).astype(str), return_inverse=True)
        share = np.bincount(code, weights=tokens, minlength=len(names)) / max(tokens.sum(), 1)
        goal = targets.get(d) or softened(dict(zip(names.tolist(), share.tolist())), power)
        goal = np.array([goal.get(n, 0.0) for n in names.tolist()]) * (share > 0)
        codes.append(code)
        goals.append(goal / max(goal.sum(), 1e-300))
    w = rake(tokens, codes, goals, rounds)
    ratio = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)

    def sums(factor: float) -> tuple[float, float]:
        full = factor * ratio >= 1
        return float(tokens[full].sum()), float((tokens * ratio)[~full].sum())

    p = chances(ratio, scale_for(sums, budget * tokens.sum()))
    schema = "__source string, __lang string, __topic string, __weight double, __probability double"
    return spark.createDataFrame([(r["__source"], r["__lang"], r["__topic"], float(a), float(b)) for r, a, b in zip(rows, w, p)], schema)


def chances(ratio: np.ndarray, factor: float) -> np.ndarray:
    return np.round(np.where(ratio > 0, np.minimum(1.0, (factor if np.isfinite(factor) else 1e300) * ratio), 0.0), DIGITS)


def _on_cluster(cells: DataFrame, targets: dict, power: float, budget: float, rounds: int) -> DataFrame:
    """The same with the cells left distributed; marginals join their cells by shuffle."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    now = cells.withColumn("__weight", F.col("tokens") / total)
    goals = {}
    for d in DIMENSIONS:
        share = cells.groupBy(f"__{d}").agg((F.sum("tokens") / total).alias("share"))
        if targets.get(d):
            given = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
            share = share.withColumn("goal", F.when(F.col("share") > 0, F.coalesce(F.try_element_at(given, F.col(f"__{d}")), F.lit(0.0))).otherwise(0.0))
        else:
            share = share.withColumn("goal", F.when(F.col("share") > 0, F.pow("share", F.lit(power))).otherwise(0.0))
        sum_ = share.agg(F.sum("goal")).first()[0] or 1.0
        goals[d] = cut_lineage(share.select(f"__{d}", (F.col("goal") / sum_).alias("goal")))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            met = cut_lineage(now.groupBy(f"__{d}").agg(F.sum("__weight").alias("w")).join(goals[d], f"__{d}").select(f"__{d}", F.when(F.col("w") > 0, F.col("goal") / F.col("w")).otherwise(0.0).alias("f"), F.when(F.col("w") > 0, F.abs(F.col("w") - F.col("goal"))).otherwise(0.0).alias("off")))
            worst = max(worst, met.agg(F.max("off")).first()[0])
            now = now.join(met.drop("off"), f"__{d}").withColumn("__weight", F.col("__weight") * F.col("f")).drop("f")
        now = cut_lineage(now)
        if worst < TOLERANCE:
            break
    sum_ = now.agg(F.sum("__weight")).first()[0] or 1.0
    now = cut_lineage(now.withColumn("__weight", F.col("__weight") / sum_))
    ratio = F.when(F.col("tokens") > 0, F.col("__weight") / F.col("tokens")).otherwise(0.0)

    def sums(factor: float) -> tuple[float, float]:
        full = factor * ratio >= 1
        return tuple(now.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("tokens") * ratio)), F.lit(0.0))).first())

    factor = scale_for(sums, budget * total)
    p = F.when(ratio > 0, F.least(F.lit(1.0), ratio * (factor if np.isfinite(factor) else 1e300))).otherwise(0.0)
    return now.select("__source", "__lang", "__topic", "__weight", F.round(p, DIGITS).alias("__probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.5, budget: float = 0.5, seed: int = 5, cells_on_driver: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """docs with topic (if it had none), n_tokens, weight, probability and drawn.

    targets: shares by category for `source`, `lang` and `topic`; a dimension without them is softened by `power`. budget: expected share
    of the tokens to keep.
    """
    known = with_cells(docs.drop("n_tokens", "weight", "probability", "drawn"))
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = cut_lineage(known.groupBy(*keys).agg(F.sum("__tokens").alias("tokens")), useful_partitions(docs))
    if cells.count() <= cells_on_driver:
        found = F.broadcast(_on_driver(cells, targets or {}, power, budget, docs.sparkSession, rounds))
    else:
        found = _on_cluster(cells, targets or {}, power, budget, rounds)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))
    u = F.pmod(F.xxhash64(name, F.coalesce("text", F.lit("")), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    out = known.join(found, keys)
    extra = [] if "topic" in docs.columns else [F.col("__topic").alias("topic")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "weight", "probability", "drawn")], *extra, F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), (u < F.col("__probability")).alias("drawn"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
