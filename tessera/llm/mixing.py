"""Problem 8: sources mixed to target weights, by temperature mixing.

A weight is a source's share of the tokens raised to a power, its exponent, and normalised. Plain temperature mixing has
one exponent for all sources and so can't meet a share for each of them. Here each source has its own: the exponent is
bisected until the share raised to it is the target. Between the natural mix (all exponents 1) and the targets lie the exponents
1 + a (t - 1); if a size is wanted that the targets can't have within the repetition limits, a is bisected to the largest
that can. Without a wanted size the largest one is taken at which the
targets themselves are within the limits, so every source reaches its target share. The plain
form, with one exponent bisected to a target entropy or to the limits, is ``temperature_weights``.

The weights are realised as budgeted block permutations: whole passes over a source as long as
the budget holds one, and of the last pass the front of a permutation. The permutation orders
blocks of documents, then documents in a block, by hash. Blocks that fit wholly are taken by a
running total over one row per block; only in the block in which the budget ends are documents
taken one by one, each if it still fits, and a few exchanged if only larger ones are left, so a source with a third of all
documents isn't gathered in one task and a share is off by a few tokens, where its documents allow that.

Defined results: a NULL source is a source that no target names and gets nothing; targets of
sources without tokens are reported as 0; targets are taken relative to their sum over sources
that exist; negative or NULL targets count as 0 and a NULL repeat limit as 1; documents
without tokens aren't used; repeated rows are documents of their own; an empty table gives an
empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import TOKENIZERS, VOCABULARY, n_tokens
from tessera.session import cut

#: Documents in a block of the permutation, on average.
BLOCK_DOCS = 10_000


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict.fromkeys(weights, 0.0)


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(holds, low: float, high: float, steps: int = 60) -> float:
    """The largest x in [low, high] for which ``holds``, given that it holds below some point."""
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def temperature_weights(sizes: Mapping[str, float], target_entropy: float | None = None, budget: float | None = None, limits: Mapping[str, int] | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights) of plain temperature mixing of the token shares.

    The exponent falls from 1 (natural) to 0 (uniform) as far as entropy ``target_entropy`` is
    reached, or as far as no source of ``limits`` is repeated more often than allowed at ``budget``.
    """
    shares = normalised({k: v for k, v in sizes.items() if v > 0})
    raised = lambda t: normalised({k: v**t for k, v in shares.items()})

    def short_of_goal(flat: float) -> bool:
        w = raised(1 - flat)
        if target_entropy is not None and entropy(w) > target_entropy:
            return False
        return limits is None or all(w[k] * budget <= limits.get(k, 1) * sizes[k] for k in w)

    exponent = 1 - bisect(short_of_goal, 0.0, 1.0)
    return exponent, raised(exponent)


class Plan(NamedTuple):
    """How far from the natural mix (0) to the targets (1), the size in tokens, and weight and exponent by source."""

    along: float
    size: float
    weights: dict[str, float]
    exponents: dict[str, float]


def exponents_to(shares: Mapping[str, float], goal: Mapping[str, float]) -> dict[str, float]:
    """The power that each share must be raised to to become its goal."""
    out = {}
    for k, share in shares.items():
        high = 1.0
        while share < 1 and share**high > goal[k]:
            high *= 2
        out[k] = bisect(lambda t: share**t >= goal[k], 0.0, high, 100) if share < 1 else 1.0
    return out


def target_weights(sizes: Mapping[str, float], targets: Mapping[str, tuple[float, int]], budget: float | None = None) -> Plan:
    """The plan for sources with token counts ``sizes`` and (share, max repeats) in ``targets``."""
    usable = {k: t for k, t in targets.items() if sizes.get(k, 0) > 0 and (t[0] or 0) > 0 and (t[1] if t[1] is not None else 1) > 0}
    if not usable:
        return Plan(1.0, 0.0, {}, {})
    goal = normalised({k: float(t[0]) for k, t in usable.items()})
    natural = normalised({k: float(sizes[k]) for k in usable})
    cap = {k: float(sizes[k]) * (t[1] if t[1] is not None else 1) for k, t in usable.items()}
    to_goal = exponents_to(natural, goal)
    powers = lambda a: {k: 1 + a * (t - 1) for k, t in to_goal.items()}
    mixed = lambda a: normalised({k: natural[k] ** t for k, t in powers(a).items()})
    most = lambda w: min(cap[k] / w[k] for k in w if w[k] > 0)
    along = 1.0 if budget is None else bisect(lambda a: budget <= most(mixed(a)) * (1 + 1e-12), 0.0, 1.0)
    weights = mixed(along)
    return Plan(along, most(weights) if budget is None else min(budget, most(weights)), weights, powers(along))


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, row) of all documents with a text; ``row`` tells repeated ids apart once the table is written."""
    sized = documents.where("doc_id IS NOT NULL").select("doc_id", "source", n_tokens("text", vocabulary, folder).alias("n_tokens")).where("n_tokens > 0")
    return sized.withColumn("row", F.monotonically_increasing_id())


def _fill_room(docs: pd.DataFrame) -> pd.DataFrame:
    """The block in which the budget ends: documents in the order of the permutation, each taken if it still fits.

    What stays free because all documents left are larger is then made smaller: the smallest of them
    comes in for taken ones that are together just large enough, as long as that leaves less room.
    """
    docs = docs.sort_values(["rank", "doc_id", "n_tokens"], ignore_index=True)
    sizes, room = docs["n_tokens"].tolist(), float(docs["room"].iloc[0])
    taken = [False] * len(sizes)
    for i, n in enumerate(sizes):
        if n <= room:
            taken[i], room = True, room - n
    by_size = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    while room >= 1:
        new = next((i for i in by_size if not taken[i]), None)
        if new is None:
            break
        need, out = sizes[new] - room, []
        for i in reversed(by_size):
            if taken[i] and sizes[i] <= need:
                out.append(i)
                need -= sizes[i]
        if need > 0:  # what is missing: the smallest taken one that is large enough
            last = next((i for i in by_size if taken[i] and i not in out and sizes[i] >= need), None)
            if last is None:
                break
            out.append(last)
            need -= sizes[last]
        if -need >= room:
            break
        taken[new], room = True, -need
        for i in out:
            taken[i] = False
    return docs.assign(extra=[int(t) for t in taken])[["doc_id", "source", "n_tokens", "passes", "extra"]]


def _held(sizes: DataFrame, targets: DataFrame) -> tuple[dict, dict]:
    """({source: (share, repeats)}, {source: (tokens, documents)}) of the sources with a target."""
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source IS NOT NULL").collect()}
    named = sizes.join(targets.where("source IS NOT NULL").select("source").distinct(), "source", "left_semi")
    return wanted, {r["source"]: (int(r["tokens"]), int(r["docs"])) for r in named.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}


def plan_of(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> Plan:
    """The plan that ``mix`` follows."""
    wanted, held = _held(sizes, targets)
    return target_weights({k: v[0] for k, v in held.items()}, wanted, budget)


def mix(sizes: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the chosen documents.

    ``sizes`` (doc_id, source, n_tokens) is read several times and should be a written table.
    The number of sources must be small (they have target shares); documents aren't collected.
    """
    spark = sizes.sparkSession
    wanted, held = _held(sizes, targets)
    _, size, weights, _ = target_weights({k: v[0] for k, v in held.items()}, wanted, budget)
    # whole passes, tokens of the last pass, blocks
    plan = [(k, int(w * size // held[k][0]), float(w * size % held[k][0]), max(1, held[k][1] // block_docs)) for k, w in weights.items()]
    plan = [(k, p, r, b) if r > 0.5 else (k, p, 0.0, b) for k, p, r, b in plan]
    budgets = spark.createDataFrame(plan, "source string, passes int, rest double, blocks int")
    # rows repeated under one id, if the table says which is which, fall into different blocks
    hashed = F.xxhash64(F.lit(seed), "doc_id", *(["row"] if "row" in sizes.columns else []))
    docs = sizes.join(budgets, "source").select("doc_id", "source", "n_tokens", "passes", "rest", hashed.alias("rank"), F.pmod(F.shiftright(hashed, 20), F.col("blocks")).cast("int").alias("block"))
    totals = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block"), "block")
    placed = totals.withColumn("before", F.coalesce(F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_block = docs.join(placed, ["source", "block"])
    whole, edge = F.col("before") + F.col("tokens") <= F.col("rest"), (F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest"))
    last = in_block.where(edge).select("doc_id", "source", "n_tokens", "passes", "rank", "block", (F.col("rest") - F.col("before")).alias("room"))
    cut_here = last.groupBy("source", "block").applyInPandas(_fill_room, "doc_id long, source string, n_tokens int, passes int, extra int")
    others = in_block.where(~edge).select("doc_id", "source", "n_tokens", "passes", whole.cast("int").alias("extra"))
    both = others.unionByName(cut_here)
    return both.select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).alias("repeats")).where("repeats > 0")


def mix_documents(documents: DataFrame, targets: DataFrame, budget: float | None = None, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``mix`` of the documents' texts."""
    return mix(cut(document_sizes(documents, vocabulary, folder), "sizes"), targets, budget)


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Per target source: wanted share, share reached, tokens used, the documents and the greatest repeat; with a plan also weight and exponent."""
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    everything = Window.partitionBy()  # one row per source
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = targets.join(held, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", zero("source_tokens"), zero("used_tokens"), zero("n_docs"), zero("most_repeats"))
    reached = joined.withColumn("share", F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(everything), F.lit(0)), F.lit(0.0)))
    if plan is None:
        return reached
    planned = chosen.sparkSession.createDataFrame([(k, w, plan.exponents[k]) for k, w in plan.weights.items()], "source string, weight double, exponent double")
    return reached.join(planned, "source", "left")
