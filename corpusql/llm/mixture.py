"""Mixing sources to target weights by weighted fair queueing.

Every use of a text gets a virtual finish time: the tokens its source has sent so far, itself included, divided by
the source's target weight. All uses are range-sorted by finish time and cut where the running total reaches the budget.
Running totals are built from bucket sums, so that no source, however large, passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import strip
from corpusql.llm.encode import token_count
from corpusql.session import staged

#: Slices of a source's shuffled order, and of virtual time, over which running totals are built.
BUCKETS = 2048


def source_label(c: Column) -> Column:
    """A source label whatever its case, outer white space and word separators; NULL if empty."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"[\s_-]+", "_"), F.lit(""))


def sized_texts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, text_key, n_tokens of every document; texts without a token have 0."""
    return documents.select(
        "doc_id",
        source_label(F.col("source")).alias("source"),
        F.sha2("text", 256).alias("text_key"),
        token_count(F.col("text"), vocabulary).alias("n_tokens"),
    )


def running_total(df: DataFrame, size: str, within: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Sum of ``size`` up to and with each row, by ``within``, over (``bucket``, ``order``); two small shuffles instead of one long window."""
    sums = df.groupBy(*within, bucket).agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*within, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*within, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.join(offsets, [*within, bucket])
        .withColumn(out, F.col("_before") + F.sum(size).over(inside))
        .drop("_before")
    )


def horizon(supply: dict[str, tuple[float, float]], budget: float | None) -> tuple[float, float]:
    """(budget, virtual time at which it is used up) for source -> (weight, most tokens it can send).

    Without a budget: the largest at which every source that has texts still meets its target.
    """
    live = {s: x for s, x in supply.items() if x[0] > 0 and x[1] > 0}
    if not live:
        return 0.0, 0.0
    ends = sorted(cap / w for w, cap in live.values())
    if budget is None:
        budget = ends[0]
    sent, v, weight = 0.0, 0.0, sum(w for w, _ in live.values())
    for end in ends:
        if sent + weight * (end - v) >= budget:
            return budget, v + (budget - sent) / weight
        sent, v = sent + weight * (end - v), end
        weight = sum(w for w, cap in live.values() if cap / w > end)
    return budget, v


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """The mixture: source, doc_id, use_no, n_tokens, finish, position (tokens before this use in the mixture's order).

    A text that several documents share is used as one text, of the source with the fewest repeats allowed (then by
    name) and its smallest doc_id, so that no text is used more often than ``max_repeats``. Texts of sources without a
    target stay out. Targets of sources without texts are spread over the others in proportion. ``budget``: total
    tokens; without it the largest total at which all targets are met. If a budget asks for more, sources that run out
    stop and the others go on. Ties of finish time go by source, doc_id, use_no. Empty documents or targets: no rows.
    ``targets`` is a small table by nature (one row a source); its rows and per-source sums come to the driver.
    """
    goal = (
        targets.select(source_label(F.col("source")).alias("source"), "target_share", "max_repeats")
        .filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        .groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    first = F.min(F.struct("max_repeats", "source", "doc_id")).alias("m")
    texts = staged(
        sized.filter("n_tokens > 0").join(F.broadcast(goal), "source").groupBy("text_key").agg(first, F.first("n_tokens").alias("n_tokens"))
        .select("m.source", "m.doc_id", "n_tokens"),
        "texts",
    )
    supply = {
        r.source: (r.target_share, r.n * r.max_repeats, r.n)
        for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(goal, "source").collect()
    }
    scale = sum(w for w, _, _ in supply.values()) or 1.0
    total, until = horizon({s: (w / scale, cap) for s, (w, cap, _) in supply.items()}, budget)
    weights = sized.sparkSession.createDataFrame(
        [(s, w / scale, n, use) for s, (w, cap, n) in supply.items() for use in range(cap // n) if use * n < until * w / scale],
        "source string, weight double, source_tokens long, use long",
    )
    key = F.xxhash64("doc_id", "use", F.lit(seed))
    uses = texts.join(F.broadcast(weights), "source").withColumn("_key", key).withColumn("_slice", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(buckets)))
    uses = running_total(uses, "n_tokens", ["source", "use"], "_slice", ["_key", "doc_id"], "_cum")
    uses = uses.withColumn("finish", (F.col("use") * F.col("source_tokens") + F.col("_cum")) / F.col("weight")).filter(
        F.col("finish") - F.col("n_tokens") / F.col("weight") < until
    )
    width = max(until, 1.0) / buckets
    uses = uses.select(
        "source", "doc_id", (F.col("use") + 1).alias("use_no"), "n_tokens", "finish", F.floor(F.col("finish") / width).alias("_range"), F.lit(0).alias("_all")
    )
    cut = running_total(uses, "n_tokens", ["_all"], "_range", ["finish", "source", "doc_id", "use_no"], "_total")
    return cut.filter(F.col("_total") <= total).select(
        "source", "doc_id", "use_no", "n_tokens", "finish", (F.col("_total") - F.col("n_tokens")).alias("position")
    )


def mixture_shares(sized: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """Per source (targets and documents): target_share, max_repeats, texts and tokens there, uses and tokens in the mixture, actual_share, most_used."""
    goal = targets.select(source_label(F.col("source")).alias("source"), "target_share", "max_repeats")
    there = sized.filter("n_tokens > 0").groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count_distinct("text_key").alias("n_texts"), F.sum("n_tokens").alias("n_tokens")
    )
    used = mixture.groupBy("source").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("mixed_tokens"), F.max("use_no").alias("most_used"))
    total = mixture.agg(F.sum("n_tokens").alias("all_tokens"))
    return (
        there.join(goal, "source", "full").join(used, "source", "left").crossJoin(F.broadcast(total))
        .withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)))
        .drop("all_tokens")
        .na.fill(0, ["n_texts", "n_tokens", "n_uses", "mixed_tokens", "most_used"])
        .na.fill(0.0, ["target_share"])
    )
