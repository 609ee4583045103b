"""Best representative of each duplicate group, field by field.

Currency reasoning: from rows that carry a time, learn which value tends to follow which (transitions between the
consecutive values of a group). Of two values the one that follows the other more often than the other way round is
the later one. Those precedences among the values of a group are its partial order; where times are missing, a value
that no other value of the group follows survives (of several, one that follows others), and where precedences run in a circle the weakest ones give way.
Known evidence (trust, confidence, time) comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.text import DAY_US, bare_doi, micros, strip
from corpusql.operators.skew import salted_join
from corpusql.session import staged

# Texts, by letters alone, that say only that there is no value.
NO_VALUE = [
    "", "none", "null", "nil", "nan", "na", "nd", "unknown", "notavailable", "notgiven", "notknown", "notapplicable", "unavailable", "missing",
    "novalue", "empty", "tbd", "tba", "tbc", "undefined", "unspecified", "notspecified", "novenue", "noabstract", "noabstractavailable",
    "abstractnotavailable", "abstractunavailable", "abstractmissing", "missingabstract", "noabstractgiven", "noyear", "nodoi", "notitle", "untitled", "nodata", "notprovided", "xxx", "todo",
]


def usable(c: Column) -> Column:
    """The text says something: it is not empty and does not only say that there is no value."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.coalesce(~letters.isin(NO_VALUE), F.lit(False))


def year_of(c: Column) -> Column:
    """A year from 1800 to 2030 in a text such as `` 2009``, ``(2024)`` or ``2023.0``; else NULL."""
    y = F.nullif(F.regexp_extract(c, r"^[^\p{L}\p{N}-]*(\d{4})(?:\.0+)?[^\p{L}\p{N}]*$", 1), F.lit("")).cast("int")
    return F.when(y.between(1800, 2030), y)


def value_class(field: Column, value: Column) -> Column:
    """What transitions are learned between: years and venues themselves, of long texts whether their end is cut and the size (powers of two)."""
    return (
        F.when(field == "year", value)
        .when(field == "venue", F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", ""))
        .otherwise(F.concat(F.when(value.rlike(r"(\.\.\.|…)\s*$"), "cut ").otherwise(""), F.lit("size "), F.floor(F.log2(F.length(value) + 1)).cast("string")))
    )


def transitions(rows: DataFrame) -> DataFrame:
    """field, before, after, n: how often the value class ``after`` directly follows ``before`` in a group.

    rows: src, grp, field, row_id, cls, ts (microseconds, NULL: left out). A group's rows are read in daily pieces whose
    ends are then joined up, so that a group with a third of all rows is not read by one task.
    """
    piece = ["src", "grp", "field", "day"]
    timed = rows.filter(F.col("ts").isNotNull()).select(*piece[:3], F.floor(F.col("ts") / DAY_US).alias("day"), F.struct("ts", "row_id", "cls").alias("x"))
    inner = timed.select("field", F.lag("x.cls").over(W.partitionBy(*piece).orderBy("x")).alias("before"), F.col("x.cls").alias("after"))
    ends = timed.groupBy(*piece).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    outer = ends.select(
        "field", F.lag("last.cls").over(W.partitionBy(*piece[:3]).orderBy("day")).alias("before"), F.col("first.cls").alias("after")
    )
    moves = inner.unionByName(outer).filter("before IS NOT NULL AND before <> after")
    return moves.groupBy("field", "before", "after").agg(F.count("*").alias("n"))


def precedences(moves: DataFrame) -> DataFrame:
    """field, before, after, weight: of two value classes, the one that follows the other more often is the later one; by how much more."""
    up = F.col("before") < F.col("after")
    pair = moves.select("field", F.least("before", "after").alias("x"), F.greatest("before", "after").alias("y"), F.when(up, F.col("n")).otherwise(-F.col("n")).alias("n"))
    net = pair.groupBy("field", "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")
    return net.select("field", F.when(F.col("n") > 0, F.col("x")).otherwise(F.col("y")).alias("before"), F.when(F.col("n") > 0, F.col("y")).otherwise(F.col("x")).alias("after"), F.abs("n").alias("weight"))


def superseded(values: DataFrame, order: DataFrame) -> DataFrame:
    """src, grp, field, cls, by, above: the strongest precedences by which another value class of the group follows this one (NULL: none
    does) and by which it follows another one; no row for a class that neither holds of.

    values: src, grp, field, cls, each once. The partial order of a group is found along the learned precedences, never by pairing
    all its values. ``by`` orders circles too: as the weakest precedences are dropped, the class with the smallest ``by`` is free first.
    """
    ahead = salted_join(values, order.withColumnRenamed("before", "cls"), ["field", "cls"], ["grp"])
    later = values.select("src", "grp", "field", F.col("cls").alias("after"))
    side = lambda c, by, above: F.struct(F.col(c).alias("cls"), by.alias("by"), above.alias("above"))
    none, weight = F.lit(None).cast("long"), F.col("weight")
    both = ahead.join(later, ["src", "grp", "field", "after"]).select("src", "grp", "field", F.inline(F.array(side("cls", weight, none), side("after", none, weight))))
    return both.groupBy("src", "grp", "field", "cls").agg(F.max("by").alias("by"), F.max("above").alias("above"))


def survivors(rows: DataFrame, min_rows: int = 2, with_value: bool = True, keep_empty: bool = False, learned: DataFrame | None = None) -> DataFrame:
    """src, grp, field, pick, value, n_rows: the surviving value of each group with ``min_rows`` rows or more and a usable value.

    Without ``with_value`` values are not carried along and the column is NULL. With ``keep_empty`` groups without a
    usable value stay, with a NULL pick. ``learned``: precedences learned elsewhere; by default those of the dated rows.

    rows: src, grp, field, row_id, value (NULL: not usable), trust (higher survives, NULL last), ts (microseconds; the
    latest survives; NULL: the learned order decides, below any known time). Remaining ties go to the largest row_id.
    Repeated rows count as rows. Groups are aggregated, never collected. NULL groups and empty tables give no rows.
    """
    rows = rows.filter(F.col("grp").isNotNull()).withColumn("cls", value_class(F.col("field"), F.col("value"))).withColumn("there", F.col("value").isNotNull())
    if not with_value:
        rows = rows.withColumn("value", F.lit(None).cast("string"))
    undated = rows.filter(F.col("there") & F.col("ts").isNull())
    order = precedences(transitions(rows.filter("there"))) if learned is None else learned
    group = ["src", "grp", "field", "cls"]
    below = superseded(undated.select(*group).distinct(), order)
    currency = F.struct((-F.coalesce("by", F.lit(0))).cast("long").alias("free"), F.coalesce("above", F.lit(0)).cast("long").alias("above"))
    undated = salted_join(undated, below, group, ["row_id"], "left").select(*rows.columns, currency.alias("currency"))
    dated = rows.filter(~(F.col("there") & F.col("ts").isNull())).withColumn("currency", F.lit(None).cast("struct<free:bigint,above:bigint>"))
    ranked = dated.unionByName(undated).withColumn("best", F.when(F.col("there"), F.struct("trust", "ts", "currency", "row_id", "value")))
    return (
        ranked.groupBy("src", "grp", "field").agg(F.max("best").alias("best"), F.count("*").alias("n_rows"))
        .filter((F.col("n_rows") >= min_rows) & (F.lit(keep_empty) | F.col("best").isNotNull()))
        .select("src", "grp", "field", F.col("best.row_id").alias("pick"), F.col("best.value").alias("value"), "n_rows")
    )


def undated_survivors(rows: DataFrame) -> DataFrame:
    """``survivors`` as if no row had a time, trust or confidence: the learned precedences alone, from the rows' times, decide."""
    valued = rows.filter("value IS NOT NULL AND grp IS NOT NULL").withColumn("cls", value_class(F.col("field"), F.col("value")))
    bare = rows.withColumns({"ts": F.lit(None).cast("long"), "trust": F.lit(None).cast("long")})
    return survivors(bare, with_value=False, learned=staged(precedences(transitions(valued)), "precedences"))


def discovery_values(discovery: DataFrame, trust: DataFrame) -> DataFrame:
    """Rows for ``survivors``: year, venue and abstract of every discovery row with a DOI; arrival is the time of year and venue."""
    ranks = trust.groupBy(F.lower(strip("source")).alias("source")).agg(F.min("trust").alias("rank"))
    d = discovery.select("arrival", F.lower(strip("source")).alias("source"), "year", "venue", "abstract", bare_doi("doi").alias("grp")).filter(F.col("grp").isNotNull())
    d = d.join(ranks, "source", "left")
    year, venue, abstract = year_of(F.col("year").cast("string")).cast("string"), F.when(usable(F.col("venue")), F.col("venue")), F.when(usable(F.col("abstract")), F.col("abstract"))
    by_trust = F.coalesce(-F.col("rank"), F.lit(-(1 << 30))).cast("long")
    field = lambda name, value, trust: F.struct(F.lit(name).alias("field"), value.alias("value"), trust.cast("long").alias("trust"))
    return d.select(
        F.lit("discovery_results").alias("src"), "grp", F.col("arrival").alias("row_id"), F.col("arrival").alias("ts"),
        F.inline(F.array(field("year", year, by_trust), field("venue", venue, by_trust), field("abstract", abstract, F.length("abstract")))),
    )


def repair_values(actions: DataFrame) -> DataFrame:
    """Rows for ``survivors``: proposed values of a paper's field."""
    level = F.lower(strip("confidence"))
    value = F.when(F.col("field") == "year", year_of(F.col("proposed_value")).cast("string")).otherwise(
        F.when(usable(F.col("proposed_value")), F.col("proposed_value"))
    )
    return actions.select(
        F.lit("repair_actions").alias("src"), F.col("paper_id").alias("grp"), "field", F.col("action_id").alias("row_id"), value.alias("value"),
        F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0).cast("long").alias("trust"),
        micros("proposed_at").alias("ts"),
    )


def merged_records(discovery: DataFrame, trust: DataFrame) -> DataFrame:
    """One built record a DOI: year, venue and abstract of the surviving rows, with the number of rows behind it."""
    picks = survivors(discovery_values(discovery, trust), min_rows=1, keep_empty=True)
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return picks.groupBy(F.col("grp").alias("doi")).agg(of("year"), of("venue"), of("abstract"), F.max("n_rows").alias("n_rows"))
