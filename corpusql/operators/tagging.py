"""TF-IDF tags and links between entries by their tags."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.operators.search import top, words
from corpusql.operators.skew import salted_join
from corpusql.session import staged

# Words that are no tags.
STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "was", "were", "are", "its", "not", "but", "our", "has", "have", "which", "than", "into", "per", "only", "was"]


def tfidf(documents: DataFrame, k: int = 8, max_share: float = 0.8) -> DataFrame:
    """doc_id, tag, score: the k best terms of each text, by (0.5 + 0.5 tf / max tf) ln(n / (1 + df)); ties by the term.

    Terms in more than ``max_share`` of the texts are left out. Texts without a term give no row.
    """
    docs = documents.filter("text IS NOT NULL")
    n = docs.count()
    terms = docs.select("doc_id", F.explode(words(F.col("text"))).alias("tag")).filter(~F.col("tag").isin(STOP_WORDS))
    tf = terms.groupBy("doc_id", "tag").agg(F.count("*").alias("tf"))
    most = tf.groupBy("doc_id").agg(F.max("tf").alias("most"))
    df = tf.groupBy("tag").agg(F.count("*").alias("df")).filter(F.col("df") <= max_share * n)
    score = F.round((0.5 + 0.5 * F.col("tf") / F.col("most")) * F.log(n / (1 + F.col("df"))), 6)
    scored = salted_join(tf, df, ["tag"], ["doc_id"]).join(most, "doc_id").select("doc_id", "tag", score.alias("score"))
    return top(scored, "doc_id", [F.desc("score"), "tag"], k).select("doc_id", "tag", "score")


#: Sets of more tags are compared pair by pair, behind a prefix filter; smaller ones are counted by their subsets.
MOST_TAGS = 10


def _needed(n: Column, least: float) -> Column:
    """Common tags that two sets of together ``n`` tags need for a Jaccard similarity of ``least``."""
    return F.ceil(n * F.lit(least / (1 + least)) - F.lit(1e-9)).cast("int")


def _counted(classes: DataFrame, least: float) -> DataFrame:
    """class_id, n: members of all classes that are as similar as ``least``, own members included, without making a pair.

    Each class is written once for every subset of its tags; W(S, b) is the number of members of sets with b tags that
    hold S. By inclusion and exclusion the sets of b tags with m common tags or more number
    the sum over all S of (-1)^(|S| - m) C(|S| - 1, m - 1) W(S, b).
    """
    subset = F.filter("s", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1)
    subsets = classes.withColumn("a", F.size("s")).withColumn("mask", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.col("a")) - 1))).select("class_id", "a", "size", subset.alias("sub"))
    weights = subsets.groupBy("sub", F.col("a").alias("b")).agg(F.sum("size").alias("w"))
    asked = subsets.select("class_id", "a", "sub").filter(F.size("sub") >= _needed(F.col("a") + 1, least))
    k, m = F.size("sub"), _needed(F.col("a") + F.col("b"), least)
    binomial = F.create_map(*(F.lit(x) for i in range(MOST_TAGS) for j in range(i + 1) for x in (i * 100 + j, comb(i, j))))
    sign = F.when((k - m) % 2 == 0, 1).otherwise(-1)
    terms = salted_join(asked, weights, ["sub"], ["class_id"]).filter(k >= m)
    return terms.groupBy("class_id").agg(F.sum(sign * binomial[(k - 1) * 100 + m - 1] * F.col("w")).alias("n"))


def _paired(large: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """class_id, n: for pairs with a large set, what either side brings to the other. Similar sets share one of the rarest tags of each."""
    counts = classes.select(F.explode("s").alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        tags = df.select("class_id", F.explode("s").alias("tag")).join(counts, "tag").groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tag"))), lambda x: x.tag).alias("r"))
        n = F.size("r")  # a class has as many rows here as it has tags
        return tags.select(F.col("class_id").alias(name), F.explode(F.slice("r", 1, n - F.ceil(n * F.lit(least)).cast("int") + 1)).alias("tag"))

    side = lambda df, x: df.select(F.col("class_id").alias(x), F.col("s").alias(f"s_{x}"), F.col("size").alias(f"n_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    pairs = prefix(large, "a").join(prefix(classes, "b"), "tag").select("a", "b").distinct()
    near = pairs.join(side(large, "a"), "a").join(side(classes, "b"), "b").filter(both / (F.size("s_a") + F.size("s_b") - both) >= least)
    back = near.filter(F.size("s_b") <= MOST_TAGS).select(F.col("b").alias("class_id"), F.col("n_a").alias("n"))
    return near.select(F.col("a").alias("class_id"), F.col("n_b").alias("n")).unionByName(back)


def tag_links(entries: DataFrame, least: float = 0.5) -> DataFrame:
    """id, class_id, n_links: for each entry its class (equal tag sets, topic included) and the number of other entries with a Jaccard similarity of ``least`` or more.

    Entries without tags and topic have no links.
    """
    topic = F.when(F.coalesce("topic", F.lit("")) != "", F.array("topic")).otherwise(F.array().cast("array<string>"))
    sets = entries.select("id", F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), topic))).alias("s"))
    classes = staged(sets.groupBy("s").agg(F.min("id").alias("class_id"), F.count("*").alias("size")).filter(F.size("s") > 0), "classes")
    small, large = classes.filter(F.size("s") <= MOST_TAGS), classes.filter(F.size("s") > MOST_TAGS)
    links = _counted(small, least).unionByName(_paired(large, classes, least)).groupBy("class_id").agg((F.sum("n") - 1).alias("n_links"))
    found = classes.join(links, "class_id").select("s", "class_id", "n_links")
    return salted_join(sets, found, ["s"], ["id"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
