"""The pN_ queries of the llm problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm import encode, formats, history, matching, mixture, personal, scans, survivors
from corpusql.session import staged, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """keep_id, copy_id of entries that differ from the kept one only in look."""
    return formats.format_copies(table(spark, d, "entries"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One record a paper with its number of copies."""
    classes = formats.format_classes(table(spark, d, "entries"))
    return classes.groupBy(F.col("keep_id").alias("id")).agg(F.max("n_copies").alias("n_copies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """src, grp, field, pick: the row whose value survives."""
    rows = survivors.discovery_values(table(spark, d, "discovery_results"), table(spark, d, "source_trust")).unionByName(
        survivors.repair_values(table(spark, d, "repair_actions"))
    )
    return survivors.survivors(rows, with_value=False).select("src", "grp", "field", "pick").distinct()


def _p4_rows(spark: SparkSession, d: str) -> DataFrame:
    found = survivors.discovery_values(table(spark, d, "discovery_results"), table(spark, d, "source_trust"))
    return found.unionByName(survivors.repair_values(table(spark, d, "repair_actions")))


def p4_latest(spark: SparkSession, d: str) -> DataFrame:
    """src, grp, field, pick: the row whose value survives if all times and ranks are missing, by the learned precedences."""
    return survivors.undated_survivors(_p4_rows(spark, d)).select("src", "grp", "field", "pick")


def p4_currency(spark: SparkSession, d: str) -> DataFrame:
    """Learned order of values: field, before, after and how often the one follows the other in a group."""
    rows = survivors.discovery_values(table(spark, d, "discovery_results"), table(spark, d, "source_trust")).unionByName(
        survivors.repair_values(table(spark, d, "repair_actions"))
    )
    valued = rows.filter("value IS NOT NULL").withColumn("cls", survivors.value_class(F.col("field"), F.col("value")))
    return survivors.transitions(valued.filter("grp IS NOT NULL"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One built record a DOI."""
    return survivors.merged_records(table(spark, d, "discovery_results"), table(spark, d, "source_trust"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the ids of byte_bpe_50k."""
    return encode.encode_corpus(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return staged(mixture.sized_texts(table(spark, d, "documents")), "sized")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture in its order: every use of a document."""
    return mixture.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares by source."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixture.mixture_shares(sized, targets, staged(mixture.mix(sized, targets), "mixture"))




def _p5_rows(spark: SparkSession, d: str) -> DataFrame:
    entries, found = table(spark, d, "entries"), table(spark, d, "discovery_results")
    return history.title_rows(entries, F.lit(None).cast("long"), F.lit(0)).unionByName(
        history.title_rows(found, F.col("arrival").cast("long"), F.col("batch_no"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """arrival, seen_in of discovery rows that bring nothing new."""
    return history.seen_before(_p5_rows(spark, d)).select(F.col("rid").alias("arrival"), "seen_in").distinct()


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, arrival, confidence, assigned (one-to-one, else a further row of the work) of library records and discovery rows that describe the same paper."""
    left, right = matching.library_rows(table(spark, d, "library_records")), matching.discovery_rows(table(spark, d, "discovery_results"))
    return matching.match_records(left, right).select(F.col("a").alias("rec_id"), F.col("b").alias("arrival"), "confidence", "assigned")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """rec_id, arrival of a library record and a discovery row that describe the same paper."""
    return p2_matches(spark, d).select("rec_id", "arrival").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, kind, value of personal information in the documents."""
    given, family = personal.learned_names(table(spark, d, "discovery_results"))
    found = table(spark, d, "documents").select("doc_id", F.inline(personal.found_in(F.col("text"), given, family)))
    return found.distinct()


def p9_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with typed placeholders. The key is the session's ``corpusql.pseudonym.key``; without one, a public one for tests."""
    given, family = personal.learned_names(table(spark, d, "discovery_results"))
    key = spark.conf.get("corpusql.pseudonym.key", "public key for tests").encode()
    return table(spark, d, "documents").select("doc_id", personal.redacted(F.col("text"), given, family, key).alias("text"))


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocabulary = scans.learn_vocabulary(table(spark, d, "documents"), table(spark, d, "discovery_results"))
    return scans.clean_scans(table(spark, d, "scanned_papers"), table(spark, d, "search_results"), scans.Cleaner(vocabulary))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """src, row_key, item, noise: a row for each kind of noise in an item."""
    parts = [x.select("src", "row_key", "item", F.explode("noise").alias("noise")) for x in _p1(spark, d)]
    return parts[0].unionByName(parts[1]).distinct()


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text item, repaired."""
    return _p1(spark, d)[0].drop("noise")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table's rows, repaired."""
    return _p1(spark, d)[1].drop("noise")


# --- SQL ------------------------------------------------------------------------------------------------------------

_CL = r"[\s\p{Z}\x{200b}\x{feff}.,;:!?)\]}>''\"’”]"
_DOI = rf"nullif(regexp_replace(regexp_extract(lower(doi), '(?s)10\.[0-9].*', 0), '{_CL}+$', ''), '')"
_COPIES = rf"""c AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM (SELECT id, type, coalesce({_DOI}, '') AS d,
    regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM entries) WINDOW w AS (PARTITION BY type, t, d))"""
_NONE = ", ".join(f"'{x}'" for x in survivors.NO_VALUE)
_USABLE = lambda c: rf"CASE WHEN regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g') NOT IN ({_NONE}) THEN {c} END"
_YEAR = lambda c: rf"(SELECT CASE WHEN y BETWEEN 1800 AND 2030 THEN y::VARCHAR END FROM (SELECT try_cast(regexp_extract({c}::VARCHAR, '^[^\p{{L}}\p{{N}}-]*(\d{{4}})(?:\.0+)?[^\p{{L}}\p{{N}}]*$', 1) AS INT) AS y))"
_VALUES = f"""d AS (SELECT arrival, {_DOI} AS grp, -trust AS t, {_YEAR("year")} AS y, {_USABLE("venue")} AS v, {_USABLE("abstract")} AS a FROM discovery_results r LEFT JOIN source_trust s ON lower(trim(s.source, ' ')) = lower(trim(r.source, ' '))),
    r AS (SELECT 'discovery_results' AS src, grp, 'year' AS field, y AS value, t::BIGINT AS trust, arrival AS ts, arrival AS id FROM d UNION ALL SELECT 'discovery_results', grp, 'venue', v, t, arrival, arrival FROM d
      UNION ALL SELECT 'discovery_results', grp, 'abstract', a, length(a), arrival, arrival FROM d
      UNION ALL SELECT 'repair_actions', paper_id, field, CASE WHEN field = 'year' THEN {_YEAR("proposed_value")} ELSE {_USABLE("proposed_value")} END,
        CASE lower(trim(confidence, ' ')) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, epoch_us(proposed_at), action_id FROM repair_actions)"""

_CLASSES = r"""c AS (SELECT src, grp, field, ts, id, CASE field WHEN 'year' THEN value WHEN 'venue' THEN regexp_replace(lower(value), '[^\p{L}\p{N}]+', '', 'g')
        ELSE CASE WHEN regexp_matches(value, '(\.\.\.|…)\s*$') THEN 'cut ' ELSE '' END || 'size ' || floor(log2(length(value) + 1))::INT END AS cls FROM r WHERE grp IS NOT NULL AND value IS NOT NULL),
      l AS (SELECT field, lag(cls) OVER (PARTITION BY src, grp, field ORDER BY ts, id) AS before, cls AS after FROM c)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_COPIES} SELECT keep_id, id AS copy_id FROM c WHERE id <> keep_id",
    "p3_records": f"WITH {_COPIES} SELECT keep_id AS id, max(n) AS n_copies FROM c GROUP BY keep_id",
    "p4_found": f"""WITH {_VALUES} SELECT src, grp, field, arg_max(id, struct_pack(a := coalesce(trust, -1073741824), b := ts, c := id)) FILTER (value IS NOT NULL) AS pick
      FROM r WHERE grp IS NOT NULL GROUP BY src, grp, field HAVING count(*) >= 2 AND count(value) > 0""",
    "p4_records": f"""WITH {_VALUES}, p AS (SELECT grp, field, arg_max(value, struct_pack(a := coalesce(trust, -1073741824), b := ts)) AS value, count(*) AS n FROM r
      WHERE src = 'discovery_results' AND grp IS NOT NULL GROUP BY grp, field)
      SELECT grp AS doi, max(value) FILTER (field = 'year') AS year, max(value) FILTER (field = 'venue') AS venue, max(value) FILTER (field = 'abstract') AS abstract, max(n) AS n_rows FROM p GROUP BY grp""",
    "p4_latest": rf"""WITH {_VALUES}, {_CLASSES}, m AS (SELECT field, before, after, count(*) AS n FROM l WHERE before IS NOT NULL AND before <> after GROUP BY ALL),
      o AS (SELECT m.field, m.before, m.after, m.n - coalesce(b.n, 0) AS weight FROM m LEFT JOIN m b ON b.field = m.field AND b.before = m.after AND b.after = m.before WHERE m.n > coalesce(b.n, 0)),
      g AS (SELECT DISTINCT src, grp, field, cls FROM c),
      e AS (SELECT g.src, g.grp, g.field, o.before, o.after, o.weight FROM g JOIN o ON o.field = g.field AND o.before = g.cls JOIN g h ON h.src = g.src AND h.grp = g.grp AND h.field = g.field AND h.cls = o.after),
      s AS (SELECT src, grp, field, cls, max(b) AS by_, max(a) AS above FROM (SELECT src, grp, field, before AS cls, weight AS b, NULL AS a FROM e UNION ALL SELECT src, grp, field, after, NULL, weight FROM e) GROUP BY ALL),
      k AS (SELECT src, grp, field FROM r WHERE grp IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
      SELECT src, grp, field, arg_max(id, struct_pack(a := -coalesce(by_, 0), aa := coalesce(above, 0), b := id)) AS pick FROM c JOIN k USING (src, grp, field) LEFT JOIN s USING (src, grp, field, cls) GROUP BY src, grp, field""",
    "p4_currency": rf"""WITH {_VALUES}, {_CLASSES} SELECT field, before, after, count(*) AS n FROM l WHERE before IS NOT NULL AND before <> after GROUP BY ALL""",
}
