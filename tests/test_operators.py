"""Operators on small fixtures: nulls, empty tables, ties, repeated rows, clashing columns; sources and sinks."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusql.functions import text, urls
from corpusql.operators import audit, catalog, extraction, graph, ingest, orphans, reports, search, sharing, tagging
from corpusql.sources import catalogue, markdown, works


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "bare"),
    [
        ("https://resolver.example/10.99105/WM-3. ", "10.99105/wm-3"), ("doi:10.1/(2003)2.x", "10.1/(2003)2.x"), (" 10.1/a\t", "10.1/a"), ("10.1/a);", "10.1/a"),
        ("", None), (" ", None), (None, None), ("none", None),
    ],
)
def test_bare_doi(spark, raw, bare):
    assert one(spark, text.bare_doi, raw) == bare


@pytest.mark.parametrize(("raw", "day"), [("2022-04-07", 19089), ("2022/4/7", 19089), ("7 Apr 2022", 19089), ("2022-04-07T23:30:00-02:00", 19090), ("soon", None), ("", None), (None, None)])
def test_day(spark, raw, day):
    got = one(spark, text.day_micros, raw)
    assert (got if got is None else got // text.DAY_US) == day


def test_title_words(spark):
    assert one(spark, text.title_words, "<i>Été</i>&#45;long wa­ter—Straße 2") == ["ete", "long", "water", "straße", "2"]
    assert one(spark, text.title_words, "") == []


REFS = "src string, row_key long, kind string, key string, at long, period string"


def test_orphans_brute_force(spark):
    refs = [("t", i, "k", k, at, "p") for i, (k, at) in enumerate([("a", 5), ("b", 5), ("b", None), ("c", 1), ("d", 9), (None, 1), ("a", 5), ("gone", 0)])]
    refs += refs[:2]  # delivered twice
    parents = [("k", "a", None), ("k", "b", 6), ("k", "d", 7), ("k", "d", 3), ("other", "c", None)]
    df = spark.createDataFrame([(*r, "x") for r in refs], REFS + ", status string")  # a clashing column
    got = orphans.find_orphans(df, spark.createDataFrame(parents, "kind string, key string, since long"), spark.createDataFrame([("k", "gone")], "kind string, key string"))
    assert rows(got, "row_key", "identifier", "status") == [(1, "b", "late"), (3, "c", "missing"), (7, "gone", "deleted")]


def test_orphans_empty(spark):
    none = spark.createDataFrame([], REFS)
    parents, gone = spark.createDataFrame([], "kind string, key string, since long"), spark.createDataFrame([], "kind string, key string")
    assert rows(orphans.find_orphans(none, parents, gone)) == []
    some = spark.createDataFrame([("t", 1, "k", "a", 1, "")], REFS)
    assert rows(orphans.find_orphans(some, parents, gone), "status") == [("missing",)]


def test_orphans_hot_key(spark):
    hot = spark.range(3000).select(F.lit("t").alias("src"), F.col("id").alias("row_key"), F.lit("k").alias("kind"), F.lit("x").alias("key"), F.col("id").alias("at"), F.lit("").alias("period"))
    parents = spark.createDataFrame([("k", "x", 1000)], "kind string, key string, since long")
    got = orphans.find_orphans(hot, parents, spark.createDataFrame([], "kind string, key string"))
    assert got.filter("status = 'late'").count() == got.count() == 1000


def test_kb_refs_of_all_tables(spark):
    at = datetime(2024, 1, 2)
    kb = spark.createDataFrame([(1, " Paper-A. ", "paper_id", at), (2, "10.1/x", None, None), (3, "", "doi", at)], "ref_id long, identifier string, identifier_type string, noted_at timestamp_ntz")
    code = spark.createDataFrame([], "ref_id long, identifier string, identifier_type string, scanned_at timestamp_ntz")
    disc = spark.createDataFrame([(1, at, ["doi:10.1/Y", None], "10.1/z")], "arrival long, found_at timestamp_ntz, cites array<string>, doi string")
    log = spark.createDataFrame([(1, " s ", at), (2, None, at)], "rowid long, session_id string, logged_at timestamp_ntz")
    got = orphans.knowledge_base_refs(kb, code, disc, log).filter("key IS NOT NULL")
    assert rows(got, "src", "row_key", "kind", "key", "period") == [
        ("discovery_results", 1, "cite", "10.1/y", "2024-01"), ("kb_refs", 1, "paper", "paper-a", "2024-01"), ("kb_refs", 2, "doi", "10.1/x", ""), ("session_entries", 1, "session", "s", "2024-01"),
    ]


ENTRY = "id string, type string, path string, title string, topic string, tags array<string>, added string, updated string, source_url string, doi string, files array<string>"


def entries(spark):
    return spark.createDataFrame(
        [
            ("p1", "paper", "papers/h/p1", "Low {flow}", "h", ["a", "b"], "2024-01-01", "", None, "10.1234/x", ["f"]),
            ("p2", "paper", "papers/h/p2", None, "", None, "bad", None, None, " 10.1234/X ", None),
            ("k1", "package", "packages/k", "Kit", None, [], "", None, None, None, ["f"]),
        ],
        ENTRY,
    )


def test_catalogue(spark):
    e = entries(spark)
    assert ("topic", "h", 1) in rows(catalog.stats(e)) and ("paper_topic", "", 1) in rows(catalog.stats(e))
    assert rows(catalog.bibtex(e))[0] == ("p1", "@article{p1, title = {Low \\{flow\\}}, year = {2024}, doi = {10.1234/x}}")
    new = spark.createDataFrame([("p1", "T"), ("p9", "N")], "id string, title string")
    assert rows(catalog.upsert(e.select("id", "title"), new)) == [("k1", "Kit"), ("p1", "T"), ("p2", None), ("p9", "N")]
    assert catalog.without(e, new.select("id")).count() == 2
    assert rows(catalog.stats(e.limit(0))) == []


def test_audit(spark):
    found = {(r.id, r.code) for r in audit.metadata_findings(entries(spark)).collect()}
    assert {("p2", "missing_title"), ("p2", "missing_topic"), ("p2", "invalid_added"), ("p2", "no_files"), ("k1", "missing_added")} <= found
    assert ("p1", "invalid_doi") not in found
    dup = audit.duplicates(entries(spark), "doi", "duplicate_doi").collect()
    assert [(r.id, r.detail) for r in dup] == [("p1", "10.1234/x x 2")]
    states = dict(rows(audit.freshness(entries(spark), "2024-06-01", 90), "id", "state"))
    assert states == {"p1": "stale", "p2": "bad_date", "k1": "never"}


def test_search_budget_and_expand(spark):
    assert search.expand("et", {"et": ["root uptake"]}) == ["root uptake", "et"]
    docs = spark.createDataFrame([(1, "snow melt " * 3, "note"), (2, None, "note"), (3, "", "note"), (4, "---\nyear: 1990\n---\nsnow melt", "note")], "doc_id long, text string, doc_kind string")
    assert [r.doc_id for r in search.keyword(docs, ["snow melt"]).collect()] == [1, 4]
    assert [r.doc_id for r in search.keyword(docs, ["snow melt"], year_from=2000).collect()] == [1]
    results = spark.createDataFrame([(i, "q", float(9 - i), "x" * 100) for i in range(6)], "result_id long, query_text string, score double, snippet string")
    assert [r.result_id for r in search.within_budget(results, 75).orderBy("rank").collect()] == [0, 1, 2]


def test_tag_links_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    data = [(f"e{i}", rng.sample("abcdef", rng.randint(0, 4)), rng.choice(["t", "u", ""])) for i in range(60)]
    data += [(f"l{i}", rng.sample("abcdefghijklmnopq", rng.randint(8, 14)), "t") for i in range(20)]  # small and large sets
    df = spark.createDataFrame(data, "id string, tags array<string>, topic string")
    sets = {i: set(t) | ({p} if p else set()) for i, t, p in data}
    n = dict.fromkeys(sets, 0)
    for a, b in itertools.permutations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5:
            n[a] += 1
    assert dict(rows(tagging.tag_links(df), "id", "n_links")) == n


def test_crawl_levels(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a2"), ("b", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "doi string")
    assert rows(graph.crawl(links, seeds, 2)) == [("a", 0), ("a2", 1), ("b", 1), ("c", 2)]


def test_extraction(spark):
    md = "## One\n\n$$x = y$$\n\n(1)\n\ntext $5\n\n## Two\n\n$$a\n= b$$\n\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    docs = spark.createDataFrame([(1, md, "section", "e"), (2, None, "section", None), (3, "", "note", "e"), (4, "$$ open", "note", "e")], "doc_id long, text string, doc_kind string, entry_id string")
    assert rows(extraction.equations(docs)) == [(1, 0, "x = y", "1", "One"), (1, 1, "a = b", "", "Two")]
    assert rows(extraction.markdown_tables(docs), "header", "n_rows") == [("| A | B |", 2)]
    src = spark.createDataFrame([(1, "# REF: doi:10.1016/j.x.001 eq.4\nx = f(p)  # REF: paper-a §methods\r\n", "source_file", "c")], "doc_id long, text string, doc_kind string, entry_id string")
    assert rows(extraction.annotations(src), "n", "identifier", "kind", "location") == [(0, "10.1016/j.x.001", "doi", "eq.4"), (1, "paper-a", "paper_id", "§methods")]


def test_claims(spark):
    t = "This suggests that baseflow matters. Earlier work (Doe et al., 1999) reported that it does. It is cold. We attribute it to wind! Short."
    docs = spark.createDataFrame([(1, t, "note"), (2, None, "note")], "doc_id long, text string, doc_kind string")
    assert [r.claim for r in extraction.claims(docs).orderBy("claim").collect()] == ["This suggests that baseflow matters.", "We attribute it to wind!"]


def test_import_first_wins(spark):
    archive = spark.createDataFrame([(1, "10.1/a", "T"), (2, "10.1/A.", "U"), (3, None, "V"), (4, None, " v "), (5, "10.1/have", "W"), (6, None, None)], "arrival long, doi string, title string")
    have = spark.createDataFrame([("10.1/have", "x")], "doi string, title string")
    assert rows(sharing.imported(archive, have), "arrival") == [(1,), (3,)]


def test_context_pack_stops_at_overflow(spark):
    e = spark.createDataFrame([(f"p{i}", "paper", "t", "x" * n, f"2024-01-0{9 - i}") for i, n in enumerate([10, 50, 3])], "id string, type string, topic string, title string, added string")
    assert rows(reports.context_pack(e, 30), "id", "used") == [("p0", 11)]


def test_markdown_source(spark, tmp_path):
    folder = tmp_path / "papers" / "h" / "snow melt"
    folder.mkdir(parents=True)
    (folder / "paper.md").write_text('---\ntype: paper\ntitle: "Snow"\ntopic: h\n---\nbody\n')
    (folder / "notes.md").write_text("no front matter")
    (tmp_path / "catalog.md").write_text("---\ntype: paper\n---\n")
    got = markdown.rebuild_catalogue(markdown.read_markdown(spark, str(tmp_path))).collect()
    assert [(r.id, r.title, r.path, len(r.files)) for r in got] == [("paper-snow melt", "Snow", "papers/h/snow melt/paper.md", 2)]
    (tmp_path / "build").mkdir()
    for name in ("a.py", "build/b.py", "c.pyc", "d.f90"):
        (tmp_path / name).write_text("x")
    assert rows(markdown.read_code(spark, str(tmp_path), ["build/", "*.pyc"]), "path", "language") == [("a.py", "python"), ("d.f90", "fortran")]


def test_catalogue_files(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps([{"id": "a", "type": "paper", "extra": 1, "tags": ["t"]}, {"id": "b", "type": "package", "title": ""}]))
    e = catalogue.read_catalogue(spark, str(path))
    assert rows(e, "id", "title") == [("a", None), ("b", "")]
    catalogue.write_catalogue(e, str(tmp_path / "out"))
    new = catalogue.merge_catalogue(spark, str(tmp_path / "out"), e.filter("id = 'a'").withColumn("title", F.lit("New")), str(tmp_path / "next"))
    assert rows(catalogue.changed(e, new, ["title"])) == [("a", "changed")]
    catalogue.write_json(e, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    for text_ in ('[{"title": "x", "is_open_access": true}, {"title": "y"}]', '{"results": [{"title": "x", "is_open_access": true}, {"title": "y"}]}'):
        cache = tmp_path / f"cache{len(text_)}.json"
        cache.write_text(text_)
        found = catalogue.read_search_cache(spark, str(cache))
        assert rows(catalogue.picked(found, [1, 2, 7], open_only=True), "pos", "title") == [(1, "x")]
    queue = tmp_path / "recovery.json"
    queue.write_text('{"pending": [{"title": "t", "path": "papers/h/p.md"}, {"title": "u", "path": ""}]}')
    assert rows(catalogue.read_recovery(spark, str(queue)), "queue_pos", "topic") == [(0, "h"), (1, "uncategorized")]


def test_works_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"doi": "10.1/a", "abstract_index": {"snow": [1], "deep": [0, 2]}}) + "\n")
    assert works.read_works(spark, str(tmp_path)).first().abstract == "deep snow deep"


def test_urls(spark):
    assert one(spark, urls.preprint_pdf, "https://preprints.example/abs/1.2") == "https://preprints.example/pdf/1.2.pdf"
    assert one(spark, urls.preprint_pdf, "https://x.example/a.pdf") == "https://x.example/a.pdf"
    assert one(spark, urls.result_path, "kb://main/papers/a.md:12") == "papers/a.md"
    assert one(spark, urls.safe_path, "a/../../b") is None and one(spark, urls.safe_path, "a/b") == "a/b"
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-old\n+new = 1\n+\n+++ b/y.py\n+z\n"
    got = rows(urls.diff_lines(spark.createDataFrame([(diff,), (None,)], "diff string")))
    assert got == [("x.py", ""), ("x.py", "new = 1"), ("y.py", "z")]


def test_new_ids(spark):
    m = spark.createDataFrame([("10.1/b", "Été in the river bed", 2001), ("10.1/a", "Ete in the sea", 2001), ("10.1/c", None, 2000), ("10.1/d", "X", 9999)], "doi string, title string, year int")
    assert rows(ingest.new_ids(m)) == [("10.1/a", "paper-ete-in-the-2001"), ("10.1/b", "paper-ete-in-the-2001-2"), ("10.1/d", "paper-x-nd")]


def test_evidence(spark):
    claims = spark.createDataFrame([(100, "This suggests that baseflow matters."), (101, "This suggests that baseflow matters.")], "doc_id long, claim string")
    e = spark.createDataFrame([("a", "Baseflow of rivers"), ("b", "Snow"), ("c", None)], "id string, title string")
    assert rows(ingest.evidence(claims, e), "doc_id", "id", "rank") == [(100, "a", 1)]
