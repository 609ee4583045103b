"""The dealt operators on small fixtures: brute force, exact round trips, nulls, empty and long texts, ties, repeats, clashing columns."""

import itertools
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusql.llm import encode, formats, history, matching, mixture, personal, scans, survivors, titles
from corpusql.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, keep_id string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- p1 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cleaner(spark):
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return scans.Cleaner(scans.learn_vocabulary(t("documents"), t("discovery_results")))


@pytest.mark.parametrize(
    ("raw", "clean", "kinds"),
    [
        ("Observed storage lagged pre-\ncipitation by 3 hours.", "Observed storage lagged precipitation by 3 hours.", ["hyphenation"]),
        ("The spatially-\nexplicit prior.", "The spatially-explicit prior.", ["hyphenation"]),
        ("Short- and long-term values.", "Short- and long-term values.", []),
        ("The stati0ns passed quality contro1.", "The stations passed quality control.", ["misread"]),
        ("Tables list the gauge\n\n– 12 –\n\nstations that passed.", "Tables list the gauge stations that passed.", ["page_number"]),
        ("Tables list the gauge\nJ. Lowland Hydrol. 4 (2021) 66–68    12\nstations that passed.", "Tables list the gauge stations that passed.", ["page_number", "running_header"]),
        ("Annual totals agree with Page 3 of 9 daily values.", "Annual totals agree with daily values.", ["page_number"]),
        ("Earlier work (Doe et al., 1994) reported that (4.2) holds. Table 4", "Earlier work (Doe et al., 1994) reported that (4.2) holds. Table 4", []),
        ("Tables list the gauge\n17    Kelstad: Robust change detection of soil moisture\nstations that passed.", "Tables list the gauge stations that passed.", ["page_number", "running_header"]),
        ("", "", []),
        (None, None, []),
    ],
)
def test_scanned_text(cleaner, raw, clean, kinds):
    assert cleaner.text(raw) == (clean, kinds)


def test_scanned_table(cleaner):
    head = ["Site", "mean", "max"]
    got, kinds = cleaner.table(head, [["lake stra-\ntification", "7I.71", "3"], ["Site", "mean", "max"], ["", "– 4 –", ""], ["Zugun", "", ""], ["flood"], None, ["x", None, "1e-5"]])
    assert got == [["lake stratification", "71.71", "3"], ["Zugun", "", ""], ["flood"], [], ["x", "", "1e-5"]]
    assert kinds == ["hyphenation", "misread", "page_number", "running_header"]
    assert cleaner.table(None, None) == ([], [])


def test_editor_held_out(cleaner):
    """Noise put into words that the editor was not trained on is repaired; clean words and unknown names stay."""
    rng, good, n = random.Random(99), 0, 0
    words = sorted(w for w in cleaner.vocabulary.words if len(w) >= 6 and w.isalpha() and w.islower())
    for w in rng.sample(words, 300):
        bad, own = rng.choice([("0", "o"), ("5", "s"), ("rn", "m"), ("cl", "d"), ("†", "t"), ("ii", "u")])
        if own in w:
            noisy = w.replace(own, bad, 1)
            n += 1
            good += cleaner.editor.edit(noisy) == w
    assert n > 50 and good / n > 0.95
    for name in ("Wuljur", "Krolfral", "Zanbel", "CO2", "k7", "m3", "2.3E4", "1e-5", "SWAT2012"):
        assert cleaner.editor.edit(name) == name


def test_long_scan(cleaner):
    text, kinds = cleaner.text("The gauge was visited twice a month. " * 3000)
    assert len(text) > 100_000 and kinds == []


def test_clean_scans_spark(spark, cleaner):
    scanned = spark.createDataFrame(
        [(1, [("x", "1", True, "s", "the sta-\ntion"), ("y", None, False, None, None)], [(["A", "B"], [["a", "b"]], None, None)]), (2, None, None), (3, [], [])],
        "scan_id long, equations array<struct<latex string, number string, display boolean, section string, context string>>, ext_tables array<struct<headers array<string>, rows array<array<string>>, section string, caption string>>",
    )
    results = spark.createDataFrame([(1, None), (2, "")], "result_id long, snippet string")
    texts, tables = scans.clean_scans(scanned, results, cleaner)
    assert rows(texts, "src", "row_key", "item", "text") == [("equation_context", 1, 0, "the station"), ("equation_context", 1, 1, None), ("search_snippet", 1, 0, None), ("search_snippet", 2, 0, "")]
    assert rows(tables, "row_key", "item") == [(1, 0)]
    texts, tables = scans.clean_scans(scanned.limit(0), results.limit(0), cleaner)
    assert texts.count() == tables.count() == 0


# --- p2 ----------------------------------------------------------------------------------------------------------------------

LIB = "rec_id long, heading string, creators string, issued string, note string, arrival long"
DISC = "arrival long, batch_no int, title string, authors array<string>, year int, doi string, rec_id long"
TITLE = "Robust change detection of shallow soil moisture in the Zulielvu estuary from rain collectors"


def matched(spark, lib, disc):
    left = matching.library_rows(spark.createDataFrame([(*x, 0) for x in lib], LIB))
    right = matching.discovery_rows(spark.createDataFrame([(*x, 0) for x in disc], DISC))
    return rows(matching.match_records(left, right), "a", "b")


def test_matching(spark):
    disc = [
        (1, 1, TITLE, ["C. Dorberg"], 2010, "10.1/a"), (2, 1, TITLE.upper(), None, 2011, None), (3, 2, TITLE + ": Part 2", ["C. Dorberg"], 2010, "10.1/b"),
        (4, 2, TITLE, ["C. Dorberg"], 2016, "10.1/c"), (5, 2, TITLE.replace("Zulielvu", "Brogulpri"), ["C. Dorberg"], 2010, "10.1/d"), (6, 3, None, None, None, None),
        (7, 3, "", [], None, ""), (8, 3, "Comment on " + TITLE, ["X"], 2010, "10.1/e"), (1, 1, TITLE, ["C. Dorberg"], 2010, "10.1/a"),
    ]
    lib = [
        (1, "Robust chnage detec. of shallow soil moistuoe in the Zulielvu estuary from rain collectors", "Dorberg, C.", "(2010)", None), (2, TITLE, "", "2016-02-01", ""), (3, "", None, None, None),
        (4, None, None, None, None), (5, "Zulielvu estuary from rain collectors, Robust change detection of shallow soil moisture in the", "Dorberg et al.", "c2010.", "doi 10.1/a"),
    ]
    assert matched(spark, lib, disc) == [(1, 1), (1, 2), (2, 4), (5, 1), (5, 2)]
    assert matched(spark, [], disc) == [] and matched(spark, lib, []) == []


def test_matching_many_copies_of_a_heading(spark):
    lib = [(i, TITLE, "Dorberg, C.", "2010", None) for i in range(60)]
    disc = [(1, 1, TITLE, ["C. Dorberg"], 2010, None), (2, 1, TITLE.replace("moisture", "moistrue"), ["C. Dorberg"], 2010, None)]
    assert matched(spark, lib, disc) == sorted(((i, j) for i in range(60) for j in (1, 2)), key=repr)


def test_matching_window_grows(spark):
    """A window of one place grows until all pairs of twelve slipped titles are found."""
    slips = [TITLE[:i] + TITLE[i + 1] + TITLE[i] + TITLE[i + 2 :] for i in (m.start() + 1 for m in re.finditer(r"[A-Za-z]{6,}", TITLE))][:6]
    left = matching.library_rows(spark.createDataFrame([(i, t, "Dorberg, C.", "2010", None, 0) for i, t in enumerate(slips)], LIB))
    right = matching.discovery_rows(spark.createDataFrame([(i, 1, t, ["C. Dorberg"], 2010, None, 0) for i, t in enumerate(slips)], DISC))
    got = rows(matching.match_records(left, right, window=1), "a", "b")
    assert got == sorted(((i, j) for i in range(len(slips)) for j in range(len(slips))), key=repr)


def test_assignment_is_best(spark):
    """Against all one-to-one assignments, on random rival edges."""
    import itertools

    rng = random.Random(5)
    for _ in range(3):
        value = {(f"l{i}", f"r{j}"): round(rng.random(), 3) + 0.01 for i in range(4) for j in range(4) if rng.random() < 0.7}
        best = max(sum(value[x] for x in pairs) for n in range(5) for pairs in itertools.combinations(value, n) if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == n)
        got = rows(matching.assign(spark.createDataFrame([(*k, v) for k, v in value.items()], "left string, right string, value double")))
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        assert sum(value[x] for x in got) == pytest.approx(best, abs=0.02)


# --- p3 -------------------------------------------------------------------------------------------------------------------------

ENT = "id string, type string, title string, doi string, keep_id string, text string, h long"


def copies(spark, data):
    return rows(formats.format_copies(spark.createDataFrame([(*x, "x", "y", 1) for x in data], ENT)))


def test_format_copies(spark):
    data = [
        ("b", "paper", "Low-flow  of É", "10.1/A."), ("a", "paper", "LOW FLOW OF É", "doi:10.1/a"), ("c", "paper", "low flow of E", "10.1/a"), ("d", "paper", "Low flow of é", None),
        ("e", "package", "Low flow of É", "10.1/a"), ("f", None, None, None), ("g", None, "", ""), ("h", "paper", "x" * 200_000, None), ("i", "paper", ("x" * 200_000).upper(), " "),
    ]
    assert copies(spark, data) == [("a", "b"), ("f", "g"), ("h", "i")]
    assert copies(spark, []) == []


def test_formats_beyond_the_letters(spark):
    """Variation selectors are skipped; letters of the supplementary planes are kept."""
    assert copies(spark, [("a", "p", "Low flow\U000e0100 X", None), ("b", "p", "low flow x", None), ("c", "p", "low flow \U00020000x", None)]) == [("a", "b")]


def test_learned_names_of_many_authors(spark):
    """However many names there are, each is learned."""
    df = spark.range(20_000).selectExpr("array(concat('Fam', translate(cast(id AS STRING), '0123456789', 'abcdefghij'), ', Giv', translate(cast(id AS STRING), '0123456789', 'klmnopqrst'))) AS authors")
    assert [len(x) for x in personal.learned_names(df)] == [20_000, 20_000]


def test_format_classes_against_brute_force(spark):
    import unicodedata

    rng = random.Random(1)
    base = ["Snow melt in Ñu", "Snow, melt in Ñu!", "SNOW MELT IN ÑU", "snow melt in nu", "日本 a", "日本-A", "²x", "x"]
    data = [(f"{i:03}", rng.choice(["p", "q"]), rng.choice(base), rng.choice(["10.1/a", "10.1/A ", None, "10.1/b"])) for i in range(200)]
    groups = defaultdict(list)
    for i, t, title, doi in data:
        key = "".join(c for c in unicodedata.normalize("NFC", title).lower() if c.isalnum())
        groups[t, key, (doi or "").strip().lower()].append(i)
    df = spark.createDataFrame([(*x, "", "", 0) for x in data], ENT)
    assert rows(formats.format_classes(df)) == sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def test_collision_is_verified(spark, monkeypatch):
    """Rows whose hashes collide are told apart by the comparison."""
    monkeypatch.setattr(formats, "title_hash", lambda c: F.lit(1).cast("long"))
    assert copies(spark, [("a", "p", "one", None), ("b", "p", "two", None), ("c", "p", "T-w-o", None), ("d", "p", "One.", None)]) == [("a", "d"), ("b", "c")]


# --- p4 ---------------------------------------------------------------------------------------------------------------------------

VAL = "src string, grp string, field string, row_id long, value string, trust long, ts long, pick string"


def test_survivors(spark):
    data = [
        ("s", "g", "year", 1, "2001", 1, 5), ("s", "g", "year", 2, "2002", 2, 1), ("s", "g", "year", 3, None, 9, 9), ("s", "g", "venue", 4, None, 1, 1), ("s", "g", "venue", 5, None, 1, 1),
        ("s", "h", "year", 6, "1999", 1, 1), ("s", "i", "year", 7, "1999", 1, 1), ("s", "i", "year", 8, "2000", 1, 1), (None, None, "year", 9, "2000", 1, 1),
    ]
    df = spark.createDataFrame([(*x, "") for x in data], VAL)
    assert rows(survivors.survivors(df), "grp", "field", "pick") == [("g", "year", 2), ("i", "year", 8)]
    assert rows(survivors.survivors(df.limit(0))) == []


def test_currency_decides_without_times(spark):
    """Dated groups show that 2001 is followed by 2003; undated rows of another group follow that, whatever their ids."""
    dated = [("s", f"g{i}", "year", 10 * i + k, v, 1, 100 * i + k) for i in range(5) for k, v in enumerate(("2001", "2003"))]
    undated = [("s", "u", "year", 900, "2003", 1, None), ("s", "u", "year", 901, "2001", 1, None), ("s", "u", "year", 902, "1950", 1, None)]
    df = spark.createDataFrame([(*x, "") for x in dated + undated], VAL)
    assert [r.value for r in survivors.survivors(df).filter("grp = 'u'").collect()] == ["2003"]


def test_partial_order_decides(spark):
    """z is followed by a, and b by c, often, a by b once: between a and b only the last counts. A circle gives way at its weakest."""
    seen = [("z", "a", 10), ("a", "b", 1), ("b", "c", 10), ("p", "q", 5), ("q", "r", 4), ("r", "p", 1)]
    pairs = [(x, y) for x, y, n in seen for _ in range(n)]
    dated = [("s", f"g{i}", "venue", 10 * i + k, v, 1, 100 * i + k) for i, pair in enumerate(pairs) for k, v in enumerate(pair)]
    undated = [("s", g, "venue", 9000 + i, v, 1, None) for i, (g, v) in enumerate([("u", "b"), ("u", "a"), ("w", "r"), ("w", "q"), ("w", "p"), ("x", "new"), ("x", "other")])]
    df = spark.createDataFrame([(*x, "") for x in dated + undated], VAL)
    got = {r.grp: r.value for r in survivors.survivors(df).collect()}
    assert (got["u"], got["w"], got["x"]) == ("b", "r", "other")


def test_transitions_in_pieces(spark):
    rng = random.Random(2)
    data = [("s", rng.choice("ab"), "year", i, str(rng.randint(2000, 2003)), 1, rng.randint(0, 6) * survivors.DAY_US // 2) for i in range(300)]
    want = Counter()
    for g in "ab":
        seq = [v for _, _, v in sorted((x[6], x[3], x[4]) for x in data if x[1] == g)]
        want.update((a, b) for a, b in zip(seq, seq[1:]) if a != b)
    df = spark.createDataFrame([(*x, "") for x in data], VAL).withColumn("cls", F.col("value"))
    assert {(r.before, r.after): r.n for r in survivors.transitions(df).collect()} == dict(want)


@pytest.mark.parametrize(("raw", "ok"), [("", False), (" - ", False), ("N/A", False), ("(no venue)", False), (None, False), ("Unknown", False), ("[abstract missing]", False), ("J. Snow", True), ("0", True)])
def test_usable(spark, raw, ok):
    assert spark.createDataFrame([(raw,)], "v string").select(survivors.usable(F.col("v")).alias("x")).first().x is ok


# --- p5 --------------------------------------------------------------------------------------------------------------------------------


def seen(spark, catalogue, found):
    schema = "rid long, batch int, title string, doi string, seen_in string"
    df = spark.createDataFrame([(None, 0, *x, "") for x in catalogue] + [(*x, "") for x in found], schema)
    return rows(history.seen_before(history.title_rows(df, F.col("rid"), F.col("batch"))))


def test_history(spark):
    other = TITLE.replace("Zulielvu", "Brogulpri")
    catalogue = [(TITLE, "10.1/a"), (other, None), ("Kit", None), (None, None)]
    found = [
        (1, 1, "whatever", "doi:10.1/A"), (2, 1, TITLE.replace("moisture", "moistrue"), None), (3, 1, TITLE, "10.1/z"), (4, 2, TITLE[:70] + "...", ""), (5, 2, other, "10.1/q"),
        (6, 2, TITLE + ": supplement", None), (7, 2, "A new neural surrogate for spring flow", None), (8, 3, "<i>A NEW neural surrogate for spring  flow</i>", "10.1/n"), (9, 3, None, None),
        (10, 3, "", ""), (11, 4, None, "10.1/z"), (12, None, TITLE, None), (4, 2, TITLE[:70] + "...", ""),
    ]
    want = [(1, "entries"), (2, "entries"), (4, "entries"), (4, "entries"), (5, "entries"), (8, "discovery_results"), (11, "discovery_results")]
    assert seen(spark, catalogue, found) == sorted(want, key=repr)
    assert seen(spark, [], []) == [] and seen(spark, catalogue, []) == []


def test_forest_batch_by_batch(spark, tmp_path):
    """Checking batch after batch against the runs gives what one pass over everything gives."""
    sf = spark.read.parquet
    entries_, found = sf(f"{SF}/entries.parquet"), sf(f"{SF}/discovery_results.parquet").filter("batch_no <= 3")
    old = history.title_rows(entries_, F.lit(None).cast("long"), F.lit(0))
    new = history.title_rows(found, F.col("arrival"), F.col("batch_no"))
    forest, got = history.Forest(spark, str(tmp_path / "a")), []
    forest.add(old)
    for batch in (1, 2, 3):
        got += rows(forest.check(new.filter(F.col("batch") == batch)))
        if batch == 2:
            assert len(forest.runs) == 3
            forest.merge()
            assert len(forest.runs) == 1
    assert sorted(got) == rows(history.seen_before(old.unionByName(new)))
    assert rows(history.Forest(spark, str(tmp_path / "c")).check(new.limit(0))) == []


def test_forest_opens_the_ranges_of_a_batch_alone(spark, tmp_path, monkeypatch):
    """However long the history is, a batch of one title reads no more ranges than it has paths."""
    monkeypatch.setattr(history, "RANGE_ROWS", 20)
    old = history.title_rows(spark.read.parquet(f"{SF}/entries.parquet"), F.lit(None).cast("long"), F.lit(0))
    forest = history.Forest(spark, str(tmp_path / "a"))
    run = forest.add(old)
    assert run.ranges >= 32
    one = history.title_rows(spark.createDataFrame([(1, 1, TITLE, None)], "rid long, batch int, title string, doi string"), F.col("rid"), F.col("batch"))
    paths = history.permutations(history.title_classes(one), *forest.words)
    opened = forest.touched(run, paths)
    assert 0 < opened.select("part").distinct().count() <= paths.count() < run.ranges
    assert re.search(r"PartitionFilters: \[.*part#\d+ (IN|INSET)", opened._jdf.queryExecution().executedPlan().toString())
    assert rows(forest.check(one)) == []


def test_history_recall_against_brute_force(spark):
    """Slips, cut ends and look changes of generated titles are found; the same rule checked pair by pair."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    lexicon = [word() for _ in range(40)]
    make = lambda: " ".join([*rng.sample(lexicon, 7), word().title() + "bri", *rng.sample(lexicon, 3)])

    def slip(t):
        i = rng.randrange(3, len(t) - 4)
        return t[:i] + t[i + 1] + t[i] + t[i + 2 :]

    base = [make() for _ in range(150)]
    found = [(i, 1, slip(t) if i % 3 else t.upper(), None) for i, t in enumerate(base[:100])] + [(500 + i, 1, make(), None) for i in range(50)]
    got = seen(spark, [(t, f"10.1/{i}") for i, t in enumerate(base)], found)
    assert sum(1 for x, _ in got if x < 500) >= 98 and not [x for x, _ in got if x >= 500]


def test_history_crowded_word_leads_alone(spark):
    """A word of more than 100 titles leads to a title whose frequent words are slipped."""
    unique = iter("".join(x) for x in itertools.product("bdfgklm", "aeiou", "nprst", "aeiou", "vwxz"))
    filler = lambda n: [next(unique) for _ in range(n)]
    titles_ = [["kelbor", *filler(2)] for _ in range(120)] + [[w, next(unique)] for w in ("morat", "silven", "dorvak") for _ in range(140)] + [filler(1) for _ in range(960)]
    catalogue = [("kelbor morat silven dorvak", "10.1/a"), *((" ".join(t), f"10.2/{i}") for i, t in enumerate(titles_))]
    df = spark.createDataFrame([(None, 0, *x) for x in catalogue] + [(1, 1, "kelbor mroat slivne dorvak", None)], "rid long, batch int, title string, doi string")
    assert rows(history.seen_before(history.title_rows(df, F.col("rid"), F.col("batch")), share=0.09)) == [(1, "entries")]


def test_word_hashes_are_those_of_spark(spark):
    words = ["a", "abcd", "abcdef", "abcdefgh", "abcdefghijk", "y" * 15, "z" * 31, "q" * 32, "abcdefghijk" * 7, "überraschung", "中文标题测试文字"]
    data, ends = titles.spaced(pa.array([" ".join(words[:4]), None, "", " ".join(words[4:])]))
    begin, hashed, long_, heads, tails = titles.word_hashes(data)
    half = lambda end, part: F.when(F.length("w") >= 6, F.xxhash64(F.lit(end), part("w", F.lit(4)))).otherwise(F.lit(0))
    want = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w"), half("head", F.left), half("tail", F.right)).collect()
    assert [tuple(r) for r in want] == list(zip(*(x.view("int64").tolist() for x in (hashed, heads, tails))))
    assert long_.tolist() == [len(w) >= 6 for w in words] and (ends.searchsorted(begin, side="right")).tolist() == [0] * 4 + [3] * 7


def test_history_puts_slips_of_frequent_words_right(spark):
    """Slips of frequent words, and two of them written together, leave the long prefixes of some trees as they are."""
    often = sorted(history_often := "transient lowland karst discharge emulation forest multi objective peak".split())
    slipped = ["trnasient lowlnd karst dischargee emulatoin forest multiobjective paek", " ".join(history_often)]
    df = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(slipped)], "rid long, batch int, title string, doi string")
    paths = history.permutations(history.title_classes(history.title_rows(df, F.col("rid"), F.col("batch"))), often, []).filter(F.col("kind").between(history.TREE, history.TREE + history.TREES - 1))
    met = paths.groupBy("kind", history.node(6).alias("node")).agg(F.count_distinct("cid").alias("n")).filter("n = 2").count()
    assert met == history.TREES - 1


def test_history_half_a_rare_word(spark):
    """A title of one rare word with a slip is found by the half that has none; so is an unspaced Chinese one."""
    catalogue = [("Hydrology", None), ("水文模型的参数估计方法", "10.1/z")]
    assert seen(spark, catalogue, [(1, 1, "Hydrologgy", None), (2, 1, "水文模型的参数诂计方法", None), (3, 1, "Geology", None)]) == [(1, "entries"), (2, "entries")]


def test_history_widens_while_the_estimate_is_low(spark, monkeypatch):
    """The prefix is made shorter until the estimate holds, and pairs with equal letters don't count in it."""
    pairs = [("a", "b", 1, False), ("c", "d", 2, False), *(("e", str(i), 6, True) for i in range(98))]
    assert history.estimated_recall(spark.createDataFrame(pairs, "a string, b string, trees long, equal boolean")) == 0.8
    seen_at = []
    monkeypatch.setattr(history.Forest, "_first_depth", lambda self: 5)
    monkeypatch.setattr(history, "estimated_recall", lambda found: seen_at.append(found.count()) or 0.0)
    seen(spark, [(TITLE, None)], [(1, 1, TITLE.replace("moisture", "moistrue"), None)])
    assert len(seen_at) == 4


def test_path_nodes_nest(spark):
    """Titles in one node at a depth share the node of every shorter prefix; keys of a node are one range."""
    df = spark.read.parquet(f"{SF}/entries.parquet")
    classes = history.title_classes(history.title_rows(df, F.lit(None).cast("long"), F.lit(0)))
    paths = history.permutations(classes, *history.vocabulary(classes, 0.02)).filter(F.col("kind") >= history.TREE)
    deep = paths.groupBy(history.node(6).alias("deep")).agg(F.count_distinct(history.node(2)).alias("n"), F.count_distinct(history.node(4)).alias("m"))
    assert deep.filter("n > 1 OR m > 1").count() == 0
    pdf = paths.select("key", history.node(2).alias("node")).toPandas().sort_values("key")
    assert (pdf.node != pdf.node.shift()).sum() == pdf.node.nunique()


def test_same_title_editions(spark):
    pairs = [
        (TITLE, TITLE + " II", False), (TITLE, "Erratum: " + TITLE, False), (TITLE + ", Part I", TITLE + ", Part II", False), (TITLE, TITLE.replace("shallow", "deep"), False),
        (TITLE, TITLE.replace("rain collectors", "raincollectors"), True), (TITLE, TITLE[:60] + "…", True), ("", "", True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    part = lambda c: (history_words(c), F.array_join(history_words(c), ""), titles.cut_end(F.col(c)))
    history_words = lambda c: titles.F.array_remove(F.split(F.coalesce(title_norm(c), F.lit("")), " "), "")
    from corpusql.functions.text import title_norm

    for r in df.select("a", "b", "want", titles.same_title(*part("a"), *part("b")).alias("got")).collect():
        assert r.got == r.want, (r.a, r.b)


def test_same_title_without_equal_words(spark):
    """Slips, abbreviations or other word borders in most words; the letters decide whatever the words."""
    pairs = [
        ("Sedimant transpart modelling", "Sediment transport modelling", False, True), ("水文模型的参数估计方法", "水文模型的参数诂计方法", False, True), ("Hydrolgy", "Hydrology", False, True),
        ("Robust dete. shal. soil moist. measur.", "Robust detection shallow soil moisture measurement", True, True),
        ("Anewlook atthe oldmodel ofslow runof inthe hills", "A new look at the old model of slow runoff in the hills", False, True),
        ("Sediment transport modelling", "Nitrogen balance modelling", False, False), ("Dark matter", "Bright stars", False, False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, by_hand boolean, want boolean")
    part = lambda c: (titles_words(c), F.array_join(titles_words(c), ""), titles.cut_end(F.col(c)))
    titles_words = lambda c: F.split(title_norm(c), " ")
    from corpusql.functions.text import title_norm

    got = F.when(F.col("by_hand"), titles.same_title(*part("a"), *part("b"), by_hand=True)).otherwise(titles.same_title(*part("a"), *part("b")))
    for r in df.select("a", "b", "want", got.alias("got")).collect():
        assert r.got == r.want, (r.a, r.b)


# --- p7 ------------------------------------------------------------------------------------------------------------------------------------


def test_encoding_equals_merges(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(encode.default_vocabulary())
    own.encode_special_tokens = True
    rng = random.Random(4)
    bits = ["a", "the", "ing", " ", "  ", "\n", "é", "日", "12", "'s", "<|endoftext|>", "ß", "aaaa", "́", "🙂", "\t", "==", " ", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a" * 50_000, " " * 5000, "日" * 3000]
    bpe = encode.tokenizer(encode.default_vocabulary(), encode.default_pattern())
    for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(t) == e.ids
        assert bpe.decode(e.ids) == t
    df = spark.createDataFrame([(1, None, "a", ""), (2, "", "b", ""), (3, "hi", None, ""), (3, "hi", None, "")], DOC)
    assert rows(encode.encode_corpus(df)) == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert rows(encode.encode_corpus(df.limit(0))) == []


# --- p8 -------------------------------------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    data = [(i, f"text {i} " * (1 + i % 5), "Big Source" if i % 4 else "small", "") for i in range(400)] + [(900 + i, "same text", "small", "") for i in range(30)]
    data += [(990, None, "small", ""), (991, "", "small", ""), (992, "x", None, ""), (993, "y", "other", "")]
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("SMALL", 0.4, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    sized = mixture.sized_texts(spark.createDataFrame(data, DOC))
    mix = mixture.mix(sized, targets).collect()
    total = Counter()
    for r in mix:
        total[r.source] += r.n_tokens
    everything = sum(total.values())
    assert total["big_source"] / everything == pytest.approx(5 / 9, abs=0.02) and total["small"] / everything == pytest.approx(4 / 9, abs=0.02)
    uses = Counter((r.source, r.doc_id) for r in mix)
    assert max(n for (s, _), n in uses.items() if s == "big_source") == 1 and max(n for (s, _), n in uses.items() if s == "small") <= 3
    assert len({r.doc_id for r in mix if r.doc_id >= 900}) <= 1  # a repeated text is one text
    order = sorted(mix, key=lambda r: r.position)
    assert [r.position for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    assert all(a.finish <= b.finish for a, b in zip(order, order[1:]))
    shares = {r.source: r for r in mixture.mixture_shares(sized, targets, mixture.mix(sized, targets)).collect()}
    assert shares["absent"].n_uses == 0 and shares["other"].target_share == 0 and "(none)" in shares
    limited = mixture.mix(sized, targets, budget=50).agg(F.sum("n_tokens").alias("n")).first().n
    assert 30 < limited <= 50
    assert mixture.mix(sized.limit(0), targets).count() == 0 and mixture.mix(sized, targets.limit(0)).count() == 0


def test_horizon():
    assert mixture.horizon({"a": (0.5, 100), "b": (0.5, 30)}, None) == (60.0, 60.0)
    assert mixture.horizon({"a": (0.5, 100), "b": (0.5, 30)}, 100) == (100, 60 + 40 / 0.5)
    assert mixture.horizon({}, 10) == (0.0, 0.0)


# --- p9 --------------------------------------------------------------------------------------------------------------------------------------

GIVEN, FAMILY = frozenset(["sanna", "kofi", "renee", "pilar"]), frozenset(["kelstad", "merazar", "dorel", "belander"])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Dr Sanna von Kelstad's note, KOFI MERÁZAR, Belander, Pilar; Renée J. Dorel-Belander and K. Dorel", [("person", x) for x in ("Sanna von Kelstad", "KOFI MERÁZAR", "Belander, Pilar", "Renée J. Dorel-Belander", "K. Dorel")]),
        ("Following Kelstad (1999), the Dorel Index; Kelstad and Belander (2001). Kofi agreed. A Gaussian process.", []),
        ("<a.b+c@lab.uni-x.example>, q [at] field [dot] test; z(at)r.test, m at lab dot example. x@2.4.1 Recall@10 @step", [("email", x) for x in ("a.b+c@lab.uni-x.example", "q [at] field [dot] test", "z(at)r.test", "m at lab dot example")]),
        ("+1 719 555 0108, (435) 555-0113; 598.555.0162 01 99 00 42 44 01632 960499, ext. 12. Grid 835 027 209", [("phone", x) for x in ("+1 719 555 0108", "(435) 555-0113", "598.555.0162", "01 99 00 42 44", "01632 960499")]),
        ("SSN123-45-6789, DNI12345678Z; _ssn 123-45-6780", [("id_number", x) for x in ("123-45-6789", "12345678Z", "123-45-6780")]),
        ("passport no. Q66724691, SSN 991-42-6150; the Steuer-ID: 16 409 649 161. Gauge 812-44-4448, Serial 1470-9382", [("id_number", x) for x in ("Q66724691", "991-42-6150", "16 409 649 161")]),
        ("at 203 North Jinford Ave, third floor; 349 rue de Tarbrook. Jirbrookstraße 189b, Calle Jaford 127", [("address", x) for x in ("203 North Jinford Ave", "349 rue de Tarbrook", "Jirbrookstraße 189b", "Calle Jaford 127")]),
        ("", []),
    ],
)
def test_personal(text, found):
    got = [(k, text[a:b]) for a, b, k in personal.Finder(GIVEN, FAMILY).spans(text)]
    assert got == found


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(personal.feistel(i, size, b"k", "t") for i in range(size)) == list(range(size))
    a, b = personal.placeholder("id_number", "540921-9615", b"k"), personal.placeholder("id_number", "540921-9615", b"k")
    assert a == b != personal.placeholder("id_number", "540921-9615", b"other")
    date = re.fullmatch(r"\[ID_NUMBER (\d{6})-\d{4}\]", a)[1]
    datetime.strptime(date, "%y%m%d")
    assert re.fullmatch(r"\[PHONE \+\d \d{3} \d{3} \d{4}\]", personal.placeholder("phone", "+1 719 555 0108", b"k"))
    assert personal.placeholder("email", "A@b.test", b"k") == personal.placeholder("email", "a@B.test", b"k")


def test_writings_of_one_number_are_linked():
    last = lambda x: re.sub(r"\D", "", personal.permute_phone(x, b"k"))[-10:]
    assert len({last(x) for x in ("+1 555-123-4567", "+1 (555) 123 4567", "1-555-123-4567", "555.123.4567")}) == 1
    assert personal.permute_phone("+49 30 1234567", b"k")[4:] == personal.permute_phone("030 1234567", b"k")[1:]
    for one, other in (("12345678Z", "12345678-Z"), ("943 476 5919", "9434765919"), ("811218-9876", "8112189876")):
        assert len({re.sub("[- ]", "", personal.permute_id(x, b"k")) for x in (one, other)}) == 1


@pytest.mark.parametrize("form", range(len(personal.ID_MAKES) + 1))
def test_numbers_keep_their_make_and_come_back(form):
    rng, seen = random.Random(form), {}
    for _ in range(4000):
        layout = personal.ID_MAKES[form][1] if form < len(personal.ID_MAKES) else "kkddddddk"
        code = "".join(rng.choice("0123456789" if c != "k" else "XYZ12") for c in layout)
        if form < len(personal.ID_MAKES) and layout.endswith("c"):  # mostly valid ones
            n = layout.count("c")
            code = code[:-n] + (personal.ID_MAKES[form][3](code[:-n]) if code[0] != "k" else "").rjust(n, "0")
        new = personal.permute_id(code, b"k")
        assert personal._make_of(new) == personal._make_of(code) and len(new) == len(code)
        assert personal.permute_id(new, b"k", back=True) == code
        assert seen.setdefault(new, code) == code


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"(\+\d{1,3} ?|00|0|\()?\d{2,4}\)?[ .-]\d{3,7}", fullmatch=True))
def test_phones_come_back(text):
    text = text.translate({ord(c): str(unicodedata.digit(c)) for c in text if c.isdigit()})
    assert personal.permute_phone(personal.permute_phone(text, b"k"), b"k", back=True) == text


def test_redacted(spark):
    df = spark.createDataFrame([(1, "Ask Kofi Dorel at 598.555.0162.", None, ""), (2, None, None, ""), (3, "", None, ""), (4, "x " * 100_000, None, "")], DOC)
    got = dict(rows(df.select("doc_id", personal.redacted(F.col("text"), list(GIVEN), list(FAMILY), b"k").alias("t"))))
    assert re.fullmatch(r"Ask \[PERSON [0-9a-f]{32}\] at \[PHONE \d{3}\.\d{3}\.\d{4}\]\.", got[1])
    assert got[2] is None and got[3] == "" and got[4] == "x " * 100_000
    assert df.limit(0).select(F.inline(personal.found_in(F.col("text"), [], []))).count() == 0


def test_sketches_rule_out_other_titles_only(spark):
    rng = random.Random(4)
    words = "deep learning for image detection retrieval networks robust sequence of graph models neural estimation 2019 métodos survey clustering transfer".split()

    def slipped(w: str) -> str:
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeé1") + w[i:], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[:4], w]) or w

    rows = []
    for _ in range(1500):
        a = rng.choices(words, k=rng.randint(1, 12))
        b = [slipped(w) if rng.random() < 0.4 else rng.choice(words) if rng.random() < 0.05 else w for w in a]
        if rng.random() < 0.2 and len(b) > 1:
            i = rng.randrange(len(b) - 1)
            b[i : i + 2] = [b[i] + b[i + 1]]
        cut = rng.random() < 0.3
        text = " ".join(b)
        rows.append((" ".join(a), text[: rng.randint(len(text) // 2, len(text))].strip() if cut else text, cut))
    rows += [("deep learning for image detection networks", f"deep learning for image {w} networks", False) for w in ("retrieval", "sequence", "clustering")]
    df = spark.createDataFrame(rows, "a string, b string, cut boolean").filter("b <> ''")
    fold = lambda c: F.replace(c, F.lit(" "))
    sketch = lambda c, cut: titles.title_sketch(F.col(c), cut)
    for by_hand in (False, True):
        same = titles.same_title(F.split("a", " "), fold("a"), F.lit(False), F.split("b", " "), fold("b"), F.col("cut"), by_hand)
        may = titles.may_be_same(sketch("a", F.lit(False)), sketch("b", F.col("cut")), by_hand)
        got = df.select("a", "b", same.alias("same"), may.alias("may")).collect()
        # Few of the same titles have many letters exchanged, which is ruled out by intent; no other may be.
        lost = [r for r in got if r.same and not r.may]
        exchanged = lambda r: min(sum((Counter(r.a) - Counter(r.b)).values()), sum((Counter(r.b) - Counter(r.a)).values()))
        assert [r for r in lost if exchanged(r) <= 4] == []
        assert sum(r.same for r in got) > 400
        assert not any(r.may for r in got[-3:])
    # Empty batches, empty and NULL titles.
    assert df.limit(0).select(sketch("a", F.lit(False))).collect() == []
    odd = spark.createDataFrame([("", ""), (None, ""), ("中文 题目", "中文 题目"), ("a", "b")], "a string, b string")
    assert [r[0] for r in odd.select(titles.may_be_same(sketch("a", F.lit(False)), sketch("b", F.lit(False)))).collect()] == [True] * 4


def test_vocabulary_reads_each_word_once(spark):
    text = "state-of-the-art table 4 3abc-def 5 x-y-z- 7-eight Nine-2 ten 11 " * 3
    docs = spark.createDataFrame([(text,), ("a" * 300_000,)], "text string")
    none = spark.createDataFrame([], "title string, authors array<string>, venue string")
    began = time.time()
    got = scans.learn_vocabulary(docs, none)
    assert time.time() - began < 30  # tried at each letter, the long word takes minutes
    low = text.lower()
    assert got.compounds == frozenset(re.findall(r"[a-z]+(?:-[a-z]+)+", low))
    assert got.before_number == frozenset(re.findall(r"([a-z]+) [0-9]", low))


def test_learned_names(spark):
    df = spark.createDataFrame([(["Dorel, Kofi", "Kofi Merázar", None],), (None,), (["K. Dorel", "BELANDER KOFI"],)], "authors array<string>")
    assert [sorted(x) for x in personal.learned_names(df)] == [["kofi"], ["belander", "dorel", "merazar"]]
    assert personal.learned_names(df.limit(0)) == ([], [])


# --- queries ----------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    ours, theirs = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = [ours.columns.index(c) for c in theirs.columns]
    assert sorted((tuple(r[i] for i in order) for r in ours.collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


@pytest.mark.parametrize(("name", "columns"), [("p1_found", "src row_key item noise"), ("p2_found", "rec_id arrival"), ("p5_found", "arrival seen_in"), ("p7_ids", "doc_id ids"), ("p9_found", "doc_id kind value")])
def test_columns(spark, name, columns):
    got = QUERIES[name](spark, SF)
    assert got.columns == columns.split()
    assert got.count() > 0
