"""Deduplicating new batches against all history with a forest of sorted title signatures.

A title has several signature permutations: hashed orders of its frequent words, with slips of frequent words put right in some of
them, its own word order (for cut ends), and each of its rare words alone; DOI and letters are two more, of one element. A permutation is a path of a prefix tree, packed so
that paths sort by their prefixes: a node of any depth is one range of the sorted run. Runs are written once, in ranges; a
batch opens only the ranges that its own paths fall into, finds its nodes there, and leaves the rest of history unread.
How many links are missed is estimated from how many were found by one permutation only and by two; while the recall is below its
target, prefixes are made a word shorter and the batch is looked up again. Candidates are verified word by word.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.text import bare_doi, title_norm
from corpusql.llm.titles import cut_end, frequent_words, may_be_same, same_title, spaced, title_sketch, word_hashes
from corpusql.operators.skew import salted_join
from corpusql.session import discard, new_path, staged, write_table

#: Hashed orders of the frequent words.
TREES = 6
#: Mean number of titles in a title's node, up to which the prefix is short enough to begin with.
NODE = 6.0
#: Rows of a range of a sorted run.
RANGE_ROWS = 2_000_000
#: Runs of one history, from which on they are merged.
RUNS = 8
#: Batches are taken together until they have so many rows, so that small ones don't cost a job each.
TOGETHER = 1_000_000
#: Rows of an Arrow batch of paths, which bounds what an executor holds of them outside its heap.
BATCH_ROWS = 10_000
#: Words of a path: the first has 28 bits of the key, three more 12 bits each, four more lie in ``rest``.
LONGEST = 8
#: Kinds of permutations: what is compared is the whole key, but for HALF and TREE (and on: one kind a tree), whose nodes are prefixes.
DOI, LETTERS, ALONE, HALF, TREE = 0, 1, 2, 3, 4


def title_rows(df: DataFrame, rid: Column, batch: Column) -> DataFrame:
    """rid, batch (0: the accepted catalogue), norm, cut, doi, cid of every row."""
    rows = df.select(
        rid.alias("rid"), batch.cast("int").alias("batch"), F.coalesce(title_norm("title"), F.lit("")).alias("norm"),
        cut_end(F.col("title")).alias("cut"), F.coalesce(bare_doi("doi"), F.lit("")).alias("doi"),
    )
    return rows.withColumn("cid", F.xxhash64("norm", "doi", "cut"))


def title_classes(rows: DataFrame) -> DataFrame:
    """One row for rows of the same words, DOI and cut: cid, norm, cut, doi, first, last (batch), sketch."""
    # Grouped by all that ``cid`` stands for: values that are kept by first() would have to be sorted.
    classes = rows.groupBy("cid", "norm", "cut", "doi").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    return classes.withColumn("sketch", title_sketch(F.col("norm"), F.col("cut")))


def vocabulary(classes: DataFrame, share: float = 0.001) -> tuple[list[str], list[str]]:
    """Frequent words, the scarcest first, and those of them in so many titles that they say nothing."""
    return frequent_words(classes.filter("norm <> ''").withColumn("words", F.split("norm", " ")), "words", share)[1:]


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """The word hashes in another order for each salt (the finaliser of splitmix64, a bijection)."""
    x = values.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _packed(words: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, rest) of each row's path: 28 bits of the word at place 0, 12 bits of each further one (0: none, or the path has ended)."""
    key, rest = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for p in range(LONGEST):
        at = np.flatnonzero(place == p)
        bits, target = (words[at] if p == 0 else words[at] % np.uint64(4095) + np.uint64(1)), key if p < 4 else rest
        target[row[at]] |= bits << np.uint64(36 if p == 0 else 12 * (3 - p % 4))
    return key.view(np.int64), rest.view(np.int64)


class Righted:
    """Rare words that are slips of a frequent one (a letter changed, left out or added, or two swapped), as that one; of several, as the most frequent.

    Words of a letter less are compared: both sides of such a slip have one in common. Two frequent words written together
    become these two. Short words and numbers stay as they are.
    """

    def __init__(self, often: list[str], least: int = 4):
        self.least, self.less = least, {}
        words = [w for w in often if not any(map(str.isdigit, w))]
        self.often = dict(zip(words, word_hashes(spaced(pa.array(words, pa.string()))[0])[1].tolist()))
        for w in reversed(words):  # the most frequent first
            if len(w) >= least:
                for v in self._variants(w):
                    self.less.setdefault(v, self.often[w])
        self.known: dict[int, tuple[int, ...]] = {}

    def _variants(self, w: str) -> list[str]:
        return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]

    def _as(self, w: str, own: int) -> tuple[int, ...]:
        if len(w) < self.least or any(map(str.isdigit, w)):
            return (own,)
        less, often = self.less, self.often
        for v in self._variants(w):
            if v in less:
                return (less[v],)
        for i in range(3, len(w) - 2):
            if w[:i] in often and w[i:] in often:
                return often[w[:i]], often[w[i:]]
        return (own,)

    def __call__(self, data: np.ndarray, begin: np.ndarray, hashed: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``hashed`` with those at ``rare`` put right, second words at the end; which of ``hashed`` each one comes from."""
        text = data.tobytes()
        each, at, which = np.unique(hashed[rare], return_index=True, return_inverse=True)
        for h, start in zip(each.tolist(), begin[rare][at].tolist()):
            if h not in self.known:
                self.known[h] = self._as(text[start : text.index(b" ", start)].decode(), h)
        new = [self.known[h] for h in each.tolist()]
        out = hashed.copy()
        out[rare] = np.array([x[0] for x in new], np.uint64)[which]
        second, has = np.array([x[-1] for x in new], np.uint64)[which], np.array([len(x) > 1 for x in new], bool)[which]
        return np.concatenate([out, second[has]]), np.concatenate([np.arange(len(hashed)), rare[has]])


def _paths_of(trees: int, often: list[str], always: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cid, bare, first, last, kind, key, rest of all paths, for batches of titles (see ``permutations``).

    As column expressions, the words' hashes, orders and their packing take Spark five times as long.
    """
    often_, always_ = (np.sort(word_hashes(spaced(pa.array(ws, pa.string()))[0])[1]) for ws in (often, always))
    right = Righted(often)

    def within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values if len(of) else np.zeros(len(values), bool)

    def ordered(hashed: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places among ``hashed`` of the words that paths are made of, whether each is rare, its row, its place in the row, and the number a row."""
        # Each word of a title once, where it stands first.
        by = np.lexsort((hashed, row))
        again = np.zeros(len(by), bool)
        again[by[1:]] = (row[by[1:]] == row[by[:-1]]) & (hashed[by[1:]] == hashed[by[:-1]])
        # Words in so many titles that they say nothing lead no path, but in titles that have no others.
        telling = ~again & ~within(hashed, always_)
        told = np.bincount(row[telling], minlength=n) > 0
        kept = np.flatnonzero(telling | (~again & ~told[row]))
        # Frequent words come first in every path; rare ones, which tell much but stand alone, follow where those have ended.
        late = told[row[kept]] & ~within(hashed[kept], often_)
        first = np.argsort(row[kept] * 2 + late, kind="stable")
        kept, late = kept[first], late[first]
        sizes = np.bincount(row[kept], minlength=n)
        return kept, late, row[kept], np.arange(len(kept)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            long = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            data, ends = spaced(batch.column("norm"))
            begin, hashed, long_words, heads, tails = word_hashes(data)
            of_word = np.searchsorted(ends, begin, side="right")
            kept, late, row, place, sizes = ordered(hashed, of_word, n)
            values = hashed[kept].view(np.int64)
            parts = [(DOI, long("doi1"), long("doi2"), np.flatnonzero(long("has_doi"))), (LETTERS, long("fold1"), long("fold2"), np.flatnonzero(long("has_letters")))]
            parts.append((ALONE, values[late], np.zeros(np.count_nonzero(late), np.int64), row[late]))
            righted, source = right(data, begin, hashed, kept[late])
            kept_r, late_r, row_r, place_r, sizes_r = ordered(righted, of_word[source], n)
            for t in range(trees):
                v, r, p, s, l = (values, row, place, sizes, late) if t == 0 else (righted[kept_r].view(np.int64), row_r, place_r, sizes_r, late_r)
                h = _mixed(v, t)
                order = np.lexsort((h, r * 2 + l))
                key, rest = _packed(h[order], r, p, n)
                parts.append((TREE + t, key, rest, np.flatnonzero(s > 0)))
                if t == 0:
                    # After half a rare word come the frequent words in the same order, one place later.
                    after, rest_after = _packed(h[order][~late], row[~late], place[~late] + 1, n)
            for i in (1, 2):
                h, tail = _mixed(values, -i), place >= i - 1
                parts.append((TREE + trees + i, *_packed(h[tail], row[tail], place[tail] - (i - 1), n), np.flatnonzero(sizes >= i)))
            long_ = late & long_words[kept]
            halves, of = np.concatenate([heads[kept[long_]], tails[kept[long_]]]).view(np.int64), np.concatenate([row[long_]] * 2)
            parts.append((HALF, (halves << 36) | after[of], rest_after[of], of))
            parts = [(kind, *((x if kind in (ALONE, HALF) else x[some]) for x in (key, rest)), some) for kind, key, rest, some in parts]
            kinds = np.concatenate([np.full(len(some), kind, np.int8) for kind, _, _, some in parts])
            keys, rests, of = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
            # Sorted as the run will be, so that Spark has few long pieces to merge.
            order = np.lexsort((rests, keys, kinds <= LETTERS))
            own = [batch.column(c).take(pa.array(of[order])) for c in ("cid", "bare", "first", "last")]
            out = pa.RecordBatch.from_arrays([*own, pa.array(kinds[order]), pa.array(keys[order]), pa.array(rests[order])], names=["cid", "bare", "first", "last", "kind", "key", "rest"])
            yield from (out.slice(at, BATCH_ROWS) for at in range(0, out.num_rows, BATCH_ROWS))

    return paths


def permutations(classes: DataFrame, often: list[str], always: list[str], trees: int = TREES) -> DataFrame:
    """cid, bare, first, last, kind, key, rest: all paths of every class.

    Words in so many titles that they say nothing lead no path, but in titles that have no others. Half a rare word (four
    letters at either end) leads a path of frequent words too, since a slip leaves one half as it is.
    """
    fold = F.replace("norm", F.lit(" "))
    c = classes.select(
        "cid", "norm", (F.col("doi") == "").alias("bare"), "first", "last", F.xxhash64("doi").alias("doi1"), F.xxhash64(F.lit(1), "doi").alias("doi2"), (F.col("doi") != "").alias("has_doi"),
        F.xxhash64(fold).alias("fold1"), F.xxhash64(F.lit(1), fold).alias("fold2"), (fold != "").alias("has_letters"),
    )
    return c.mapInArrow(_paths_of(trees, often, always), "cid long, bare boolean, first int, last int, kind byte, key long, rest long")


def node(depth: int) -> Column:
    """The node of a path: all of its key or, of a tree, the first ``depth`` words (two less where half a word leads), a range of keys."""

    def prefix(n: int) -> Column:
        return F.shiftright("key", 12 * (4 - n)) if n <= 4 else F.xxhash64("key", F.shiftright("rest", 12 * (LONGEST - n)))

    return F.when(F.col("kind") >= TREE, prefix(depth)).when(F.col("kind") == HALF, prefix(max(1, depth - 2))).otherwise(F.col("key"))


def narrowed(big: DataFrame, small: DataFrame, on: str, slots: int) -> DataFrame:
    """Rows of ``big`` whose key ``on`` may be one of ``small``'s: all that are, and few others.

    ``small``'s keys are marked in a bitmap of ``slots`` bits, 2**26 at most, which as a table of 64-bit words (16 bytes with their
    place) has a proven bound of 16 MB; it is broadcast.
    """
    slot = F.pmod(F.xxhash64(on), F.lit(slots))
    marks = small.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS INT))")).alias("bits"))
    met = big.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(marks), "word")
    return met.filter(F.getbit("bits", slot.bitwiseAND(63).cast("int")) == 1).drop("word", "bits")


def _slots(n: int) -> int:
    return 1 << min(26, max(16, math.ceil(math.log2(16 * n + 1))))


def estimated_recall(found: DataFrame) -> float:
    """Share of the links found, from those that one path only and two paths found (Chao's estimate of the unseen).

    Pairs with equal letters don't count: one path finds them all.
    """
    r = found.filter("NOT equal").agg(F.count("*").alias("n"), F.count_if(F.col("trees") == 1).alias("one"), F.count_if(F.col("trees") == 2).alias("two")).first()
    return r.n / (r.n + r.one * r.one / (2.0 * max(r.two, 1))) if r.n else 1.0


@dataclass
class Run:
    """Classes of some batches and all their paths, on disk: ``paths`` in ranges of sorted keys, ``titles`` to verify with."""

    paths: str
    titles: str
    ranges: int
    size: int


@dataclass
class Forest:
    """History on disk, as sorted runs of signature permutations; new batches are checked against it and added.

    The words that paths are made of are counted on the first run and stay, so that runs made later fit.
    """

    spark: SparkSession
    folder: str
    share: float = 0.001
    trees: int = TREES
    recall: float = 0.97
    runs: list[Run] = field(default_factory=list)
    words: tuple[list[str], list[str]] | None = None
    #: Words of a prefix, as the last check left it; None before the first.
    depth: int | None = None

    def _ranges(self, paths: DataFrame, ranges: int) -> DataFrame:
        """Adds ``exact`` (what meets whole or not at all lies apart) and ``part``, the range of the key; each range is sorted."""
        part = F.shiftrightunsigned("key", 64 - int(math.log2(ranges))).cast("int") if ranges > 1 else F.lit(0)
        return paths.withColumns({"exact": F.col("kind") <= LETTERS, "part": part}).sortWithinPartitions("exact", "part", "key", "rest")

    def _write(self, classes: DataFrame, size: int) -> Run:
        if self.words is None:
            self.words = vocabulary(classes, self.share)
        ranges = 1 << max(0, math.ceil(math.log2(max(1, size * (self.trees + 5) / RANGE_ROWS))))
        paths = permutations(classes, *self.words, self.trees)
        path = new_path(self.spark, f"{self.folder}/paths")
        write_table(self._ranges(paths, ranges), path, ["exact", "part"])
        return Run(path, classes._staged_at, ranges, size)

    def add(self, rows: DataFrame) -> Run:
        """Accept a batch (see ``title_rows``)."""
        classes = staged(title_classes(rows.filter("batch IS NOT NULL")), f"{self.folder}/titles")
        run = self._write(classes, classes.count())
        self.runs.append(run)
        return run

    def _read(self, run: Run, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema("cid long, bare boolean, first int, last int, kind byte, key long, rest long, exact boolean, part int").parquet(run.paths)
        return df if parts is None or len(parts) == run.ranges else df.filter(F.col("part").isin(parts))

    def touched(self, run: Run, keys: DataFrame) -> DataFrame:
        """The ranges of a run that the keys (of one depth of four words at most: prefixes stay within a range) fall into."""
        if run.ranges == 1:
            return self._read(run)
        part = F.shiftrightunsigned("key", 64 - int(math.log2(run.ranges))).cast("int")
        return self._read(run, [r.part for r in keys.select(part.alias("part")).distinct().collect()])

    def merge(self) -> None:
        """All runs into one: a class once, with its earliest batch; ranges are merged range by range."""
        old = self.runs
        union = lambda tables: self.spark.read.parquet(*tables)
        titles = staged(union([r.titles for r in old]).groupBy("cid").agg(
            *(F.first(c).alias(c) for c in ("norm", "cut", "doi", "sketch")), F.min("first").alias("first"), F.max("last").alias("last")), f"{self.folder}/titles")
        self.runs = [self._write(titles, titles.count())]
        discard(self.spark, *(r.paths for r in old), *(r.titles for r in old))

    def check(self, rows: DataFrame) -> DataFrame:
        """rid, seen_in of the rows of one or several new batches, as ``seen_before`` gives them; the batches are then history."""
        new = rows.filter("batch IS NOT NULL")
        if len(self.runs) >= RUNS:
            self.merge()
        run = self.add(new)
        mine = self._read(run)
        slots = _slots(mine.count())
        history = [self.touched(r, mine) for r in self.runs]
        history = history[0] if len(history) == 1 else _union(history)
        exact = staged(self._exact(mine, history, slots), f"{self.folder}/exact")
        # A class that is known to be in the catalogue needs no second proof.
        unknown = self.spark.read.parquet(run.titles).select("cid").join(exact.filter("first = 0").select("cid"), "cid", "left_anti")
        open_ = staged(unknown, f"{self.folder}/open")
        found = self._linked(narrowed(mine.filter("NOT exact"), open_, "cid", slots), history.filter("NOT exact"), slots, run)
        facts = exact.unionByName(found.select(F.col("a").alias("cid"), "first")).groupBy("cid").agg(F.min("first").alias("first"))
        out = staged(
            salted_join(new.filter("batch > 0").select("rid", "batch", "cid"), facts, ["cid"], ["rid"])
            .filter(F.col("first") < F.col("batch"))
            .select("rid", F.when(F.col("first") == 0, "entries").otherwise("discovery_results").alias("seen_in")),
            f"{self.folder}/seen",
        )
        discard(self.spark, exact, open_, found)
        return out

    def _exact(self, mine: DataFrame, history: DataFrame, slots: int) -> DataFrame:
        """cid, first: the earliest batch with the same DOI, or the same letters where one side has no DOI."""
        # Two classes with DOIs meet by DOI alone; the sides of a key are told apart by whether history's has one.
        sides = lambda kind, bare: F.when(kind == DOI, F.array(F.lit(False))).when(bare, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
        meet = lambda bare: F.xxhash64("kind", "key", "rest", bare)
        asked = mine.filter("exact").withColumn("side", F.explode(sides(F.col("kind"), F.col("bare")))).withColumn("meet", meet("side"))
        known = narrowed(history.filter("exact").withColumn("meet", meet("bare")), asked, "meet", slots)
        known = known.groupBy("meet", "key", "rest").agg(F.min("first").alias("before"))
        met = salted_join(asked.select("meet", "key", "rest", "cid", "last"), known, ["meet", "key", "rest"], ["cid"]).filter(F.col("before") < F.col("last"))
        return met.groupBy("cid").agg(F.min("before").alias("first"))

    def _linked(self, mine: DataFrame, history: DataFrame, slots: int, run: Run) -> DataFrame:
        """a (of the batch), b (of earlier ones), trees, equal, first: classes with the same title, one of them without DOI."""
        at = self.depth or self._first_depth()
        found = staged(self._links(mine, history, slots, run, at), f"{self.folder}/links")
        while at > 1 and estimated_recall(found) < self.recall:
            at -= 1
            discard(self.spark, found)
            found = staged(self._links(mine, history, slots, run, at), f"{self.folder}/links")  # a shorter prefix leads to all that a longer one does
        self.depth = at
        return found

    def _first_depth(self) -> int:
        """Prefix length at which nodes are small, by all paths of the first tree in the largest run."""
        run, total = max(self.runs, key=lambda r: r.size), sum(r.size for r in self.runs)
        paths, depth = self._read(run).filter(~F.col("exact") & (F.col("kind") == TREE)), 3
        nodes = staged(paths.groupBy("key", "rest").agg(F.count("*").alias("n")).withColumn("kind", F.lit(TREE)), f"{self.folder}/nodes")
        while depth < LONGEST:
            sizes = nodes.groupBy(node(depth).alias("node")).agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first()
            if (sizes.m or 0.0) * total / max(run.size, 1) <= NODE:
                break
            depth += 1
        discard(self.spark, nodes)
        return depth

    def _links(self, mine: DataFrame, history: DataFrame, slots: int, run: Run, depth: int) -> DataFrame:
        meet = lambda side: F.xxhash64(node(depth), side)
        # A class with a DOI meets those of history that have none; one without meets all.
        asked = mine.withColumn("side", F.explode(F.when(F.col("bare"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
        asked = asked.select(meet("side").alias("meet"), F.col("cid").alias("a"), "last")
        known = history.select(meet("bare").alias("meet"), F.col("cid").alias("b"), "first")
        pairs = asked.join(narrowed(known, asked, "meet", slots), "meet").filter((F.col("first") < F.col("last")) & (F.col("a") != F.col("b")))
        pairs = staged(pairs.select("a", "b", "first"), f"{self.folder}/pairs")
        titles = self.spark.read.parquet(*(r.titles for r in self.runs))
        side = lambda titles, x, *of: titles.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in of))
        met = lambda pairs: narrowed(titles, pairs.select(F.col("b").alias("cid")), "cid", slots).dropDuplicates(["cid"])
        sketched = pairs.join(side(self.spark.read.parquet(run.titles), "a", "sketch"), "a").join(side(met(pairs), "b", "sketch"), "b")
        # Few pairs meet on several paths, but for those that are the same: they are counted when the others are ruled out.
        alike = sketched.filter(may_be_same(F.col("sketch_a"), F.col("sketch_b"))).groupBy("a", "b").agg(F.count("*").alias("trees"), F.min("first").alias("first"))
        alike = staged(alike, f"{self.folder}/alike")
        discard(self.spark, pairs)
        mine = narrowed(self.spark.read.parquet(run.titles), alike.select(F.col("a").alias("cid")), "cid", slots)
        both = alike.join(side(mine, "a", "norm", "cut"), "a").join(side(met(alike), "b", "norm", "cut"), "b")
        letters = lambda x: F.replace(f"norm_{x}", F.lit(" "))
        part = lambda x: (F.split(f"norm_{x}", " "), letters(x), F.col(f"cut_{x}"))
        return both.filter(same_title(*part("a"), *part("b"))).select("a", "b", "trees", "first", (letters("a") == letters("b")).alias("equal"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def seen_before(rows: DataFrame, share: float = 0.001, recall: float = 0.97, trees: int = TREES, together: int = TOGETHER) -> DataFrame:
    """rid, seen_in of rows with batch > 0 whose paper is in batch 0 (``entries``), else in an earlier batch (``discovery_results``).

    rows: see ``title_rows``. The catalogue is the forest's first run; the batches are checked and added in their order, small ones
    together. Same paper: equal bare DOI or, where a side has no DOI, the same title (``titles.same_title``). Rows without DOI
    and title match nothing. Repeated rows give repeated results. A NULL batch counts as none: such a row is neither
    new nor history. Empty tables give no rows.
    """
    spark = rows.sparkSession
    sizes = sorted((r.batch, r.n) for r in rows.filter("batch > 0").groupBy("batch").agg(F.count("*").alias("n")).collect())
    starts: list[int] = []  # the first batch of each group
    size = together
    for batch, n in sizes:
        if size + n > together:
            starts.append(batch)
            size = 0
        size += n
    # A folder a group: with one a batch, each task would write as many files as there are batches.
    step = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("batch"))) if starts else F.lit(0)
    rows = staged(rows.filter("batch >= 0").withColumn("step", step), "rows", ["step"])
    forest = Forest(spark, "forest", share, trees, recall)
    forest.add(rows.filter("step = 0"))
    seen = [forest.check(rows.filter(F.col("step") == i + 1)) for i in range(len(starts))]
    return _union(seen) if seen else spark.createDataFrame([], "rid long, seen_in string")
