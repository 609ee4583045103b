"""When two titles are the same up to look, small slips and a cut end. Column expressions; what rules most pairs out works on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that make a title another edition or part of the work it names.
EDITION_WORDS = [
    "part", "supplement", "supplementary", "revisited", "extended", "erratum", "errata", "corrigendum", "correction", "corrections", "addendum",
    "comment", "comments", "reply", "response", "retraction", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "edition",
]

# Those of them that may follow a title.
EDITION_ENDS = [w for w in EDITION_WORDS if w not in ("correction", "corrections", "comment", "comments", "reply", "response")]


def cut_end(title: Column) -> Column:
    """The title ends with an ellipsis (so its end may be missing)."""
    dots = F.contains(title, F.lit("...")) | F.contains(title, F.lit("…"))
    return F.coalesce(dots & F.rtrim(title).rlike(r"(\.\.\.|…)[\s\p{Z}\"'”’)*}\]]*(</\w+>)?$"), F.lit(False))


def _tolerance(w: Column) -> Column:
    n = F.length(w)
    return F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def _slip_of(w: Column, v: Column) -> Column:
    """The words are slips of one another: few letters changed, left out, added or swapped.

    Swapped neighbours cost two edits though they are one slip; they leave the letters in sorted order as they are.
    """
    roman, number = (lambda x: x.rlike("^[ivx]+$")), (lambda x: x.rlike("[0-9]"))
    most = F.greatest(_tolerance(w), _tolerance(v))
    moved = F.levenshtein(*(F.array_join(F.array_sort(F.split(x, "")), "") for x in (w, v)))
    long_ = F.least(F.length(w), F.length(v)) >= 5

    def near(edits: Column) -> Column:
        few = (edits <= most) | ((edits == 2) & (moved == 0)) | (long_ & (edits <= most + 1) & (moved <= 2)) | (long_ & (edits <= most + 2) & (moved <= 1))
        telling = (roman(w) & roman(v)) | number(w) | number(v)
        return (edits >= 0) & few & ((edits == 0) | ~telling)

    # The distance is worked out once, in an array of one, and only for words of about the same length.
    return (F.abs(F.length(w) - F.length(v)) <= 4) & F.exists(F.array(F.levenshtein(w, v, 5)), near)


def _all_near(extra: Column, others: Column, other_fold: Column, abbreviated: bool) -> Column:
    """Each word has a near word among the others, or stands within the other title (words written together)."""

    def near(w: Column) -> Column:
        inside = (F.length(w) >= 3) & ~w.isin(EDITION_WORDS) & F.contains(other_fold, w)
        starts = lambda v, w: (F.length(v) >= 3) & F.startswith(w, v)
        short = (lambda v: starts(v, w) | starts(w, v)) if abbreviated else lambda v: F.lit(False)
        return inside | F.exists(others, lambda v: _slip_of(w, v) | short(v))

    return F.forall(extra, near)


def same_title(words_a: Column, fold_a: Column, cut_a: Column, words_b: Column, fold_b: Column, cut_b: Column, by_hand: bool = False) -> Column:
    """Both titles name the same work.

    Words of one title that the other lacks must each be a slip of one that the other has instead; a site is such a
    word, so titles that differ in the site differ. Numerals that tell parts apart allow no slip. Titles that differ in
    three letters at most are the same, however their words are divided, unless a word that tells editions apart is among
    what differs. A title with a cut end is compared with as many words of the other one, without its last, broken word; at least five
    words must be left. ``by_hand``: title a may abbreviate words and leave out a subtitle (at least five words stay).
    """
    na, nb = F.size(words_a), F.size(words_b)

    def near(x: Column, fx: Column, y: Column, fy: Column) -> Column:
        dx, dy = F.array_except(x, y), F.array_except(y, x)
        # Of a word that stands twice in a title one may be a slip; the other title then lacks no word.
        even = F.size(x) == F.size(y)
        of_y, of_x = F.when(even & (F.size(dx) > F.size(dy)), y).otherwise(dy), F.when(even & (F.size(dy) > F.size(dx)), x).otherwise(dx)
        words = _all_near(dx, of_y, fy, by_hand) & _all_near(dy, of_x, fx, by_hand)
        # Slips in words that one title writes together: the letters of the whole titles are compared.
        telling = F.exists(F.concat(dx, dy), lambda w: w.isin(EDITION_ENDS) | w.rlike("[0-9]"))
        letters = (F.length(fx) >= 30) & (F.abs(F.length(fx) - F.length(fy)) <= 3) & F.levenshtein(fx, fy, 3).between(0, 3) & ~telling
        return words | letters

    def head(x: Column, fx: Column, n: Column, y: Column, fy: Column, m: Column, broken: int = 1) -> Column:
        """x is cut: its words (but a broken last one) are those at y's start."""
        short, start = F.slice(x, 1, F.greatest(n - broken, F.lit(1))), F.slice(y, 1, F.greatest(n - broken, F.lit(1)))
        rest = F.slice(y, F.greatest(n - broken + 1, F.lit(1)), F.greatest(m, F.lit(1)))
        other_work = F.exists(rest, lambda w: w.isin(EDITION_ENDS) | w.rlike("^[0-9]+$"))
        return (n - broken >= 5) & (m >= n) & ~other_work & near(short, fx, start, fy)

    same = (
        near(words_a, fold_a, words_b, fold_b)
        | (cut_a & head(words_a, fold_a, na, words_b, fold_b, nb))
        | (cut_b & head(words_b, fold_b, nb, words_a, fold_a, na))
    )
    if by_hand:
        same = same | head(words_a, fold_a, na, words_b, fold_b, nb, 0)
    return (fold_a == fold_b) | same


#: Bytes of a sketch before its words: counts of 26 letters (half a byte each), cut, length without blanks (two bytes); 256 bits of three-byte pieces.
_HEAD = 48
#: Titles of more words are not ruled out by their words.
_LONG = 64
_LETTERS = np.uint64((1 << 26) - 1)


def _pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number under 256 for the three bytes from each place on."""
    x, last = data.astype(np.uint32), len(data) - 1
    mixed = (x[np.minimum(at, last)] * np.uint32(40503) ^ x[np.minimum(at + 1, last)] * np.uint32(2654435761)) * np.uint32(5) ^ x[np.minimum(at + 2, last)] * np.uint32(2246822519)
    return (mixed * np.uint32(2654435761)) >> np.uint32(24)


def spaced(titles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all titles with a blank after each, and where each one ends (after its blank)."""
    if not len(titles):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    joined = pc.binary_join_element_wise(pc.fill_null(titles, ""), pa.scalar("", titles.type), pa.scalar(" ", titles.type))
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(joined.type) else np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _hashed(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Spark's xxhash64 (with that seed) of the pieces of ``data`` that begin at ``at``."""
    turn = lambda x, by: (x << np.uint64(by)) | (x >> np.uint64(64 - by))
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray((len(data) - 7,), t, data, strides=(1,)) for t in ("<u8", "<u4"))
    seeds, done = np.full(len(at), seed), np.zeros(len(at), np.int64)
    h, lanes = seeds + _P5, [seeds + _P1 + _P2, seeds + _P2, seeds.copy(), seeds - _P1]
    for stripe in range(int(size.max(initial=0)) // 32):
        some = np.flatnonzero(size >= 32 * (stripe + 1))
        for i, v in enumerate(lanes):
            v[some] = turn(v[some] + eight[at[some] + 32 * stripe + 8 * i] * _P2, 31) * _P1
        done[some] += 32
    some = np.flatnonzero(done)
    if len(some):
        x = sum((turn(v[some], by) for v, by in zip(lanes, (1, 7, 12, 18))), np.zeros(len(some), np.uint64))
        for v in lanes:
            x = (x ^ turn(v[some] * _P2, 31) * _P1) * _P1 + _P4
        h[some] = x
    h += size.astype(np.uint64)
    while len(some := np.flatnonzero(size - done >= 8)):
        h[some] = turn(h[some] ^ turn(eight[at[some] + done[some]] * _P2, 31) * _P1, 27) * _P1 + _P4
        done[some] += 8
    some = np.flatnonzero(size - done >= 4)
    h[some] = turn(h[some] ^ four[at[some] + done[some]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    done[some] += 4
    while len(some := np.flatnonzero(size > done)):
        h[some] = turn(h[some] ^ data[at[some] + done[some]].astype(np.uint64) * _P5, 11) * _P1
        done[some] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, halves: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words (a blank after each; empty ones left out), by Spark's xxhash64.

    Where each begins, xxhash64(word), whether it has ``least`` letters; if so, xxhash64('head', its first letters) and
    xxhash64('tail', its last ones), else 0.
    """
    end = np.flatnonzero(data == 32)
    begin = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else end
    begin, end = begin[end > begin], end[end > begin]
    seed = np.uint64(42)
    words = _hashed(data, begin, end - begin, seed)
    letter = np.flatnonzero((data & 0xC0) != 0x80)  # where letters begin
    from_, to = np.searchsorted(letter, begin), np.searchsorted(letter, end)
    long_ = to - from_ >= least
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    salted = lambda salt: _hashed(np.frombuffer(salt, np.uint8), np.zeros(1, np.int64), np.array([len(salt)]), seed)[0]
    if long_.any():
        b, e = begin[long_], end[long_]
        head[long_] = _hashed(data, b, letter[from_[long_] + halves] - b, salted(b"head"))
        back = letter[to[long_] - halves]
        tail[long_] = _hashed(data, back, e - back, salted(b"tail"))
    return begin, words, long_, head, tail


def _sketches(titles: pa.Array, cut: pa.Array) -> pa.Array:
    """Of each title (words with blanks between): how often it has each letter (nine times at most), which pieces its letters have, and eight bytes a word.

    A word's bytes: its letters (26 bits), length (6), first, last and middle piece (8 each), a hash (7), whether it has digits (1).
    """
    n = len(titles)
    if not n:
        return pa.array([], pa.binary())
    data, ends = spaced(titles)
    sizes = np.diff(ends, prepend=0)
    row, blank = np.repeat(np.arange(n), sizes), data == 32
    head = np.zeros((n, _HEAD), np.uint8)
    letter = (data >= 97) & (data <= 122)
    counts = np.minimum(np.bincount(row[letter] * 26 + (data[letter].astype(np.int64) - 97), minlength=n * 26).reshape(n, 26), 9).astype(np.uint8)
    head[:, :13] = counts[:, :13] | counts[:, 13:] << 4
    starts = (data & 0xC0) != 0x80
    letters = np.bincount(row[starts & ~blank], minlength=n)
    head[:, 13] = cut.to_numpy(zero_copy_only=False)
    head[:, 14:16] = np.minimum(letters, 65535).astype("<u2").view(np.uint8).reshape(n, 2)
    fold, of = data[~blank], row[~blank]
    inner = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    has = np.zeros((n, 256), bool)
    has[of[inner], _pieces(fold, inner)] = True
    head[:, 16:] = np.packbits(has, axis=1, bitorder="little")
    # Every blank ends a word, which may be empty.
    end = np.flatnonzero(blank)
    begin = np.concatenate([[0], end[:-1] + 1])
    each = lambda values, f: f.reduceat(values, begin)  # noqa: E731  (with the blank at the end, which has no bits)
    bits = np.where(letter, np.left_shift(np.uint64(1), np.where(letter, data - 97, 0).astype(np.uint64)), np.uint64(0))
    size = np.minimum(each((starts & ~blank).astype(np.int64), np.add), 63).astype(np.uint64)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(begin, end - begin + 1).astype(np.uint64)
    hash_ = each(np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(2) + np.uint64(0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)), np.add)
    hash_ = (hash_ * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(57)
    digits = each(((data >= 48) & (data <= 57)).astype(np.int64), np.add) > 0
    words = each(bits, np.bitwise_or) | size << np.uint64(26)
    for shift, at in ((32, begin), (40, end - 3), (48, begin + np.maximum(end - begin - 3, 0) // 2)):
        words |= _pieces(data, np.maximum(at, 0)).astype(np.uint64) << np.uint64(shift)
    words |= hash_ << np.uint64(56) | digits.astype(np.uint64) << np.uint64(63)
    count = np.bincount(row[end], minlength=n)
    width = _HEAD + 8 * count
    offsets = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(offsets[-1] // 8, np.uint64)
    out[(offsets[:-1, None] // 8 + np.arange(_HEAD // 8)).ravel()] = head.view("<u8").ravel()
    out[np.repeat(offsets[:-1] // 8 + _HEAD // 8, count) + np.arange(len(end)) - np.repeat(np.cumsum(count) - count, count)] = words
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


class _Sketched:
    """The sketches of one side of a batch of pairs."""

    def __init__(self, sketches: pa.Array):
        _, offsets, data = sketches.buffers()
        at = np.frombuffer(offsets, np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64)
        self.data = np.frombuffer(data, "<u8", count=at[-1] // 8)
        self.at, self.n = at[:-1] // 8 + _HEAD // 8, (np.diff(at) - _HEAD) // 8
        head = self.data[(self.at - _HEAD // 8)[:, None] + np.arange(_HEAD // 8)].view(np.uint8).reshape(-1, _HEAD)
        self.counts = np.concatenate([head[:, :13] & 15, head[:, :13] >> 4], axis=1).astype(np.int16)
        self.cut, self.pieces = head[:, 13] > 0, head[:, 16:]
        self.letters = np.ascontiguousarray(head[:, 14:16]).view("<u2").astype(np.int64)[:, 0]
        self.length = self.letters + self.n - 1  # a blank between words

    def word(self, rows: np.ndarray, i: int) -> np.ndarray:
        return self.data[self.at[rows] + i]

    def has(self, rows: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (self.pieces[rows, piece >> 3] >> (piece & 7)) & 1 > 0


def _no_counterpart(words: np.ndarray, y: _Sketched, rows: np.ndarray, by_hand: bool) -> np.ndarray:
    """The word (one a row) is surely neither a word of y, nor a slip of one, nor within y's letters (nor, by hand, short for one)."""
    w = words[:, None]
    at = np.arange(int(y.n[rows].max()))
    real = at < y.n[rows][:, None]
    v = y.data[np.minimum(y.at[rows][:, None] + at, len(y.data) - 1)]
    field = lambda z, shift, bits: (z >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    nw, nv = field(w, 26, 6).astype(np.int8), field(v, 26, 6).astype(np.int8)
    longer = np.maximum(nw, nv)
    most = np.int8(1) + (longer > 4) + (longer > 8)  # see _slip_of: neither letters nor length differ by more
    slip = (np.abs(nw - nv) <= most) & (np.bitwise_count(w & ~v & _LETTERS) <= most) & (np.bitwise_count(v & ~w & _LETTERS) <= most)
    slip &= ((w | v) >> np.uint64(63) == 0) | (w >> np.uint64(56) == v >> np.uint64(56))
    if by_hand:
        slip |= (np.minimum(nw, nv) >= 3) & (field(w, 32, 8) == field(v, 32, 8))
    inside = nw[:, 0] >= 3
    for shift in (32, 40, 48):
        inside &= y.has(rows, field(w[:, 0], shift, 8).astype(np.int64))
    return ~(inside | (slip & real).any(axis=1))


def _may_be_same(a: pa.Array, b: pa.Array, by_hand: bool = False) -> np.ndarray:
    if not len(a):
        return np.zeros(0, bool)
    x, y = _Sketched(a), _Sketched(b)
    missing = lambda p, q: np.maximum(p.counts - q.counts, 0).sum(axis=1)
    over_x, over_y = missing(x, y), missing(y, x)
    shorter = np.minimum(x.letters, y.letters) if by_hand else np.minimum(x.length, y.length)
    few = np.minimum(over_x, over_y) <= np.maximum(shorter / 8, 4)
    letters = (np.maximum(over_x, over_y) <= 3) & (np.abs(x.letters - y.letters) <= 3)
    sure = letters | (np.maximum(x.n, y.n) > _LONG)
    alive = few & ~sure
    for p, q, hand in ((x, y, False), (y, x, by_hand)):
        for i in range(int(p.n[alive].max(initial=0))):
            # A cut end lacks its last word and all that follow in the other title; by hand, a subtitle may be left out.
            excused = (p.cut & (i == p.n - 1)) | (q.cut & (i >= q.n - 1)) | (hand & (i >= q.n))
            rows = np.flatnonzero(alive & (i < p.n) & ~excused)
            if len(rows):
                alive[rows[_no_counterpart(p.word(rows, i), q, rows, by_hand)]] = False
    return few & (sure | alive)


def title_sketch(words: Column, cut: Column) -> Column:
    """What ``may_be_same`` asks of a title, given as its words with blanks between."""

    @F.arrow_udf("binary")
    def sketch(w: pa.Array, c: pa.Array) -> pa.Array:
        return _sketches(w, c)

    return sketch(words, cut)


def may_be_same(a: Column, b: Column, by_hand: bool = False) -> Column:
    """False for titles that ``same_title`` (for all pairs that have few letters exchanged) tells apart, by sketches alone; true for a few of those, too.

    Few letters exchanged means small slips only: of one of the titles all letters but an eighth of the shorter one's (or four) are in the
    other, wherever they stand. Swapped letters, divided words, abbreviations and cut ends exchange no letter at all; a changed one
    counts once. Then each word needs one in the other title that has about the same letters, or its pieces must be among the other's.
    """

    @F.arrow_udf("boolean")
    def may(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(_may_be_same(x, y, by_hand))

    return may(a, b)


def frequent_words(words: DataFrame, column: str, share: float) -> tuple[DataFrame, list[str], list[str]]:
    """(word, df) of all rows; words in at least ``share`` of the rows, the scarcest first; those of them in at least a tenth of the rows (and 100).

    At most (mean words a row) / ``share`` words can be that frequent, however many rows there are: that bounds what the
    driver gets.
    """
    counts = words.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = words.count()
    often = counts.filter(F.col("df") >= max(3.0, share * n)).collect()
    return counts, [r.word for r in sorted(often, key=lambda r: (r.df, r.word))], sorted(r.word for r in often if r.df >= max(100.0, 0.1 * n))
