"""Duplicates hidden by formatting differences.

Titles are streamed code point by code point through one table that says of each character whether it is
skipped and, if not, what it folds to; the kept codes go into two rolling polynomial hashes a row. No canonical
string is built. Rows with equal hashes are compared with their group's representative by two pointers that skip
the same characters.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.functions.text import bare_doi
from corpusql.operators.skew import salted_join
from corpusql.session import staged

#: Two primes below 2**31 and the bases of the hashes.
PRIMES = ((2_147_483_629, 1_000_003), (2_147_483_587, 69_621))
#: Beyond the last plane with letters everything is skipped.
_TABLE_SIZE = 0x32400


@functools.cache
def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> folded code point (0: skipped), and which code points are combining marks."""
    fold, mark = np.zeros(_TABLE_SIZE, np.uint32), np.zeros(_TABLE_SIZE, bool)
    for cp in range(1, _TABLE_SIZE):
        c = chr(cp)
        if c.isalnum():
            low = unicodedata.normalize("NFC", c).lower()
            fold[cp] = ord(low) if len(low) == 1 else cp
        elif unicodedata.combining(c):
            mark[cp] = True
    return fold, mark


@functools.cache
def _composed(base: int, mark: int) -> int:
    c = unicodedata.normalize("NFC", chr(base) + chr(mark))
    return ord(c) if len(c) == 1 else 0


def _stream(texts: pd.Series, skip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Kept, folded codes of all rows in one array, and how many each row has. Without ``skip`` every character is kept."""
    values = [t if isinstance(t, str) else "" for t in texts]
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not skip:
        return codes, sizes
    fold, mark = _fold_table()
    inside = codes < _TABLE_SIZE
    for i in np.flatnonzero(inside & mark[np.where(inside, codes, 0)]):
        j = i - 1
        while j >= 0 and codes[j] == 0:
            j -= 1
        if j >= 0 and (whole := _composed(int(codes[j]), int(codes[i]))):
            codes[j], codes[i] = whole, 0
    inside = codes < _TABLE_SIZE
    kept = np.where(inside, fold[np.where(inside, codes, 0)], 0)
    row = np.repeat(np.arange(len(values)), sizes)[kept != 0]
    return kept[kept != 0], np.bincount(row, minlength=len(values)).astype(np.int64)


def _rolling(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 62-bit polynomial hash of each row's codes."""
    n = len(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, np.int64)
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    out = np.zeros(n, np.uint64)
    for prime, base in PRIMES:
        powers = _powers(prime, base, int(sizes.max()) if n else 0)
        terms = (codes.astype(np.uint64) + np.uint64(1)) * powers[place] % np.uint64(prime)
        sums = np.zeros(n, np.uint64)
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(terms, starts[some])
        out = (out << np.uint64(31)) | (sums % np.uint64(prime))
    return out.astype(np.int64)


@functools.lru_cache(maxsize=8)
def _power_table(prime: int, base: int, size: int) -> np.ndarray:
    p = np.ones(size, np.uint64)
    for i in range(1, size):
        p[i] = int(p[i - 1]) * base % prime
    return p


def _powers(prime: int, base: int, size: int) -> np.ndarray:
    return _power_table(prime, base, 1 << max(8, size.bit_length()))


@F.pandas_udf(T.LongType())
def title_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Hash of a text's letters and digits; NULL is hashed like an empty text."""
    for texts in batches:
        yield pd.Series(_rolling(*_stream(texts, True)))


@F.pandas_udf(T.BooleanType())
def same_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Two pointers over both texts of a row, each skipping what the table skips, meet only equal characters."""
    (x, nx), (y, ny) = _stream(a, True), _stream(b, True)
    equal = nx == ny
    keep_x, keep_y = np.repeat(equal, nx), np.repeat(equal, ny)
    row = np.repeat(np.arange(len(nx)), nx)[keep_x]
    equal[row[x[keep_x] != y[keep_y]]] = False
    return pd.Series(equal)


@F.pandas_udf(T.StringType())
def letters_only(texts: pd.Series) -> pd.Series:
    """The kept characters as a string; only for rows whose hashes collided."""
    codes, sizes = _stream(texts, True)
    ends = np.cumsum(sizes)
    return pd.Series([codes[e - n : e].tobytes().decode("utf-32-le") for e, n in zip(ends, sizes)], dtype=object)


def format_classes(records: DataFrame, id_col: str = "id", same: tuple[str, ...] = ("type",), text: str = "title", doi: str = "doi") -> DataFrame:
    """One row a record: ``id``, ``keep_id`` (the smallest id of its class) and ``n_copies`` (records of the class).

    A class shares the ``same`` columns (NULL equals NULL), the text by letters and digits alone and the bare DOI or
    none. Empty and NULL texts are equal to each other. Ids are unique; rows with a NULL id are left out. An empty
    table gives no rows. Further columns are ignored, whatever their names.
    """
    keys = [f"k{i}" for i in range(len(same))]
    rows = staged(
        records.filter(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in zip(same, keys)),
            F.col(text).alias("text"),
            F.coalesce(bare_doi(doi), F.lit("")).alias("doi"),
            title_hash(F.col(text)).alias("h"),
        ),
        "formats",
    )
    by = [*keys, "h", "doi"]
    groups = rows.groupBy(*by).agg(F.min(F.struct("id", "text")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = salted_join(rows, groups, by, ["id"]).select(
        "id", *by, "text", F.col("first.id").alias("first_id"), (F.col("id") == F.col("first.id")) | same_letters("text", "first.text"), "n"
    ).toDF("id", *by, "text", "first_id", "is_same", "n")
    seen = staged(seen.select("id", *by, "first_id", "is_same", F.when(~F.col("is_same"), F.col("text")).alias("text")), "verified")
    # Rows whose letters differ although the hashes are equal form classes of their own.
    odd = seen.filter(~F.col("is_same")).withColumn("letters", letters_only("text"))
    odd_first = odd.groupBy(*by, "letters").agg(F.min("id").alias("keep_id"))
    odd = odd.join(odd_first, [*by, "letters"]).select("id", "keep_id")
    pairs = seen.filter("is_same").select("id", F.col("first_id").alias("keep_id")).unionByName(odd)
    sizes = pairs.groupBy("keep_id").agg(F.count("*").alias("n_copies"))
    pairs = salted_join(pairs, sizes, ["keep_id"], ["id"])
    single = rows.select("id").join(pairs.select("id"), "id", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"))
    return pairs.select("id", "keep_id", "n_copies").unionByName(single)


def format_copies(records: DataFrame, **options: object) -> DataFrame:
    """keep_id, copy_id of every record that is a copy of another one (the columns of format_classes apply)."""
    return format_classes(records, **options).filter("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
