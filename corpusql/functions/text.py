"""Column expressions for identifiers, dates and titles. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the wide sense, and punctuation that may close an identifier.
SPACE = r"\s   -​    　﻿"
CLOSING = r".,;:!?)\]}>'\"’”"

# Latin letters with marks and their base letters, position by position.
MARKED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśşšťţùúûüūůűýÿźżž"
PLAIN_ = "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"

DAY_US = 86_400_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(as_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_closing(c: Column | str) -> Column:
    """Without surrounding white space and closing punctuation."""
    return F.regexp_replace(as_col(c), f"^[{SPACE}]+|[{SPACE}{CLOSING}]+$", "")


def bare_doi(c: Column | str) -> Column:
    """Lower case from ``10.`` on, without white space and closing punctuation; NULL where there is none."""
    return F.nullif(strip_closing(F.regexp_extract(F.lower(as_col(c)), r"(?s)10\.[0-9].*", 0)), F.lit(""))


def clean_key(c: Column | str) -> Column:
    """A paper id: lower case, without surrounding white space and closing punctuation; NULL if empty."""
    return F.nullif(strip_closing(F.lower(as_col(c))), F.lit(""))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_col(c).cast("timestamp_ntz"))


def day_micros(c: Column | str) -> Column:
    """Start of the day, in microseconds since 1970, of a date in one of several writings; NULL if unreadable."""
    s = strip(c)
    day = F.coalesce(
        F.to_date(F.convert_timezone(None, F.lit("UTC"), F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ].*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(s)))),
        F.try_to_date(F.regexp_extract(s, r"^\d{4}-\d\d-\d\d", 0), "yyyy-MM-dd"),
        F.try_to_date(F.regexp_extract(s, r"^\d{4}/\d\d?/\d\d?", 0), "yyyy/M/d"),
        F.try_to_date(s, "d MMM yyyy"),
        F.try_to_date(s, "MMM d, yyyy"),
        F.try_to_date(s, "dd.MM.yyyy"),
    )
    return F.unix_date(day) * F.lit(DAY_US)


def instant_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO-8601 string with zone (UTC where it names none)."""
    s = strip(c)
    return F.unix_micros(F.try_to_timestamp(F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), s).otherwise(F.concat(s, F.lit("Z")))))


def strip_marks(c: Column | str) -> Column:
    """Lower-case letters without accents (precomposed or combining), soft hyphens and characters of no width."""
    gone = "\u00ad\u200b\u200c\u200d\ufeff" + "".join(map(chr, range(0x300, 0x370)))
    low = F.lower(as_col(c))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, MARKED + gone, PLAIN_))  # ASCII has none of them


def title_norm(c: Column | str) -> Column:
    """The words of a title, one blank between them: no markup, entities or accents, lower case; NULL stays NULL."""
    c = as_col(c)
    plain = F.when(c.rlike("[<&]"), F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^<>]{0,20}>", ""), r"&(#\d+|#x[0-9A-Fa-f]+|[A-Za-z]+);", " ")).otherwise(c)
    return F.trim(F.regexp_replace(strip_marks(plain), r"[^\p{L}\p{N}]+", " "))


def title_words(c: Column | str) -> Column:
    """The words of a title as an array."""
    return F.array_remove(F.split(title_norm(c), " "), "")


def fold_title(c: Column | str) -> Column:
    """A title's letters and digits alone, in lower case without accents; NULL if nothing is left."""
    return F.nullif(F.replace(title_norm(c), F.lit(" ")), F.lit(""))


def slug_title(c: Column | str) -> Column:
    """Letters a-z and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]+", " "))
