"""Personal information inside free text: find it, and write typed placeholders in its place.

Finding is by the forms of each kind; names come from a list that Spark learns from author fields. Numbers and dates
are permuted within their form by a keyed Feistel network, check characters and dates kept valid, so that equal values, however
laid out, stay equal (and linked) in all documents while the text stays readable; other values get a keyed tag.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.functions.text import strip_marks

# The words that come before personal numbers.
ID_CUES = [
    r"social security", r"ssn", r"passport", r"reisepass", r"pasaporte", r"passeport", r"travel document", r"identity card", r"id card", r"identity number",
    r"identity document", r"national id", r"national identity", r"personalausweis", r"dni", r"nie", r"nif", r"national insurance", r"ni number", r"ni no",
    r"nino", r"insurance number", r"insurance no", r"health insurance", r"tax id", r"tax number", r"tax no", r"tax file", r"taxpayer", r"taxpayer id", r"tin", r"steuer-?id",
    r"steuernummer", r"steueridentifikationsnummer", r"personal number", r"personal no", r"personal identity", r"personal id", r"personnummer", r"civil registry",
    r"registry number", r"registry no", r"population register", r"resident registration", r"sozialversicherungsnummer", r"seguridad social", r"sécurité sociale",
    r"carte d'identité", r"nhs", r"身份证", r"护照",
]
# Forms of personal numbers.
ID_FORMS = [
    r"\d{3}-\d{2}-\d{4}", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]", r"\d{2} \d{3} \d{3} \d{3}", r"(?:\d{2})?\d{6}[-+ ]?\d{4}", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{8}[- ]?[A-Z]",
    r"[A-Z]{1,3} ?\d{6,9}", r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?", r"\d{3} \d{3} \d{3,4}", r"\d{17}[\dXx]", r"\d[\d.\- ]{4,16}\d",
]
# Forms of telephone numbers.
PHONE_FORMS = [
    r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){1,6}\d", r"\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}", r"\d{3}[.\-]\d{3}[.\-]\d{4}", r"0\d(?:[ .]\d{2}){4}", r"0\d{3,4}[ /\-]\d{5,7}",
    r"\d{3} \d{3} \d{4}", r"1[.\-]\d{3}[.\-]\d{3}[.\-]\d{4}",
]
# Words for streets, before and after the name.
STREET_AFTER = r"Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Drive|Dr|Court|Ct|Close|Terrace|Boulevard|Blvd|Square|Crescent|Way|Row|Place"
STREET_BEFORE = r"rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|route|Rue|Avenue|Boulevard|Place|Chemin|All[ée]e|Impasse|Quai|Route"
STREET_SOUTH = r"Calle|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua|calle|avenida|plaza|paseo|via|viale|rua"
STREET_END = r"stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|damm|ufer|ring"
PARTICLES = r"von der|von dem|von|van der|van den|van de|van|de la|de los|de|del|della|di|da|dos|du|la|le|af|zu|ter|ten|bin|al|el"

_EMAIL = regex.compile(
    r"""(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}](?:[\p{L}\p{N}._%+\-]*[\p{L}\p{N}_])?
    (?:[@＠]|\ ?[\[({<]\ ?(?:at|AT|At|@|arroba)\ ?[\])}>]\ ?|\ (?:at|AT|arroba)\ (?=[\p{L}\p{N}\-]+(?:\ (?:dot|DOT)\ |\ ?[\[({]\ ?(?:dot|DOT)\ ?[\])}]\ ?)))
    [\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?
    (?:(?:\.|\ ?[\[({<]\ ?(?:dot|DOT|Dot|punto|\.)\ ?[\])}>]\ ?|\ (?:dot|DOT|punto)\ )[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)*
    (?:\.|\ ?[\[({<]\ ?(?:dot|DOT|Dot|punto|\.)\ ?[\])}>]\ ?|\ (?:dot|DOT|punto)\ )\p{L}{2,}(?![\p{L}\p{N}])""",
    regex.VERBOSE,
)
_ID = regex.compile(
    r"(?<![\p{L}\p{N}])(?:(?i:" + "|".join(ID_CUES) + r"))(?:[\s:：#.]|(?i:number|numbers|card|code|document|no\b|nr\b|nº|n°|num\b|nummer|is|ist|número|id\b))*"
    r"[:：#]?\s*\(?(?P<v>" + "|".join(ID_FORMS) + r")(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}])(?P<v>[A-Z]{2} \d{2} \d{2} \d{2} [A-D])(?![\p{L}\p{N}])"
)
_PHONE = regex.compile(r"(?<![\p{L}\p{N}.\-/+(§])(?:" + "|".join(PHONE_FORMS) + r")(?![\p{L}\p{N}]|[\-.]\d)", regex.ASCII)
# What every match of the longer patterns has: quick to look for.
_DIGIT = regex.compile(r"\d")
_AT = regex.compile(r"[@＠]|(?i:[\[({<] ?at ?[\])}>]| at [\p{L}\p{N}\-]+(?: dot | ?[\[({])|arroba)")
_CUE = regex.compile(
    r"(?<![\p{L}\p{N}])(?i:social|ssn|passport|pasaporte|passeport|reisepass|travel|identi|id card|national|personal|personnummer|dni|ni[efn]|ni n|insurance|sozial|tax|tin|steuer"
    r"|civil|health|registry|population|resident|seguridad|sécurité|carte|nhs|身份证|护照)|[A-Z]{2} \d{2} \d{2}"
)
_GAP = r"(?:[ \t\u00a0]+|[ \t]*\r?\n[ \t]*)"
_NAME = r"\p{Lu}[\p{L}\p{M}’']+(?:-\p{Lu}[\p{L}\p{M}]+)?"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:\d{{1,4}}\ ?[a-zA-Z]?,?{_GAP}(?:(?:North|South|East|West|Old|New|Upper|Lower|N\.|S\.|E\.|W\.){_GAP})?{_NAME}(?:{_GAP}{_NAME})?{_GAP}(?:{STREET_AFTER})(?![\p{{L}}\p{{N}}])"
    rf"|\d{{1,4}}(?:\ ?(?:bis|ter|[a-zA-Z]))?,?{_GAP}(?:{STREET_BEFORE}){_GAP}(?:(?:de\ la|de|du|des){_GAP}|de\ l['’]|d['’])?{_NAME}"
    rf"|\p{{Lu}}[\p{{L}}\p{{M}}]*(?:{STREET_END})\ \d{{1,4}}\ ?[a-zA-Z]?(?![\p{{L}}\p{{N}}])"
    rf"|(?:{STREET_SOUTH}){_GAP}(?:(?:de\ la|de\ los|del|de|do|da){_GAP})?{_NAME}(?:{_GAP}{_NAME})?,?\ (?:n[º°.]\ ?)?\d{{1,4}}\ ?[a-zA-Z]?(?![\p{{L}}\p{{N}}]))"
)
_INITIALS = r"(?:\p{Lu}\.[ \u00a0]?){1,3}"
_POSSESSIVE = regex.compile(r"(?:['’]s|['’])$")


@functools.lru_cache(maxsize=100_000)
def fold_name(s: str) -> str:
    """Lower case without marks, as ``strip_marks`` folds names in Spark."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFC", s).lower())
    return "".join(c for c in s if not unicodedata.combining(c)).translate(str.maketrans("øđłı", "odli"))


class Finder:
    """Finds personal information; ``given`` and ``family`` hold folded names."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family = given, family

    def _is_family(self, name: str) -> bool:
        return any(part in self.family for part in fold_name(name).replace("’", "'").split("'")[0].split("-"))

    def _is_given(self, name: str) -> bool:
        return fold_name(_POSSESSIVE.sub("", name)) in self.given

    def _persons(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for m in _PERSON.finditer(text):
            start = m.start()
            if start >= at and (m["i"] or self._begins_name(m.group())) and (span := self._person(m, text)):
                yield span
                at = span[1]

    def _begins_name(self, word: str) -> bool:
        word = fold_name(word)
        if word in self.given or word in self.family:
            return True
        first = _POSSESSIVE.sub("", word.split("-")[0])
        return first in self.given or first in self.family

    def _person(self, m: regex.Match, text: str) -> tuple[int, int] | None:
        start = m.start()
        # Given name first, with what follows of middle names, initials and particles.
        p = _GIVEN_FIRST.match(text, start)
        while p:
            if self._is_given(p["g"]):
                if p["g2"] and not (self._is_given(p["g2"]) or self._is_family(p["f"])):
                    end = p.end("g2") if not self._is_given(p["g2"]) else None
                    return self._cut(text, start, end) if end else None
                if self._is_family(p["f"]) or not p["g2"] and not self._is_given(p["f"]) and len(p["f"]) > 3:
                    if p["g2"] and not self._is_given(p["g2"]) and self._is_family(p["g2"]):
                        return self._cut(text, start, p.end("g2"))
                    return self._cut(text, start, p.end("f"))
            break
        p = _INITIAL_FIRST.match(text, start)
        if p and self._is_family(p["f"]):
            return self._cut(text, start, p.end("f"))
        p = _FAMILY_FIRST.match(text, start)
        if p and self._is_family(p["f"]) and not self._is_given(p["f"]) and (p["c"] or p["f"].isupper() or self._is_given(p["r"])) and self._is_given(p["r"]):
            after = _GIVEN_FIRST.match(text, p.start("r"))
            if not (after and self._is_family(after["f"]) and not after["g2"]):
                return self._cut(text, start, p.end())
        p = _FAMILY_INITIAL.match(text, start)
        if p and self._is_family(p["f"]) and not self._is_given(p["f"]):
            return start, p.end()
        return None

    def _cut(self, text: str, start: int, end: int) -> tuple[int, int]:
        possessive = _POSSESSIVE.search(text, start, end)
        return start, possessive.start() if possessive else end

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of what is found, without overlaps, in the text's order."""
        taken: list[tuple[int, int, str]] = []

        def add(start: int, end: int, kind: str) -> None:
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, kind))

        if _AT.search(text):  # else the text has no address however written
            for m in _EMAIL.finditer(text):
                add(m.start(), m.end(), "email")
        if _DIGIT.search(text):
            if _CUE.search(text):
                for m in _ID.finditer(text):
                    add(*m.span("v"), "id_number")
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    add(m.start(), m.end(), "phone")
            for m in _ADDRESS.finditer(text):
                add(m.start(), m.end(), "address")
        for start, end in self._persons(text):
            add(start, end, "person")
        return sorted(taken)


_GIVEN_FIRST = regex.compile(
    rf"(?P<g>{_NAME}){_GAP}(?:(?P<g2>{_NAME}){_GAP})?(?:\p{{Lu}}\.?{_GAP}|\p{{Lu}}\.(?=\p{{Lu}}))*(?:(?:(?i:{PARTICLES})){_GAP})?(?P<f>{_NAME})"
)
_INITIAL_FIRST = regex.compile(rf"{_INITIALS}(?:{_GAP})?(?:(?:(?i:{PARTICLES})){_GAP})?(?P<f>{_NAME})")
_FAMILY_FIRST = regex.compile(rf"(?:(?:{PARTICLES}){_GAP})?(?P<f>{_NAME})(?P<c>,?){_GAP}(?P<r>{_NAME})(?:{_GAP}\p{{Lu}}\.(?!\p{{L}}))*")
_FAMILY_INITIAL = regex.compile(rf"(?P<f>{_NAME}),{_GAP}(?:\p{{Lu}}\.[ -]?)*\p{{Lu}}\.(?!\p{{L}})")
# Where a name may begin: a capitalised word, an initial or a particle before either.
_PERSON = regex.compile(rf"(?<![\p{{L}}\p{{N}}\p{{M}}’'@._-])(?:(?P<i>\p{{Lu}}\.)|\p{{Lu}}[\p{{L}}\p{{M}}’']+)")


# --- format-preserving pseudonyms ---------------------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of 0..size-1 (``back``: its inverse): a balanced Feistel network over the next even number of bits, walked until it stays inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{x}".encode(), key=key, digest_size=8).digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for i in reversed(range(rounds)) if back else range(rounds):
            a, b = (b ^ mixed(i, a), a) if back else (b, a ^ mixed(i, b))
        value = a << half | b
        if value < size:
            return value


def _digits(digits: str, key: bytes, tweak: str, back: bool) -> str:
    return f"{feistel(int(digits), 10 ** len(digits), key, tweak, back):0{len(digits)}d}" if digits else ""


def _laid_out(text: str, code: str) -> str:
    """The letters and digits of ``code`` where the text has its own."""
    new = iter(code)
    return "".join(next(new) if c.isalnum() else c for c in text)


# Country codes of two digits; 1 and 7 have one, all others three.
COUNTRIES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute_phone(text: str, key: bytes, back: bool = False) -> str:
    """A telephone number whose national digits are changed for others; country code, trunk zero and layout stay.

    All writings of a number, with or without country code and trunk zero, get the same new national digits.
    """
    digits = "".join(c for c in text if c.isdecimal())
    at = 2 if digits.startswith("00") else 0
    if text.startswith("+") or at:
        at += 1 if digits[at : at + 1] in ("1", "7") else 2 if digits[at : at + 2] in COUNTRIES else 3
        places = [i for i, c in enumerate(text) if c.isdecimal()]
        at += at < len(digits) and digits[at] == "0" and text[places[at] - 1] == "("
    elif digits.startswith("0") or len(digits) == 11 and digits.startswith("1"):
        at = 1
    own = new = digits[at:]
    while own:
        new = _digits(new, key, f"phone|{len(own)}", back)
        if all((new[0] == c) == (own[0] == c) for c in "01"):  # it still begins like a national number
            break
    return _laid_out(text, digits[:at] + new)


def _luhn(body: str) -> str:
    doubled = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(body))]
    return str(-sum(n - 9 * (n > 9) for n in doubled) % 10)


def _eleven(body: str) -> str:
    rest = -sum(int(c) * (10 - i) for i, c in enumerate(body)) % 11
    return str(rest) if rest < 10 else ""


def _eleven_ten(body: str) -> str:
    product = 10
    for c in body:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return str((11 - product) % 10)


def _letter(body: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body) % 23]


#: How personal numbers are made: n a digit, d a date's digit, k a character that stays, c the check characters, worked out from what
#: stands before them (``""``: no number has this body). The first form that a number fits, date and check characters included, is its form.
ID_MAKES = [
    ("resident", "nnnnnnddddddddnnnc", "%Y%m%d", lambda b: "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(b)) % 11]),
    ("birth", "kkddddddnnnc", "%y%m%d", lambda b: _luhn(b[2:])),
    ("birth", "ddddddnnnc", "%y%m%d", _luhn),
    ("health", "nnnnnnnnnc", None, _eleven),
    ("tax", "nnnnnnnnnnc", None, _eleven_ten),
    ("insured", "nnnnnnnnnnnnncc", None, lambda b: f"{97 - int(b) % 97:02d}"),
    ("identity", "nnnnnnnnc", None, _letter),
    ("foreigner", "knnnnnnnc", None, lambda b: _letter(str("XYZ".index(b[0])) + b[1:]) if b[0] in "XYZ" else ""),
    ("social", "nnnnnnnnn", None, lambda b: "" if b[:3] in ("000", "666") or b[0] == "9" or b[3:5] == "00" or b[5:] == "0000" else "ok"),
    ("born", "kkddddddnnnn", "%y%m%d", lambda b: "ok"),
    ("born", "ddddddnnnn", "%y%m%d", lambda b: "ok"),
    ("day", "ddddddnnnn", "%d%m%y", lambda b: "ok"),
]
_CLASS = {"n": "[0-9]", "d": "[0-9]", "k": "[0-9A-Z]", "c": "[0-9A-Z]"}
_MAKES = [(name, regex.compile("".join(_CLASS[c] for c in form)), form, date, check) for name, form, date, check in ID_MAKES]


def _day(digits: str, form: str) -> dt.date | None:
    """The date; years of two digits are those of one century."""
    try:
        day = dt.datetime.strptime(digits, form).date()
        day = day.replace(year=1900 + day.year % 100) if "%y" in form else day
    except ValueError:
        return None
    return day if day.strftime(form) == digits and 1900 <= day.year < 2100 else None


def permute_date(digits: str, form: str, key: bytes, back: bool = False) -> str:
    """A valid date changed for another one, both of 1900 to 1999 (two digits a year) or to 2099."""
    first = dt.date(1900, 1, 1)
    days = (dt.date(2000 if "%y" in form else 2100, 1, 1) - first).days
    return (first + dt.timedelta(days=feistel((_day(digits, form) - first).days, days, key, "date", back))).strftime(form)


def _picked(code: str, form: str, kind: str) -> str:
    return "".join(c for c, f in zip(code, form) if f == kind)


def _make_of(code: str) -> int | None:
    """Which of ``ID_MAKES`` a number is."""
    for i, (_, whole, form, date, check) in enumerate(_MAKES):
        if whole.fullmatch(code) and (not date or _day(_picked(code, form, "d"), date)):
            made = check(code[: len(form) - form.count("c")])
            if made == _picked(code, form, "c") if "c" in form else made:
                return i
    return None


def _stepped(code: str, make: int | None, key: bytes, back: bool) -> str:
    """The next number of the same make, its check characters made anew, or, without make, of the same shape."""
    if make is None:
        shape = regex.sub("[A-Z]", "A", regex.sub("[0-9]", "9", code))
        letters = _picked(code, shape, "A")
        digits = iter(_digits(_picked(code, shape, "9"), key, f"id|{shape}|d", back))
        at = feistel(functools.reduce(lambda v, c: v * 26 + ord(c) - 65, letters, 0), 26 ** len(letters), key, f"id|{shape}|a", back)
        new = iter("".join(chr(65 + at // 26**i % 26) for i in reversed(range(len(letters)))))
        return "".join(next(digits) if s == "9" else next(new) if s == "A" else c for c, s in zip(code, shape))
    name, _, form, date, check = _MAKES[make]
    numbers = iter(_digits(_picked(code, form, "n"), key, f"id|{name}", back))
    day = iter(permute_date(_picked(code, form, "d"), date, key, back) if date else "")
    body = "".join(next(numbers) if f == "n" else next(day) if f == "d" else c for c, f in zip(code, form) if f != "c")
    return body + (check(body).rjust(form.count("c"), "?") if "c" in form else "")


def permute_id(text: str, key: bytes, back: bool = False) -> str:
    """A personal number changed for another one of its make: dates stay dates and check characters stay right (or wrong). Layout aside, equal numbers get equal ones."""
    code = "".join(c for c in unicodedata.normalize("NFKC", text).upper() if c.isalnum())
    if len(code) != sum(c.isalnum() for c in text):
        return text
    make = _make_of(code)
    code = _stepped(code, make, key, back)
    while _make_of(code) != make:
        code = _stepped(code, make, key, back)
    return _laid_out(text, code)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """``[KIND pseudonym]``: numbers in their own form, anything else by a keyed tag of 128 bits; equal values get equal ones, however numbers
    are laid out and whatever the white space and case of the rest."""
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()} {(permute_phone if kind == 'phone' else permute_id)(value, key)}]"
    folded = " ".join(unicodedata.normalize("NFC", value).casefold().split())
    return f"[{kind.upper()} {hashlib.blake2b(folded.encode(), key=key, digest_size=16).hexdigest()}]"


# --- Spark --------------------------------------------------------------------------------------------------------

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def learned_names(authors: DataFrame, share: float = 5e-6) -> tuple[list[str], list[str]]:
    """(given, family) names, folded, from author lists (column ``authors``).

    Given names are what follows the comma of ``Family, Given``; family names what stands before it, or beside a known
    given name. Only names with at least ``share`` of all mentions are kept, hence at most 1 / ``share`` of either kind
    come to the driver, whatever the table's size.
    """
    names = authors.select(F.explode("authors").alias("name")).filter("name IS NOT NULL")
    split = F.split(F.trim("name"), r",\s*")
    pairs = names.filter(F.col("name").rlike(r"^[^,.\d]{2,},\s*[^,.\s\d]{2,}$")).select(strip_marks(split[1]).alias("g"), strip_marks(F.element_at(F.split(split[0], " "), -1)).alias("f"))

    def often(df: DataFrame, c: str) -> list[str]:
        counts = df.groupBy(c).agg(F.count("*").alias("n"))
        total = df.count()
        return [r[c] for r in counts.filter(F.col("n") >= share * total).select(c).collect()]

    given = often(pairs, "g")
    words = F.split(strip_marks(F.trim("name")), r"\s+")
    plain = names.filter(~F.col("name").rlike(r"[,.\d]")).select(words.alias("w")).filter(F.size("w") >= 2)
    first, last = F.col("w")[0], F.element_at("w", -1)
    beside = plain.select(F.when(first.isin(given) & ~last.isin(given), last).when(last.isin(given) & ~first.isin(given), first).alias("f")).filter("f IS NOT NULL")
    family = often(pairs.select("f").unionByName(beside), "f")
    return given, [f for f in family if f not in set(given)]


@functools.lru_cache(maxsize=4)
def _finder(given: frozenset[str], family: frozenset[str]) -> Finder:
    return Finder(given, family)


def found_in(text: Column, given: list[str], family: list[str]) -> Column:
    """ARRAY<STRUCT<kind, value>> of a text's personal information, values exactly as in the text."""
    g, f = frozenset(given), frozenset(family)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(g, f)
        for texts in batches:
            yield pd.Series([[{"kind": k, "value": t[a:b]} for a, b, k in finder.spans(t)] if t else [] for t in texts], dtype=object)

    return find(text)


def redacted(text: Column, given: list[str], family: list[str], key: bytes) -> Column:
    """The text with placeholders for personal information; NULL stays NULL, the rest of the text stays as it is.

    Whoever has the key can undo the numbers (``back``), so it is the caller's secret: 16 to 64 bytes.
    """
    g, f = frozenset(given), frozenset(family)

    @F.pandas_udf(T.StringType())
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(g, f)
        for texts in batches:
            out = []
            for t in texts:
                at, parts = 0, []
                for a, b, k in finder.spans(t) if t else []:
                    parts += [t[at:a], placeholder(k, t[a:b], key)]
                    at = b
                out.append("".join(parts) + t[at:] if t else t)
            yield pd.Series(out, dtype=object)

    return redact(text)
