"""Noise in text from scanned pages: find it, and repair the text into continuous paragraphs and rows.

An averaged perceptron edits characters: it predicts keep, replace, delete and insert for each character of a word that
is not in the corpus vocabulary, and join, join with hyphen or part for each hyphen before a line end. A second one
tells furniture (running headers, page numbers) from text by the form of a line or span and its position on the page:
on a line of its own, between blank lines, in the middle of a sentence. Both are trained here, on clean words and
sentences of the corpus into which noise is put; the vocabulary is counted by Spark over all documents.
"""

from __future__ import annotations

import functools
import random
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.session import staged

# What scanning makes of letters and digits (noisy form, own form).
CONFUSIONS = [
    ("�", "e"), ("�", "a"), ("�", "i"), ("�", "o"), ("�", "n"), ("�", "s"), ("�", "t"), ("�", "r"), ("c", "e"), ("@", "a"), ("|", "i"), ("|", "l"), ("0", "o"), ("ri", "n"), ("†", "t"), ("5", "s"),
    ("1", "l"), ("1", "i"), ("cl", "d"), ("ii", "u"), ("9", "g"), ("rn", "m"), ("b", "h"), ("v", "y"), ("vv", "w"), ("h", "li"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("8", "B"), ("6", "b"), ("I", "l"), ("!", "l"), ("$", "s"), ("€", "e"), ("m", "rn"), ("e", "c"), ("o", "c"), ("tl", "h"), ("0", "O"), ("1", "I"), ("5", "S"),
]
# Letters that scanning makes of digits.
DIGIT_CONFUSIONS = [("I", "1"), ("l", "1"), ("|", "1"), ("i", "1"), ("o", "0"), ("O", "0"), ("g", "9"), ("q", "9"), ("S", "5"), ("s", "5"), ("B", "8"), ("Z", "2"), ("z", "2"), ("b", "6"), ("G", "6"), ("�", "0")]
HYPHENS = "-¬‐­‑"
DASHES = "–—·•~-"

#: Bounds of the samples that the perceptrons are trained on.
TRAIN_WORDS, TRAIN_PAGES, TRAIN_TITLES, EPOCHS = 4000, 500, 300, 3
#: A word belongs to the vocabulary if it has this share of all words and is there this often; at most 1 / share words can.
SHARE, LEAST = 2e-6, 3

_NUMBER = regex.compile(r"[<>~±+\-−]?\d[\d,]*(?:\.\d+)?(?:[eE][+\-−]?\d+)?[*%]?")
_ALIEN = regex.compile(r"[†�@|ﬁﬂ!$€]|\p{L}[0-9]+\p{L}|\p{L}{2,}[0-9]+$|^[0-9]+\p{L}{3,}")
_OUTER = "()[]{}<>.,;:\"'“”„‘’«»…*°%#"
_TOKEN = regex.compile(r"[^\s\-–—/‐¬­‑+=×·]+")


class Perceptron:
    """A multi-class averaged perceptron over sparse string features."""

    def __init__(self, labels: Iterable[str]):
        self.labels = list(labels)
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0

    def scores(self, features: list[str], labels: list[str] | None = None) -> dict[str, float]:
        out = dict.fromkeys(labels or self.labels, 0.0)
        for f in features:
            for label, w in self.w.get(f, {}).items():
                if label in out:
                    out[label] += w
        return out

    def predict(self, features: list[str], labels: list[str] | None = None) -> str:
        s = self.scores(features, labels)
        return max(s, key=s.get)

    def learn(self, features: list[str], truth: str, labels: list[str] | None = None) -> None:
        self._n += 1
        guess = self.predict(features, labels)
        if guess != truth:
            for f in features:
                for label, d in ((truth, 1.0), (guess, -1.0)):
                    w, key = self.w.setdefault(f, {}), (f, label)
                    self._sum[key] += (self._n - self._at[key]) * w.get(label, 0.0)
                    self._at[key] = self._n
                    w[label] = w.get(label, 0.0) + d

    def average(self) -> None:
        for f, w in self.w.items():
            for label in w:
                w[label] = (self._sum[f, label] + (self._n - self._at[f, label]) * w[label]) / max(1, self._n)
        self._sum.clear()
        self._at.clear()


@dataclass(frozen=True)
class Vocabulary:
    """What Spark counted over the clean corpus."""

    words: frozenset[str]  # as written and in lower case
    common: frozenset[str]  # written in lower case in the corpus
    compounds: frozenset[str]  # words with a hyphen of their own, lower case
    before_number: frozenset[str]
    after_number: frozenset[str]
    titles: tuple[str, ...]
    names: tuple[str, ...]
    venues: tuple[str, ...]
    sentences: tuple[str, ...]

    def known(self, word: str) -> bool:
        return word in self.words or word.lower() in self.words or bool(_NUMBER.fullmatch(word))


# --- the character editor --------------------------------------------------------------------------------------------

KEEP = "keep"


@functools.cache
def _by_noise() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for bad, good in (*CONFUSIONS, *DIGIT_CONFUSIONS):
        out[bad].append((bad, good))
    return out


def _options(word: str, i: int) -> list[tuple[str, str]]:
    """Edits that may begin at place i: (characters there, what they stand for)."""
    return [x for n in (1, 2) for x in _by_noise().get(word[i : i + n], []) if len(word[i : i + n]) == n]


def _op(bad: str, good: str) -> str:
    """The edit as operations: replace, then delete or insert."""
    return f"replace {good[0]}" + (" delete" * (len(bad) - 1)) + "".join(f" insert {c}" for c in good[1:])


def _features(word: str, i: int, vocabulary: Vocabulary, options: list[tuple[str, str]]) -> list[str]:
    pad = f"^^{word}$$"
    c, j = word[i], i + 2
    letters = sum(x.isalpha() for x in word)
    digits = sum(x.isdigit() for x in word)
    kind = "number" if digits > letters else "word"
    f = [f"c={c}", f"k={kind}", f"c={c},k={kind}", f"l={pad[j - 1]},c={c}", f"c={c},r={pad[j + 1]}", f"x={pad[j - 1 : j + 2]}", f"first={i == 0},c={c}"]
    f.append(f"alien={not (c.isalnum())}")
    f.append(f"digit-in-word={c.isdigit() and kind == 'word'}")
    f.append(f"letter-in-number={c.isalpha() and kind == 'number'}")
    some = False
    for bad, good in options:
        if vocabulary.known(word[:i] + good + word[i + len(bad) :]):
            f.append(f"known-after {_op(bad, good)}")
            some = True
    f.append(f"some-known={some}")
    return f


class Editor:
    """Edits words that are not in the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        ops = sorted({_op(*x) for x in (*CONFUSIONS, *DIGIT_CONFUSIONS)})
        self.model = Perceptron([KEEP, *ops, "join", "join-hyphen", "part"])

    def _step(self, word: str) -> tuple[float, int, str, str] | None:
        best = None
        for i in range(len(word)):
            options = _options(word, i)
            if not options:
                continue
            by_op = {_op(*x): x for x in options}
            s = self.model.scores(_features(word, i, self.vocabulary, options), [KEEP, *by_op])
            op = max(s, key=s.get)
            if op != KEEP and (best is None or s[op] - s[KEEP] > best[0]):
                best = (s[op] - s[KEEP], i, *by_op[op])
        return best

    def edit(self, word: str) -> str:
        """The word with its misread characters repaired; unchanged if it is known or nothing better is found.

        A repair must give a known word or at least remove characters that no word has.
        """
        now = word
        for _ in range(len(word)):
            if self.vocabulary.known(now):
                return now
            step = self._step(now)
            if step is None:
                break
            _, i, bad, good = step
            now = now[:i] + good + now[i + len(bad) :]
        if now != word and (self.vocabulary.known(now) or _ALIEN.search(word) and not _ALIEN.search(now)):
            return now
        return word

    def join_features(self, left: str, right: str, mark: str, gap: str) -> list[str]:
        v = self.vocabulary
        return [
            f"joined={v.known(left + right)}", f"compound={f'{left}-{right}'.lower() in v.compounds}", f"left={v.known(left)},right={v.known(right)}",
            f"mark={mark == '-'}", f"line-end={chr(10) in gap}", f"lower={right[:1].islower()}", f"and={right.lower() in ('and', 'or', 'to', 'und', 'et', 'y')}",
            f"line-end={chr(10) in gap},joined={v.known(left + right)},mark={mark == '-'}", f"and={right.lower() in ('and', 'or', 'to')},mark={mark == '-'},line-end={chr(10) in gap}",
        ]

    def joins(self, left: str, right: str, mark: str, gap: str) -> str:
        return self.model.predict(self.join_features(left, right, mark, gap), ["join", "join-hyphen", "part"])

    def train(self, rng: random.Random) -> None:
        words = sorted(w for w in self.vocabulary.words if len(w) >= 4 and w.isalpha())
        rng.shuffle(words)
        words = words[:TRAIN_WORDS]
        plain = [x for x in CONFUSIONS]
        data: list[tuple[list[str], str, list[str]]] = []
        hidden = Vocabulary(*(frozenset(),) * 5, (), (), (), ())

        def add(word: str, truth: dict[int, str], vocabulary: Vocabulary) -> None:
            for i in range(len(word)):
                options = _options(word, i)
                if options:
                    data.append((_features(word, i, vocabulary, options), truth.get(i, KEEP), [KEEP, *sorted({_op(*x) for x in options})]))

        for w in words:
            places = [(i, bad, good) for bad, good in plain for i in range(len(w)) if w.startswith(good, i)]
            if places:
                i, bad, good = rng.choice(places)
                noisy = w[:i] + bad + w[i + len(good) :]
                if not self.vocabulary.known(noisy):
                    add(noisy, {i: _op(bad, good)}, self.vocabulary)
                    alien = bad[0] in "†�@|ﬁﬂ!$€" or bad[0].isdigit()
                    # A name that no vocabulary has: only characters that no word has are wrong in it.
                    add(noisy if alien else w, {i: _op(bad, good)} if alien else {}, hidden)
            add(w.title(), {}, hidden)
            number = f"{rng.randint(1, 9999)}" if rng.random() < 0.5 else f"{rng.randint(0, 99)}.{rng.randint(0, 99):02d}"
            spots = [(i, bad, good) for bad, good in DIGIT_CONFUSIONS for i, c in enumerate(number) if c == good]
            if spots and len(number) > 2:
                i, bad, good = rng.choice(spots)
                add(number[:i] + bad + number[i + 1 :], {i: _op(bad, good)}, self.vocabulary)
            cut, gap, mark = rng.randint(2, len(w) - 2), rng.choice(["\n", " \n", " "]), rng.choice(HYPHENS)
            data.append((self.join_features(w[:cut], w[cut:], mark, gap), "join", ["join", "join-hyphen", "part"]))
        for c in sorted(self.vocabulary.compounds)[:TRAIN_WORDS]:
            left, right = c.split("-", 1)
            for gap in ("\n", " \n", " "):
                data.append((self.join_features(left, right, rng.choice(HYPHENS), gap), "join-hyphen", ["join", "join-hyphen", "part"]))
            for link in ("and", "or", "to"):
                data.append((self.join_features(left, link, "-", " "), "part", ["join", "join-hyphen", "part"]))
        for _ in range(EPOCHS):
            rng.shuffle(data)
            for x in data:
                self.model.learn(*x)
        self.model.average()


# --- furniture ----------------------------------------------------------------------------------------------------------

_CAP = r"\p{Lu}[\p{L}\p{M}’']+"
_FORMS = {
    "venue": rf"(?:(?:{_CAP}|\p{{Lu}})\.?(?: (?:of|on|and|the|de|in|for))* ?){{1,7}} ?\d{{1,3}} \((?:1[89]|20)\d\d\) \d+ ?[–—-] ?\d+",
    "slash": rf"{_CAP}(?:-{_CAP})? et al\. ?/ ?{_CAP}[^/\n()]{{2,48}}? \d{{1,3}}",
    "et-al": rf"{_CAP}(?:-{_CAP})? et al\.",
    "initial": rf"(?:\p{{Lu}}\. ?){{1,3}}{_CAP}(?:-{_CAP})?",
    "named": rf"\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}’']*(?:-{_CAP})?(?: et al\.)?: [\p{{Lu}}\d\"“][^\n]{{7,60}}",
    "upper": r"(?:[\p{Lu}\"“”'‘’(][\p{Lu}\p{N}\"“”'’(),.:?–—-]*(?: |$)){3,}",
}
_PAGES = {
    "page-word": r"\[?\(?[Pp](?:age|AGE|ág\.|\.|g\.|p\.)? ?\d{1,4}(?: (?:of|/) ?\d{1,4})?\]?\)?|[Ss]eite \d{1,4}|\d{1,4} of \d{1,4}",
    "dashed": rf"[{DASHES}] ?\d{{1,4}} ?[{DASHES}]",
    "bar": r"\d{1,4} ?\||\| ?\d{1,4}",
    "digits": r"\d{1,4}",
    "roman": r"(?=[ivxlc]{2,8}$)(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})",
}
_LINE_FORMS = {k: regex.compile(v) for k, v in (_FORMS | _PAGES).items()}
_TAIL = regex.compile(r"(?P<head>.*?\S)(?P<gap>\s+)(?P<tail>" + "|".join(_PAGES[k] for k in ("page-word", "dashed", "bar", "digits")) + r")$")
_LEAD = regex.compile(r"(?P<tail>" + "|".join(_PAGES[k] for k in ("page-word", "dashed", "bar", "digits")) + r")(?P<gap>\s{2,})(?P<head>\S.*)$")
_OPENS = regex.compile(r"\p{Lu}[\p{L}\p{M}’'-]*(?: et al\.)?: |(?:\p{Lu}\. ?){1,3}\p{Lu}")
_ISSUE = regex.compile(r"\(\d{4}\) \d")
_GAP_WIDE = regex.compile(r"\s{2,}")
LABELS = ["text", "header", "page", "header+page"]


def _form(segment: str) -> tuple[str, str]:
    """(form of the head, form of a page number at its end): names in _FORMS and _PAGES or ``none``."""
    # Cheap signs that every form has: short, all capitals, an issue, ``et al`` or the opening of a named title; a number may stand before it.
    parts = [segment, *_GAP_WIDE.split(segment, 1)[1:]]
    if not any(len(x) <= 24 or "et al" in x or _ISSUE.search(x) or _OPENS.match(x) or x == x.upper() for x in parts):
        return "none", "none"
    for name, rx in _LINE_FORMS.items():
        if rx.fullmatch(segment):
            return name, "none"
    for rx in (_TAIL, _LEAD):
        if m := rx.fullmatch(segment):
            for name in _FORMS:
                if _LINE_FORMS[name].fullmatch(m["head"]):
                    return name, "tail" if len(m["gap"]) > 1 or m["tail"].isdigit() is False else "tail1"
    return "none", "none"


def _line_features(lines: list[str], i: int, vocabulary: Vocabulary) -> list[str]:
    """Form of line i and its position on the page."""
    line = lines[i].strip()
    form, tail = _form(line)
    before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
    after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
    alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
    open_ = bool(before) and before[-1] not in ".:!?…" and bool(after)
    goes_on = after[:1].islower()
    upper = sum(c.isupper() for c in line) / max(1, sum(c.isalpha() for c in line))
    at = "only" if len(lines) == 1 else "first" if not before else "last" if not after else "inside"
    position = f"at={at},alone={alone},open={open_},on={goes_on}"
    shape = f"upper={upper > 0.8},stop={line[-1:] in '.!?'},heading={line[:1] == '#'},short={len(line) < 64},few={len(line.split()) <= 3}"
    return [f"form={form},{tail}", f"form={form},at={at}", f"form={form},{position}", position, shape, f"form={form},{shape}", f"broken={before[-1:] in HYPHENS if before else False},form={form}"]


class Furniture:
    """Tells running headers and page numbers from text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.model = Perceptron(LABELS)

    def lines(self, lines: list[str]) -> list[str]:
        """A label for each line; blank lines are text. A line of an unknown form is text."""
        out = []
        for i, line in enumerate(lines):
            line = line.strip()
            out.append("text" if not line or _form(line)[0] == "none" else self.model.predict(_line_features(lines, i, self.vocabulary)))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Furniture within a running line, where line ends became blanks: (start, end, label)."""
        found: list[tuple[int, int, str]] = []
        for m in (_INLINE if _SIGN.search(text) else _INLINE_NUMBERS).finditer(text):
            name = m.lastgroup
            start, end = m.span()
            rest, prior = text[end:], text[:start]
            if name == "et_al" and regex.match(r"\s*(?:,|\(|\d{4}|and |\))", rest) or name in ("et_al", "initial") and prior.endswith("("):
                continue
            if name in ("initial", "named") and regex.search(r"\p{Lu}[\p{L}\p{M}’']+", m.group())[0].lower() in self.vocabulary.common:
                continue
            if name in ("digits", "roman"):
                a, b = regex.search(r"([\p{L}\p{M}]+)[-¬‐­]? ?$", prior), regex.match(r" ?([\p{L}\p{M}]+)", rest)
                header = bool(found) and text[found[-1][1] : start].strip() == ""
                if not header and not (a and b and b[1][0].islower() and a[1].lower() not in self.vocabulary.before_number and b[1].lower() not in self.vocabulary.after_number):
                    continue
                if header and b and b[1].lower() in self.vocabulary.after_number:
                    continue
            label = "page" if name in ("page_word", "dashed", "bar", "digits", "roman") else "header"
            found.append((start, end, label))
        return found

    def train(self, rng: random.Random) -> None:
        v = self.vocabulary
        if not v.sentences or not v.titles:
            return
        data = []
        names, venues = v.names or ("Doe",), v.venues or ("Notes",)
        page = lambda: rng.choice(
            [f"{rng.randint(1, 999)}", "iii", "xiv", f"– {rng.randint(1, 999)} –", f"· {rng.randint(1, 99)} ·", f"- {rng.randint(1, 99)} -", f"{rng.randint(1, 999)} |", f"p. {rng.randint(1, 999)}", f"Page {rng.randint(1, 99)} of 100", f"[page {rng.randint(1, 999)}]"]
        )
        for _ in range(TRAIN_PAGES):
            words = " ".join(rng.choice(v.sentences) for _ in range(rng.randint(2, 5))).split()
            width, lines, now = rng.randint(40, 80), [], ""
            for w in words:
                if len(now) + len(w) + 1 > width and now:
                    lines.append(now)
                    now = ""
                now = f"{now} {w}".strip()
            lines.append(now)
            truth = ["text"] * len(lines)
            title, name, venue = rng.choice(v.titles), rng.choice(names), rng.choice(venues)
            header = rng.choice(
                [title.upper()[:60], f"{name}: {title[:40]}", f"{name} et al.", f"{name} et al. / {venue} {rng.randint(1, 60)}", f"{name[:1]}. {name}", f"{venue} {rng.randint(1, 60)} ({rng.randint(1990, 2024)}) {rng.randint(1, 400)}–{rng.randint(401, 900)}"]
            ).strip()
            put = rng.choice(["page", "header", "header+page", "heading", "caption", "equation", "none"])
            line = {"page": page(), "header": header, "header+page": f"{header}    {rng.randint(1, 999)}", "heading": "## Results", "caption": f"Table {rng.randint(1, 9)}", "equation": f"({rng.randint(1, 9)}.{rng.randint(1, 9)})", "none": ""}[put]
            if put != "none":
                i = rng.randint(1, len(lines))
                block = [line, *([page()] if put == "header" and rng.random() < 0.3 else [])]
                labels = [put if put in LABELS else "text", *["page"] * (len(block) - 1)]
                if rng.random() < 0.4:
                    block, labels = ["", *block, ""], ["text", *labels, "text"]
                lines[i:i], truth[i:i] = block, labels
            data += [(_line_features(lines, i, v), t) for i, t in enumerate(truth) if lines[i].strip() and _form(lines[i].strip())[0] != "none"]
        for _ in range(EPOCHS * 2):
            rng.shuffle(data)
            for x in data:
                self.model.learn(*x)
        self.model.average()


_BARE_NUMBERS = rf"(?P<digits>(?<=\s|^)\d{{1,4}}(?=\s|$))|(?P<roman>(?<=\s)(?=[ivxl]{{2,6}}\s)(?:xl|x{{0,3}})(?:ix|iv|v?i{{0,3}})(?=\s))"
_INLINE_NUMBERS = regex.compile(_BARE_NUMBERS)
#: What all furniture but bare numbers has.
_SIGN = regex.compile(rf"\(\d{{4}}\) \d|et al\.(?!,)|\p{{Lu}}[\p{{Lu}}\p{{N}}\"“”'’(),.:?–—-]*(?: |$)\p{{Lu}}|[Pp]age \d|[Pp]\. ?\d|[{DASHES}] \d|\||\p{{Lu}}\. ?\p{{Lu}}\p{{L}}|\p{{Ll}}: [\p{{Lu}}\d\"“]|\d of \d")
_INLINE = regex.compile(
    rf"(?P<venue>{_FORMS['venue']})|(?P<slash>{_FORMS['slash']}(?![\d.]))|(?P<named>(?<![\p{{L}}\[])\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}’']*(?:-{_CAP})?: [\p{{Lu}}\d\"“][^\n]{{7,39}}?(?=(?<=\p{{L}}) \p{{Ll}}|$)[^\n]{{0,30}})"
    rf"|(?P<et_al>(?<!\()(?<![\p{{L}}]){_FORMS['et-al']})|(?P<initial>(?<![\p{{L}}.°/]){_FORMS['initial']}(?! et al))|(?P<upper>(?<![\p{{L}}\"“(])(?=[^\p{{Ll}}]{{15}})(?:[\p{{Lu}}\"“”'‘’(][\p{{Lu}}\p{{N}}\"“”'’(),.:?–—-]*(?: |$)){{3,}})"
    rf"|(?P<page_word>(?<![\p{{L}}\d])(?:\[page \d{{1,4}}\]|[Pp]age \d{{1,4}}(?: of \d{{1,4}})?|[Pp]\. ?\d{{1,4}}|(?<=\s|^)\d{{1,4}} of \d{{1,4}}(?= [\p{{Ll}}]|$))(?![\d.]*\d))|(?P<dashed>(?<=\s|^)[{DASHES}] \d{{1,4}} [{DASHES}](?=\s|$))|(?P<bar>(?<=\s|^)(?:\d{{1,4}} \||\| \d{{1,4}})(?=\s|$))"
    "|" + _BARE_NUMBERS)


# --- items -----------------------------------------------------------------------------------------------------------------


class Cleaner:
    """Repairs items; holds the trained editors."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        rng = random.Random(seed)
        self.vocabulary = vocabulary
        self.editor, self.furniture = Editor(vocabulary), Furniture(vocabulary)
        self.editor.train(rng)
        self.furniture.train(rng)
        self._tokens: dict[str, str] = {}
        self._clean: set[str] = set()  # tokens that stay as they are

    def _token(self, token: str) -> str:
        """A token with its core edited; remembered, and the memory emptied when it is full."""
        new = self._tokens.get(token)
        if new is None:
            core = token.strip(_OUTER)
            if not core or self.vocabulary.known(core) or not any(c.isalnum() for c in core):
                new = token
            else:
                at = token.index(core)
                new = token[:at] + self.editor.edit(core) + token[at + len(core) :]
            if len(self._tokens) > 300_000:
                self._tokens.clear()
                self._clean.clear()
            self._tokens[token] = new
        return new

    def _words(self, text: str) -> tuple[str, bool]:
        """The text with its words edited, and whether any was."""
        strange = set(_TOKEN.findall(text)) - self._clean
        if all([self._token(t) == t for t in strange]):
            self._clean |= strange
            return text, False
        return _TOKEN.sub(lambda m: self._token(m.group()), text), True

    def _joined(self, text: str) -> tuple[str, bool]:
        out, at, broken = [], 0, False
        if not _GAP_MARK.search(text):
            return text, False
        for m in _BREAK.finditer(text):
            how = self.editor.joins(m["a"], m["b"], m["mark"], m["gap"])
            if how != "part":
                out += [text[at : m.end("a")], "-" if how == "join-hyphen" else ""]
                at, broken = m.start("b"), True
        return "".join(out) + text[at:], broken

    def text(self, text: str | None) -> tuple[str | None, list[str]]:
        """The repaired text, one paragraph a line, and the kinds of noise it had. NULL stays NULL, without noise."""
        if not text:
            return text, []
        kinds: set[str] = set()
        lines = _LINE_END.split(text)
        if len(lines) > 1:
            labels = self.furniture.lines(lines)
            for label in labels:
                kinds |= _kinds(label)
            kept: list[str] = []
            for i, (line, label) in enumerate(zip(lines, labels)):
                if label == "text":
                    kept.append(line)
                elif kept and not kept[-1].strip() and i + 1 < len(lines) and not lines[i + 1].strip():
                    kept.pop()  # the blank line before furniture belongs to it
            now = "\n".join(kept)
        else:
            parts, at = [], 0
            for start, end, label in self.furniture.spans(text):
                if start >= at:
                    kinds |= _kinds(label)
                    parts.append(text[at:start])
                    at = end
            now = _BLANKS.sub(" ", " ".join([*(p.strip() for p in parts), text[at:].strip()])) if parts else text
        # Furniture stood in the middle of a sentence or word; the blank lines around it go with it.
        tight = _TORN.sub("\n", now)
        now, broken = self._joined(tight)
        if broken:
            kinds.add("hyphenation")
        now, misread = self._words(now)
        if misread:
            kinds.add("misread")
        paragraphs = [" ".join(p.split()) for p in _PARAGRAPHS.split(now)]
        return "\n".join(p for p in paragraphs if p), sorted(kinds)

    def table(self, headers: list[str] | None, rows: list[list[str]] | None) -> tuple[list[list[str]], list[str]]:
        """The repaired rows, furniture rows left out, and the kinds of noise they had. Ragged rows stay ragged."""
        kinds: set[str] = set()
        out: list[list[str]] = []
        head = [(h or "").strip().lower() for h in headers or []]
        for row in rows or []:
            cells = [c or "" for c in (row if row is not None else [])]
            some = [c.strip() for c in cells if c.strip()]
            if head and len(cells) == len(head) and len(some) > 1:
                same = sum(c.strip().lower() == h for c, h in zip(cells, head))
                if same >= 0.6 * len(head) and same >= 2:
                    kinds.add("running_header")
                    continue
            if len(some) == 1 and len(cells) > 1:
                label = self.row_label(some[0], head)
                if label != "text":
                    kinds |= _kinds(label)
                    continue
            new = []
            for c in cells:
                joined, broken = self._joined(c)
                words, misread = self._words(joined)
                kinds |= ({"hyphenation"} if broken else set()) | ({"misread"} if misread else set())
                new.append(" ".join(words.split()) if broken or misread else c)
            out.append(new)
        return out, sorted(kinds)

    def row_label(self, cell: str, head: list[str]) -> str:
        form, tail = _form(cell)
        if form == "none" or form == "digits" and head and cell.isdigit() and len(cell) == 4:
            return "text"
        # A row with one filled cell stands between rows as a line of its own in the middle of a sentence does.
        return self.furniture.model.predict(_line_features(["a", "", cell, "", "b"], 2, self.vocabulary))


_GAP_MARK = regex.compile(rf"[{HYPHENS}](?:[ \t]*\n| )")
_LINE_END, _BLANKS, _PARAGRAPHS = regex.compile(r"\r\n|\r|\n"), regex.compile("  +"), regex.compile(r"\n[ \t]*\n+|\n(?=#)|(?<=#[^\n]*)\n")
_TORN = regex.compile(r"(?<![.!?:…\s])[ \t]*\n(?:[ \t]*\n)+(?=\p{Ll})")
_BREAK = regex.compile(rf"(?P<a>[\p{{L}}\p{{M}}\p{{N}}†�@|]+)(?P<mark>[{HYPHENS}])(?P<gap>[ \t]*\n[ \t]*| +)(?P<b>[\p{{L}}\p{{M}}\p{{N}}†�@|]+)")


def _kinds(label: str) -> set[str]:
    return {"header": {"running_header"}, "page": {"page_number"}, "header+page": {"running_header", "page_number"}}.get(label, set())


# --- Spark ------------------------------------------------------------------------------------------------------------------


def learn_vocabulary(documents: DataFrame, discovery: DataFrame, share: float = SHARE) -> Vocabulary:
    """Counts over all documents (clean text) and bounded samples of titles, names, venues and sentences to make noise from.

    What comes to the driver is bounded: at most 1 / ``share`` words of each kind, TRAIN_TITLES titles, names and venues,
    TRAIN_PAGES * 2 sentences.
    """
    text = documents.select("text").filter("text IS NOT NULL")

    # What is counted, as pattern, group and whether in lower case. A word is tried at its start alone, not again at each of its letters.
    kinds = {
        "words": (r"[\p{L}\p{M}\p{N}]*[\p{L}][\p{L}\p{M}\p{N}']*", 0, False), "compounds": (r"(?<!\p{L})\p{L}++(?:-\p{L}++)+", 0, True),
        "before": (r"(?<!\p{L})(\p{L}++) [0-9]", 1, True), "after": (r"[0-9] (\p{L}+)", 1, True),
    }

    def marked(kind: str) -> Column:
        pattern, group, lower = kinds[kind]
        found = F.regexp_extract_all(F.lower("text") if lower else F.col("text"), F.lit(pattern), F.lit(group))
        return F.transform(found, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))

    each = [marked(kind) for kind in kinds]
    counts = staged(text.select(F.explode(F.concat(*each)).alias("x")).groupBy("x.kind", "x.w").agg(F.count("*").alias("n")), "words")
    totals = counts.groupBy("kind").agg((F.sum("n") * share).alias("floor"))
    kept = counts.join(F.broadcast(totals), "kind").filter(F.col("n") >= F.greatest(F.lit(float(LEAST)), "floor")).select("kind", "w").collect()
    words, compounds, before, after = ([r.w for r in kept if r.kind == k] for k in kinds)
    sample = discovery.select("title", F.get("authors", F.lit(0)).alias("author"), "venue").filter("title IS NOT NULL").orderBy(F.xxhash64("title")).limit(TRAIN_TITLES).collect()
    names = sorted({w for r in sample for w in regex.findall(r"\p{Lu}\p{Ll}{3,}", r.author or "")})
    sentences = text.select(F.explode(F.slice(F.regexp_extract_all("text", F.lit(r"[A-Z][^.\n#$|{}]{30,160}\. "), F.lit(0)), 1, 2)).alias("s")).orderBy(F.xxhash64("s")).limit(TRAIN_PAGES * 2)
    lower = {w.lower() for w in words}
    return Vocabulary(
        frozenset(words) | frozenset(lower), frozenset(w for w in words if w[0].islower()), frozenset(c for c in compounds if c.count("-") >= 1), frozenset(before), frozenset(after),
        tuple(sorted({r.title for r in sample})), tuple(names), tuple(sorted({r.venue for r in sample if r.venue and len(r.venue) > 8})), tuple(sorted(r.s.strip() for r in sentences.collect())),
    )


ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("noise", T.ArrayType(T.StringType()))])
TABLE = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("noise", T.ArrayType(T.StringType()))])


def cleaned(text: Column, cleaner: Cleaner) -> Column:
    """STRUCT<text, noise> of a scanned text. NULL and empty texts stay as they are, without noise."""
    @F.pandas_udf(ITEM)
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([cleaner.text(t if isinstance(t, str) else None) for t in texts], columns=["text", "noise"])

    return clean(text)


def cleaned_table(headers: Column, rows: Column, cleaner: Cleaner) -> Column:
    """STRUCT<rows, noise> of a scanned table."""
    @F.pandas_udf(TABLE)
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for heads, tables in batches:
            yield pd.DataFrame(
                [cleaner.table(None if h is None else list(h), None if t is None else [None if r is None else list(r) for r in t]) for h, t in zip(heads, tables)], columns=["rows", "noise"]
            )

    return clean(headers, rows)


def clean_scans(scanned: DataFrame, results: DataFrame, cleaner: Cleaner) -> tuple[DataFrame, DataFrame]:
    """(texts, tables): src, row_key, item, text or rows, noise of every item of scanned papers and search results."""
    equations = scanned.select(F.lit("equation_context").alias("src"), F.col("scan_id").alias("row_key"), F.posexplode("equations").alias("item", "e")).select(
        "src", "row_key", "item", F.col("e.context").alias("raw")
    )
    snippets = results.select(F.lit("search_snippet").alias("src"), F.col("result_id").alias("row_key"), F.lit(0).alias("item"), F.col("snippet").alias("raw"))
    texts = equations.unionByName(snippets).withColumn("c", cleaned(F.col("raw"), cleaner)).select("src", "row_key", "item", "c.text", "c.noise")
    tables = scanned.select(F.lit("table_rows").alias("src"), F.col("scan_id").alias("row_key"), F.posexplode("ext_tables").alias("item", "t"))
    tables = tables.withColumn("c", cleaned_table(F.col("t.headers"), F.col("t.rows"), cleaner)).select("src", "row_key", "item", "c.rows", "c.noise")
    return texts, tables
