"""PII spans in source characters, found through disguises.

Base identifiers are matched on the text itself. Then a chain of small transducers
rewrites a copy: invisible characters vanish, homoglyphs become the ASCII characters
they imitate, at and dot disguises become ``@`` and ``.``, runs of spelled digits become
digits. Each keeps, for every character it writes, the span of source characters it
stands for. The same detectors run on the result, and what they find beyond the base
is mapped back, so every span counts code points of the text as it came.

Detectors take time in proportion to the text: each anchors at a rare character or
consumes maximal runs; whether a sign stands before a domain is read off chains of labels
that are walked once. Texts that no transducer changes are not copied.

Defined cases: null counts as empty and has no spans; a disguised span that overlaps a
base span of its kind is left out (base spans stay as they are); repeated rows give
the same spans; all input columns are kept, one named like a result is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

# Characters that imitate ASCII letters and signs, and what they imitate.
# Compatibility forms (full-width, mathematical, circled) and foreign decimal digits follow from Unicode's own tables.
LOOKALIKES = {
    "аеорсухіјѕԁһӏԛԝѵ": "aeopcyxijsdhlqwv",
    "АВЕКМНОРСТУХІЈЅ": "ABEKMHOPCTYXIJS",
    "αορνικυχτ": "aopvikuxt",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ıɡɑℓ․。‐‑–−": "igal..----",
}
INVISIBLE = "­​‌‍⁠﻿"
AT_WORDS = ("at", "arroba")
DOT_WORDS = ("dot", "punto", "punkt", "point")
PLUS_WORDS = ("plus", "más")
#: Signs that occur in prose ("at" before "point" or a spaced "."; after a word of PROSE) are a disguise only before
#: one of these endings (fixed values); all others before any ending of 2 to 24 letters.
ENDINGS = ("at", "be", "biz", "br", "ca", "ch", "co", "com", "de", "dev", "edu", "es", "eu", "fr", "gov", "info", "io", "it",
           "jp", "mx", "net", "nl", "org", "pl", "pt", "ru", "se", "test", "uk", "us")
#: Words before "dot" and after it that are prose where "at" stands alone (fixed values).
PROSE = (*AT_WORDS, *DOT_WORDS, "the", "a", "an", "that", "this", "these", "those", "each", "every", "one", "some", "any", "no", "which",
         "my", "your", "his", "her", "its", "our", "their", "polka", "quantum", "red", "blue", "black", "white", "green", "yellow",
         "tiny", "small", "little", "big", "single", "last", "first", "second")
PROSE_AFTER = (*AT_WORDS[1:], *DOT_WORDS, "and", "or", "the", "that", "then", "of", "on", "if", "was", "were", "with", "for", "from", "when", "which", "while")
DIGIT_WORDS = {
    "0": ("zero", "oh", "cero", "zéro", "null"), "1": ("one", "uno", "un", "eins"), "2": ("two", "dos", "deux", "zwei"),
    "3": ("three", "tres", "trois", "drei"), "4": ("four", "cuatro", "quatre", "vier"),
    "5": ("five", "cinco", "cinq", "fünf"), "6": ("six", "seis", "sechs"), "7": ("seven", "siete", "sept", "sieben"),
    "8": ("eight", "ocho", "huit", "acht"), "9": ("nine", "nueve", "neuf", "neun"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        if len(parts) < 4:
            continue
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _SPACED.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in run[0]) <= 15:
            yield run.span()


def detect(text: str) -> list[Span]:
    """Spans of all kinds, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in addresses(text)] + [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


class Tape:
    """A rewritten text; character i stands for source characters ``start[i]`` up to ``end[i]``."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans (in order, apart from each other); what is written stands for the whole span."""
        if not edits:
            return
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join(texts) + self.text[at:]
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])

    def replace(self, text: str) -> None:
        """The same number of characters, one for one."""
        self.text = text

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


class Homoglyphs(dict):
    """Translation of one character to the ASCII character it imitates, found once per character."""

    def __init__(self):
        super().__init__({ord(a): ord(b) for many, to in LOOKALIKES.items() for a, b in zip(many, to)})

    def __missing__(self, code: int) -> int:
        char, plain = chr(code), code
        if code >= 128:
            digit = unicodedata.decimal(char, None)
            form = unicodedata.normalize("NFKC", char)
            if digit is not None:
                plain = ord(str(digit))
            elif len(form) == 1:
                plain = ord(form) if form < "\x7f" else super().get(ord(form), code)
        self[code] = plain
        return plain


_HOMOGLYPHS = Homoglyphs()
_UNSEEN = re.compile(f"[{INVISIBLE}]+")
_words = lambda words: "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w))))
_bracketed = lambda words: rf"(?<!\s)\s*[(\[{{<]\s*(?:{_words(words)})\s*[)\]}}>]\s*"
_bare = lambda words: rf"(?<=[\w%+-])\s+(?:{_words(words)})\s+(?=[\w-])"
_tied = lambda words: rf"(?<=[A-Za-z0-9])(?:_(?:{_words(words)})_|-(?:{_words(words)})-)(?=[A-Za-z0-9])"
_DOT = re.compile(rf"{_bracketed((*DOT_WORDS, '.'))}|{_bare((*DOT_WORDS, '.'))}|{_tied(DOT_WORDS)}", re.I)
#: What disguised dots are written as until the at signs are decided; UNSURE stands for those that prose has as well.
SURE, UNSURE = "\x00", "\ufdd0"
_PROSE_DOT = re.compile(r"\s+(?:point|\.)\s+", re.I)
_LABEL = re.compile("[A-Za-z0-9-]+")
_SIGN = re.compile(rf"(?P<bracketed>{_bracketed((*AT_WORDS, '@'))})|(?P<bare>{_bare((*AT_WORDS, '@'))})|(?P<tied>{_tied(AT_WORDS)})", re.I)
#: What the labels of a chain after the first hold: a listed ending after a disguised dot; any ending after one, by how sure the dot is.
LISTED, ANY_DOT, SURE_DOT, NO_PROSE = 1, 2, 4, 8


def _ending(dot: str, label: str) -> int:
    """What a label says as the ending of a domain, by the dot before it."""
    if dot == ".":
        return 0
    low = label.lower() if len(label) <= 24 else ""
    out = LISTED if low in ENDINGS else 0
    if len(low) > 1 and low.isalpha():
        if dot == SURE:
            out |= ANY_DOT | SURE_DOT | (0 if low in PROSE_AFTER else NO_PROSE)
        elif not (label[0].isupper() and label[1].islower()):
            out |= ANY_DOT
    return out


class Chains:
    """Chains of labels and dots in a text; every label is visited once, however many signs stand before or in it."""

    def __init__(self, text: str):
        self.text, self.run, self.rest = text, (0, 0), {}

    def label(self, at: int) -> int:
        """The end of the label from ``at`` on; places are asked for from left to right."""
        if not self.run[0] <= at < self.run[1]:
            found = _LABEL.match(self.text, at)
            self.run = (at, found.end() if found else at)
        return self.run[1]

    def after(self, end: int) -> int:
        """What the labels hold that follow one that ends at ``end``."""
        text, rest, way, at = self.text, self.rest, [], end
        while at not in rest:
            found = _LABEL.match(text, at + 1) if text[at:at + 1] in (".", SURE, UNSURE) else None
            if found is None:
                rest[at] = 0
                break
            way.append((at, _ending(text[at], found[0])))
            at = found.end()
        have = rest[at]
        for at, here in reversed(way):
            have = rest[at] = have | here
        return rest[end]


def at_signs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of disguised at signs in a text whose disguised dots are marked: those before a chain that may be a domain."""
    chains, at = Chains(text), 0
    while found := _SIGN.search(text, at):
        start, end = found.span()
        stop = chains.label(end)
        if end == stop:
            sign = False
        elif found["bracketed"]:
            sign = text[stop:stop + 1] in (".", SURE, UNSURE)
        else:
            have = chains.after(stop)
            if found["tied"]:
                sign = have & (LISTED | SURE_DOT)
            elif found["bare"].strip().lower() != AT_WORDS[0]:
                sign = have & (LISTED | ANY_DOT)
            else:
                prose = text[stop:stop + 1] in (SURE, UNSURE) and text[end:stop].lower() in PROSE
                sign = have & (LISTED if prose else LISTED | NO_PROSE)
        if sign:
            yield start, end
        at = end if sign else start + 1


_DIGIT_OF = {w: d for d, words in DIGIT_WORDS.items() for w in words}
_SPELLED = re.compile(rf"(?<!\w)(?:{_words(_DIGIT_OF)})(?:[\s,-]+(?:{_words(_DIGIT_OF)}))*(?!\w)", re.I)
_DIGIT_WORD = re.compile(rf"{_words(_DIGIT_OF)}", re.I)
_BESIDE = re.compile(f"[0-9{SURE}{UNSURE}]")
_PLUS = re.compile(rf"(?<!\w)(?:{_words(PLUS_WORDS)})\s+(?=[0-9(])", re.I)
_MAY_DOT = re.compile(rf"{_words(DOT_WORDS)}|[(\[{{<]\s*\.|\s\.\s", re.I)


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits in runs of three or more, or next to a digit or a dot; the gaps within a run are dropped."""
    out: list[tuple[int, int, str]] = []
    for run in _SPELLED.finditer(text):
        found = list(_DIGIT_WORD.finditer(text, run.start(), run.end()))
        if len(found) < 3 and not _BESIDE.search(text[max(run.start() - 2, 0):run.start()] + text[run.end():run.end() + 2]):
            continue
        for word, after in zip(found, [*found[1:], None]):
            digit = _DIGIT_OF[word[0].lower()]
            out.append((word.start(), word.end(), digit))
            if after:
                out.append((word.end(), after.start(), ""))
    return out


def rewrite(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.edit([(*m.span(), "") for m in _UNSEEN.finditer(tape.text)])
        tape.replace(tape.text.translate(_HOMOGLYPHS))
    if _MAY_DOT.search(tape.text):  # a dot that was disguised is written as a mark until the at signs are decided
        tape.edit([(*m.span(), UNSURE if _PROSE_DOT.fullmatch(m[0]) else SURE) for m in _DOT.finditer(tape.text)])
    tape.edit([e for e in _digit_edits(tape.text) if e[0] < e[1]])
    tape.edit([(*span, "@") for span in at_signs(tape.text)])
    tape.edit([(*m.span(), "+") for m in _PLUS.finditer(tape.text)])
    if tape.start is not None:
        tape.replace(tape.text.replace(SURE, ".").replace(UNSURE, "."))
    return tape


def disguised(text: str, base: list[Span]) -> list[tuple[Span, str]]:
    """Spans in ``text`` that only its rewritten copy shows, with what they normalise to."""
    tape = rewrite(text)
    if tape.text == text:
        return []
    out = []
    for a, kind, b in detect(tape.text):
        start, end = tape.source(a, b)
        if text[start:end] != tape.text[a:b] and not any(k == kind and s < end and start < e for s, k, e in base):
            out.append(((start, kind, end), tape.text[a:b]))
    return out


RESULT = "kinds array<string>, starts array<long>, ends array<long>, added array<boolean>, normal array<string>"


def _find():
    @F.pandas_udf(RESULT)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for text in series:
                text = text or ""
                base = detect(text)
                found = sorted([(s, False, text[s[0]:s[2]]) for s in base] + [(s, True, normal) for s, normal in disguised(text, base)])
                rows.append(([KINDS[k] for (_, k, _), _, _ in found], [s[0] for s, _, _ in found], [s[2] for s, _, _ in found],
                             [a for _, a, _ in found], [n for _, _, n in found]))
            yield pd.DataFrame(rows, columns=["kinds", "starts", "ends", "added", "normal"])

    return find


def find_identifiers(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``spans``: array of kind, start, end (code points, end exclusive), added, normal; by start, then kind."""
    rows = docs.withColumn("__found", _find()(F.col(text)))
    names = {"kinds": "kind", "starts": "start", "ends": "end", "added": "added", "normal": "normal"}
    zipped = F.arrays_zip(*[F.col(f"__found.{c}").alias(c) for c in names])
    return rows.withColumn("spans", F.transform(zipped, lambda s: F.struct(*[s[c].alias(n) for c, n in names.items()]))).drop("__found")
