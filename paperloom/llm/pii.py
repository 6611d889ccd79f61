"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the source text. Where a text holds disguises, a transducer also rewrites homoglyphs,
spelled digits and at/dot disguises to plain characters while noting where each came from; identifiers found in the
rewritten text are mapped back to source characters and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import rows_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9](?:[0-9 .-]*[0-9])?")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХІЈЅаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναι", "ABEKMHOPCTXIJSaeopcyxijsdhqwABEZHIKMNOPTYXovai", strict=True))
#: Characters that show nothing.
HIDDEN = "­​‌‍⁠﻿"
DIGIT_WORDS = (
    dict(zip("zero one two three four five six seven eight nine oh".split(), "01234567890", strict=True)),
    dict(zip("null eins zwei drei vier fünf sechs sieben acht neun zwo".split(), "01234567892", strict=True)),
    dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
)


def _plain(c: str) -> str | None:
    """The ASCII character that ``c`` imitates, "" if it is hidden, None if it is itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in HIDDEN:
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and "!" <= wide <= "~" else "." if c in "。｡" else None


FOLD = {c: p for c in map(chr, range(0x100, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (p := _plain(c)) is not None} | {"­": ""}


def _sequence(words: dict[str, str]) -> str:
    one = "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    return rf"\b(?:plus[\s-]+)?{one}(?:[\s,.-]{{1,3}}{one}){{3,}}\b"


#: Disguises in folded text: bracketed "at" and "dot", spelled digits.
BRACKETS = r"(?:(?<!\s)\s+)?[\[({<]\s*%s\s*[\])}>]\s*"
NAME = r"[A-Za-z0-9._%+-]+"
BRACKETED = rf"(?P<at>{BRACKETS % '(?:at|@)'})|(?P<dot>{BRACKETS % '(?:dot|[.])'})"
DISGUISE = re.compile(BRACKETED + "".join(f"|(?P<d{i}>{_sequence(w)})" for i, w in enumerate(DIGIT_WORDS)), re.IGNORECASE)
BRACKETED = re.compile(BRACKETED, re.IGNORECASE)
#: The two halves of "name at host dot tld": no host starts with an article, and one has at most 127 labels.
AT = re.compile(r"(?<!\s)\s+at\s+(?!(?:the|an?|this|that|each|every|my|your|our|his|her|its|their)\b)|@", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s++dot\s++)[A-Za-z0-9-]++){1,126}", re.IGNORECASE)
DOT = re.compile(r"\.|\s+dot\s+", re.IGNORECASE)
TLD = re.compile(r"[A-Za-z]{2,}")
#: Digits and digit words of any language in a row, of any length; they count only if an identifier comes out.
ANY_DIGIT = {w: d for words in DIGIT_WORDS for w, d in words.items()}
SPELLED = {"dot": ".", "plus": "+"} | ANY_DIGIT
TOKEN = r"(?:[0-9]++|" + "|".join(sorted(ANY_DIGIT, key=len, reverse=True)) + r")\b"
MIXED = re.compile(rf"(?<![\w.])(?:plus[\s-]+|\+\s?)?{TOKEN}(?:(?:\s++dot\s++|[\s()-]{{1,3}}|,\s?|\.){TOKEN})++", re.IGNORECASE)
PART = re.compile(r"[0-9]+|\.(?=\w)|\+|[^\W\d_]+")
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """Plain identifiers in order of start, then kind: leftmost, not overlapping within a kind. Time is linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL_SET:
            lo -= 1
        hit = DOMAIN.match(text, at + 1) if lo < at else None
        if hit:
            out.append(("email", lo, hit.end()))
        done = hit.end() if hit else at + 1
        at = text.find("@", done)
    for run in DIGITS.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        for m in IP.finditer(text, lo, hi):
            if all(int(p[-20:]) <= 255 and not p[:-20].strip("0") for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text, lo, hi):
            if m.end() - m.start() >= 12:
                d = NOT_DIGIT.sub("", m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Rewriting:
    """A text with stretches replaced, and the way from its positions back to the source's."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.at, self.source, self.stop = [0], [0], [0]
        parts, done, size = [], 0, 0
        for lo, hi, new in edits:
            for src, end, piece in ((done, None, text[done:lo]), (lo, hi, new)):
                parts.append(piece)
                self.at.append(size)
                self.source.append(src)
                self.stop.append(end)
                size += len(piece)
            done = hi
        parts.append(text[done:])
        self.at.append(size)
        self.source.append(done)
        self.stop.append(None)
        self.text = "".join(parts)

    def dots(self) -> set[int]:
        """Where replacements by a dot stand."""
        return {at for at, stop in zip(self.at, self.stop, strict=True) if stop is not None and self.text[at : at + 1] == "."}

    def back(self, lo: int, hi: int) -> tuple[int, int, bool]:
        """The source span of [lo, hi), and whether it touches a replacement."""
        i, j = bisect_right(self.at, lo) - 1, bisect_right(self.at, hi - 1) - 1
        start = self.source[i] if self.stop[i] is not None else self.source[i] + lo - self.at[i]
        stop = self.stop[j] if self.stop[j] is not None else self.source[j] + hi - self.at[j]
        return start, stop, any(self.stop[k] is not None for k in range(i, j + 1))


FOLD_RE = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")


def fold(text: str) -> Rewriting | None:
    """Homoglyphs as the characters they imitate; None if there are none."""
    try:
        if "­" not in text:
            text.encode("latin-1")
            return None
    except UnicodeEncodeError:
        pass
    edits = [(m.start(), m.end(), FOLD[m[0]]) for m in FOLD_RE.finditer(text)]
    return Rewriting(text, edits) if edits else None


def neighbours(text: str) -> bool:
    """Whether two words in a row are digits, digit words or "dot", and one is not in digits: without, no number is spelled."""
    words = WORD.findall(text.lower())
    if SPELLED.keys().isdisjoint(words):
        return False
    hit = [w in SPELLED or w.isdecimal() for w in words]
    return any(map(and_, hit, hit[1:]))


def unmask(text: str, spelled: bool = True) -> Rewriting | None:
    """Bracketed at/dot and longer runs of spelled digits as plain characters; None if there are none."""
    edits = []
    if not spelled and not any(c in text for c in "[({<"):
        return None
    for m in (DISGUISE if spelled else BRACKETED).finditer(text):
        kind = m.lastgroup
        if kind in ("at", "dot"):
            edits.append((m.start(), m.end(), "@" if kind == "at" else "."))
        else:
            words = DIGIT_WORDS[int(kind[1:])]
            plus = "+" if m[0][:4].lower() == "plus" else ""
            edits.append((m.start(), m.end(), plus + "".join(words.get(w.lower(), "") for w in WORD.findall(m[0]))))
    return Rewriting(text, edits) if edits else None


def addresses(text: str, dots: frozenset[int] | set[int]) -> list[tuple[int, int, str]]:
    """Edits of spelled at and dot. Plain "at" counts only with a dot that is spelled or stands in ``dots`` (disguised before)."""
    edits, done = [], 0
    for at in AT.finditer(text):
        spelled = at[0] != "@"
        host = HOST.match(text, at.end()) if at.start() >= done else None
        if not host:
            continue
        cuts = [m.span() for m in DOT.finditer(text, *host.span())]
        stop = host.end()
        while cuts and not TLD.fullmatch(text, cuts[-1][1], stop):
            stop = cuts.pop()[0]
        lo, before = at.start(), []
        while lo > done and text[lo - 1] in LOCAL_SET:
            lo -= 1
            if lo == done or text[lo - 1] not in LOCAL_SET:
                word = dot_before(text, lo, done)
                if word is None:
                    break
                before.append((word, lo))
                lo = word
        words = [c for c in [*before, *cuts] if c[1] - c[0] > 1]
        if not cuts or lo == at.start() or not (words or spelled and any(c[0] in dots for c in cuts)):
            continue
        if spelled and not any(c[1] - c[0] > 1 or c[0] in dots for c in cuts):
            continue
        edits += [(*c, ".") for c in words]
        if spelled:
            edits.append((*at.span(), "@"))
        done = stop
    return edits


def dot_before(text: str, at: int, done: int) -> int | None:
    """Where a spelled dot that ends at ``at`` begins, if a name stands before it."""
    j = at
    while j > done and text[j - 1].isspace():
        j -= 1
    if j == at or text[max(done, j - 3) : j].lower() != "dot":
        return None
    i = j = j - 3
    while i > done and text[i - 1].isspace():
        i -= 1
    return i if i < j and i > done and text[i - 1] in LOCAL_SET else None


def numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits of digits partly spelled or parted by spelled dots, where the whole run makes an identifier."""
    edits = []
    for m in MIXED.finditer(text):
        if m[0].upper() == m[0].lower():
            continue
        plain = "".join(SPELLED.get(w.lower(), w) for w in PART.findall(m[0]))
        if any((lo, hi) == (0, len(plain)) for _, lo, hi in find(plain)):
            edits.append((*m.span(), plain))
    return edits


def respell(text: str, dots: frozenset[int] | set[int], spelled: bool = True) -> Rewriting | None:
    """Spelled at, dot and short digit runs of a text whose brackets are already plain; None if there are none."""
    edits = addresses(text, dots) if dots or "dot" in text.lower() else []
    edits = sorted([*edits, *numbers(text)] if spelled else edits)
    kept: list[tuple[int, int, str]] = []
    for e in edits:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return Rewriting(text, kept) if kept else None


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers behind disguises, in source positions, apart from those within a span of ``base``."""
    first = fold(text)
    folded = first.text if first else text
    spelled = neighbours(folded)
    second = unmask(folded, spelled)
    plain = second.text if second else folded
    third = respell(plain, second.dots() if second else frozenset(), spelled)
    if not first and not second and not third:
        return []
    out: list[Span] = []
    for kind, lo, hi in find(third.text if third else plain):
        changed = False
        for step in (third, second, first):
            if step:
                lo, hi, touched = step.back(lo, hi)
                changed |= touched
        if changed and not any(b <= lo and hi <= e for _, b, e in base):
            out.append((kind, lo, hi))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with its spans replaced by their kind in angle brackets; spans that overlap become one of the first's kind."""
    out, done, last = [], 0, None
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if last is not None and lo < done:
            done = max(done, hi)
            continue
        out += [text[done:lo], f"<{kind.upper()}>"]
        done, last = hi, kind
    return "".join([*out, text[done:]])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def annotate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row's whole text.

    The counts and base_sha256 (over ``kind:start:end``, comma-joined) cover plain identifiers; ``spans`` lists them and
    the n_added disguised ones, by start and then kind. Positions are code points, ends exclusive. A null text counts as
    empty. Repeated rows and null keys stay; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in rows_of(batch, "text"):
                base = find(t or "")
                more = disguised(t or "", base)
                every = sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))
                kinds = [s[0] for s in base]
                row = (*map(kinds.count, KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(more))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"`{key}` {rows.schema['key'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(run, schema)


def scrub(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every identifier in its text replaced by ``<KIND>``; other columns, nulls and row counts stay."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                clean = []
                for t in part.column(at).to_pylist():
                    base = find(t) if t else []
                    clean.append(redact(t, [*base, *disguised(t, base)]) if t else t)
                yield part.set_column(at, part.schema.field(at).with_type(pa.string()), pa.array(clean, pa.string()))

    return df.mapInArrow(run, df.schema)


def recounted(df: DataFrame, text: str = "text", count: str = "n_chars") -> dict[str, Column]:
    """The column that keeps ``count`` equal to the text's length after `scrub`, if ``df`` has it; null texts keep theirs."""
    if count not in df.columns:
        return {}
    return {count: F.coalesce(F.length(text), F.col(count)).cast(df.schema[count].dataType)}
