"""Sentences of texts in many languages and scripts.

Method: document-centred disambiguation. Whether a word with a period is an abbreviation is read off
its unambiguous occurrences (a word in small letters follows, or the paragraph ends there, or a common
word with a capital follows) in the same document and, where the document is silent, in the whole
corpus. A word with a capital is common if the document has it in small letters elsewhere, a proper name
if it has it with a capital inside a sentence only; an abbreviation that was learned ends its sentence
before a common word. The fixed lists come before all evidence. Terminators follow the
script: full stops of CJK need no space, dandas end Devanagari sentences, Greek asks with a semicolon,
Arabic has its own question mark, and Thai sentences are parted by spaces.

Rules: a blank line always ends a sentence, a single line break is a space; closing quotes and brackets
go with the sentence before them, a number label with the sentence after it; nothing inside a quotation
ends the sentence that reports it.

Defined cases: null, empty and blank texts give no rows; a repeated key gives the rows of each row.
Offsets are code points of the text as stored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._streams import blockwise

_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
_THAI = "ก-ฺเ-ๅ็-๎"
_MARK = re.compile(rf"[.!?…。！？｡؟।॥;;]+|(?<=[{_THAI}])\s+(?=[{_THAI}])")
_DOTTED = re.compile(r"([^\s()\[\]{}“”„«»\"‘]{1,14})\.(?=\s|$)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_FULL = set("。！？｡")
_CLOSE = set("”’»«“\"」』）)]}›‹")
#: What a quote sign may be closed by.
_QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", '"': '"', "‹": "›", "（": "）", "(": ")"}
_SIGNS = re.compile("[" + re.escape("".join(_QUOTES) + "”»“」』)）›") + "]")
#: Abbreviations known without evidence, always followed by what they belong to.
KNOWN = frozenset(
    "Dr Prof Mr Mrs Ms St Sr Sra Srta Dra Fig fig Sec No no p pp ll cf vs ca bzw Abb Nr art pág стр рис См им ул σελ εικ Βλ κ i.e e.g viz".split()
)
#: Abbreviations that may end a sentence.
MAY_END = frozenset("etc usw Ltd Inc Co Corp a.m p.m г гг д др κλπ bzgl Jr".split())
#: Words before a German ordinal, and words after one.
_BEFORE_ORDINAL = frozenset("am im vom zum zur beim der dem den des die das seit bis ab".split())
_AFTER_ORDINAL = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jh Kapitel Stock Auflage".split())
#: How a reporting clause goes on after a quotation in scripts without case.
_REPORTS = re.compile(r"と|って|उस|उन|ثم")
#: The share of evidence that must speak for an abbreviation in the corpus.
SURE = 0.9


def _follows(text: str, at: int, end: int) -> tuple[str, int]:
    """The first character after white space from ``at``, '' at the end, and where it is."""
    while at < end and text[at].isspace():
        at += 1
    return (text[at] if at < end else ""), at


_MIXED = re.compile(r"[^\W\d_]+")


def _small(text: str, at: int) -> bool:
    """Whether a word in small letters starts there; one with a capital inside is a name."""
    if at >= len(text) or not text[at].islower():
        return False
    word = _MIXED.match(text, at)
    return not word or word[0].islower() or not any(c.isupper() for c in word[0])


class _Words:
    """Which words with a capital are common in a text (small elsewhere and never a name), and which are
    names (inside a sentence with a capital, and never small)."""

    def __init__(self, text: str) -> None:
        self.text, self.all, self.seen = text, set(_MIXED.findall(text)), {}

    def common(self, at: int) -> bool:
        """Whether a common word starts there."""
        return self._kind(at) == "common"

    def name(self, at: int) -> bool:
        """Whether a name starts there."""
        return self._kind(at) == "name"

    def _kind(self, at: int) -> str:
        found = _MIXED.match(self.text, at) if self.text[at].isupper() else None
        if not found:
            return ""
        word = found[0]
        if word not in self.seen:
            small, inside = word.lower() in self.all, self._inside(word)
            self.seen[word] = "" if small == inside else "common" if small else "name"
        return self.seen[word]

    def _inside(self, word: str) -> bool:
        """Whether the word stands inside a sentence, after a word and a space."""
        t, at = self.text, self.text.find(word, 2)
        while at >= 0:
            if t[at - 1].isspace() and t[at - 2].isalnum() and not t[at + len(word) : at + len(word) + 1].isalpha():
                return True
            at = t.find(word, at + 1)
        return False


def _evidence(text: str, start: int, end: int, words: _Words, out: dict[str, list[int]]) -> None:
    """Counts per token with a period: at a paragraph's end, before a small letter, before a proper name,
    before a common word with a capital. What follows otherwise is no evidence."""
    for m in _DOTTED.finditer(text, start, end):
        after, at = _follows(text, m.end(), end)
        found = out.setdefault(m[1], [0, 0, 0, 0])
        if not after:
            found[0] += 1
        elif _small(text, at):
            found[1] += 1
        else:
            found[2] += words.name(at)
            found[3] += words.common(at)


def _paragraphs(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _pairs(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets; unmatched signs count for nothing."""
    open_at: list[int] = []
    waiting: dict[str, list[tuple[int, int]]] = {}  # by closing sign: (depth, place) of the signs it closes
    found: list[tuple[int, int]] = []
    for m in _SIGNS.finditer(text, start, end):
        i, c = m.start(), m[0]
        mine = waiting.get(c, [])
        while mine and (mine[-1][0] >= len(open_at) or open_at[mine[-1][0]] != mine[-1][1]):
            mine.pop()  # gone with a pair around it
        if mine:
            depth, place = mine.pop()
            found.append((place, i))
            del open_at[depth:]
        elif c in _QUOTES:
            for closing in _QUOTES[c]:
                waiting.setdefault(closing, []).append((len(open_at), i))
            open_at.append(i)
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _kind(token: str, own: dict[str, list[int]], known: dict[str, tuple]) -> str:
    """'listed', 'always': an abbreviation inside its sentence; 'may': it may end one; 'word': no abbreviation."""
    bare = token.rstrip(".").rpartition("-")[2]
    if bare in KNOWN:
        return "listed"
    if bare in MAY_END:
        return "may"
    if bare.isdigit():
        return "word"
    e, low, _, common = own.get(token, (0, 0, 0, 0))
    if low > e + common:
        return "always" if not e + common and (len(bare) <= 6 or low > 1) else "may"
    if e + common:
        return "word"
    e, low, name, common = (*known.get(token, (0, 0, 0)), 0)[:4]
    against = e + common
    if len(bare) > 6:
        return "word"
    # Small letters that follow speak for an abbreviation; a share with half an occurrence added to each side.
    if low + 0.5 >= SURE * (low + against + 1):
        return "always"
    # What only names follow is one ("Dr.") if the share against it is below 1 - SURE, at a confidence of 95 %.
    if against + 3 <= (1 - SURE) * (low + name + against):
        return "always"
    return "may" if low >= 0.05 * (low + name + against) > 0 else "word"


def _splits(text: str, start: int, end: int, words: _Words, own: dict[str, list[int]], known: dict[str, tuple]) -> list[int]:
    """Where sentences end inside a paragraph."""
    pairs = _pairs(text, start, end)
    closers = {b: a for a, b in pairs}
    out: list[int] = []
    _, begin = _follows(text, start, end)
    p = 0
    for m in _MARK.finditer(text, start, end):
        i, j = m.start(), m.end()
        if i < begin:
            continue
        while p < len(pairs) and pairs[p][1] < i:
            p += 1
        pair = pairs[p] if p < len(pairs) and pairs[p][0] < i else None
        mark = m[0]
        if mark[0].isspace():
            if pair is None:
                out.append(i)
                begin = j
            continue
        # closing signs belong to the sentence; a closing French quote may stand after a space
        while j < end:
            c, at = _follows(text, j, min(end, j + 2))
            if at in closers and c in _CLOSE and (at == j or c in "»«"):
                j = at + 1
            elif text[j] in "’'" and j + 1 < end and text[j + 1].isspace():
                j += 1
            else:
                break
        if pair and j <= pair[1]:
            continue
        after, at = _follows(text, j, end)
        spaced = at > j or not after
        if not after:
            out.append(j)
            break
        if pair:
            if text[pair[0]] in "(（" or _CJK.match(after) or not (after.isupper() or after.islower()):
                at_start = pair[0] == begin
                if not at_start and not (after.isupper() or after.isdigit() or after in "“„«\"¿¡(") or after in ",，、;:—–-":
                    continue
                if at_start and _REPORTS.match(text, at):
                    continue
            elif _small(text, at):
                continue
            out.append(j)
            begin = at
            continue
        if after in ",،，、;:" and not spaced:
            continue
        if mark[-1] in _FULL or mark[-1] in "।॥؟":
            if after in "—–" and spaced:
                continue
            out.append(j)
            begin = at
            continue
        if not spaced:
            if not (mark[-1] in "!?" and _CJK.match(after)):
                continue
        if mark[-1] in ";;":
            if len(mark) == 1 and i > start and _GREEK.match(text[i - 1]):
                out.append(j)
                begin = at
            continue
        if "…" in mark or mark.startswith(".."):
            if after.isupper():
                out.append(j)
                begin = at
            continue
        if mark[-1] in "!?":
            if not _small(text, at) and after not in "—–,":
                out.append(j)
                begin = at
            continue
        # one period before white space
        left = i
        while left > begin and not text[left - 1].isspace() and text[left - 1] not in "()[]{}“”„«»\"‘":
            left -= 1
        token = text[left:i]
        if not token:
            if not _small(text, at):
                out.append(j)
                begin = at
            continue
        if token.isdigit():
            if left == begin:
                continue  # a number label
            before = text[max(begin, left - 12) : left].split()
            word = re.match(r"\w+", text[at : at + 20])
            if (before and before[-1].lower() in _BEFORE_ORDINAL and len(token) <= 2) or (word and word[0] in _AFTER_ORDINAL):
                continue
        if _DEVANAGARI.match(token[-1]):
            continue
        last = token.rpartition(".")[2]
        kind = _kind(token, own, known)
        if len(last) == 1 and last.isalpha() and token.rstrip(".") not in MAY_END and (last.isupper() or len(token) == 1):
            continue
        if kind == "listed" or (kind == "always" and not words.common(at)) or _small(text, at):
            continue
        out.append(j)
        begin = at
    return out


def boundaries(text: str, known: dict[str, tuple]) -> list[tuple[int, int]]:
    """(start, end) of the sentences; ``known`` has the corpus's counts of the tokens with a period."""
    own: dict[str, list[int]] = {}
    spans, words = _paragraphs(text), _Words(text)
    for a, b in spans:
        _evidence(text, a, b, words, own)
    out = []
    for a, b in spans:
        at = a
        for cut in [*_splits(text, a, b, words, own, known), b]:
            s, e = at, cut
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
            at = cut
    return out


def _wanted(texts: list[str]) -> dict[str, list]:
    counts: dict[str, list[int]] = {}
    for t in texts:
        words = _Words(t)
        for a, b in _paragraphs(t):
            _evidence(t, a, b, words, counts)
    return {"entry": list(counts), **{c: [v[i] for v in counts.values()] for i, c in enumerate("elns")}}


def _lookup(asked: DataFrame) -> DataFrame:
    total = asked.groupBy("entry").agg(*[F.sum(c).alias(c) for c in "elns"])
    return asked.select("block", "entry").distinct().join(total, "entry").select("block", "entry", *"elns")


def _sentence_stream(docs: DataFrame, key: str, text: str, apply: Callable, schema: str) -> DataFrame:
    return blockwise(docs, key, text, _wanted, "entry string, e long, l long, n long, s long", _lookup, apply, schema)


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``key, sentence_no, start_at, end_at`` and, if asked for, ``sentence``."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "sentence_no", "start_at", "end_at", *["sentence"] * with_text]

    def apply(known: dict, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        owner, number, start, end, body = [], [], [], [], []
        for k, t in zip(keys, texts, strict=True):
            for n, (a, b) in enumerate(boundaries(t, known) if t else ()):
                owner.append(k), number.append(n), start.append(a), end.append(b)
                if with_text:
                    body.append(t[a:b])
        columns = [pa.array(owner, pa.array(keys).type if owner else None), *(pa.array(v, pa.int32()) for v in (number, start, end)), *[pa.array(body, pa.string())] * with_text]
        if not owner:
            columns[0] = pa.array(keys).slice(0, 0)
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {kind}, sentence_no int, start_at int, end_at int" + ", sentence string" * with_text
    return _sentence_stream(docs, key, text, apply, schema).withColumnRenamed("key", key)
