"""Repairing text from scanned pages.

Method: every suspicious word is looked up in a trie of the corpus's vocabulary by a Levenshtein
automaton, extended by the scanner's confusions as single edits, so that all candidates within the
distance are found. A vocabulary word is kept under its half before and its half behind, so that a word
with one edit meets only tries that share a half with it; where no word is within one edit, all words of
like length are searched for two. Candidates are ranked by edits, then by the context: whether the
document has the candidate beside the same neighbour, then whether it has it at all, then by frequency. A
word is misread if its best candidate differs by confusions only and is far more common.
Page furniture is found per document: page numbers form a rising sequence in one style that ends at
the last line, headers stand at page tops and do not wrap like text. Then furniture goes, words broken
at line ends are joined (unless the corpus writes them with the mark), misread words are replaced,
and lines flow into paragraphs.

Defined cases: null, empty and blank texts have no findings, their repaired text is null or ''; a
repeated row of a path counts once; lines are cut at ``\\n`` and a carriage return belongs to no word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ._streams import blockwise, partitions, runs

#: What a scanner reads, and what stood there.
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("5", "s"), ("f", "t"), ("1", "l"), ("1", "i"), ("l", "i"), ("|", "l"), ("0", "o"), ("ri", "n"), ("cl", "d"),
    ("li", "h"), ("ii", "u"), ("rn", "m"), ("6", "b"), ("8", "b"), ("9", "g"), ("vv", "w"), ("m", "rn"), ("d", "cl"), ("2", "z"),
)
#: How much more common a word must be than what it was misread as; signs inside a word need less.
RATIO, RATIO_SIGN = 8, 2
MARKS = "-\u00ad\u2010\u00ac\u2011"
_STRIP = ".,;:!?()[]{}«»\"“”„'’‘…—–*"
_CONJUNCTIONS = frozenset("und oder bzw and or et ou y o e".split())
_CODE = re.compile(r"[A-Za-z]{1,4}-?\d{2,}|\d+[.,]?\d*$")
_WORD = re.compile(r"\S+")
#: Vocabulary words in a trie of words of like length, and slices that share the words asked for.
_SHARD, _SLICES = 20_000, 4
#: Scanned text is set in lines. A text that mostly stands in longer ones was never scanned.
WRAPPED = 110


# --- pages ------------------------------------------------------------------------------------------

_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_STYLES = (
    ("dash", re.compile(r"-\s*(\w{1,5})\s*-$")),
    ("bracket", re.compile(r"\[\s*(\w{1,5})\s*\]$")),
    ("slash", re.compile(r"(\w{1,5})\s*/\s*\w{1,5}$")),
    ("short", re.compile(r"[pPsS]\.\s*(\w{1,5})$")),
    ("word", re.compile(r"(?:[^\W\d_]|[@|\d]){4,7}\s+(\d{1,5})(?:\s+\S{2}\s+(\d{1,5}))?$")),
    ("bare", re.compile(r"(\d{1,4})$")),
    ("roman", re.compile(r"([ivxlc]{1,8})$")),
)
_TITLE_WORD = re.compile(r"[^\W\d_]{4}")
_LEADERS = re.compile(r"\.\s?\.\s?\.")
_DIGITS = str.maketrans("lI|oOsSbgzZi", "111005569221")


def _roman(s: str) -> int | None:
    if not _ROMAN.match(s):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-v if n > v else v for v, n in zip(values, [*values[1:], 0], strict=True))


def _as_roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


_STROKES = str.maketrans("l1|", "iii")


def _near(a: str, b: str) -> bool:
    """The same but for a few places."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or not a or not b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= max(1, min(len(a), len(b)) // 5)


def _number(line: str) -> list[tuple[str, int]]:
    """(style, number) readings of a line as a page number."""
    s = line.strip()
    if not s or len(s) > 24:
        return []
    out = []
    for style, pattern in _STYLES:
        m = pattern.match(s)
        if not m:
            continue
        if style == "roman":
            n = _roman(m[1])
        elif style == "word":
            n, style = int(m[1]), f"word {s.split()[0].lower()}"
        else:
            digits = m[1].translate(_DIGITS)
            n = int(digits) if digits.isdecimal() else None
            if n is None and style != "slash":
                n = _roman(m[1])
        if n is not None:
            indent = len(line) - len(line.lstrip())
            out.append((f"{style}{'-in' if style in ('bare', 'roman') and indent >= 8 else ''}", n))
    return out


def _alike(a: str, b: str) -> bool:
    """Whether two styles are the same, a misread page word included."""
    return a == b or (a.startswith("word ") and b.startswith("word ") and _near(a, b))


def _page_numbers(lines: list[str], known: dict[str, tuple] | None = None) -> list[tuple[int, int]]:
    """(line, number) of the page numbers, upwards from the last line that is not blank. A word with a
    number is one if it comes again with the number before, or if ``known`` has it from other texts."""
    at = len(lines) - 1
    while at >= 0 and not lines[at].strip("\f \r\t"):
        at -= 1
    if at < 1:
        return []
    last = lines[at].strip("\f")
    readings = _number(last)
    if last.strip() and set(last.strip()) <= set("ivxlc1|"):  # perhaps a misread roman number
        style = "roman-in" if len(last) - len(last.lstrip()) >= 8 else "roman"
        same = last.strip().translate(_STROKES)
        readings += [(style, n) for n in range(1, 100) if (style, n) not in readings and _as_roman(n).translate(_STROKES) == same]
    best: list[tuple[int, int]] = []
    for style, n in readings:
        found, want, styles = [(at, n)], n - 1, {style}
        # the gap to the next page number must be like a page (the last one may be short), so that lists
        # of numbers are no pages
        i = at - 1
        while i >= 0:
            own = [other for other, m in _number(lines[i].strip("\f")) if m == want and any(_alike(s, other) for s in styles)]
            same = bool(own)
            if not same and style.startswith("roman") and want > 0:  # strokes are easily taken for each other
                same = lines[i].strip("\f \r\t").translate(_STROKES) == _as_roman(want).translate(_STROKES)
            if same and found[-1][0] - i >= (4 if len(found) > 1 else 2):
                found.append((i, want))
                styles.update(own)
                want -= 1
            i -= 1
        if style.startswith("word ") and len(found) < 2 and not (known and known.get(header_key(last), (0,))[0] >= 2):
            continue
        if len(found) > len(best):
            best = found
    return best[::-1]


def _blank(line: str) -> bool:
    return not line.strip("\f \r\t")


def _width(lines: list[str], taken: set[int]) -> int:
    body = sorted(n for i, x in enumerate(lines) if i not in taken and x.strip() and (n := len(x.rstrip())) <= WRAPPED)
    return body[int((len(body) - 1) * 0.95)] if body else 0


def _long(lines: list[str]) -> bool:
    """Whether most of the text stands in lines too long for a page."""
    sizes = [len(x.rstrip()) for x in lines]
    return 2 * sum(n for n in sizes if n > WRAPPED) > sum(sizes)


def header_key(line: str) -> str:
    """A header's shape: how the dictionary knows it."""
    return "\x02" + re.sub(r"\d+", "9", line.strip("\f \r\t").lower())


def furniture(lines: list[str], known: dict[str, tuple] | None = None) -> set[int]:
    """Lines that are page headers, footers or page numbers. Where a text has no page numbers, headers
    are the titles that stand on top of its pages or come again; ``known`` adds titles that are headers
    of other texts and stand in the middle of a sentence here."""
    numbers = _page_numbers(lines, known)
    out = {i for i, _ in numbers}
    width = _width(lines, out)
    if not width or _long(lines):
        return out
    if numbers:
        for at, number in ((0, numbers[0][1]), *((i + 1, n + 1) for i, n in numbers[:-1])):
            end = min(len(lines), at + 4)
            while at < end and _blank(lines[at]):
                at += 1
            if at < end and at not in out and _is_header(lines, at, number, width, out):
                out.add(at)
        return out
    tops = {i for i, x in enumerate(lines) if x.startswith("\f")}
    titles = [
        i
        for i, x in enumerate(lines)
        if _TITLE_WORD.search(x) and _is_header(lines, i, -1, width, out) and _amid_text(lines, i, width)
    ]
    loose = {i for i in titles if i not in tops and i and not _interrupts(lines, i)}
    # a title that stands by itself between paragraphs must come again to the letter, numbers included
    shape = {i: header_key(lines[i]) if i not in loose else lines[i].strip("\f \r\t") for i in titles}
    first: dict[str, int] = {}
    repeated = set()
    for i in titles:
        for s in {shape[i], lines[i].strip("\f \r\t")}:
            if i - first.setdefault(s, i) >= 10:
                repeated.add(s)
    for i in titles:
        again = shape[i] in repeated or lines[i].strip("\f \r\t") in repeated
        again |= i not in loose and any(_near(shape[i], other) for other in repeated if other[:1] == "\x02")
        again |= i not in loose and bool(re.match(r"\d{1,4}\s{3,}\S|.*\S\s{3,}\d{1,4}$", lines[i].strip("\f \r\t")))  # with its page's number
        if again or i in tops or (i and i not in loose and (_breaks(lines, i) or (known and known.get(shape[i], (0,))[0] >= 2))):
            out.add(i)
    if 0 in titles and out:
        out.add(0)  # a text with headers has one on its first page, if a title stands there
    return out


def _amid_text(lines: list[str], at: int, width: int) -> bool:
    """Whether text stands before and after the line, not rows of a table."""
    for step in (-1, 1):
        i = at + step
        while 0 <= i < len(lines) and _blank(lines[i]):
            i += step
        if 0 <= i < len(lines):
            s = lines[i].strip("\f \r\t")
            if len(s) < 0.6 * width and s[-1] not in ".!?:\"”»":
                return False
    return True


def _breaks(lines: list[str], at: int) -> bool:
    """Whether a sentence goes on after the line that stood unfinished before it."""
    before, after = at - 1, at + 1
    while before >= 0 and _blank(lines[before]):
        before -= 1
    while after < len(lines) and _blank(lines[after]):
        after += 1
    if before < 0 or after >= len(lines):
        return False
    ended = lines[before].rstrip()[-1] in ".!?:\"”»"
    return not ended and len(lines[before].split()) > 3 and lines[after].strip("\f \t")[:1].islower()


def _interrupts(lines: list[str], at: int) -> bool:
    """Whether the line follows on an unfinished sentence."""
    before = at - 1
    while before >= 0 and _blank(lines[before]):
        before -= 1
    return before >= 0 and lines[before].rstrip()[-1] not in ".!?:\"”»" or at > 0 and not _blank(lines[at - 1])


def _is_header(lines: list[str], at: int, number: int, width: int, taken: set[int]) -> bool:
    line = lines[at].strip("\f\r\n")
    s = line.strip()
    embedded = re.match(r"(\S{1,6})\s{3,}\S|.*\S\s{3,}(\S{1,6})$", s)
    if embedded:
        shown = (embedded[1] or embedded[2]).translate(_DIGITS)
        if (shown.isdecimal() and int(shown) == number) or _roman((embedded[1] or embedded[2]).lower()) == number:
            return True
    if s[-1] in ".!?:,;" or s[-1] in MARKS or _LEADERS.search(s):
        return False
    letters = [c for c in s if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and len(s) <= width:
        return len(s) >= 5
    if len(s) > 0.85 * width or not letters:
        return False
    follow = at + 1
    while follow < len(lines) and (follow in taken or not lines[follow].strip("\f \r\t")):
        follow += 1
    if follow >= len(lines):
        return False
    blank_after = at + 1 < len(lines) and not lines[at + 1].strip("\f \r\t")
    word = lines[follow].split()[0]
    # a line of running text is filled up to the width: the next word would not have fitted
    return blank_after or len(line.rstrip()) + 1 + len(word) <= width - 1


# --- words ------------------------------------------------------------------------------------------


def _bare(token: str) -> str:
    return token.strip(_STRIP).lower()


@dataclass
class Broken:
    """A word that goes on after a line end: its parts, and where they are."""

    line: int
    start: int
    first: str
    next_line: int
    rest: str
    mark: str = "-"

    @property
    def joined(self) -> str:
        return _bare(self.first) + _bare(self.rest)

    @property
    def hyphened(self) -> str:
        return f"{_bare(self.first)}-{_bare(self.rest)}"


@dataclass
class Page:
    """A text with what is known of it before any word is looked up."""

    lines: list[str]
    furniture: set[int]
    broken: list[Broken] = field(default_factory=list)

    def tokens(self) -> Iterator[tuple[int, int, str]]:
        """(line, start, token) of the text lines, without the parts of broken words."""
        tails = {b.line: b.start for b in self.broken}
        heads = {b.next_line for b in self.broken}
        for i, line in enumerate(self.lines):
            if i in self.furniture:
                continue
            for n, m in enumerate(_WORD.finditer(line)):
                if (n == 0 and i in heads) or m.start() == tails.get(i):
                    continue
                yield i, m.start(), m[0]


def read(text: str, known: dict[str, tuple] | None = None) -> Page:
    lines = text.split("\n")
    page = Page(lines, furniture(lines, known))
    for i, line in enumerate(lines):
        if i in page.furniture:
            continue
        s = line.rstrip()
        if len(s) < 3 or s[-1] not in MARKS or s[-2] in MARKS or not s[-2].isalpha():
            continue
        follow, skipped = i + 1, False
        while follow < len(lines) and (follow in page.furniture or not lines[follow].strip("\f \r\t")):
            skipped |= follow in page.furniture
            follow += 1
        if follow >= len(lines) or (follow > i + 1 and not skipped):
            continue
        rest = lines[follow].split()[0]
        start = s.rfind(" ") + 1
        if rest.strip(_STRIP)[:1].isalpha() or (rest[:1] in "@|0156" and not rest.isdigit()):
            page.broken.append(Broken(i, start, s[start:-1], follow, rest, s[-1]))
    return page


# --- vocabulary -------------------------------------------------------------------------------------


def trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


_BY_SIGHT: dict[str, list[str]] = {}
for _seen, _meant in CONFUSIONS:
    _BY_SIGHT.setdefault(_meant, []).append(_seen)


def candidates(word: str, root: dict, most: int = 2) -> list[tuple[int, bool, str]]:
    """(edits, confusions only, word) of all words of the trie within ``most`` edits, where an edit is a
    deletion, insertion or substitution of a character, or a confusion. The automaton's state is the
    set of places in ``word`` with the least edits, with and without other edits than confusions."""
    n = len(word)
    out: list[tuple[int, bool, str]] = []
    start = {(i, i > 0): i for i in range(min(n, most) + 1)}

    def close(state: dict) -> dict:
        for (i, plain), e in sorted(state.items(), key=lambda x: x[0][0]):
            if e < most and i < n and state.get((i + 1, True), most + 1) > e + 1:
                state[(i + 1, True)] = e + 1
                j, f = i + 1, e + 1
                while f < most and j < n and state.get((j + 1, True), most + 1) > f + 1:
                    j, f = j + 1, f + 1
                    state[(j, True)] = f
        return state

    def walk(node: dict, state: dict, pending: list[tuple[str, dict]]) -> None:
        if "" in node:
            for plain in (False, True):
                if (n, plain) in state:
                    out.append((state[(n, plain)], not plain, node[""]))
                    break
        for c, child in node.items():
            if not c:
                continue
            nxt: dict = {}

            def put(key: tuple[int, bool], e: int, nxt: dict = nxt) -> None:
                if e <= most and nxt.get(key, most + 1) > e:
                    nxt[key] = e

            for (i, plain), e in state.items():
                if i < n and word[i] == c:
                    put((i + 1, plain), e)
                if e < most:
                    put((i, True), e + 1)
                    if i < n:
                        put((i + 1, True), e + 1)
                    for seen in _BY_SIGHT.get(c, ()):
                        if word.startswith(seen, i):
                            put((i + len(seen), plain), e + 1)
            # confusions of two characters of the vocabulary word: begun one character ago
            begun = []
            for meant, old in pending:
                if meant[0] == c:
                    for (i, plain), e in old.items():
                        if e < most:
                            for seen in _BY_SIGHT[meant[1]]:
                                if word.startswith(seen, i):
                                    put((i + len(seen), plain), e + 1)
            for meant in _BY_SIGHT:
                if len(meant) == 2 and meant[0] == c:
                    begun.append(((meant[1], meant), state))
            if nxt or begun:
                walk(child, close(nxt), begun)

    walk(root, close(start), [])
    out.sort(key=lambda x: (x[0], not x[1], x[2]))
    return out


def _suspect(word: str) -> bool:
    return word == "@" or (len(word) >= 2 and any(c.isalpha() for c in word) and not _CODE.match(word))


def _sign(word: str) -> bool:
    return any(c in "@|" or c.isdigit() for c in word)


def _wanted(texts: list[str]) -> dict[str, list]:
    """Words and headers with the number of texts that have them, and of those that were never scanned;
    the two readings of broken words, and titles that may be headers, with 0."""
    counts: dict[str, list[int]] = {}
    for t in texts:
        page = read(t)
        clean = never_scanned(page)
        seen = {_bare(w) for _, _, w in page.tokens()} | {header_key(page.lines[i]) for i in page.furniture}
        for w in seen:
            if w:
                found = counts.setdefault(w, [0, 0])
                found[0] += 1
                found[1] += clean
        for b in page.broken:
            counts.setdefault(b.joined, [0, 0])
            counts.setdefault(b.hyphened, [0, 0])
        if not clean:
            end = next((x for x in reversed(page.lines) if not _blank(x)), "")
            if any(style.startswith("word ") for style, _ in _number(end.strip("\f"))):
                counts.setdefault(header_key(end), [0, 0])
            for i, x in enumerate(page.lines):
                if 5 <= len(x.strip()) <= 60 and x.rstrip()[-1] not in ".,;!?" and (i == 0 or _interrupts(page.lines, i)):
                    counts.setdefault(header_key(x), [0, 0])
    return {"entry": list(counts), "n": [v[0] for v in counts.values()], "c": [v[1] for v in counts.values()]}


def never_scanned(page: Page) -> bool:
    return not page.furniture and _long(page.lines)


_FOUND = "entry string, fix string, fix_n long, edits int, glyph boolean"


def _search(stream: DataFrame, most: int) -> DataFrame:
    """_FOUND of ``place, kind, entry, n``: in each place the words of kind 1 against the trie of the words
    of kind 0. All candidates by confusions are given, of the others the best."""
    stream = stream.repartition(partitions(stream), "place").sortWithinPartitions("place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, root = None, {}, None
        for batch in batches:
            out: list[tuple] = []
            for place, rows in runs(batch, "place"):
                if place != now:
                    now, known, root = place, {}, None
                for kind, part in runs(rows, "kind"):
                    pairs = zip(part.column("entry").to_pylist(), part.column("n").to_pylist(), strict=True)
                    if kind == 0:
                        known.update(pairs)
                        continue
                    if not known:
                        continue
                    root = root or trie(list(known))
                    for w, n in pairs:
                        if not _suspect(w):
                            continue
                        ratio = RATIO_SIGN if _sign(w) else RATIO
                        need = max(2, n * ratio, ratio)
                        good = sorted((e, -known[v], v, g) for e, g, v in candidates(w, root, most) if v != w and known[v] >= max(2, n) and (known[v] >= need or not g))
                        best = next((c for c in good if not c[3]), None)
                        out += [(w, v, -m, e, g) for e, m, v, g in good if g or (e, m, v, g) == best]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["entry", "fix", "fix_n", "edits", "glyph"])

    return stream.mapInArrow(run, _FOUND)


def _halves(meant: DataFrame, asks: DataFrame) -> DataFrame:
    """Places for one edit. It touches two characters of either word at most, so that the word meant has
    its first or its last ceil((length - 2) / 2) characters in common with the one read, and is a character
    longer or shorter at most."""
    half = lambda n: F.ceil((n - 2) / F.lit(2)).cast("int")
    ends = lambda n: F.array(F.struct(F.lit("a").alias("side"), F.substring("entry", F.lit(1), half(n)).alias("part")), F.struct(F.lit("z").alias("side"), F.when(half(n) > 0, F.right("entry", half(n))).otherwise("").alias("part")))
    place = F.xxhash64("long", "end.side", "end.part", "slice")
    n = F.length("entry")
    words = meant.withColumn("long", n).filter("long > 0").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1)))).withColumn("end", F.explode(ends(F.greatest(F.lit(2), n))))
    sought = asks.withColumn("slice", F.pmod(F.xxhash64("entry"), F.lit(_SLICES)).cast("int")).withColumn("long", F.explode(F.sequence(F.greatest(F.lit(1), n - 1), n + 1)))
    sought = sought.withColumn("end", F.explode(ends(F.greatest(F.lit(2), F.col("long")))))
    return words.select(place.alias("place"), F.lit(0).alias("kind"), "entry", "n").unionByName(sought.select(place.alias("place"), F.lit(1).alias("kind"), "entry", "n"))


def _lengths(meant: DataFrame, asks: DataFrame) -> DataFrame:
    """Places for two edits: all words at most two characters longer or shorter, a shard at a time."""
    n = F.length("entry")
    shards = meant.groupBy(n.alias("long")).agg(F.ceil(F.count(F.lit(1)) / _SHARD).cast("int").alias("shards"))  # a row for each length
    place = F.xxhash64("long", "shard", "slice")
    words = meant.withColumn("long", n).join(shards, "long").withColumn("shard", F.pmod(F.xxhash64("entry"), F.col("shards")).cast("int"))
    words = words.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))))
    sought = asks.withColumn("long", F.explode(F.sequence(F.greatest(F.lit(1), n - 2), n + 2))).join(shards, "long")
    sought = sought.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("slice", F.pmod(F.xxhash64("entry"), F.lit(_SLICES)).cast("int"))
    return words.select(place.alias("place"), F.lit(0).alias("kind"), "entry", "n").unionByName(sought.select(place.alias("place"), F.lit(1).alias("kind"), "entry", "n"))


def corrections(words: DataFrame) -> DataFrame:
    """``entry, n, fixes`` of ``entry, n, c``: the words that are misread have all the words that may be
    meant, the most common first."""
    # Words that may be meant: letters only.
    letters = F.col("entry").rlike(r"^[\p{L}]+(['’-][\p{L}]+)*$")
    meant = words.filter(letters & (F.col("n") >= 2)).select("entry", "n")
    top = meant.agg(F.max("n")).head()[0] or 0
    # A word of letters that texts never scanned have too is a word of its own.
    own = letters & (F.col("c") > 0) & (F.col("c") * 10 >= F.col("n"))
    asks = words.filter(~own & ~F.col("entry").startswith("\x02") & (F.col("n") * F.when(letters, RATIO).otherwise(1) <= top) & (F.length("entry") > 0)).select("entry", "n")
    once = materialize(_search(_halves(meant, asks), 1), "within-one").distinct()
    twice = _search(_lengths(meant, asks.join(once, "entry", "left_anti")), 2)
    # Fewest edits, confusions before others, then the most common.
    order = F.struct(F.col("edits"), (~F.col("glyph")).alias("other"), (-F.col("fix_n")).alias("m"), F.col("fix"))
    best = once.unionByName(twice).groupBy("entry").agg(F.min(order).alias("best"), F.array_sort(F.collect_list(order)).alias("all"))
    fixes = best.filter("not best.other").select("entry", F.transform(F.filter("all", lambda x: ~x["other"] & (x["edits"] == F.col("best.edits"))), lambda x: x["fix"]).alias("fixes"))
    return words.join(fixes, "entry", "left").select("entry", "n", "fixes")


def _lookup(asked: DataFrame) -> DataFrame:
    words = materialize(asked.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    return asked.select("block", "entry").distinct().join(corrections(words), "entry").select("block", "entry", "n", "fixes")


# --- findings and repair ----------------------------------------------------------------------------


class _Context:
    """A document's words, and which stand beside which."""

    def __init__(self, page: Page) -> None:
        words = [_bare(w) for _, _, w in page.tokens()]
        self.words, self.beside = set(words), set(zip(words, words[1:], strict=False))

    def meant(self, word: str, known: dict[str, tuple], before: str = "", after: str = "") -> str | None:
        """The word meant by a misread one: of the best candidates one that the document has beside the
        same neighbour, else one that it has, else the most common."""
        fixes = known.get(word, (0, None))[1]
        if not fixes:
            return None
        return min(enumerate(fixes), key=lambda x: ((before, x[1]) not in self.beside and (x[1], after) not in self.beside, x[1] not in self.words, x[0]))[1]


def _resolve(page: Page, known: dict[str, tuple]) -> tuple[list[tuple[Broken, str | None]], list[tuple[int, int, str, str]]]:
    """Broken words to join with the word meant if misread; misread words (line, start, token, meant)."""
    own = _Context(page)
    count = lambda w: known.get(w, (0, None))[0]
    joins: list[tuple[Broken, str | None]] = []
    for b in page.broken:
        first, rest = _bare(b.first), _bare(b.rest)
        with_mark, without = count(b.hyphened), count(b.joined)
        if not first or not rest or (rest in _CONJUNCTIONS and not without):
            continue
        if with_mark > without or b.rest[:1].isdigit() and b.first.isupper():
            continue
        if not without:
            meant = own.meant(b.joined, known)
            if meant is None or "-" in meant:
                if own.meant(b.hyphened, known) or (count(first) and count(rest)) or meant:
                    continue
            joins.append((b, meant))
        else:
            joins.append((b, own.meant(b.joined, known)))
    taken = {(b.line, b.start) for b, _ in joins}
    misread = []
    tokens = [(i, start, token, _bare(token)) for i, start, token in page.tokens()]
    for at, (i, start, token, word) in enumerate(tokens):
        if (i, start) in taken or not word:
            continue
        if meant := own.meant(word, known, tokens[at - 1][3] if at else "", tokens[at + 1][3] if at + 1 < len(tokens) else ""):
            misread.append((i, start, token, meant))
    kept = {id(b) for b, _ in joins}
    for b in page.broken:  # parts that stay apart are words of a compound
        if id(b) not in kept and (meant := own.meant(b.hyphened, known)):
            at = b.line if not meant.startswith(_bare(b.first)) else b.next_line
            misread.append((at, -1, "", meant))
    return joins, misread


def findings(text: str, known: dict[str, tuple]) -> list[tuple[int, str]]:
    """(line, kind), each once."""
    page = read(text, known)
    if never_scanned(page):
        return []
    joins, misread = _resolve(page, known)
    out = {(i, "furniture") for i in page.furniture}
    out |= {(b.line, "hyphen") for b, _ in joins}
    out |= {(i, "glyph") for i, *_ in misread}
    for b, meant in joins:
        if meant:
            # the half that is unlike the word meant
            first, rest = _bare(b.first), _bare(b.rest)
            a, z = meant.startswith(first), meant.endswith(rest)
            if not a:
                out.add((b.line, "glyph"))
            if not z:
                out.add((b.next_line, "glyph"))
    return sorted(out)


def _cased(token: str, meant: str) -> str:
    core = token.strip(_STRIP)
    lead = token[: token.index(core)] if core else token
    tail = token[len(lead) + len(core) :]
    if core[:1].isupper():
        meant = meant.upper() if len(core) > 1 and core.isupper() else meant[:1].upper() + meant[1:]
    return lead + meant + tail


def repair(text: str, known: dict[str, tuple]) -> str:
    """Continuous paragraphs, parted by a blank line."""
    page = read(text, known)
    joins, misread = _resolve(page, known) if not never_scanned(page) else ([], [])
    words = [[(m.start(), m[0]) for m in _WORD.finditer(line)] for line in page.lines]
    fix = {(i, s): _cased(t, m) for i, s, t, m in misread if s >= 0}
    lines = [[fix.get((i, s), w) for s, w in ws] for i, ws in enumerate(words)]
    dropped: set[int] = set()
    for b, meant in joins:
        joined = _cased(b.first + b.rest, meant) if meant else b.first + b.rest
        if lines[b.line]:
            lines[b.line][-1] = joined
            dropped.add(b.next_line)
    for b in page.broken:
        if b.next_line not in dropped and lines[b.line] and lines[b.next_line]:
            rest = _bare(b.rest)
            if rest not in _CONJUNCTIONS:
                lines[b.line][-1] = f"{b.first}-{lines[b.next_line][0]}"
                dropped.add(b.next_line)
    paragraphs, now, after_page = [], [], False
    for i, line in enumerate(page.lines):
        if i in page.furniture:
            after_page = True
            continue
        if not line.strip("\f \r\t"):
            # a blank line beside a page's furniture is no end of a paragraph unless the text says so
            beside = after_page or any(j in page.furniture for j in (i + 1, i - 1))
            if now and not (beside and now[-1][-1:] not in ".!?:\"”»"):
                paragraphs.append(now)
                now = []
            continue
        if now and line.strip("\f")[:1].isspace() and not words_before_indented(page.lines, i):
            paragraphs.append(now)
            now = []
        after_page = False
        now += lines[i][1:] if i in dropped else lines[i]
    if now:
        paragraphs.append(now)
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def words_before_indented(lines: list[str], i: int) -> bool:
    """Whether the line before is indented too: then indentation marks no new paragraph."""
    return i > 0 and lines[i - 1].strip("\f")[:1].isspace() and bool(lines[i - 1].strip("\f \r\t"))


def _once(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(text).isNotNull()).groupBy(key).agg(F.first(text).alias(text))


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, kind``."""

    def apply(known: dict, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        rows = [(k, i, kind) for k, t in zip(keys, texts, strict=True) if t for i, kind in findings(t, known)]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["key", "line_no", "kind"])

    return blockwise(_once(docs, key, text), key, text, _wanted, "entry string, n long, c long", _lookup, apply, "key string, line_no int, kind string").withColumnRenamed("key", key)


def repaired(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text``: every record with a text, as continuous paragraphs."""

    def apply(known: dict, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([repair(t, known) if t else t for t in texts], pa.string())], names=["key", "text"])

    return blockwise(_once(docs, key, text), key, text, _wanted, "entry string, n long, c long", _lookup, apply, "key string, text string").withColumnRenamed("key", key)
