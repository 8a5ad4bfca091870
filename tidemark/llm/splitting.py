"""Splitting oversized items at natural boundaries.

Method: balanced targets. The smallest piece count that can cover the item is computed, equal-length
targets are placed, and each cut snaps to the strongest boundary near its target: paragraph break,
line break, sentence end, clause end, white space. Where a window holds no boundary although one piece
more would give it one, a piece is added. Consecutive pieces overlap by exactly ``overlap`` code points.

Defined cases: items not longer than the limit after removing characters up to U+0020 at both ends,
and null ones, are one piece (no pieces if nothing is left); text without any boundary is cut at
the targets. Offsets are code points of the text as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRIMMED

#: From the strongest to the weakest; a cut is placed at the end of the match.
BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\r?\n[^\S\r\n]*(?:\r?\n\s*)+|\f\s*",
        r"\r?\n\s*",
        r"[.!?…;·]+[\"'”’»)\]]*\s+|[。！？｡][」』”’）]*|[।॥؟]+\s*",
        r"[,;:،؛]\s+|[，、；：]",
        r"\s+",
    )
)


def _snap(text: str, low: int, high: int, target: int, slack: int) -> int | None:
    """The cut in [low, high] at the strongest boundary near the target; any boundary if none is near."""
    near_low, near_high = max(low, target - slack), min(high, target + slack)
    for a, b in ((near_low, near_high), (low, high)):
        if a > b:
            continue
        begin = max(0, a - 8)
        window = text[begin : min(len(text), b + 8)]
        for kind in BOUNDARIES:
            ends = [e for m in kind.finditer(window) if a <= (e := begin + m.end()) <= b]
            if ends:
                return min(ends, key=lambda e: (abs(e - target), e))
    return None


def cut(text: str | None, limit: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) of the pieces."""
    body = (text or "").strip(TRIMMED)
    if not body:
        return []
    base = text.index(body[0]) if text[0] in TRIMMED else 0
    n = len(body)
    if n <= limit:
        return [(base, base + n)]
    step = limit - overlap
    count = -(-(n - overlap) // step)
    most = 2 * count + 1
    while True:
        at, out, missed = 0, [], False
        for left in range(count, 1, -1):
            low, high = max(at + overlap + 1, n - (left - 1) * step), min(at + limit, n - 1)
            target = at + overlap + -(-(n - at - overlap) // left)
            target = min(max(target, low), high)
            end = _snap(body, low, high, target, max(limit // 5, 1))
            if end is None:
                missed |= _snap(body, at + overlap + 1, high, target, limit) is not None
                end = target
            out.append((at, end))
            at = end - overlap
        out.append((at, n))
        if (not missed and n - at <= limit) or count >= most:
            break
        count += 1
    return [(base + a, base + b) for a, b in out]


def split(items: DataFrame, keys: list[str], text: str, limit: int = 1000, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """``keys..., piece_no, n_pieces, start_at, end_at`` and, unless left out, ``piece``. One row per
    piece of every row; repeated records are the caller's to reduce."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be in [0, limit)")
    source = items.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                owner, number, total, start, end, piece = [], [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    found = cut(t, limit, overlap)
                    owner += [i] * len(found)
                    number += range(len(found))
                    total += [len(found)] * len(found)
                    start += [a for a, _ in found]
                    end += [b for _, b in found]
                    if with_text:
                        piece += [t[a:b] for a, b in found]
                columns = [part.column(k).take(pa.array(owner, pa.int64())) for k in names]
                columns += [pa.array(v, pa.int32()) for v in (number, total, start, end)] + [pa.array(piece, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "piece_no", "n_pieces", "start_at", "end_at", *["piece"] * with_text])

    kinds = ", ".join(f"{n} {items.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    out = source.mapInArrow(run, f"{kinds}, piece_no int, n_pieces int, start_at int, end_at int" + ", piece string" * with_text)
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def oversized(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The records that had to be cut, each once."""
    return pieces.filter("n_pieces > 1 and piece_no = 0").select(*keys).distinct()
