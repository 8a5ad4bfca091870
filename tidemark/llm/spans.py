"""Long exact spans shared between records.

Method: collinear chaining. Every text gives k-mer seeds, the minimizers of windows, chosen so that
each run of ``length`` code points holds one and equal runs choose the same one. Seeds of different
texts are joined into matches, matches of two texts are chained in order with gap costs through a
Fenwick tree, and each chain is aligned on the texts: exact runs along its diagonals, and a fuzzy
passage around them.

Seeds are not joined all with all. Occurrences of a seed are grouped by the text around them that
chose it, and every occurrence is matched with the first text of its group (the first with the last).
Where a seed stands in different surroundings, one occurrence of each is compared window by window,
and each window's occurrences are again matched with the first. So the matches grow in proportion to
the occurrences, and every shared window is in at least one match. Equal texts are one class: with two
records or more it is shared as a whole.

Defined cases: null texts and texts shorter than ``length`` share nothing; a repeated row of a key is
one record; ties go to the smaller class; a run repeated only inside one record is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import _kernels as k
from ._streams import partitions
from .near import sift

U64 = np.uint64
_PLACE = U64(24)
#: Seeds in a bucket: what one task joins at a time.
BUCKET = 1_000_000
#: Longer texts are worked on in overlapping stretches of so many code points, which bounds memory and
#: keeps places below 2**24.
STRETCH = 1_000_000
#: Occurrences that are matched with the same one.
HUB = 256


def minimizers(texts: list[str], length: int, mer: int) -> tuple[np.ndarray, ...]:
    """(text number, position, seed, first window, last window, context hash) of the seeds. A seed is the
    k-mer of the least hash, the leftmost on a tie, of one or more windows of ``length``; the context is
    the text those windows cover."""
    cp, starts = k.codepoints(texts)
    n, w = len(cp) - mer + 1, length - mer + 1
    none = np.empty(0, np.int64)
    if n < w:
        return none, none, none.astype(U64), none, none, none.astype(U64)
    h = k.prefix_hash(cp)
    _, down = k.powers(len(cp))
    seed = k.mix((h[mer : mer + n] - h[:n]) * down[:n])
    key = (seed >> _PLACE << _PLACE) | np.arange(n, dtype=U64)
    padded = np.full(-(-n // w) * w, np.iinfo(U64).max, U64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    window = np.arange(n - w + 1)
    least = np.minimum(behind[window], ahead[window + w - 1])
    owner = np.searchsorted(starts, window, "right") - 1
    whole = window + length < starts[owner + 1]
    window, owner, place = window[whole], owner[whole], (least[whole] & ((U64(1) << _PLACE) - U64(1))).astype(np.int64)
    if not len(window):
        return none, none, none.astype(U64), none, none, none.astype(U64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(place)]]) - 1
    at, lo, hi, who = place[first], window[first], window[last], owner[first]
    context = k.mix(((h[hi + length] - h[lo]) * down[lo]) ^ (at - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    base = starts[who]
    return who, at - base, seed[at], lo - base, hi - base, context


def _pack(cls: np.ndarray, local: np.ndarray, *columns: np.ndarray) -> bytes:
    at, seed, before, behind, context = columns
    head = np.array([len(cls), len(at)], np.uint32)
    kinds = (local.astype(np.uint16 if len(cls) < 65536 else np.uint32), at.astype(np.uint32), (seed >> U64(32)).astype(np.uint32), seed.astype(np.uint32), before.astype(np.uint16), behind.astype(np.uint16), context.astype(np.uint32), (context >> U64(32)).astype(np.uint8))
    return b"".join(x.tobytes() for x in (head, cls, *kinds))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, c = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at, out = 8, []
    for kind, count in ((np.int64, n), (np.uint16 if n < 65536 else np.uint32, c), (np.uint32, c), (np.uint32, c), (np.uint32, c), (np.uint16, c), (np.uint16, c), (np.uint32, c), (np.uint8, c)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    cls, local, pos, high, low, before, behind, c1, c2 = out
    return cls[local], pos.astype(np.int64), high.astype(U64) << U64(32) | low, before.astype(np.int64), behind.astype(np.int64), c1.astype(U64) | c2.astype(U64) << U64(32)


def _seeds(classed: DataFrame, length: int, mer: int, buckets: int) -> DataFrame:
    """``bucket, blob`` of ``cls, text, salt``; a task works on each class once."""
    stretch = max(STRETCH, 2 * length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls, texts, salts, base = [], [], [], []
            for c, t, salt in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), batch.column("salt").to_pylist(), strict=True):
                if c not in seen:
                    seen.add(c)
                    # every window of ``length`` lies whole in a stretch
                    for at in range(0, max(1, len(t) - length + 1), stretch - length + 1):
                        cls.append(c), texts.append(t[at : at + stretch]), salts.append(salt), base.append(at)
            for a, b in k.slices(texts):
                who, at, seed, lo, hi, context = minimizers(texts[a:b], length, mer)
                if not len(who):
                    continue
                own, begin = np.array(cls[a:b], np.int64), np.array(base[a:b], np.int64)[who]
                at, lo, hi = at + begin, lo + begin, hi + begin
                seed = seed ^ np.array(salts[a:b], np.int64).view(U64)[who]  # spaces keep to themselves
                bucket = ((k.mix(seed) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                numbers, heads = np.unique(bucket[by], return_index=True)
                blobs = []
                for part in np.split(by, heads[1:]):
                    texts_here, local = np.unique(own[who[part]], return_inverse=True)
                    blobs.append(_pack(texts_here, local, at[part], seed[part], (at - lo)[part], (hi - lo)[part], context[part]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return classed.mapInArrow(run, "bucket int, blob binary")


def _star(group: np.ndarray, cls: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Matches (cls, at, cls, at) inside groups, given sorted by group, class and place: each occurrence
    with one of another class, the hub of its HUB occurrences, or else the group's last or first class. A
    class that has the group several times is matched in turn, so that periodic texts stay on few
    diagonals; several hubs keep a passage that very many texts share from meeting in one text."""
    if not len(group):
        return np.empty((0, 4), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff([*heads, len(group)])
    first, last = np.repeat(heads, size), np.repeat(heads + size - 1, size)
    block = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (cls[1:] != cls[:-1])]))
    length = np.diff([*block, len(group)])
    start, count = np.repeat(block, length), np.repeat(length, length)
    turn = np.arange(len(group)) - start
    hub = first + (np.arange(len(group)) - first) // HUB * HUB
    side = np.where(cls == cls[hub], last, hub)
    side = np.where(cls == cls[side], first, side)
    partner = start[side] + turn % count[side]
    ok = cls != cls[partner]
    i, j = np.flatnonzero(ok), partner[ok]
    swap = cls[i] > cls[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return np.unique(np.stack([cls[i], at[i], cls[j], at[j]], 1), axis=0)


_MATCH = "edge boolean, a long, at_a long, b long, at_b long, lo long, hi long, seed long"


def _match_bucket(blobs: list[bytes]) -> pa.Table:
    """Matches of seeds in equal surroundings, and one occurrence of each of a seed's surroundings where
    there are several."""
    cls, at, seed, before, behind, context = (np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True))
    by = np.lexsort((at, cls, context, seed))
    cls, at, seed, before, behind, context = (x[by] for x in (cls, at, seed, before, behind, context))
    keep = np.ones(len(cls), bool)  # a class met by several tasks
    keep[1:] = (seed[1:] != seed[:-1]) | (context[1:] != context[:-1]) | (cls[1:] != cls[:-1]) | (at[1:] != at[:-1])
    cls, at, seed, before, behind, context = (x[keep] for x in (cls, at, seed, before, behind, context))
    new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
    number = np.cumsum(new_seed) - 1
    heads = np.flatnonzero(new_seed)
    several = (np.minimum.reduceat(cls, heads) != np.maximum.reduceat(cls, heads))[number]
    cls, at, seed, before, behind, context, number = (x[several] for x in (cls, at, seed, before, behind, context, number))
    new = np.ones(len(cls), bool)
    new[1:] = (number[1:] != number[:-1]) | (context[1:] != context[:-1])
    group = np.cumsum(new) - 1
    links = _star(group, cls, at)
    head = np.flatnonzero(new)
    # A seed in more than one surrounding: of a surrounding of several classes the first and the last
    # class, so that any other class meets a different one; else all occurrences.
    tail = np.concatenate([head[1:], [len(cls)]]) - 1
    edge = np.empty(0, np.int64)
    if len(head):
        many = (np.bincount(number[head])[number[head]] > 1)[group]
        mixed = (cls[tail] != cls[head])[group]
        ends = np.zeros(len(cls), bool)
        ends[head] = ends[tail] = True
        edge = np.flatnonzero(many & (~mixed | ends))
    lo, n = at[edge] - before[edge], len(edge)
    fill = np.zeros(len(links), np.int64)
    return pa.table(
        {
            "edge": np.concatenate([np.zeros(len(links), bool), np.ones(n, bool)]),
            "a": np.concatenate([links[:, 0], cls[edge]]),
            "at_a": np.concatenate([links[:, 1], at[edge]]),
            "b": np.concatenate([links[:, 2], np.zeros(n, np.int64)]),
            "at_b": np.concatenate([links[:, 3], np.zeros(n, np.int64)]),
            "lo": np.concatenate([fill, lo]),
            "hi": np.concatenate([fill, lo + behind[edge]]),
            "seed": np.concatenate([fill, seed[edge].view(np.int64)]),
        }
    )


def _match_windows(rows: pa.Table, length: int) -> pa.Table:
    """Matches between surroundings of a seed that agree in a window."""
    texts = rows.column("context").to_pylist()
    links = []
    cls, at, lo, hi = (rows.column(c).to_numpy() for c in ("a", "at_a", "lo", "hi"))
    owners = rows.column("seed").to_numpy().view(U64)
    order = np.argsort(owners, kind="stable")
    seeds = owners[order]
    # slices end between seeds, so that a seed's surroundings are compared in one
    ends = [*np.flatnonzero(seeds[1:] != seeds[:-1]) + 1, len(seeds)]
    begin = 0
    for end, nxt in zip(ends, [*ends[1:], None], strict=True):
        if nxt is not None and nxt - begin <= 3000:
            continue
        part = order[begin:end]
        begin = end
        cp, starts = k.codepoints([texts[i] for i in part])
        h = k.prefix_hash(cp)
        _, down = k.powers(len(cp))
        count = (hi - lo)[part] + 1
        first = np.repeat(starts[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who = np.repeat(part, count)
        value = k.mix(((h[first + length] - h[first]) * down[first]) ^ owners[who])
        by = np.lexsort((at[who], cls[who], value))
        links.append(_star(value[by], cls[who[by]], at[who[by]]))
    found = np.unique(np.concatenate(links), axis=0) if links else np.empty((0, 4), np.int64)
    return pa.table({c: found[:, i] for i, c in enumerate(("a", "at_a", "b", "at_b"))})


class Fenwick:
    """Greatest value, and who has it, over prefixes of ranks."""

    def __init__(self, n: int) -> None:
        self.best, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, rank: int, value: float, who: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank], self.who[rank] = value, who
            rank += rank & -rank

    def get(self, rank: int) -> tuple[float, int]:
        """Over ranks below the given one."""
        value, who = float("-inf"), -1
        while rank > 0:
            if self.best[rank] > value:
                value, who = self.best[rank], self.who[rank]
            rank -= rank & -rank
        return value, who


def chain(a: list[int], b: list[int], gain: float, gap_cost: float, most_gap: int) -> list[list[int]]:
    """Numbers of the matches by chain, best chain first, until every match is in one. Along a chain both
    places rise; a step costs ``gap_cost`` for each code point it spans in either text. A chain that runs
    into a better one ends there."""
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    ranks = {v: r for r, v in enumerate(sorted(set(b)))}
    tree, score, before = Fenwick(len(ranks)), [0.0] * len(a), [-1] * len(a)
    waiting: list[int] = []
    for n, i in enumerate(order):
        if n and a[order[n - 1]] != a[i]:  # matches of one place in a do not follow each other
            for j in waiting:
                tree.put(ranks[b[j]], score[j] + gap_cost * (a[j] + b[j]), j)
            waiting = []
        value, j = tree.get(ranks[b[i]])
        value -= gap_cost * (a[i] + b[i])
        if j >= 0 and value > 0 and a[i] - a[j] <= most_gap and b[i] - b[j] <= most_gap:
            score[i], before[i] = gain + value, j
        else:
            score[i] = gain
        waiting.append(i)
    out, used = [], [False] * len(a)
    for i in sorted(order, key=lambda i: (-score[i], i)):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(i)
            i = before[i]
        if found:
            out.append(found[::-1])
    return out


def passages(records: DataFrame, length: int = 200, mer: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, passages) of ``space, key, text``: members is ``space, key, cls, n_chars``; a passage is
    ``a, start_a, end_a, b, start_b, end_b, identity, runs`` of two classes, runs being the exact runs
    of at least ``length`` as (start_a, start_b, n)."""
    if not 0 < mer <= length:
        raise ValueError("mer must be in [1, length]")
    classed = records.filter(F.length("text") >= length).withColumn("cls", F.xxhash64("space", "text"))
    members = materialize(classed.select("space", "key", "cls", F.length("text").alias("n_chars")).distinct(), "members")
    texts = classed.select("cls", "text")
    total = members.agg(F.sum("n_chars")).head()[0] or 0  # two seeds for each window of positions
    parts = max(partitions(records), int(2 * total // (length - mer + 1) // BUCKET) + 1)
    seeds = _seeds(classed.select("cls", "text", F.xxhash64("space").alias("salt")), length, mer, parts)
    found = seeds.groupBy("bucket").applyInArrow(lambda rows: _match_bucket(rows.column("blob").to_pylist()), _MATCH)
    found = materialize(found, "matches")

    edges = found.filter("edge")
    contexts = edges.join(_texts_of(texts, edges.select(F.col("a").alias("rid"))), F.col("a") == F.col("cls"))
    contexts = contexts.select("seed", "a", "at_a", "lo", "hi", F.expr(f"substring(text, cast(lo + 1 as int), cast(hi - lo + {length} as int))").alias("context"))
    more = contexts.groupBy(F.pmod("seed", F.lit(parts)).alias("part")).applyInArrow(lambda rows: _match_windows(rows, length), "a long, at_a long, b long, at_b long")
    matches = found.filter("not edge").select("a", "at_a", "b", "at_b").unionByName(more)
    pairs = matches.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("at_a", "at_b"))).alias("seeds"))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = length - mer
        for batch in batches:
            rows = []
            for a, b, seen in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("seeds").to_pylist(), strict=True):
                x, y = [s["at_a"] for s in seen], [s["at_b"] for s in seen]
                for one in chain(x, y, float(mer), 0.25, 2 * length):
                    rows.append((a, max(0, x[one[0]] - margin), x[one[-1]] + length, b, max(0, y[one[0]] - margin), y[one[-1]] + length, [x[i] for i in one], [y[i] for i in one]))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "from_a", "to_a", "b", "from_b", "to_b", "seeds_a", "seeds_b"])

    chained = materialize(pairs.mapInArrow(chains, "a long, from_a long, to_a long, b long, from_b long, to_b long, seeds_a array<long>, seeds_b array<long>"), "chains")
    needed = _texts_of(texts, chained.select(F.explode(F.array("a", "b")).alias("rid")))
    cut = lambda side: F.expr(f"substring(text, cast(from_{side} + 1 as int), cast(to_{side} - from_{side} as int))")
    one = chained.join(needed, F.col("a") == F.col("cls")).withColumn("text_a", cut("a")).drop("cls", "text")
    both = one.join(needed, F.col("b") == F.col("cls")).withColumn("text_b", cut("b")).drop("cls", "text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in batch.to_pylist() if (r := _align(row, length, mer))]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            run = pa.list_(pa.struct([("start_a", pa.int64()), ("start_b", pa.int64()), ("n", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64()] * 2 + [pa.float64(), run]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "start_a", "end_a", "b", "start_b", "end_b", "identity", "runs"])

    schema = "a long, start_a long, end_a long, b long, start_b long, end_b long, identity double, runs array<struct<start_a: long, start_b: long, n: long>>"
    return members, both.mapInArrow(align, schema)


def _align(row: dict, length: int, mer: int) -> tuple | None:
    """A chain on its texts: along each diagonal of its seeds, the equal stretches around them."""
    x = np.frombuffer(row["text_a"].encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(row["text_b"].encode("utf-32-le", "surrogatepass"), np.uint32)
    sa, sb = np.array(row["seeds_a"]) - row["from_a"], np.array(row["seeds_b"]) - row["from_b"]
    runs, stretches = [], []
    for d in np.unique(sa - sb):
        i = max(0, d)
        n = min(len(x) - i, len(y) - (i - d))
        same = np.zeros(n + 2, np.int8)
        same[1:-1] = x[i : i + n] == y[i - d : i - d + n]
        edge = np.flatnonzero(np.diff(same))
        begin, end = edge[::2] + i, edge[1::2] + i
        mine = sa[sa - sb == d]
        hit = np.unique(np.searchsorted(begin, mine, "right") - 1)
        for r in hit[hit >= 0]:
            if end[r] - begin[r] >= mer:
                stretches.append((int(begin[r]), int(end[r]), int(d)))
            if end[r] - begin[r] >= length:
                runs.append({"start_a": int(begin[r]) + row["from_a"], "start_b": int(begin[r] - d) + row["from_b"], "n": int(end[r] - begin[r])})
    if not stretches:
        return None
    a0, a1 = min(s[0] for s in stretches), max(s[1] for s in stretches)
    b0, b1 = min(s[0] - s[2] for s in stretches), max(s[1] - s[2] for s in stretches)
    equal, at = 0, a0
    for s, e, _ in sorted(stretches):
        equal += max(0, e - max(s, at))
        at = max(at, e)
    identity = equal / max(a1 - a0, b1 - b0)
    return row["a"], row["from_a"] + a0, row["from_a"] + a1, row["b"], row["from_b"] + b0, row["from_b"] + b1, float(identity), runs


def _texts_of(texts: DataFrame, rids: DataFrame) -> DataFrame:
    """``cls, text`` once for each class asked for, and a few more: only those whose bit is set in a table
    of fixed size go into the shuffle."""
    return sift(texts, "cls", rids).filter("hit").groupBy("cls").agg(F.first("text").alias("text"))


def shared_spans(records: DataFrame, length: int = 200, mer: int = 100) -> DataFrame:
    """``space, key, start_at, end_at``: the maximal stretches of each record in which every code point
    lies in a run of ``length`` that stands in another record of the space too."""
    members, found = passages(records, length, mer)
    runs = found.select("a", "b", F.explode("runs").alias("r"))
    side = lambda c: runs.select(F.col(c).alias("cls"), F.col(f"r.start_{c}").alias("s"), (F.col(f"r.start_{c}") + F.col("r.n")).alias("e"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.first("n_chars").cast("long").alias("e")).filter("n > 1")
    spans = side("a").unionByName(side("b")).unionByName(copies.select("cls", F.lit(0).cast("long").alias("s"), "e")).distinct()
    order = Window.partitionBy("cls").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    merged = marked.groupBy("cls", "island").agg(F.min("s").cast("int").alias("start_at"), F.max("e").cast("int").alias("end_at"))
    return members.join(merged, "cls").select("space", "key", "start_at", "end_at")


def shared_amount(records: DataFrame, length: int = 200, mer: int = 100) -> DataFrame:
    """``space, key, n_chars, n_shared, share``: how much of each record stands elsewhere too."""
    spans = shared_spans(records, length, mer).groupBy("space", "key").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("n_shared"))
    sizes = records.groupBy("space", "key").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    joined = sizes.join(spans, ["space", "key"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return joined.withColumn("share", F.coalesce(F.try_divide(F.col("n_shared").cast("double"), "n_chars"), F.lit(0.0)))
