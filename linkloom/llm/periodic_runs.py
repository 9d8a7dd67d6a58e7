"""Periodic runs of words, by Lyndon roots from the first phase of Baier's suffix sorter.

The first phase groups suffixes by their longest Lyndon prefix. It starts with groups of equal first words and
takes groups from the greatest down; an element of the group that is taken extends the context of the nearest
element to its left that is not taken yet, and elements that were extended alike make a new group just above
their old one. The length of a group's context, when its turn comes, is the Lyndon array at its elements; the
second phase, which would sort inside of groups, is not needed. The phase is run under an order of words and
under the reverse order, because every run holds a Lyndon word of its period's length that is longest at its
start under one of them. Each such root is extended to both sides by the longest common extensions of its
two ends; where at least two periods come out it is a run, and equal runs from several roots count once.

A run of twelve words or more lies inside of runs of six words that are found twice, so only the stretches
that such runs cover are sorted. Nothing is lost by that, and most texts have no such stretch.

* Words are runs of anything but space and control white space, compared by their bytes. Null and empty texts
  have no words: no run, nulls in place of the longest, digests of nothing.
* Whole texts are read, one row at a time; memory grows with the longest text of a batch of rows.
* Ties for the longest run go to the smallest start, then period. Repeated rows are judged alike.
* Null ids count as empty text where the query's repetition looks at ids. Empty tables give empty results.
  Other columns are not looked at.
* Common extensions are found by 64-bit sums and then compared word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.minmax_dedup import BASE, mixed
from linkloom.llm.suffix_dedup import Names
from linkloom.llm.words import in_repeated_windows, word_names, word_spans

LEAST_WORDS = 12
#: Words that a run of LEAST_WORDS repeats one period on, at least.
SHARED = LEAST_WORDS // 2
#: How often a stretch is narrowed before it is sorted; any number gives the same runs.
NARROWINGS = 3

FOUND = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place: phase one, groups from the greatest down."""
    lengths = [1] * len(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, context = list(ranks), [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left = list(range(len(ranks) + 1))  # place + 1 of the nearest element at or before a place that is not taken yet; 0 is none
    top = len(members) - 1
    while top >= 0:
        size, taken = context[top], [i for i in members[top] if group[i] == top]
        for i in taken:
            lengths[i] = size
            left[i + 1] = i
        times: dict[int, int] = {}
        for i in taken:
            root = i
            while left[root] != root:
                root = left[root]
            at = i
            while at != root:
                left[at], at = root, left[at]
            if root:
                times[root - 1] = times.get(root - 1, 0) + 1
        alike: dict[tuple[int, int], list[int]] = {}
        for i, k in times.items():
            alike.setdefault((group[i], k), []).append(i)
        for old, k in sorted(alike, reverse=True):  # the greatest multiple first: each goes directly above the old group
            new, over = len(members), above[old]
            members.append(alike[old, k])
            context.append(context[old] + k * size)
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for i in members[new]:
                group[i] = new
        top = below[top]
    return lengths


def _common(names: Names, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places ``a`` and ``b`` on, to the right (step 1) or before them to the left (step -1)."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        half = np.where(open_, (low + high + 1) // 2, low)
        if step > 0:
            same = names.of(a, a + half) == names.of(b, b + half)
        else:
            same = names.of(a - half, a) == names.of(b - half, b)
        low, high = np.where(same, half, low), np.where(same | ~open_, high, half - 1)
    return low


def _extended(ids: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """Start and length of the repetition around a root, word by word."""
    end = start + period
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    while start > 0 and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    return start, end - start


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of a sequence of numbers 0..k, all of which occur."""
    ranks = ids.tolist()
    top = max(ranks)
    places = np.arange(len(ids))
    periods = np.concatenate([lyndon_lengths(ranks), lyndon_lengths([top - r for r in ranks])]).astype(np.int64)
    start = np.concatenate([places, places])
    start, period = np.unique(np.stack([start, periods]), axis=1)
    end = start + period
    padded = np.concatenate([ids, [-1]])
    goes_on = (padded[start] == padded[end]) | ((start > 0) & (padded[start - 1] == padded[end - 1]))
    start, period, end = start[goes_on], period[goes_on], end[goes_on]
    names = Names(ids, mixed(np.arange(1, top + 2, dtype=np.uint64) * BASE))
    right = _common(names, start, end, len(ids) - end, 1)
    before = _common(names, start, end, start, -1)
    length = before + period + right
    enough = length >= np.maximum(LEAST_WORDS, 2 * period)
    found = set()
    for root, p, s, n in zip(start[enough].tolist(), period[enough].tolist(), (start - before)[enough].tolist(), length[enough].tolist(), strict=True):
        if (s, n, p) in found:
            continue
        if not np.array_equal(ids[s : s + n - p], ids[s + p : s + n]):
            s, n = _extended(ids, root, p)
            if n < max(LEAST_WORDS, 2 * p):
                continue
        found.add((s, n, p))
    return list(found)


def stretches(names: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts in which all runs lie: of words that runs of SHARED words cover which the part holds twice."""
    work = [(0, len(names), 0)]
    while work:
        a, b, depth = work.pop()
        if b - a < LEAST_WORDS:
            continue
        covered = in_repeated_windows(names[a:b], SHARED)
        if covered.all() or depth == NARROWINGS:
            yield a, b
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        work += [(a + int(s), a + int(e), depth + 1) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def runs(names: np.ndarray, words: list[bytes] | None = None) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of LEAST_WORDS words and two periods or more, by start and period.

    ``names`` stand for the words; the words themselves, if given, decide what is equal.
    """
    out = []
    for a, b in stretches(names):
        held: dict = {}
        part = words[a:b] if words is not None else names[a:b].tolist()
        ids = np.array([held.setdefault(w, len(held)) for w in part], np.int64)
        out += [(a + s, n, p) for s, n, p in runs_of(ids)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def repetition(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of the texts that the query makes periodic."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def periodic(docs: DataFrame, repeat: bool = False, outputs: bool = True) -> DataFrame:
    """The runs of every row's text, the longest of them, and the text without its repetitions.

    ``repeat`` makes some texts periodic first, by their ids. Without ``outputs`` the columns ``runs`` and
    ``collapsed`` are left out, and only their digests and figures are given.
    """
    schema = FOUND if outputs else FOUND[: FOUND.index(", runs array")]

    def row(doc_id: int | None, text: bytes) -> tuple:
        raw = np.frombuffer(text, np.uint8)
        names, words = word_names(raw, *word_spans(raw)), text.split()
        moved = repetition(doc_id, len(words)) if repeat else None
        if moved is not None:
            names, words = names[moved], [words[i] for i in moved.tolist()]
        found = runs(names, words)
        longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        start, length, period = longest or (None, None, None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        left = collapsed(words, found)
        digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
        out = (doc_id, len(found), start, length, period, 1000 * length // period if longest else None, *digests)
        if outputs:
            out += ([{"start": s, "length": n, "period": p} for s, n, p in found], left.decode())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
        columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").cast(pa.large_string())
                rows = [row(d.as_py(), (t.as_py() or "").encode()) for d, t in zip(part.column("doc_id"), texts, strict=True)]
                wide = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(wide, kinds, strict=False)], columns[: len(wide)])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, schema)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of all documents, a tenth of which is made periodic by a rule on ids."""
    return periodic(table(spark, folder, "documents").select("doc_id", "text"), repeat=True, outputs=False)
