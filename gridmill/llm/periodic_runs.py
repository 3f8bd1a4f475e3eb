"""Periodic runs of words in texts, by maximal pairs.

A run is a stretch of words with smallest period q, at least ``times`` periods and ``least`` words long, that cannot
be extended. Let u be a run without its last period, and l its length. Then u stands at the run's start and again q
words on; the words before the two places differ, and so do the words after them: the run is a maximal pair whose
distance q is at most l / (times - 1). Each maximal pair that meets this is a run, none has to be extended.

Pairs are read off the LCP-interval tree of a text's suffixes, bottom-up. An interval holds the places of its prefix
in text order, filed by the word to their left; when two intervals meet, each place of the smaller looks up its two
neighbours in the larger, unless all places are of one class. Neighbours are enough: with l >= 2 q, no place of u lies between the two.

Intervals shorter than ``least * (times - 1) / times`` words can give no run. So only places whose first 16 words
(with the defaults) come again in their text enter the tree; they are sorted by doubling prefixes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridmill.functions.semantics import require
from gridmill.llm.common import without
from gridmill.llm.pieces import slices

LEAST = 24
TIMES = 3

Pair = tuple[int, int, int]  # first place, distance, common length


def _again(words: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The places whose next ``width`` words (a power of two) come again in their text; others may slip in where hashes are equal."""
    code, h = words.astype(np.uint64), 1
    while h < width:
        code = (code + np.uint64(h)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code = (code + np.append(code[h:], np.zeros(min(h, len(code)), np.uint64))) * np.uint64(0xC2B2AE3D27D4EB4F)
        code ^= code >> np.uint64(32)
        h *= 2
    inside = np.flatnonzero(np.arange(len(words)) + width <= ends)
    keys = code[inside] ^ (ends[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    by_key = np.argsort(keys)
    equal = keys[by_key[1:]] == keys[by_key[:-1]]
    return inside[by_key[np.append(equal, False) | np.append(False, equal)]] if len(inside) else inside


def suffix_order(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): the suffixes whose next ``width`` words come again in their text, and a few more, sorted text by text.

    ``common[k]`` is the length that the k-th suffix has in common with the one before it, 0 if that is less than ``width``.
    The first ``width`` words are compared as they are, then prefixes are doubled.
    """
    again = _again(words, ends, width)
    places = np.unique(np.append(again, (again + width)[again + width < ends[again]]))
    size = len(places)
    if not size:
        return places, places
    ahead = places[:, None] + np.arange(width)
    rows = np.where(ahead < ends[places, None], words[np.minimum(ahead, len(words) - 1)], -1)
    order = places[by_row := np.lexsort((*rows.T[::-1], ends[places]))]
    rows = rows[by_row]
    new = np.ones(size, bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1) | (ends[order[1:]] != ends[order[:-1]])
    at = np.full(len(words), -1)  # place -> its number in ``places``
    at[places] = np.arange(size)
    slots = np.arange(size)
    rank = np.empty(size, np.int64)
    rank[at[order]] = np.maximum.accumulate(np.where(new, slots, 0))
    ranks, active, h = [(width, rank)], slots[~(new & np.append(new[1:], True))], width
    while len(active):
        # prefixes of h words that come again are followed by places that are known
        place = order[active]
        after = place + h
        second = np.where(after < ends[place], rank[at[np.minimum(after, len(words) - 1)]], -1)
        both = rank[at[place]] * (size + 1) + second + 1
        sort = np.argsort(both, kind="stable")
        place, both = place[sort], both[sort]
        start = np.append(True, both[1:] != both[:-1])
        order[active] = place
        rank = rank.copy()
        rank[at[place]] = active[np.maximum.accumulate(np.where(start, np.arange(len(both)), 0))]
        active = active[~(start & np.append(start[1:], True))]
        h *= 2
        ranks.append((h, rank))
    low, high, common = order[:-1], order[1:], np.zeros(size - 1, np.int64)
    end = np.where(new[1:], 0, ends[high])
    for step, rank in reversed(ranks):
        a, b = low + common, high + common
        fits = (a + step <= end) & (b + step <= end)
        a, b = at[np.where(fits, a, low)], at[np.where(fits, b, high)]
        common += step * (fits & (a >= 0) & (b >= 0) & (rank[a] == rank[b]))
    going = ~new[1:]
    for _ in range(width - 1):
        a, b = low + common, high + common
        going = going & (a < end) & (b < end)
        going &= words[np.where(going, a, 0)] == words[np.where(going, b, 0)]
        common += going
    return order, np.append(0, common)


def maximal_pairs(places: list[int], depths: list[int], left: list[int], least: int, times: int) -> Iterator[Pair]:
    """The neighbouring maximal pairs of one LCP-interval tree that are far enough alike, bottom-up.

    ``left`` has the class of each place by its number in ``places``: the word before it. An open interval is (places in
    text order, their classes in the same order, the class if there is one only, common length with the interval before it).
    """
    stack: list[tuple[list[int], dict[int, int], int | None, int]] = []

    def meet() -> Iterator[Pair]:
        places_b, class_b, only_b, depth = stack.pop()
        places_a, class_a, only_a, below = stack.pop()
        if len(places_a) < len(places_b):
            places_a, class_a, only_a, places_b, class_b, only_b = places_b, class_b, only_b, places_a, class_a, only_a
        one = only_a is not None and only_a == only_b
        if not one:
            reach = depth // (times - 1)
            for p in places_b:
                at, own = bisect_left(places_a, p), class_b[p]
                if at and (q := p - (o := places_a[at - 1])) <= reach and q + depth >= least and class_a[o] != own:
                    yield o, q, depth
                if at < len(places_a) and (q := (o := places_a[at]) - p) <= reach and q + depth >= least and class_a[o] != own:
                    yield p, q, depth
        if len(places_b) <= 8:
            for p in places_b:
                insort(places_a, p)
        else:
            places_a.extend(places_b)
            places_a.sort()
        class_a.update(class_b)
        stack.append((places_a, class_a, only_a if one else None, below))

    for place, depth, word in zip(places, depths, left, strict=True):
        while len(stack) > 1 and stack[-1][3] > depth:
            yield from meet()
        stack.append(([place], {place: word}, word, depth))
    while len(stack) > 1:
        yield from meet()


def runs(words: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """The runs of texts laid end to end: rows of (text, start in the text, length, period), by text, start, then period.

    ``words`` numbers the words, equal words alike; ``starts`` has the first place of each text and the end of the last.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    lengths = np.diff(starts)
    ends = np.repeat(starts[1:], lengths)
    if not len(words):
        return np.empty((0, 4), np.int64)
    before = np.append(-1, words[:-1]).astype(np.int64)
    heads = starts[:-1][lengths > 0]
    before[heads] = -1 - heads  # a text's first place has a class of its own
    shortest = -(-least * (times - 1) // times)
    width = 1 << max(0, shortest.bit_length() - 1)
    order, common = suffix_order(words, ends, width)
    cuts = np.append(np.flatnonzero(common == 0), len(order)).tolist()
    places, depths, left = order.tolist(), common.tolist(), before[order].tolist()
    pairs = [
        pair for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1
        for pair in maximal_pairs(places[a:b], depths[a:b], left[a:b], least, times)
    ]
    smallest: dict[tuple[int, int], int] = {}
    for i, q, n in pairs:  # a multiple of a period gives the same stretch
        stretch = (i, i + q + n)
        smallest[stretch] = min(q, smallest.get(stretch, q))
    if not smallest:
        return np.empty((0, 4), np.int64)
    found = np.array([(i, j - i, q) for (i, j), q in smallest.items()], np.int64)
    text = np.searchsorted(starts, found[:, 0], "right") - 1
    out = np.column_stack([text, found[:, 0] - starts[text], found[:, 1:]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length and period, by start and then period) and ``collapsed``.

    Words are numbered from 0. ``collapsed`` joins by one space the words that no run contains after its first period. A null or
    empty text, or one without a word, has no word, no run and an empty ``collapsed``. Whole texts are searched, row by row,
    without a shuffle; memory follows the longest text. Two runs of one text may overlap, and are both listed; runs
    that start together are told apart by their period. Repeated rows fare alike, an empty table gives an empty result,
    and columns already named ``n_words``, ``runs`` or ``collapsed`` are replaced.
    """
    require(docs, text)
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    kept = docs.select(*without(docs, added.names))
    require(kept, text)
    schema = T.StructType([*kept.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                # bytes are split at the six ASCII white-space characters
                texts = [t.split() if t else [] for t in part.column(text).cast(pa.binary()).to_pylist()]
                starts = np.cumsum([0, *map(len, texts)])
                numbered = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy()
                found = runs(numbered, starts, least, times)
                collapsed = list(texts)
                for k in np.unique(found[:, 0]).tolist():
                    stay = np.ones(len(texts[k]), bool)
                    for _, start, length, period in found[found[:, 0] == k].tolist():
                        stay[start + period : start + length] = False
                    collapsed[k] = [texts[k][i] for i in np.flatnonzero(stay).tolist()]
                offsets = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                fields = [pa.field(f.name, pa.int64(), False) for f in RUNS.elementType.fields]
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in found.T[1:]], fields=fields))
                joined = pa.array([b" ".join(t) for t in collapsed], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(starts)), listed, joined], names=schema.names)

    return kept.mapInArrow(run, schema)
