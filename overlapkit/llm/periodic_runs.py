"""Periodic runs of words: stretches that repeat themselves at least ``exponent`` times, found as maximal pairs.

Two places i < j of a text are a maximal pair of length L if their next L words are equal, the words
after those differ, and so do the words before them. Where L is at least twice the distance p = j - i,
the stretch from i to j + L has period p and no neighbour goes on with it: it is a run, with nothing to
extend. Every run of smallest period q and length n is the pair (start, start + q) of length n - q, and
its two places are neighbours among the places of those n - q words, since a place between them would
give a smaller period.

The pairs are enumerated bottom-up over the tree of LCP intervals of the text's suffixes. An interval
keeps its places with the word to the left of each (its class); the classes are kept in one list, in
order of place. When children join, the shorter list goes into the longer one, and each of its places
meets the nearest places on both sides: a pair counts if the classes differ and the distance satisfies
the length constraints. So no two classes are multiplied out, and a list's places are looked up
O(log n) times in all. A longer period of the same stretch (a multiple) may come up as well; the
smallest one stays.

A run needs pairs of ``gram`` words at least (5 for runs of 6 words and 4 periods), so suffixes whose
first ``gram`` words come once in their text are left out at the start, by counting hashes; the others
are ranked exactly, by doubling. Of those, only suffixes with another place of these words within
``longest common prefix / (exponent - 1)`` can stand in a pair; the tree is built on them alone. Many
texts go through numpy together; a text is never cut.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shortest_pair(words: int, exponent: int) -> int:
    """Length of the shortest maximal pair that is a run of ``words`` words and ``exponent`` periods."""
    return min(max(words - p, (exponent - 1) * p) for p in range(1, words + 1))


def _candidates(code: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """Places whose ``gram`` words may come again in the same text: by counts of hashes, none is missed."""
    n = len(code) - gram + 1
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    h = owner[:n].astype(np.uint64)
    whole = np.ones(n, dtype=bool)
    for k in range(gram):
        h = (h ^ code[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        whole &= code[k : k + n] >= 0
    at = np.flatnonzero(whole)
    slot = (h[at] >> np.uint64(64 - min(max(n.bit_length() + 3, 8), 40))).astype(np.int64)
    return at[np.bincount(slot)[slot] > 1] if len(at) else at


def suffixes(code: np.ndarray, owner: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with a repeated gram in order of their suffixes, and each one's common prefix with the one before.

    ``code`` has a negative number of its own before every text and after the last. The order of words
    is that of their numbers. A common prefix below ``gram`` counts as 0.
    """
    at = _candidates(code, owner, gram)
    keys = [code[at + k] for k in range(gram)][::-1]
    at = at[np.lexsort((*keys, owner[at]))] if len(at) else at
    new = np.ones(len(at), dtype=bool)
    if len(at):
        new[1:] = owner[at[1:]] != owner[at[:-1]]
        for k in range(gram):
            new[1:] |= code[at[1:] + k] != code[at[:-1] + k]
    last = np.append(new[1:], True)[: len(at)]
    stay = ~(new & last)
    sa, new = at[stay], new[stay]
    if not len(sa):
        return sa, sa
    gram_of = np.cumsum(new)
    rank = np.arange(len(sa), len(sa) + len(code))  # of places left out: each its own
    start = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = start
    levels, length = [(gram, rank.copy())], gram
    while True:  # refine the groups that still hold several places, by what follows
        size = np.bincount(start, minlength=len(sa))[start]
        act = np.flatnonzero(size > 1)
        if not len(act):
            break
        # of what follows, the gram's words come first: places left out have no rank among the others
        first, after = start[act], sa[act] + length
        then = rank[after]
        order = np.lexsort((then, *[code[np.minimum(after + k, len(code) - 1)] for k in range(gram)][::-1], first))
        sa[act], then = sa[act][order], then[order]
        change = np.ones(len(act), dtype=bool)
        change[1:] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        start[act] = np.maximum.accumulate(np.where(change, act, 0))
        rank[sa[act]] = start[act]
        length *= 2
        levels.append((length, rank.copy()))
    lcp = np.zeros(len(sa), dtype=np.int64)
    inner = np.flatnonzero(gram_of[1:] == gram_of[:-1]) + 1
    a, b = sa[inner - 1].copy(), sa[inner].copy()
    for length, level in reversed(levels):
        step = np.where(level[a] == level[b], length, 0)
        a, b = a + step, b + step
    same = np.ones(len(inner), dtype=bool)
    for _ in range(gram - 1):
        same &= code[a] == code[b]
        a, b = a + same, b + same
    lcp[inner] = a - sa[inner - 1]
    return sa, lcp


def _near_enough(sa: np.ndarray, lcp: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that can stand in a pair, and their common prefixes with the one before."""
    group = np.cumsum(lcp == 0)
    order = np.lexsort((sa, group))
    place, of = sa[order], group[order]
    gap = np.where(of[1:] == of[:-1], place[1:] - place[:-1], np.iinfo(np.int64).max // (2 * times))
    near = np.empty(len(sa), dtype=np.int64)
    edge = gap[:0].tolist() or [np.iinfo(np.int64).max // (2 * times)]
    near[order] = np.minimum(np.concatenate([edge, gap]), np.concatenate([gap, edge]))
    most = np.maximum(lcp, np.append(lcp[1:], 0))
    keep = np.flatnonzero(times * near <= most)
    if not len(keep):
        return keep, keep
    # what two kept neighbours share is the least over the stretch between them
    least = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
    least[0] = 0
    return sa[keep], least


def maximal_pairs(places: list[int], lcp: list[int], left: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    """(i, distance, length) of maximal pairs at most ``length / times`` apart, from the interval tree's leaves in order.

    ``lcp`` holds each leaf's common prefix with the one before, ``left`` its class. A stack holds the
    intervals that are open; one that closes joins its parent.
    """
    stack: list[list] = []
    for k in range(len(places) + 1):
        depth = lcp[k] if k < len(places) else 0
        while stack and stack[-1][0] > depth:
            _, child = stack.pop()
            if not stack or stack[-1][0] < depth:
                if depth:
                    stack.append([depth, child])
                break
            level, own = stack[-1]
            if len(child) > len(own):
                child, own = own, child
                stack[-1][1] = own
            met = []
            for place, c in child:
                at = bisect(own, (place,))
                if at:
                    i, d = own[at - 1]
                    if (place - i) * times <= level and d != c:
                        yield i, place - i, level
                if at < len(own):
                    j, d = own[at]
                    if (j - place) * times <= level and d != c:
                        yield place, j - place, level
                met.append(at)
            if len(child) > 64:
                own += child
                own.sort()
            else:
                for at, item in zip(reversed(met), reversed(child), strict=True):  # from the end, so that places hold
                    own.insert(at, item)
        if k < len(places):
            stack.append([1 << 60, [(places[k], left[k])]])


def find_runs(code: np.ndarray, owner: np.ndarray, words: int, exponent: int) -> np.ndarray:
    """(place, length, period) rows, by place and period, of all runs in texts of numbered words (see ``suffixes``)."""
    sa, lcp = suffixes(code, owner, shortest_pair(words, exponent))
    if len(sa):
        sa, lcp = _near_enough(sa, lcp, exponent - 1)
    best: dict[tuple[int, int], int] = {}
    for i, p, length in maximal_pairs(sa.tolist(), lcp.tolist(), code[sa - 1].tolist(), exponent - 1):
        if p + length >= words and p < best.get((i, p + length), p + 1):
            best[i, p + length] = p
    rows = np.array([(i, n, p) for (i, n), p in best.items()], dtype=np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _described(text: pa.Array, words: int, exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed texts of a batch of texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.string()), ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    flat, n_docs, total = flat.filter(pa.array(real)), len(text), int(before[-1])
    own = np.repeat(np.arange(n_docs), np.diff(offsets))
    code = -1 - np.arange(total + n_docs + 1)
    place = np.arange(total) + own + 1
    code[place] = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    owner = np.zeros(len(code), dtype=np.int64)
    owner[place] = own
    runs = find_runs(code, owner, words, exponent)
    of = owner[runs[:, 0]]
    start = runs[:, 0] - of - 1  # among all words of the batch
    cover = np.zeros(total + 1, dtype=np.int64)
    np.add.at(cover, start + runs[:, 2], 1)
    np.add.at(cover, start + runs[:, 1], -1)
    keep = np.cumsum(cover)[:total] == 0
    left = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep)))
    each = pa.StructArray.from_arrays([pa.array(x) for x in (start - offsets[of], runs[:, 1], runs[:, 2])], fields=list(RUN))
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pc.binary_join(kept, " ")


def periodic_runs(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, words: int = 6, exponent: int = 4, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """``keep`` columns with ``runs`` (array of start, length, period) and ``collapsed``, the text without repeats.

    A run is a stretch of words of smallest period q and at least ``words`` words and ``exponent``
    periods that no neighbour extends; runs come by start, then period. Words are what stands between
    ASCII white space. ``collapsed`` leaves out every word that a run contains after its first period;
    its words are joined by one space. Cases: a null, empty or blank text has no runs and collapses to
    the empty text; rows that repeat stay; a text of any length is one unit, in some hundred bytes a
    word; an empty table gives no rows. ``exponent`` is 3 at least.
    """
    if exponent < 3 or words < 2:
        raise ValueError("exponent is 3 or more, words 2 or more")
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    if {runs_col.lower(), collapsed_col.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"{runs_col} or {collapsed_col} is a column of its own")
    schema = S.schema_of(docs, keep, **{runs_col: "array<struct<start: long, length: long, period: long>>", collapsed_col: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, text_col, 2_000_000):
            runs, collapsed = _described(batch.column(text_col), words, exponent)
            yield S.with_columns(batch, keep, **{runs_col: runs, collapsed_col: collapsed})

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def repeat_tails(text: Column, id_col: Column) -> Column:
    """The text, or where crc32 of the decimal id ends in 0, its words with the tail made periodic.

    With h that number, g = h // 10 and n words, words from a = g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of theirs. A null id or text, or one without words, stays as it is.
    """
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        rest = n - a
        p = (F.floor(rest / (3 + g % 8)) + 1).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when((h % 10 == 0) & text.isNotNull(), F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)
