"""Overlap reconciliation: windows that were scored independently become one sequence.

Tokens are rows (key, window_no, ord, piece, initial, pos); ``ord`` counts from 0 in a window. Two
neighbouring windows are spliced at the longest run of words that both have. The work is done on
*window rows* (key, window_no, toks: the window's tokens as an array in order), which every function
here takes as well as token rows: windows are streamed in order, each with the one before it, and the runs
of many seams are found together in numpy. Only stretches of windows whose seams depend on each other are folded, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overlapkit.functions import word_core
from overlapkit.sources import written

WORD_TYPE = "array<struct<at: int, pos: bigint, core: string>>"
PAIR = "left_n: long, n: long, falls: boolean, keep_len: long, append_from: long, run: long, spliced: boolean, left_at: long, right_at: long, slice_start: long, dropped: long"


def window_rows(tokens: DataFrame, key: str) -> DataFrame:
    """(key, window_no, toks) of token rows; window rows come back as they are."""
    if "toks" in tokens.columns:
        return tokens
    rest = F.struct(*[c for c in tokens.columns if c not in (key, "window_no", "ord")])
    in_order = F.array_sort(F.collect_list(F.struct(F.col("ord"), rest.alias("tok"))))
    # one shuffle for the windows and for what meets across them
    dealt = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.groupBy(key, "window_no").agg(F.transform(in_order, lambda x: x["tok"]).alias("toks"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def left_slice(toks: Column, search: int | None) -> Column:
    """Number of tokens of the earlier window before its candidates: the longest end all of which has pos + search >= the last pos."""
    if search is None:
        return F.lit(0)
    least = F.element_at(toks, -1)["pos"] - search
    return F.coalesce(_let(least, lambda at: F.array_max(F.transform(toks, lambda t, k: F.when(t["pos"] < at, k + 1)))), F.lit(0))


def right_slice(toks: Column, boundary: Column, search: int | None) -> Column:
    """The later window's tokens up to the first with pos > max(boundary, its first position) + search."""
    if search is None:
        return toks
    limit = F.greatest(boundary, F.element_at(toks, 1)["pos"]) + search
    over = _let(limit, lambda most: F.array_position(F.transform(toks, lambda t: t["pos"] > most), True))
    return F.when(over > 0, F.slice(toks, F.lit(1), (over - 1).cast("int"))).otherwise(toks)


def words_of(toks: Column) -> Column:
    """Words of an array of tokens: token index, position, core. One begins at every initial token and at the first."""

    def words(toks: Column) -> Column:
        def spell(starts: Column) -> Column:
            def one(k: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(toks))
                pieces = F.transform(F.slice(toks, k + 1, end - k), lambda t: F.coalesce(t["piece"], F.lit("")))
                return F.struct(k.alias("at"), F.get(toks, k)["pos"].cast("bigint").alias("pos"), word_core(F.array_join(pieces, "")).alias("core"))

            return F.transform(starts, one)

        begins = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda k: (k == 0) | F.coalesce(F.get(toks, k)["initial"], F.lit(False)))
        return F.when(F.size(toks) > 0, _let(begins, spell)).otherwise(F.array().cast(WORD_TYPE))

    return _let(toks, words)


#: Code points from U+0080 on that a core keeps at its ends, as (first, last + 1) in turn; those that lower case changes; characters looked up so far.
Letters = tuple[np.ndarray, dict[int, str], dict[str, bool]]
_letters: list[Letters] = []


def _letters_of(spark: SparkSession) -> Letters:
    """What ``word_core`` makes of each character beyond ASCII, asked of Spark once, so that tasks spell cores as it does."""
    if not _letters:
        some = spark.range(0x80, 0x110000).where(~F.col("id").between(0xD800, 0xDFFF))
        some = some.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
        found = some.select("id", "c", F.lower("c").alias("low"), (word_core(F.col("c")) != "").alias("kept")).where("kept or low != c").toArrow()
        at = found["id"].to_numpy()
        at = np.sort(at[found["kept"].to_numpy()])
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=1 << 30) > 1)
        ranges = np.stack([at[edges[:-1]], at[edges[1:] - 1] + 1], axis=1).ravel()
        lower = {k: chr(k).lower() for k in range(0x80)} | {i: low for i, c, low in zip(*(found[n].to_pylist() for n in ("id", "c", "low")), strict=True) if low != c}
        _letters.append((ranges, lower, {}))
    return _letters[0]


ODD = "".join(chr(k) for k in range(0x80) if not chr(k).isalnum())


def _core(word: str, letters: Letters) -> str:
    """``word_core`` of a word."""
    ranges, lower, known = letters

    def kept(c: str) -> bool:
        if c not in known:
            known[c] = c.isalnum() if c < "\x80" else bool(np.searchsorted(ranges, ord(c), "right") % 2)
        return known[c]

    i, j = 0, len(word)
    while i < j and not kept(word[i]):
        i += 1
    while i < j and not kept(word[j - 1]):
        j -= 1
    core = word[i:j]
    return core.lower() if "Σ" in core else core.translate(lower)  # the one letter whose lower case depends on its neighbours


def _cores(words: pa.Array, letters: Letters) -> pa.Array:
    """``word_core`` of many words; those of ASCII go together."""
    plain = pc.string_is_ascii(words)
    cores = pc.ascii_lower(pc.utf8_trim(words, characters=ODD))
    if pc.all(plain).as_py() is not False:
        return cores
    other = pc.invert(plain)
    return pc.replace_with_mask(cores, other, pa.array([_core(x, letters) for x in words.filter(other).to_pylist()], words.type))


def _by_row(ufunc: np.ufunc, values: np.ndarray, size: np.ndarray, empty: float) -> np.ndarray:
    """``ufunc`` over each row's values, which lie one row after the other."""
    out, some = np.full(len(size), empty, dtype=values.dtype), size > 0
    if some.any():
        out[some] = ufunc.reduceat(values, (np.cumsum(size) - size)[some])
    return out


class _Words:
    """Words of a part of each row's tokens: their row, place, position and core's number (0: empty), and how many a row has."""

    def __init__(self, taken: np.ndarray, begins: np.ndarray, toks: _Toks):
        index = np.flatnonzero(taken)
        heads = np.flatnonzero(begins[index])
        many = np.diff(heads, append=len(index))
        head = index[heads]
        self.at, self.pos, self.core = toks.at[head], np.trunc(toks.pos[head]), toks.single[toks.code[head]]
        if len(longer := np.flatnonzero(many > 1)):
            self.core[longer] = toks.numbers([toks.code[head[k] : head[k] + many[k]].tolist() for k in longer])
        self.n = np.bincount(toks.row[head], minlength=len(toks.size))
        self.start = np.cumsum(self.n) - self.n


class _Toks:
    """The tokens of window rows, flat: row, place in the row, position, whether one begins a word, and its piece's code."""

    def __init__(self, lists: pa.ListArray, letters: Letters):
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(self.size)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.row)) - (self.end - self.size)[self.row]
        flat = lists.flatten()
        self.pos = pc.struct_field(flat, "pos").to_numpy(zero_copy_only=False)
        if not self.size.all():
            self.pos = self.pos.astype(np.float64)  # an empty row's last position is none
        self.initial = pc.fill_null(pc.struct_field(flat, "initial").cast(pa.bool_()), False).to_numpy(zero_copy_only=False)
        codes = pc.fill_null(pc.struct_field(flat, "piece").cast(pa.string()), "").dictionary_encode()
        self.code, self.pieces = codes.indices.to_numpy(), codes.dictionary
        cores = pa.concat_arrays([pa.array([""]), _cores(self.pieces, letters)]).dictionary_encode()
        self.single, self._letters = cores.indices.to_numpy()[1:].astype(np.int64), letters
        self._single_cores, self._known = cores.dictionary, None

    def numbers(self, words: list[list[int]]) -> list[int]:
        """The cores' numbers of words of several pieces, which are given by their codes."""
        if self._known is None:
            self._known = {x: k for k, x in enumerate(self._single_cores.to_pylist())}
        pieces, known = self.pieces.to_pylist(), self._known  # both sides' words share the numbers
        cores = _cores(pa.array(["".join(pieces[c] for c in word) for word in words], pa.string()), self._letters)
        return [known.setdefault(x, len(known)) for x in cores.to_pylist()]

    def of_row(self, k: np.ndarray) -> np.ndarray:
        """The position of the token at ``k`` (of all) of each row; none where the row is empty."""
        if not self.size.all():
            return np.where(self.size > 0, np.append(self.pos, np.nan)[np.where(self.size > 0, k, 0)], np.nan)
        return self.pos[k]


def _longest_runs(a: _Words, b: _Words, left: np.ndarray, right: np.ndarray, near: float) -> np.ndarray:
    """(run, left_at, right_at) of each pair of rows: the longest run of words with equal cores, in place.

    Two words match with the same core, not empty, and positions at most ``near`` apart. The smallest
    place on the left, then on the right, wins ties. Many pairs go together, a word of the left at a time.
    """
    found = np.zeros((3, len(left)), dtype=np.int64)
    for part in np.array_split(np.arange(len(left)), max(1, len(left) * max(1, b.n.max(initial=0)) // 1_000_000)):
        if not len(part):
            continue
        grid = []
        for words, rows, missing in ((a, left[part], -1), (b, right[part], -2)):
            col = np.arange(max(1, words.n[rows].max()))
            real = col < words.n[rows][:, None]
            index = np.where(real, words.start[rows][:, None] + col, 0)
            core = np.where(real, words.core[index] if len(words.core) else 0, missing)
            grid += [np.where(core == 0, missing, core), np.where(real, words.pos[index] if len(words.pos) else 0, 0)]
        x, p, y, q = grid
        rows, length = np.arange(len(part)), np.zeros((len(part), y.shape[1] + 1), dtype=np.int64)
        best = np.zeros((3, len(part)), dtype=np.int64)
        for i in range(x.shape[1]):
            same = (x[:, i, None] == y) & (np.abs(q - p[:, i, None]) <= near)
            length[:, 1:] = np.where(same, length[:, :-1] + 1, 0)
            j = length[:, 1:].argmax(axis=1)
            n = length[rows, j + 1]
            more = n > best[0]
            best[:, more] = n[more], (i - n + 1)[more], (j - n + 1)[more]
        found[:, part] = best
    return found


def _seams(lists: pa.ListArray, first: np.ndarray, reach: float | None, search: int | None, tolerance: int | None, letters: Letters) -> tuple[dict[str, np.ndarray], float | None]:
    """The columns of ``PAIR`` for rows in order; where not ``first``, a row's left window is the row before it.

    ``reach`` is the furthest position of the first row's key before it; what it is after the last row comes back.
    """
    t = _Toks(lists, letters)
    none = np.nan if t.pos.dtype.kind == "f" else np.iinfo(t.pos.dtype).min
    tops = _by_row(np.fmax, t.pos, t.size, none)
    reaches = np.full(len(first), none, dtype=t.pos.dtype)
    begins, after = np.flatnonzero(np.append(True, first[1:])[: len(first)]), reach
    for i, j in zip(begins, [*begins[1:], len(first)], strict=True):
        known = none if first[i] or reach is None else reach
        so_far = np.fmax.accumulate(np.concatenate([[known], tops[i:j]]))
        reaches[i:j], after = so_far[:-1], so_far[-1]
    last, head = t.of_row(t.end - 1), t.of_row(t.end - t.size)
    boundary = np.roll(last, 1)
    if search is None:
        lo, upto, dropped = np.zeros_like(t.size), t.size, t.size
    else:
        dropped = _by_row(np.minimum, np.where(t.pos > (np.fmax(reaches, head) + search)[t.row], t.at, t.size[t.row]), t.size, 0)
        lo = _by_row(np.maximum, np.where(t.pos < (last - search)[t.row], t.at + 1, 0), t.size, 0)
        upto = _by_row(np.minimum, np.where(t.pos > (np.fmax(boundary, head) + search)[t.row], t.at, t.size[t.row]), t.size, 0)
    beyond = _by_row(np.minimum, np.where(t.pos > boundary[t.row], t.at, t.size[t.row]), t.size, 0)
    right = np.flatnonzero(~first[1:]) + 1
    left = right - 1
    is_left, is_right = np.zeros((2, len(first)), dtype=bool)
    is_left[left], is_right[right] = True, True
    a = _Words(is_left[t.row] & (t.at >= lo[t.row]), t.initial | (t.at == lo[t.row]), t)
    b = _Words(is_right[t.row] & (t.at < upto[t.row]), t.initial | (t.at == 0), t)
    found = _longest_runs(a, b, left, right, np.inf if tolerance is None else tolerance)
    run, left_at, right_at, keep, start, slice_start, left_n = np.zeros((7, len(first)), dtype=np.int64)
    run[right], left_at[right], right_at[right] = found
    # a run of two words or more cuts the left where it starts and takes the right's copy; else the left is whole, and the right loses what lies at or before the boundary
    left_n[right], slice_start[right] = t.size[left], lo[left]
    keep[right], start[right] = t.size[left], beyond[right]
    good = run >= 2
    of = np.flatnonzero(good)
    keep[of], start[of] = a.at[a.start[of - 1] + left_at[of]], b.at[b.start[of] + right_at[of]]
    # descending anywhere, nulls first
    order = np.where(np.isnan(t.pos), -np.inf, t.pos) if t.pos.dtype.kind == "f" else t.pos
    down = np.zeros(len(t.pos), dtype=bool)
    down[1:] = (order[1:] < order[:-1]) & (t.at[1:] > 0)
    return {
        "left_n": left_n, "n": t.size, "falls": _by_row(np.logical_or, down, t.size, False), "keep_len": keep, "append_from": start, "run": run, "spliced": good,
        "left_at": left_at, "right_at": right_at, "slice_start": slice_start,
        "dropped": np.where(first, 0, dropped),
    }, after


def _run_in_row(left: Column, right: Column, tolerance: int | None) -> Column:
    """``_longest_runs`` in array functions, for use inside a fold."""

    def extend(state: Column, w: Column) -> Column:
        def length(v: Column, j: Column) -> Column:
            same = (w["core"] != "") & (v["core"] == w["core"])
            if tolerance is not None:
                same &= F.abs(v["pos"] - w["pos"]) <= tolerance
            return F.when(same, F.coalesce(F.get(state["row"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0))

        def keep(row: Column) -> Column:
            # places are negated, so that the greatest struct is the longest run that starts first
            ends = F.transform(row, lambda n, j: F.struct(n.alias("run"), (n - w["no"] - 1).alias("i"), (n - j - 1).alias("j")))
            return F.struct(row.alias("row"), F.greatest(state["best"], F.array_max(ends)).alias("best"))

        return _let(F.transform(right, length), keep)

    numbered = F.transform(left, lambda w, k: F.struct(k.alias("no"), w["pos"].alias("pos"), w["core"].alias("core")))
    nothing = F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    state = F.struct(F.array_repeat(F.lit(0), F.size(right)).alias("row"), nothing.alias("best"))
    return F.aggregate(
        numbered, state, extend, lambda s: F.struct(s["best"]["run"].alias("run"), (-s["best"]["i"]).alias("left_at"), (-s["best"]["j"]).alias("right_at"))
    )


def _candidates(left: Column, right: Column, search: int | None) -> Column:
    """struct(lo, a, b): where the left slice begins, and the words of both slices."""

    def both(lo: Column) -> Column:
        a = words_of(F.slice(left, lo + 1, F.size(left)))
        b = words_of(right_slice(right, F.element_at(left, -1)["pos"], search))
        return F.struct(lo.alias("lo"), a.alias("a"), b.alias("b"))

    return _let(left_slice(left, search), both)


def _cut(left: Column, right: Column, lo: Column, a: Column, b: Column, run: Column) -> tuple[Column, Column]:
    """(keep_len, append_from). A run of two words or more cuts the left where the run starts and takes
    the right's copy from there; else the left is kept whole and the right loses what lies at or
    before the boundary."""
    beyond = _let(F.element_at(left, -1)["pos"], lambda end: F.array_position(F.transform(right, lambda t: t["pos"] > end), True))
    fallback = F.when(beyond > 0, beyond - 1).otherwise(F.size(right))
    good = run["run"] >= 2
    keep = F.when(good, lo + F.get(a, run["left_at"].cast("int"))["at"]).otherwise(F.size(left))
    return keep.cast("bigint"), F.when(good, F.get(b, run["right_at"].cast("int"))["at"]).otherwise(fallback).cast("bigint")


def overlap_slices(tokens: DataFrame, key: str, search: int | None = None) -> DataFrame:
    """Candidate tokens of every seam: token rows with side ("left" or "right") and seam.

    Seam k lies between window k and the window before it. ``search`` None is unbounded.
    """
    w = Window.partitionBy(key).orderBy("window_no")
    t = window_rows(tokens, key).withColumn("_left", F.lag("toks").over(w)).withColumn("_no", F.lag("window_no").over(w)).where("_left is not null")
    number = lambda toks, at: F.transform(toks, lambda x, k: F.struct((k + at).cast("bigint").alias("ord"), x.alias("tok")))
    left = _let(left_slice(F.col("_left"), search), lambda lo: number(F.slice("_left", lo + 1, F.size("_left")), lo))
    right = number(right_slice(F.col("toks"), F.element_at("_left", -1)["pos"], search), F.lit(0))
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("_no").alias("no"), left.alias("slice")),
        F.struct(F.lit("right").alias("side"), F.col("window_no").alias("no"), right.alias("slice")),
    )
    t = t.select(key, F.col("window_no").alias("seam"), F.inline_outer(sides)).select(key, "seam", "side", F.col("no").alias("window_no"), F.inline_outer("slice"))
    return t.select(key, "window_no", "ord", "tok.*", "side", "seam")


def splice_pairs(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None) -> DataFrame:
    """One row per window: (key, seam, toks, left_n, n, falls, keep_len, append_from, run, spliced, left_at, right_at, slice_start, dropped).

    The seam is that with the window before; a key's first window has none and appends all it has.
    ``dropped`` is the most that the window can lose at its start, whatever came before. Windows are
    streamed in order, a batch and the window before it at a time: many seams go through numpy together.
    """
    w, letters = Window.partitionBy(key).orderBy("window_no"), _letters_of(tokens.sparkSession)
    t = window_rows(tokens, key).select(key, F.col("window_no").alias("seam"), "toks", (F.row_number().over(w) == 1).alias("_first")).sortWithinPartitions(key, "seam")

    @F.arrow_udf(f"struct<{PAIR}>")
    def pairs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        before, reach = None, None
        for toks, begins in batches:
            first, rows = begins.to_numpy(zero_copy_only=False), toks
            carried = not first[:1].all()
            if carried:
                rows, first = pa.concat_arrays([before, toks]), np.append(False, first)
            made, reach = _seams(rows, first, reach, search, tolerance, letters)
            before = rows.slice(max(0, len(rows) - 1))
            found = [pa.array(x, mask=None if n in ("n", "falls", "append_from", "dropped") else first)[int(carried) :] for n, x in made.items()]
            yield pa.StructArray.from_arrays(found, names=list(made))

    # what comes out depends on the row before: no filter may pass below
    t = t.select(key, "seam", "toks", pairs.asNondeterministic()("toks", "_first").alias("_pair"))
    return t.select(key, "seam", "toks", "_pair.*")


def _folded(windows: DataFrame, key: str, search: int | None, tolerance: int | None) -> DataFrame:
    """The exact fold of each stretch's windows, in array functions; its first window begins at its own append_from."""
    kind = windows.schema["toks"].dataType.simpleString()
    one = F.struct("window_no", "toks", "append_from", "cut", "n", "is_last")
    in_order = F.array_sort(F.collect_list(one), lambda a, b: F.when(a["window_no"] < b["window_no"], -1).otherwise(1))
    g = windows.groupBy(key, "stretch").agg(in_order.alias("_ws"))
    start = F.struct(F.array().cast(kind).alias("all"), F.array().cast("array<struct<append_from: bigint, start: bigint>>").alias("taken"))

    def step(state: Column, w: Column) -> Column:
        def add(at: Column) -> Column:
            fresh = F.slice(w["toks"], (at["append_from"] + 1).cast("int"), F.size(w["toks"]))
            mark = F.struct(at["append_from"].alias("append_from"), at["keep_len"].alias("start"))
            return F.struct(
                F.concat(F.slice(state["all"], F.lit(1), at["keep_len"].cast("int")), fresh).alias("all"), F.concat(state["taken"], F.array(mark)).alias("taken")
            )

        def meet(c: Column) -> Column:
            return _let(_run_in_row(c["a"], c["b"], tolerance), lambda run: F.struct(*[
                x.alias(n) for x, n in zip(_cut(state["all"], w["toks"], c["lo"], c["a"], c["b"], run), ("keep_len", "append_from"), strict=True)
            ]))

        first = F.when(F.size(state["taken"]) == 0, w["append_from"]).otherwise(0).cast("bigint")
        alone = F.struct(F.lit(0).cast("bigint").alias("keep_len"), first.alias("append_from"))
        return _let(F.when(F.size(state["all"]) > 0, _let(_candidates(state["all"], w["toks"], search), meet)).otherwise(alone), add)

    g = g.select(key, "stretch", "_ws", F.inline_outer(F.array(F.aggregate("_ws", start, step))))
    g = g.select(key, "stretch", F.size("all").cast("bigint").alias("_end"), F.inline_outer(F.arrays_zip("_ws", "taken")))
    # what a window left is cut by every later one's start; the last one's by the cut point after the stretch
    w = Window.partitionBy(key, "stretch")
    later = w.orderBy(F.desc("window_no")).rowsBetween(Window.unboundedPreceding, -1)
    past = w.orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select(key, "stretch", "_end", "_ws.window_no", "_ws.toks", "_ws.cut", "_ws.is_last", "taken.append_from", "taken.start").withColumn("_next", F.min("start").over(later))
    left = F.col("append_from") + F.greatest(F.coalesce("_next", "_end") - F.col("start"), F.lit(0))
    g = g.withColumn("cut", F.when(F.col("_next").isNull() & ~F.col("is_last"), F.col("cut")).otherwise(left))
    shift = F.col("start") - F.coalesce(F.sum(F.greatest(F.col("cut") - F.col("append_from"), F.lit(0))).over(past), F.lit(0))
    return g.select(key, "window_no", "toks", "append_from", "cut", shift.alias("_shift"), F.lit(True).alias("exact"))


def window_spans(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None) -> DataFrame:
    """(key, window_no, toks, append_from, cut, start, exact): what each window gives to the merged sequence.

    A window appended its tokens from ``append_from`` on, after ``start`` tokens of earlier windows, and
    those below ``cut`` are left at the end.

    A seam is a *cut point* where its two windows alone decide it, whatever came before: the earlier
    one's candidates begin beyond all that it can have dropped, that is beyond the tokens within
    ``search`` of the furthest position of the windows before it. Cut points part a key into stretches.
    Where every window of a stretch leaves enough for the next seam, the pairs' decisions hold; the other
    stretches are folded, each gathered in a row of its own (``exact``). Offsets are a sum over the
    windows. A fold never looks behind its stretch: no window of it ends within ``search`` of the
    stretch's first token. A key with a stretch of which that can't be said is one stretch.
    """
    s = splice_pairs(tokens, key, search, tolerance).withColumnRenamed("seam", "window_no")
    # dealt once more, so that both branches below read the seams from one exchange
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    w = Window.partitionBy(key).orderBy("window_no")
    past, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "cut": F.lead("keep_len").over(w), "next_slice": F.lead("slice_start").over(w), "is_last": F.lead("window_no").over(w).isNull(),
    })
    first = F.col("left_n").isNull()
    held = F.coalesce(F.col("next_slice") > F.col("append_from"), F.lit(False))
    s = s.withColumn("free", F.coalesce(F.col("next_slice") > F.col("dropped"), F.lit(False)))
    s = s.withColumn("stretch", F.sum((first | (F.lag("free").over(w) & (F.col("is_last") | held))).cast("long")).over(w))
    # a pair's decision on the next seam needs the window to leave its candidates
    bad = ~F.col("is_last") & ((F.col("append_from") >= F.col("n")) | (F.col("append_from") > F.col("cut")) | (~first & ~held))
    at = F.when(first | (F.col("stretch") == 1), None).otherwise(F.get("toks", F.col("append_from").cast("int"))["pos"])
    v = Window.partitionBy(key, "stretch").orderBy("window_no")
    of_stretch = v.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = F.min(F.when(~F.col("is_last"), F.element_at("toks", -1)["pos"])).over(of_stretch)
    s = s.withColumns({"_bad": F.max(F.coalesce(bad, F.lit(True))).over(of_stretch) & (F.count("*").over(of_stretch) > 1), "_first": F.first(at).over(of_stretch), "_lasts": lasts})
    torn = F.col("_bad") & (F.col("stretch") > 1) & ~F.coalesce(F.col("_lasts") - (search or 0) > F.col("_first"), F.lit(False))
    s = s.withColumns({"_torn": F.max(torn).over(whole)}).withColumns({"_bad": F.col("_bad") | F.col("_torn"), "stretch": F.when(F.col("_torn"), 0).otherwise(F.col("stretch"))})
    s = s.withColumn("append_from", F.when(F.col("_torn") & first, 0).otherwise(F.col("append_from")))
    quick = s.where("not _bad").select(key, "window_no", "toks", "append_from", F.coalesce("cut", "n").alias("cut"), F.lit(0).cast("bigint").alias("_shift"), F.lit(False).alias("exact"))
    t = quick.unionByName(_folded(s.where("_bad"), key, search, tolerance))
    before = F.coalesce(F.sum(F.greatest(F.col("cut") - F.col("append_from"), F.lit(0))).over(past), F.lit(0))
    return t.withColumn("start", before + F.col("_shift")).select(key, "window_no", "toks", "append_from", "cut", "start", "exact")


def _left(upto: str) -> Column:
    return F.slice("toks", (F.col("append_from") + 1).cast("int"), F.greatest(F.col(upto) - F.col("append_from"), F.lit(0)).cast("int"))


def _text(toks: Column, separator: str) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["piece"]), separator)


def merge_windows(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None) -> DataFrame:
    """The merged sequence: token rows that stay, to be read in the order (window_no, ord)."""
    spans = window_spans(tokens, key, search, tolerance)
    rows = spans.select(key, "window_no", "append_from", F.posexplode(_left("cut")).alias("_k", "_t"))
    return rows.select(key, "window_no", (F.col("append_from") + F.col("_k")).alias("ord"), "_t.*")


def merged_text(spans: DataFrame, key: str, separator: str = " ") -> DataFrame:
    """(key, n_tokens, text) of ``window_spans``, its pieces in merged order."""
    parts = spans.select(key, "window_no", _left("cut").alias("_t"))
    parts = parts.select(key, "window_no", F.size("_t").alias("_n"), _text(F.col("_t"), separator).alias("_text")).where("_n > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_no", "_text"))), lambda x: x["_text"]), separator)
    return parts.groupBy(key).agg(F.sum("_n").alias("n_tokens"), text.alias("text"))


def segments(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None, frame_ms: int = 80, separator: str = " ") -> DataFrame:
    """One segment per window that appended something: id from 0, text as it was then, start and end ms.

    Later seams never change a segment.
    """
    s = window_spans(tokens, key, search, tolerance).withColumn("_n", F.size("toks")).where("_n > append_from")
    number = (F.row_number().over(Window.partitionBy(key).orderBy("window_no")) - 1).cast("long")
    first, last = F.get("toks", F.col("append_from").cast("int"))["pos"], F.element_at("toks", -1)["pos"]
    return s.select(
        key, number.alias("segment_id"), _text(_left("_n"), separator).alias("text"), (first * frame_ms).cast("long").alias("start_ms"), (last * frame_ms).cast("long").alias("end_ms")
    )


def confirmed_split(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None, separator: str = " ") -> DataFrame:
    """One row per step (window): confirmed tokens before it, how many of them stay, and what it adds.

    (key, step, confirmed_before, kept, unconfirmed, confirmed_after). A step shows its own tokens
    from append_from on as unconfirmed; its promotion truncates and appends as one.
    """
    s = window_spans(tokens, key, search, tolerance).withColumn("_n", F.size("toks"))
    after = F.col("start") + F.col("_n") - F.col("append_from")
    before = F.coalesce(F.lag(after).over(Window.partitionBy(key).orderBy("window_no")), F.lit(0))
    return s.select(
        key, F.col("window_no").alias("step"), before.cast("long").alias("confirmed_before"), F.col("start").cast("long").alias("kept"),
        _text(_left("_n"), separator).alias("unconfirmed"), after.cast("long").alias("confirmed_after"),
    )


def seam_audit(tokens: DataFrame, key: str, search: int | None = None, tolerance: int | None = None) -> DataFrame:
    """Per key: seams, splices, fallbacks, fallback rate, longest run, tokens cut and tokens dropped."""
    s = splice_pairs(tokens, key, search, tolerance).where("left_n is not null")
    good = F.col("spliced").cast("long")
    return s.groupBy(key).agg(
        F.count("*").alias("seams"), F.sum(good).alias("spliced"), F.sum(1 - good).alias("fallbacks"), F.round(F.avg((1 - good).cast("double")), 6).alias("fallback_rate"),
        F.max("run").alias("longest_run"), F.sum(F.col("left_n") - F.col("keep_len")).alias("cut_tokens"), F.sum("append_from").alias("dropped_tokens"),
    )


def _word_triples(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda k: F.array_join(F.slice(words, k, F.lit(3)), " "))


def _char_grams(text: Column, n: int) -> Column:
    return _let(F.split(text, ""), lambda c: F.transform(c, lambda x, i: F.array_join(F.slice(c, i + 1, F.lit(n)), "")))


def phrase_candidates(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str, phrase_id: str, phrase_col: str) -> DataFrame:
    """(_row, id, _t, phrase id, _p): lower-cased texts and phrases that share the phrase's rarest gram.

    A phrase's words but its first and last stand between spaces, and must stand so in the text. Its
    grams are every three such words in a row; with one or two of them, each; without any, all its
    stretches of three characters (or the phrase, if shorter). Texts are cut into grams once, and those
    that some phrase has are kept with their row and counted. Each phrase then meets the texts by the
    one of its grams that the fewest have: a gram that many texts hold is a key only for phrases that
    have no other. A phrase with a gram that no text has is nowhere. Rows of both tables are told apart
    by number, so repeated and null ids stay rows of their own.
    """
    t = written(texts.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.lower(F.col(text_col)).alias("_t")).where("_t is not null"))
    p = phrases.select(F.col(phrase_id).alias("_pid"), F.lower(F.col(phrase_col)).alias("_p")).where("length(_p) > 0")
    p = written(p.withColumn("_no", F.monotonically_increasing_id()))
    inner = _let(F.split("_p", " "), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    q = p.withColumn("_w", inner).withColumn("_full", F.filter("_w", lambda w: w != ""))
    kind = F.when(F.size("_w") >= 3, 3).when(F.size("_full") > 0, 1).otherwise(0)
    letters = F.when(F.length("_p") < 3, F.array("_p")).otherwise(F.filter(_char_grams(F.col("_p"), 3), lambda g: F.length(g) == 3))
    grams = F.when(kind == 3, _word_triples(F.col("_w"))).when(kind == 1, F.col("_full")).otherwise(letters)
    q = written(q.select("_no", kind.alias("_kind"), F.explode(F.array_distinct(grams)).alias("_gram")))
    words = t.select("_row", F.split("_t", " ").alias("_w"))
    of_kind = {3: words.select("_row", _word_triples(F.col("_w")).alias("_g")), 1: words.select("_row", F.col("_w").alias("_g")), 0: t.select("_row", F.concat(*[_char_grams(F.col("_t"), n) for n in (1, 2, 3)]).alias("_g"))}
    asked = {r["_kind"] for r in q.select("_kind").distinct().collect()}  # three kinds at most
    hits = None
    for k in sorted(asked):
        rows = of_kind[k].select("_row", F.lit(k).alias("_kind"), F.explode(F.array_distinct("_g")).alias("_gram"))
        found = rows.join(q.where(F.col("_kind") == k).select("_gram").distinct(), "_gram", "left_semi").select("_row", "_kind", "_gram")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = q.select(F.col("_no").alias("_row"), "_kind", "_gram")
    hits = written(hits)
    counts = hits.groupBy("_kind", "_gram").agg(F.count("*").alias("_n"))
    rarest = F.min_by(F.struct("_kind", "_gram"), F.struct(F.coalesce("_n", F.lit(0)), "_gram"))
    keys = q.join(counts, ["_kind", "_gram"], "left").groupBy("_no").agg(rarest.alias("_k"), F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0")
    met = hits.join(keys.select("_no", "_k._kind", "_k._gram"), ["_kind", "_gram"]).select("_row", "_no")
    return met.join(p, "_no").join(t, "_row").select("_row", id_col, "_t", F.col("_pid").alias(phrase_id), "_p")


def phrase_audit(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str, phrase_id: str, phrase_col: str) -> DataFrame:
    """(id, phrase id, hits) where a phrase occurs: occurrences that do not overlap, in any case.

    Candidates share the phrase's rarest gram (``phrase_candidates``). A row of texts and a row of
    phrases give one row, whatever their ids; null texts and empty phrases give none.
    """
    hit = ((F.length("_t") - F.length(F.replace(F.col("_t"), F.col("_p"), F.lit("")))) / F.length("_p")).cast("long")
    found = phrase_candidates(texts, phrases, id_col, text_col, phrase_id, phrase_col)
    return found.select(id_col, phrase_id, hit.alias("hits")).where("hits > 0")


def bucket_digests(df: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """(bucket, n, total): rows and an order-free checksum of every bucket of keys, combined before the shuffle."""
    row = F.xxhash64(*keys, *[F.coalesce(F.col(v).cast("string"), F.lit("null")) for v in values], *[F.col(v).isNull() for v in values])
    other = F.xxhash64(row, *keys)
    sums = [F.sum(x.cast("decimal(38,0)")).alias(n) for x, n in ((row, "total"), (other, "again"))]
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), *sums)


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0, buckets: int = 1 << 16) -> DataFrame:
    """Per key: "match", "missing_left", "missing_right" or "differs" (beyond ``tolerance``), and the largest delta.

    Keys come once in each table. Both sides are digested by buckets of keys first; only rows of buckets
    that differ are joined, all others match where they lie. Two buckets with equal counts and two equal
    64-bit sums are taken to be equal.
    """
    da = bucket_digests(a, keys, values, buckets).select("bucket", F.struct("n", "total", "again").alias("a"))
    db = bucket_digests(b, keys, values, buckets).select("bucket", F.struct("n", "total", "again").alias("b"))
    # written, so that both tables are digested once
    odd = written(da.join(db, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("bucket").alias("_odd")))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    some = lambda df, how: df.withColumn("_bucket", bucket).join(F.broadcast(odd), F.col("_bucket") == F.col("_odd"), how).drop("_bucket")  # noqa: E731  ``buckets`` rows at most
    left = some(a, "left_semi").select(*[F.col(k).alias(f"_a{k}") for k in keys], *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_in_a"))
    right = some(b, "left_semi").select(*[F.col(k).alias(f"_b{k}") for k in keys], *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_in_b"))
    on: Column = F.lit(True)
    for k in keys:
        on &= F.col(f"_a{k}").eqNullSafe(F.col(f"_b{k}"))
    joined = left.join(right, on, "full_outer")
    deltas = [F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}")) for v in values]
    same: Column = F.lit(True)
    for v, d in zip(values, deltas, strict=True):
        same &= F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")) | F.coalesce(d <= tolerance, F.lit(False))
    status = F.when(F.col("_in_a").isNull(), "missing_left").when(F.col("_in_b").isNull(), "missing_right").when(same, "match").otherwise("differs")
    largest = lambda of: F.greatest(*of) if len(of) > 1 else of[0]
    met = joined.select(*[F.coalesce(f"_a{k}", f"_b{k}").alias(k) for k in keys], status.alias("status"), largest(deltas).alias("delta"))
    alike = some(a, "left_anti").select(*keys, F.lit("match").alias("status"), largest([F.abs(F.col(v) - F.col(v)) for v in values]).alias("delta"))
    return met.unionByName(alike)


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.max("delta"), 6).alias("max_delta"))
