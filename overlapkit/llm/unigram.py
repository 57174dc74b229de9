"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a SentencePiece model file, which the library reads; the segmentation is this
module's: the sequence of pieces with the highest sum of log scores, a longer last piece winning ties.
A unigram model's file holds the pieces' log-probabilities, which are taken as they are. A BPE model's
file holds merge ranks in their place, and no tokenizer is trained here: log-probabilities are then
read off the ranks by Zipf's law, log(1 / (rank + 2.7)) less the logarithm of their sum, since merges
are ranked by how often they occur. Ids are thus those of a unigram model with these pieces and
scores, and not those that BPE merging gives.

A character that no piece covers costs the lowest score less 10 and is written as its UTF-8 bytes'
pieces ``<0xNN>``. Spaces become the marker U+2581, and one is put before the text; decoding joins
pieces, turns bytes back into text (each invalid byte run into U+FFFD), and markers into spaces, and
drops the first.

No piece has a marker after another character, so a text's best path is the best paths of its
stretches "markers, then the rest" one after another. Stretches are found once per batch and many of
them go through the trie together, a byte at a time, as numpy arrays; a worker remembers up to
``room`` bytes of them. Stretches above ``LONG`` bytes take the same steps one by one and are not kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from overlapkit.llm import _shared as S

MARK = "▁"
UNKNOWN_COST = 10.0
ZIPF_SHIFT = 2.7  # Mandelbrot's constant for words
LONG = 48
BREAK = re.compile(r"\n| *[^ \n]+| +")  # a new line is cut off alone where no piece holds one
PLAIN_BREAK = re.compile(r" *[^ ]+| +")


class DoubleArray:
    """Trie of byte strings: a node's child by byte c is ``base[node] + c`` if ``check`` there is the node."""

    def __init__(self, words: list[bytes]):
        tree: dict[int, dict[int, int]] = {0: {}}
        value: dict[int, int] = {}
        for k, word in enumerate(words):
            node = 0
            for c in word:
                children = tree[node]
                if c not in children:
                    children[c] = len(tree)
                    tree[len(tree)] = {}
                node = children[c]
            value.setdefault(node, k)
        size = 2 * len(tree) + 1024
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        slots, bases, parents = {0: 0}, {}, {}
        free, hint = 257, 257  # so that no base is below 1
        queue = [0]
        for node in queue:  # grows as children are placed
            codes = np.array(sorted(tree[node]), dtype=np.int64)
            if not len(codes):
                continue
            while taken[free]:
                free += 1
            # an only child takes the first free slot; other families look on from where the last one found room
            base = free - int(codes[0]) if len(codes) == 1 else hint
            width = 1 if len(codes) == 1 else 64
            while True:
                if base + width + 256 > len(taken):
                    taken = np.r_[taken, np.zeros(len(taken) + width + 256, dtype=bool)]
                clash = taken[base + codes[0] : base + codes[0] + width].copy()
                for c in codes[1:].tolist():
                    clash |= taken[base + c : base + c + width]
                if not clash.all():
                    base += int(np.argmin(clash))
                    break
                base, width = base + width, 512
            if len(codes) > 1:
                hint = base
            bases[node] = base
            taken[base + codes] = True
            for c in codes.tolist():
                child = tree[node][c]
                slots[child], parents[child] = base + c, slots[node]
                queue.append(child)
        size = max(slots.values()) + 257
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.value = np.full(size, -1, dtype=np.int32)
        for table, found in ((self.base, bases), (self.check, parents), (self.value, value)):
            at = np.array([slots[node] for node in found], dtype=np.int64)
            table[at] = list(found.values())


class Unigram:
    """Pieces with scores; ``kinds`` are "normal", "byte" or "control" for each."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], room: int = 64_000_000):
        self.room, self.known, self.held = room, {}, 0
        plain = [k for k, kind in enumerate(kinds) if kind == "normal"]
        if any(MARK in pieces[k].lstrip(MARK) for k in plain):
            raise ValueError("a piece has a marker after another character")
        self.trie = DoubleArray([pieces[k].encode() for k in plain])
        self.plain = np.array(plain, dtype=np.int64)
        self.score = np.array([scores[k] for k in plain])
        self.unknown = float(min(self.score, default=0.0)) - UNKNOWN_COST
        self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist()
        byte = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == "byte"}
        if len(byte) < 256:
            raise ValueError("the pieces of some bytes are missing")
        self.byte = np.array([byte[b] for b in range(256)], dtype=np.int64)
        of_byte = {k: bytes([b]) for b, k in byte.items()}
        self.bytes_of = [of_byte.get(k, b"" if kinds[k] == "control" else pieces[k].replace(MARK, " ").encode()) for k in range(len(pieces))]
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[self.byte] = True
        self.split = PLAIN_BREAK if any("\n" in pieces[k] for k in plain) else BREAK

    # one stretch: the plain form of the same steps
    def best(self, word: bytes) -> list[int]:
        base, check, value, score, n = *self.lists, len(word)
        top, back = [0.0] + [-np.inf] * n, [(-1, -1)] * (n + 1)
        for i in range(n):
            if top[i] == -np.inf:
                continue
            width = 1 + (word[i] >= 0xC0) + (word[i] >= 0xE0) + (word[i] >= 0xF0)
            node, single = 0, False
            for k in range(i, n):
                child = base[node] + word[k]
                if check[child] != node:
                    break
                node, v = child, value[child]
                if v >= 0:
                    single |= k + 1 - i == width
                    if top[i] + score[v] > top[k + 1]:
                        top[k + 1], back[k + 1] = top[i] + score[v], (i, v)
            if not single and top[i] + self.unknown > top[i + width]:
                top[i + width], back[i + width] = top[i] + self.unknown, (i, -1)
        out, at = [], n
        while at:
            i, v = back[at]
            out += [int(self.plain[v])] if v >= 0 else [int(self.byte[b]) for b in reversed(word[i:at])]
            at = i
        return out[::-1]

    def _many(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of stretches of similar length."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, size = len(words), np.array([len(w) for w in words])
        longest = int(size.max())
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), dtype=np.uint8).reshape(n, longest).T.astype(np.int32)
        top = np.full((longest + 1, n), -np.inf)
        top[0] = 0.0
        start = np.zeros((longest + 1, n), dtype=np.int32)
        piece = np.full((longest + 1, n), -1, dtype=np.int32)
        for i in range(longest):
            rows = np.flatnonzero((top[i] > -np.inf) & (i < size))
            if not len(rows):
                continue
            lead = text[i][rows]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, dtype=bool)
            live, node = rows, np.zeros(len(rows), dtype=np.int32)
            for k in range(i, longest):
                child = base[node] + text[k][live]
                ok = (check[child] == node) & (k < size[live])
                live, node = live[ok], child[ok]
                if not len(live):
                    break
                v = value[node]
                has = v >= 0
                r, v = live[has], v[has]
                score = top[i][r] + self.score[v]
                better = score > top[k + 1][r]
                rb = r[better]
                top[k + 1][rb], start[k + 1][rb], piece[k + 1][rb] = score[better], i, v[better]
                wide = text[i][r]
                single[r] |= 1 + (wide >= 0xC0) + (wide >= 0xE0) + (wide >= 0xF0) == k + 1 - i
            lone = rows[~single[rows]]
            if len(lone):
                to = i + width[~single[rows]]
                score = top[i][lone] + self.unknown
                better = score > top[to, lone]
                lone, to, score = lone[better], to[better], score[better]
                top[to, lone], start[to, lone], piece[to, lone] = score, i, -1
        at, rows = size.copy(), np.arange(n)
        owner, ids, order, step = [], [], [], 0
        while len(rows):
            i, v = start[at[rows], rows], piece[at[rows], rows]
            plain = v >= 0
            owner.append(rows[plain])
            ids.append(self.plain[v[plain]])
            order.append(np.full(plain.sum(), step))
            step += 1
            raw, first, last = rows[~plain], i[~plain], at[rows][~plain]
            for k in range(4 if len(raw) else 0):  # the bytes of an unknown character, last first
                has = last - 1 - k >= first
                owner.append(raw[has])
                ids.append(self.byte[text[last[has] - 1 - k, raw[has]]])
                order.append(np.full(has.sum(), step))
                step += 1
            at[rows] = i
            rows = rows[i > 0]
        owner, ids, order = (np.concatenate(x) for x in (owner, ids, order))
        sort = np.lexsort((-order, owner))
        flat = ids[sort].astype("<u4").tobytes()
        cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].tolist()
        return [flat[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, stretches: set[str]) -> dict[str, bytes]:
        """Ids of stretches; those up to ``LONG`` bytes are remembered."""
        coded = [(w, w.replace(" ", MARK).encode()) for w in stretches]
        coded.sort(key=lambda x: len(x[1]))
        short, found = [x for x in coded if len(x[1]) <= LONG], {}
        for a in range(0, len(short), 8_192):
            part = short[a : a + 8_192]
            found.update(zip((w for w, _ in part), self._many([b for _, b in part]), strict=True))
        self.known.update(found)
        self.held += sum(len(w) + len(x) + 150 for w, x in found.items())  # 150: what Python adds to two small objects
        return {w: np.array(self.best(b), dtype="<u4").tobytes() for w, b in coded[len(short) :]}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        cut = [self.split.findall(" " + t) if t else [] for t in texts]
        if self.held > self.room:  # start over
            self.known, self.held = {}, 0
        new = {w for words in cut for w in words} - self.known.keys()
        long = self._learn(new) if new else {}
        get = self.known.__getitem__ if not long else lambda w: long[w] if w in long else self.known[w]
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def zipf_scores(scores: list[float], kinds: list[str]) -> list[float]:
    """Log-probabilities of ranked pieces: the higher a normal piece's score, the lower its rank; equal scores keep their order."""
    plain = [k for k, kind in enumerate(kinds) if kind == "normal"]
    order = sorted(plain, key=lambda k: -scores[k])
    share = 1 / (np.arange(len(order)) + 1 + ZIPF_SHIFT)
    out = np.zeros(len(scores))
    out[order] = np.log(share / share.sum())
    return out.astype(np.float32).astype(float).tolist()  # as a model file would hold them


def read_model(path: str) -> tuple[list[str], list[float], list[str]]:
    """(pieces, log scores, kinds) of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    kinds = ["byte" if sp.is_byte(k) else "control" if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) else "normal" for k in ids]
    scores = [sp.get_score(k) for k in ids]
    plain = [s for s, kind in zip(scores, kinds, strict=True) if kind == "normal"]
    if all(s == int(s) for s in plain):  # whole numbers: merge ranks
        scores = zipf_scores(scores, kinds)
    return [sp.id_to_piece(k) for k in ids], scores, kinds


@cache
def tokenizer(path: str) -> Unigram:
    return Unigram(*read_model(path))


def encode_texts(docs: DataFrame, model: str, *, text_col: str = "text", keep: list[str], ids: bool = True, digest: bool = False) -> DataFrame:
    """``keep`` columns and n_tokens, n_byte_tokens, and, if asked for, ``ids`` (array<int>).

    ``digest`` adds ids_crc32 (of the ids as little-endian 32-bit integers) and
    round_trip (the ids decode to the text). Whole texts, no shuffle.

    Cases: null and empty texts have no ids; repeated rows are encoded alike, each with a row; columns
    outside ``keep`` are dropped, and one in it that has a result's name is an error; an empty table
    gives no rows.
    """
    more = {"n_tokens": "int", "n_byte_tokens": "int"} | ({"ids_crc32": "long", "round_trip": "boolean"} if digest else {}) | ({"ids": "array<int>"} if ids else {})
    if clash := set(more) & set(keep):
        raise ValueError(f"columns to keep have the results' names: {sorted(clash)}")
    schema, with_ids = S.schema_of(docs, keep, **more), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model)
        for batch in S.slices(batches, text_col, 2_000_000):
            texts = S.strings(batch.column(text_col))
            coded = tok.encode(texts)
            ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
            ends = np.cumsum([len(x) // 4 for x in coded], dtype=np.int64)
            seen = np.r_[0, np.cumsum(tok.is_byte[ids])]
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            more = {"n_tokens": pa.array((ends - starts).astype(np.int32)), "n_byte_tokens": pa.array((seen[ends] - seen[starts]).astype(np.int32))}
            if digest:
                more["ids_crc32"] = pa.array([zlib.crc32(x) for x in coded], pa.int64())
                back = [tok.decode(ids[a:b]) == t for a, b, t in zip(starts.tolist(), ends.tolist(), texts, strict=True)]
                more["round_trip"] = pa.array(back, pa.bool_())
            if with_ids:
                more["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
            yield S.with_columns(batch, keep, **more)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, model: str, *, ids_col: str = "ids", keep: list[str]) -> DataFrame:
    """``keep`` columns and ``text`` from an array column of ids. Null ids give a null text."""
    schema = S.schema_of(tokens, keep, text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model)
        for batch in batches:
            rows = batch.column(ids_col).to_pylist()
            yield S.with_columns(batch, keep, text=pa.array([None if r is None else tok.decode(np.array(r, dtype=np.int64)) for r in rows], pa.string()))

    return tokens.select(*dict.fromkeys([*keep, ids_col])).mapInArrow(run, schema)
