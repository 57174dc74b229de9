"""Token ids as binary files of patched frame-of-reference blocks.

A file is one image of bounded size, kept as a row of a Parquet table that Spark's committer writes:
task retries and lost executors leave no half files, on any filesystem. Image, little-endian:

    magic "PFB1", u32 documents, u32 blocks, u64 ids
    i64 id and u8 "id is not null" and u32 count of each document
    u64 start of each block in the payload, and the payload's end
    payload: per block u32 minimum, u8 width, u8 zero, u16 exceptions,
             u16 place and u32 excess of each exception, then the packed low bits

A block holds ``BLOCK`` ids. Its minimum is subtracted; the width is the least that holds
``PERCENTILE`` of the differences; those above it keep their low bits in place and are listed whole
as exceptions. 64 differences fill ``width`` 64-bit words.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from overlapkit.llm import _shared as S

BLOCK, PERCENTILE = 512, 0.9
MAGIC = b"PFB1"
FILE_IDS = 1_000_000

# ---------------------------------------------------------------------------------------------
# blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(groups, 64) uint64 below 2**width into (groups, width) words."""
    columns, out = np.ascontiguousarray(values.T), np.zeros((width, len(values)), dtype=np.uint64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    columns, out = np.ascontiguousarray(words.T), np.zeros((64, len(words)), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | columns[word + 1] << np.uint64(64 - shift)
        out[k] = v & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks of ``ids`` (below 2**32) and their starts, the end included."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return [], np.zeros(1, dtype=np.uint64)
    padded = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(n, BLOCK)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    width = np.full(n, 32)
    for w in range(31, -1, -1):
        fits = (delta < np.uint32(1 << w)).sum(axis=1) >= PERCENTILE * BLOCK
        width[fits] = w
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        mask = np.uint64((1 << w) - 1)
        words = pack((delta[rows].astype(np.uint64) & mask).reshape(-1, 64), w).astype("<u8").reshape(len(rows), -1)
        for r, body in zip(rows.tolist(), words, strict=True):
            packed[r] = body.tobytes()
    over_row, over_at = np.nonzero(delta >= (np.uint64(1) << width.astype(np.uint64))[:, None])
    over = delta[over_row, over_at].astype("<u4")
    cut = np.searchsorted(over_row, np.arange(n + 1))
    places = over_at.astype("<u2")
    out = []
    for r in range(n):
        a, b = cut[r], cut[r + 1]
        out.append(struct.pack("<IBBH", low[r], width[r], 0, b - a) + places[a:b].tobytes() + over[a:b].tobytes() + packed[r])
    return out, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype("<u8")


def decode_blocks(payload: bytes, starts: np.ndarray, count: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last``; ``count`` is the number of ids in the whole payload."""
    last = len(starts) - 1 if last is None else last
    heads = [struct.unpack_from("<IBBH", payload, int(starts[k])) for k in range(first, last)]
    out = np.zeros((len(heads), BLOCK), dtype=np.uint64)
    width = np.array([h[1] for h in heads], dtype=np.int64)
    for w in np.unique(width).tolist() if heads else []:
        rows = np.flatnonzero(width == w)
        if w:
            at = [int(starts[first + r]) + 8 + 6 * heads[r][3] for r in rows.tolist()]
            words = np.concatenate([np.frombuffer(payload, dtype="<u8", count=BLOCK // 64 * w, offset=a) for a in at])
            out[rows] = unpack(words.reshape(-1, w), w).reshape(len(rows), BLOCK)
    for r, (_, _, _, n) in enumerate(heads):
        if n:
            a = int(starts[first + r]) + 8
            place = np.frombuffer(payload, dtype="<u2", count=n, offset=a)
            out[r, place] = np.frombuffer(payload, dtype="<u4", count=n, offset=a + 2 * n)
    out += np.array([h[0] for h in heads], dtype=np.uint64)[:, None] if heads else np.uint64(0)
    return out.reshape(-1).astype(np.uint32)[: max(0, count - first * BLOCK)]


def write_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    blocks, starts = encode_blocks(ids)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    plain = np.array([x or 0 for x in doc_ids], dtype="<i8")
    head = MAGIC + struct.pack("<IIQ", len(doc_ids), len(blocks), len(ids))
    return b"".join([head, plain.tobytes(), known.tobytes(), np.array(counts, dtype="<u4").tobytes(), starts.tobytes(), *blocks])


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, counts, ids) of an image."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, blocks, n = struct.unpack_from("<IIQ", image, 4)
    at = 20
    plain = np.frombuffer(image, dtype="<i8", count=docs, offset=at)
    known = np.frombuffer(image, dtype=np.uint8, count=docs, offset=at + 8 * docs)
    counts = np.frombuffer(image, dtype="<u4", count=docs, offset=at + 9 * docs)
    starts = np.frombuffer(image, dtype="<u8", count=blocks + 1, offset=at + 13 * docs)
    payload = image[at + 13 * docs + 8 * (blocks + 1) :]
    return [x if k else None for x, k in zip(plain.tolist(), known.tolist(), strict=True)], counts, decode_blocks(payload, starts, n)


# ---------------------------------------------------------------------------------------------
# encoding, with what a piece of text between white space gives kept per worker

WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
PLAIN = r"\A[\t\n\r -~¡-įı-ɏ]*\z"  # letters without context in lower-casing, and no combining marks
MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""  # one piece together, as the apostrophe, which may begin one, is not among them
BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level pieces spell these as they are, others from U+0100 on
SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in BYTES)}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pieces never cross white space.

    Texts of plain letters are lower-cased, cut at white space and numbered by their distinct stretches
    as Arrow arrays; each new stretch is encoded by the tokenizer and remembered, up to ``room`` bytes of
    them: half a room of new ones at most, and what the half before has seen. A stretch of letters is one
    piece and goes to the tokenizer's model at once, marks after it are a piece of their own; other
    stretches are encoded many together, told apart by the word-end mark of their last piece. Any other
    text, or one that may hold a special token, is encoded as it is.
    """

    def __init__(self, path: str, room: int = 128_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.known, self.older, self.held = Tokenizer.from_file(path), room, {}, {}, 0
        self.model, vocab = self.tokenizer.model, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True

    def _learn(self, stretches: list[str]) -> None:
        known, tokenize = self.known, self.model.tokenize
        cut, rest = [], set()
        for x in stretches:
            stem = x.rstrip(MARKS)
            if not stem.isalpha():
                rest.add(x)
                continue
            if stem not in known:
                word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(SPELT)
                known[stem] = array("I", [t.id for t in tokenize(word)]).tobytes()
            if len(stem) < len(x):
                cut.append((x, stem, x[len(stem) :]))
        need = [x for x in rest.union(marks for _, _, marks in cut) if x not in known]
        for a in range(0, len(need), 5_000):
            part = need[a : a + 5_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            words = np.cumsum([len(WORDS.findall(x)) for x in part])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == words[-1]:
                cuts = [0, *ends[words - 1].tolist()]
                known.update((x, ids[i:j].tobytes()) for x, i, j in zip(part, cuts, cuts[1:], strict=False))
            else:
                for x in part:
                    known[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
        for x, stem, marks in cut:
            known[x] = known[stem] + known[marks]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _plain(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        numbered = words.flatten().dictionary_encode()
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > self.room / 2:
            self.known, self.older, self.held = {}, self.known, 0
        self.known[""], before = b"", len(self.known)
        ids = list(map(self.known.get, names))
        new = [w for w, x in zip(names, ids, strict=True) if x is None]
        old = {w: self.older[w] for w in new if w in self.older}
        self.known.update(old)
        if len(old) < len(new):
            self._learn([w for w in new if w not in old] if old else new)
        self.held += 2 * sum(map(len, new)) + sum(map(len, old.values())) + 8 * len(new)
        self.held += 150 * (len(self.known) - before)  # what Python adds to two small objects
        if new:
            ids = [self.known[w] if x is None else x for w, x in zip(names, ids, strict=True)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size
        flat, code = np.frombuffer(b"".join(ids), dtype="<u4"), numbered.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        take = np.repeat(start[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out = flat[take].tobytes()
        cuts = 4 * np.r_[0, ends][words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = pc.and_(pc.match_substring_regex(column, PLAIN), pc.invert(pc.match_substring(column, "<|")))
        made = iter(self._plain(column.filter(plain)))
        return [next(made) if ok else self._whole(text) for ok, text in zip(plain.to_pylist(), pc.if_else(plain, "", column).to_pylist(), strict=True)]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------------------------------------
# tables of files


def token_files(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """(shard, file_no, n_docs, n_ids, image): files of ids in ascending order of ``id_col``.

    One range shuffle of the texts; a shard's rows stream through in order, and a file is closed at
    ``FILE_IDS`` ids, documents whole.

    Cases: null ids come first; of rows with one id, or none, the order is that of a hash of the text,
    so that ``start`` does not depend on how the rows lie, and however many they are, several shards
    share them; null texts are empty and hold the end id alone; ids that are no integers are an error;
    other columns are dropped; an empty table has no files.
    """
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col} is no integer column")
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id()]  # the last tells equal rows apart
    rows = rows.select("*", *[o.alias(f"o{k}") for k, o in enumerate(order[1:])])
    rows = rows.repartitionByRange(partitions, "id", "o0", "o1").sortWithinPartitions("id", "o0").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, shard = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        ids, counts, parts, size, number = [], [], [], 0, 0

        def image() -> pa.RecordBatch:
            data = write_image(ids, counts, np.frombuffer(b"".join(parts), dtype="<u4"))
            row = [pa.array([x]) for x in (shard, number, len(ids), size)]
            names = ["shard", "file_no", "n_docs", "n_ids", "image"]
            return pa.RecordBatch.from_arrays([row[0].cast("int32"), row[1].cast("int32"), *row[2:], pa.array([data], pa.binary())], names=names)

        for batch in S.slices(batches, "text"):
            for doc, data in zip(batch.column("id").to_pylist(), encode(batch.column("text")), strict=True):
                ids.append(doc)
                parts.append(data + end)
                counts.append(len(data) // 4 + 1)
                size += counts[-1]
                if size >= FILE_IDS:
                    yield image()
                    ids, counts, parts, size, number = [], [], [], 0, number + 1
        if ids:
            yield image()

    return rows.mapInArrow(run, "shard int, file_no int, n_docs long, n_ids long, image binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    token_files(docs, tokenizer, **options).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """One row per document of the files in ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start is the number of ids before the document: sums over the files' counts give each file's
    start (a window per shard, and one over the shards, of which there are as many as partitions).
    """
    files = spark.read.parquet(path)
    index = files.select("shard", "file_no", "n_ids")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shards, "shard")
    index = index.select("shard", "file_no", (F.col("shard_start") + F.col("in_shard")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, image in zip(*(batch.column(c).to_pylist() for c in ("shard", "file_no", "image")), strict=True):
                docs, counts, values = read_image(image)
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                raw, n = memoryview(values.astype("<u4").tobytes()), len(docs)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [np.full(n, shard, dtype=np.int32), np.full(n, number, dtype=np.int32), starts, counts.astype(np.int64)]
                arrays = [*map(pa.array, out), pa.array(docs, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "file_no", "at", "n_tokens", "doc_id", "ids_crc32"]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "shard int, file_no int, at long, n_tokens long, doc_id long, ids_crc32 long" + ", ids array<long>" * ids
    rows = files.select("shard", "file_no", "image").mapInArrow(run, schema).join(index, ["shard", "file_no"])
    return rows.select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
