"""How the given tables stand in for samples, frames, tokens, events and artifacts.

Each function gives a DataFrame; SQL of the same name (upper case) gives the same rows in DuckDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overlapkit.operators import windows
from overlapkit.plans import read

W, OVERLAP = 40, 12  # words in a window and in an overlap

SERIES = """SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
 value, ts, event_id, event_type FROM events"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, idx, value, ts, event_id, event_type): each user's events in order."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), "value", "ts", "event_id", "event_type")


FRAMES = f"SELECT series_id, idx AS frame_no, least(value / 100, 1.0) AS prob, ts, event_id FROM ({SERIES})"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return s.select("series_id", F.col("idx").alias("frame_no"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"), "ts", "event_id")


WORDS = r"SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda w: w <> '') AS ws FROM documents"


def words(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(series_id, words): the words of each document, as an array; dealt out by document if asked for."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("series_id"), "text")
    if dealt:
        d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series_id")
    ws = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\x0c]+"), lambda w: w != "")
    return d.select("series_id", ws.alias("words"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("series_id", F.size("words").cast("long").alias("n"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, idx, piece): one row a word."""
    w = words(spark, sf_dir)
    return w.select("series_id", F.posexplode("words").alias("idx", "piece")).withColumn("idx", F.col("idx").cast("long"))


def window_arrays(spark: SparkSession, sf_dir: str, noisy: bool = False, dealt: bool = True) -> DataFrame:
    """(series_id, window_no, toks): the words of every window, each word a token (piece, initial, pos).

    Noisy: in odd windows the word at pos % 11 = 0 is upper-cased (unless it has an "ß") with "," after it, and that at
    pos % 29 = 0 is "zz". Texts are dealt out by document (``dealt``), then cut; windows slice the word array, so nothing is joined.
    """
    w = words(spark, sf_dir, dealt).withColumn("n", F.size("words").cast("long"))
    plan = windows.plan_windows(w, "series_id", "n", W, OVERLAP, 1, keep=("words",)).where("len > 0")

    def token(piece, k):
        pos = F.col("start") + k
        if noisy:
            odd = F.col("window_no") % 2 == 1
            loud = F.concat(F.when(F.contains(piece, F.lit("ß")), piece).otherwise(F.upper(piece)), F.lit(","))
            piece = F.when(odd & (pos % 29 == 0), "zz").when(odd & (pos % 11 == 0), loud).otherwise(piece)
        return F.struct(piece.alias("piece"), F.lit(True).alias("initial"), pos.alias("pos"))

    own = F.slice("words", (F.col("start") + 1).cast("int"), F.col("len").cast("int"))
    return plan.select("series_id", "window_no", F.transform(own, token).alias("toks"))


def cut_windows(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """The rows of ``window_arrays`` for what does not meet across windows: cut as indices into a batch's words.

    Texts are dealt out by document; no document's words are copied for each of its windows.
    """
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("series_id"), "text")
    kind = d.schema["series_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // 1_000_000  # about as many bytes of text at once
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield _windows(batch.slice(i, j - i), noisy)

    dealt = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series_id")
    return dealt.mapInArrow(cut, f"series_id {kind}, window_no long, toks array<struct<piece: string, initial: boolean, pos: bigint>>")


def _windows(batch: pa.RecordBatch, noisy: bool) -> pa.RecordBatch:
    """The windows of a batch's texts, by the plan's closed form (as in ``PLAN``)."""
    split = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]  # at ASCII white space
    n = np.array([len(x) for x in split], dtype=np.int64)
    base = np.cumsum(n) - n
    full = np.where(n < W, 0, (n - W) // (W - OVERLAP) + 1)
    tail = np.where(full > 0, (full - 1) * (W - OVERLAP) + W, -1) < n
    many = np.where(n > 0, full + tail, 0)
    doc = np.repeat(np.arange(len(n)), many)
    no = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.where(no < full[doc], no * (W - OVERLAP), np.maximum(n[doc] - W, 0))
    size = np.where(no < full[doc], W, np.minimum(W, n[doc] - start))
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    pos = np.repeat(start, size) + at
    index = np.repeat(base[doc], size) + pos
    flat = [w.decode() for x in split for w in x]
    if noisy:
        odd = np.repeat(no % 2 == 1, size)
        lost, loud = odd & (pos % 29 == 0), odd & (pos % 11 == 0)
        changed = np.flatnonzero(loud & ~lost)
        index = index.copy()
        louder = [(w if "ß" in w else w.upper()) + "," for w in (flat[k] for k in index[changed].tolist())]
        index[changed] = len(flat) + np.arange(len(changed))
        flat = [*flat, *louder, "zz"]
        index[lost] = len(flat) - 1
    pieces = pa.array(flat, pa.string()).take(pa.array(index))
    toks = pa.StructArray.from_arrays([pieces, pa.array(np.ones(len(pos), dtype=bool)), pa.array(pos)], names=["piece", "initial", "pos"])
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), toks)
    return pa.RecordBatch.from_arrays([batch.column("series_id").take(pa.array(doc)), pa.array(no), lists], names=["series_id", "window_no", "toks"])


def window_tokens(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """(series_id, window_no, ord, piece, initial, pos): ``window_arrays`` as token rows."""
    t = window_arrays(spark, sf_dir, noisy).select("series_id", "window_no", F.posexplode("toks").alias("ord", "tok"))
    return t.select("series_id", "window_no", F.col("ord").cast("long").alias("ord"), "tok.*")


#: Windows of the documents' words by the plan's closed form.
PLAN = f"""SELECT doc_id AS series_id, n, k AS window_no,
 CASE WHEN n >= {W} AND k < full_n THEN k * {W - OVERLAP} ELSE greatest(n - {W}, 0) END AS start,
 CASE WHEN n >= {W} AND k < full_n THEN {W} ELSE least({W}, n - greatest(n - {W}, 0)) END AS len
 FROM (SELECT *, unnest(range(0, full_n + CASE WHEN full_n = 0 OR (full_n - 1) * {W - OVERLAP} + {W} < n THEN 1 ELSE 0 END)) AS k
   FROM (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) < {W} THEN 0 ELSE (len(ws) - {W}) // {W - OVERLAP} + 1 END AS full_n FROM ({WORDS})))"""

TOKENS = f"""SELECT p.series_id, p.window_no, i AS ord, w.ws[p.start + i + 1] AS piece, p.start + i AS pos
 FROM (SELECT *, unnest(range(0, len)) AS i FROM ({PLAN})) p JOIN ({WORDS}) w ON w.doc_id = p.series_id"""

NOISY = f"""SELECT series_id, window_no, ord, pos, CASE WHEN window_no % 2 = 1 AND pos % 29 = 0 THEN 'zz'
 WHEN window_no % 2 = 1 AND pos % 11 = 0 THEN CASE WHEN contains(piece, 'ß') THEN piece ELSE upper(piece) END || ',' ELSE piece END AS piece FROM ({TOKENS})"""


SUBWORD = f"""SELECT doc_id AS series_id, 2 * (i - 1) + h AS ord, i - 1 AS pos,
 CASE WHEN h = 0 THEN '▁' || CASE WHEN length(w) >= 4 THEN substr(w, 1, 2) ELSE w END ELSE substr(w, 3) END AS piece
 FROM (SELECT doc_id, i, ws[i] AS w, unnest(CASE WHEN length(ws[i]) >= 4 THEN [0, 1] ELSE [0] END) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM ({WORDS})))"""


def subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ord, pos, piece): words of four letters or more as two pieces, cut after the second."""
    e = elements(spark, sf_dir)
    long = F.length("piece") >= 4
    head = F.concat(F.lit("▁"), F.when(long, F.substring("piece", 1, 2)).otherwise(F.col("piece")))
    parts = F.when(long, F.array(head, F.expr("substr(piece, 3)"))).otherwise(F.array(head))
    p = e.select("series_id", F.col("idx").alias("pos"), F.posexplode(parts).alias("h", "piece"))
    return p.select("series_id", (F.col("pos") * 2 + F.col("h")).alias("ord"), "pos", "piece")
