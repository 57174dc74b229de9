"""Queries of the window, token and seam operators over the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit.functions import position_to_ms, word_core, word_initial
from overlapkit.operators import seams, tokens, windows
from overlapkit.plans import fixtures as fx
from overlapkit.plans import read

KEY, W, O = "series_id", fx.W, fx.OVERLAP
N_DIFF = 6  # tolerance of the noisy runs: half the overlap


def entry_merge_round_trip(spark, sf_dir):
    """Windows of every document's words, merged back: the text must be the document's words."""
    return seams.merged_text(seams.window_spans(fx.window_arrays(spark, sf_dir), KEY, O, 0), KEY)


def b1_plan_windows(spark, sf_dir):
    return windows.plan_windows(fx.lengths(spark, sf_dir), KEY, "n", W, O, 1)


def b1_plan_windows_aligned(spark, sf_dir):
    return windows.plan_windows(fx.lengths(spark, sf_dir), KEY, "n", W, O, 8).select(KEY, "window_no", "start", "len", "frame_offset")


def b2_assign_windows(spark, sf_dir):
    """Words in each window, by the arithmetic join."""
    plan = windows.plan_windows(fx.lengths(spark, sf_dir), KEY, "n", W, O, 1)
    rows = windows.assign_windows(fx.elements(spark, sf_dir), plan, KEY, stride=W - O, size=W)
    return rows.groupBy(KEY, "window_no").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum(F.length("piece")).alias("chars"))


def b2_assign_irregular(spark, sf_dir):
    """Words in windows of uneven places and lengths, by the binned join."""
    w = fx.lengths(spark, sf_dir).where("n > 0").withColumn("window_no", F.explode(F.expr("sequence(0L, n div 20)")))
    w = w.select(KEY, "window_no", F.expr("window_no * 20 + window_no * window_no % 13").alias("start"), F.expr(f"1 + (window_no * 31 + {KEY}) % 120").alias("len"))
    rows = windows.assign_windows(fx.elements(spark, sf_dir), w, KEY)
    return rows.groupBy(KEY, "window_no").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum(F.length("piece")).alias("chars"))


def b3_pad_windows(spark, sf_dir):
    t = fx.cut_windows(spark, sf_dir)
    p = windows.pad_windows(t.select(KEY, "window_no", F.transform("toks", lambda x: F.length(x["piece"])).alias("lengths")), "lengths", W)
    return p.select(KEY, "window_no", "valid_len", F.size("lengths").cast("long").alias("size"), F.array_join("lengths", ",").alias("lengths"))


def b4_score_windows(spark, sf_dir):
    """A scorer that counts the letters of each word of a window, and fails on windows that begin with "zz"."""
    t = fx.cut_windows(spark, sf_dir, noisy=True)
    w = t.select(KEY, "window_no", F.col("toks.piece").alias("words"), F.array_min("toks.pos").alias("frame_offset"))

    def score(row):
        if row["words"][0] == "zz":
            raise ValueError("first word lost")
        return [(f"{len(x)}:{x}", k) for k, x in enumerate(row["words"])]

    return windows.score_windows(w, score, KEY)


def b4_score_batched(spark, sf_dir):
    """The same scorer, an Arrow batch of windows at a time; batches that fail are scored window by window."""
    t = fx.cut_windows(spark, sf_dir, noisy=True)
    w = t.select(KEY, "window_no", F.col("toks.piece").alias("words"), F.array_min("toks.pos").alias("frame_offset"))

    def score(batch):
        found = []
        for words in batch.column("words").to_pylist():
            if words[0] == "zz":
                raise ValueError("first word lost")
            found.append([(f"{len(x)}:{x}", k) for k, x in enumerate(words)])
        return found

    return windows.score_windows(w, score, KEY, batched=True)


def b5_stamp_positions(spark, sf_dir):
    t = fx.window_tokens(spark, sf_dir)
    t = t.select(KEY, "window_no", "ord", (F.col("pos") - F.col("ord")).alias("frame_offset"), F.lit(50).cast("long").alias("valid_frames"))
    return windows.stamp_positions(t, [KEY, "window_no"]).select(KEY, "window_no", "ord", "pos", position_to_ms(F.col("pos")).alias("ms"))


def c1_piece_info(spark, sf_dir):
    """Pieces by whether they begin a word, by joining a vocabulary; every piece beyond 5 letters is unknown."""
    t = fx.subword(spark, sf_dir).withColumnRenamed("piece", "token_id")
    vocab = t.select("token_id").distinct().where("length(token_id) <= 5").withColumn("piece", F.col("token_id"))
    return tokens.piece_info(t, vocab).groupBy(KEY, "initial").agg(F.count("*").alias("n"))


def c2_detokenize(spark, sf_dir):
    return tokens.detokenize(fx.subword(spark, sf_dir), [KEY])


def c3_byte_fallback_runs(spark, sf_dir):
    """Every word with a letter beyond ASCII spelt as byte pieces, and read back."""
    e = fx.elements(spark, sf_dir)
    plain = F.col("piece").rlike("^[\\x00-\\x7F]+$")
    spelt = F.transform(F.regexp_extract_all(F.hex("piece"), F.lit("(..)")), lambda x: F.concat(F.lit("<0x"), x, F.lit(">")))
    # a plain piece before every word keeps runs of neighbouring words apart
    pieces = F.concat(F.array(F.lit("▁")), F.when(plain, F.array("piece")).otherwise(spelt))
    t = e.select(KEY, "idx", F.posexplode(pieces).alias("k", "piece")).select(KEY, F.expr("shiftleft(idx, 32) + k").alias("ord"), "piece")
    runs = tokens.byte_fallback_runs(t, [KEY]).where("is_byte")
    return runs.select(KEY, F.expr("shiftright(ord, 32)").alias("idx"), F.col("n").cast("long").alias("n"), "piece")


def c4_segment_words(spark, sf_dir):
    t = fx.subword(spark, sf_dir).withColumn("initial", word_initial(F.col("piece")))
    w = tokens.segment_words(t, [KEY])
    return w.select(KEY, "word_no", "pos", F.col("tok_end").alias("tok_end"), F.regexp_replace("word", "^▁", "").alias("word"))


def c5_word_core(spark, sf_dir):
    return fx.elements(spark, sf_dir).groupBy(word_core(F.col("piece")).alias("core")).agg(F.count("*").alias("n"))


def d1_overlap_slices(spark, sf_dir):
    s = seams.overlap_slices(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O)
    return s.groupBy(KEY, "seam", "side").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def d2_longest_common_run(spark, sf_dir):
    s = seams.splice_pairs(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O, N_DIFF)
    return s.where("run > 0").select(KEY, "seam", "left_at", "right_at", "run")


def d3_splice_pairs(spark, sf_dir):
    s = seams.splice_pairs(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O, N_DIFF).where("left_n is not null")
    return s.select(KEY, "seam", "keep_len", "append_from", "run", "spliced")


def d4_merge_windows(spark, sf_dir):
    """The noisy windows merged at half the overlap's tolerance; keys that need it are folded exactly."""
    return seams.merged_text(seams.window_spans(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O, N_DIFF), KEY)


def d5_segments(spark, sf_dir):
    return seams.segments(fx.window_arrays(spark, sf_dir), KEY, O, 0)


def d6_confirmed_split(spark, sf_dir):
    return seams.confirmed_split(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O, 0)


def d7_seam_audit(spark, sf_dir):
    return seams.seam_audit(fx.window_arrays(spark, sf_dir, noisy=True), KEY, O, 0)


def d8_phrase_audit(spark, sf_dir):
    return seams.phrase_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def d9_table_diff(spark, sf_dir):
    """Words per document against a copy without every 7th document and with every 5th count one up."""
    a = fx.lengths(spark, sf_dir).groupBy(KEY).agg(F.sum("n").cast("double").alias("n"))
    b = a.where(f"{KEY} % 7 != 0").withColumn("n", F.col("n") + F.when(F.col(KEY) % 5 == 0, 1.0).otherwise(0.0))
    return seams.diff_summary(seams.table_diff(a, b, [KEY], ["n"], 0.5))


QUERIES = {
    f.__name__: f
    for f in (
        entry_merge_round_trip, b1_plan_windows, b1_plan_windows_aligned, b2_assign_windows, b2_assign_irregular, b3_pad_windows, b4_score_windows, b4_score_batched, b5_stamp_positions,
        c1_piece_info, c2_detokenize, c3_byte_fallback_runs, c4_segment_words, c5_word_core, d1_overlap_slices, d2_longest_common_run, d3_splice_pairs,
        d4_merge_windows, d5_segments, d6_confirmed_split, d7_seam_audit, d8_phrase_audit, d9_table_diff,
    )
}

_CORE = r"lower(regexp_replace(regexp_replace({0}, '^[^\p{{L}}\p{{M}}\p{{N}}]+', ''), '[^\p{{L}}\p{{M}}\p{{N}}]+$', ''))"
_ENDS = f"""SELECT series_id, window_no, n, last_pos, lag(last_pos) OVER w AS boundary, lag(n) OVER w AS left_n, lead(window_no) OVER w AS next_no FROM
 (SELECT series_id, window_no, count(*) AS n, arg_max(pos, ord) AS last_pos FROM noisy GROUP BY ALL) WINDOW w AS (PARTITION BY series_id ORDER BY window_no)"""
_SLICES = f"""noisy AS ({fx.NOISY}), ends AS ({_ENDS}),
 slices AS (SELECT n.*, 'left' AS side, e.next_no AS seam FROM noisy n JOIN ends e USING (series_id, window_no) WHERE e.next_no IS NOT NULL AND n.pos + {O} >= e.last_pos
 UNION ALL SELECT n.*, 'right', n.window_no FROM noisy n JOIN ends e USING (series_id, window_no)
 WHERE e.boundary IS NOT NULL AND n.pos <= greatest(e.boundary, n.pos - n.ord) + {O})"""
_RUNS = f"""words AS (SELECT *, row_number() OVER (PARTITION BY series_id, seam, side ORDER BY ord) - 1 AS no, {_CORE.format("piece")} AS core FROM slices),
 hits AS (SELECT a.series_id, a.seam, a.no AS i, b.no AS j, a.ord AS cut, b.ord AS from_ord FROM words a JOIN words b ON a.series_id = b.series_id AND a.seam = b.seam
  AND a.side = 'left' AND b.side = 'right' AND a.core = b.core AND a.core <> '' AND abs(a.pos - b.pos) <= {{tol}}),
 isl AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, seam, i - j ORDER BY i) AS g FROM hits),
 runs AS (SELECT series_id, seam, i - j AS d, g, count(*) AS run, min(i) AS i, min(j) AS j, min(cut) AS cut, min(from_ord) AS from_ord FROM isl GROUP BY ALL),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, seam ORDER BY run DESC, i, j) AS r FROM runs) WHERE r = 1)"""
_SPLICE = """splice AS (SELECT e.series_id, e.window_no AS seam, e.left_n, CASE WHEN b.run >= 2 THEN b.cut ELSE e.left_n END AS keep_len,
 CASE WHEN b.run >= 2 THEN b.from_ord ELSE coalesce((SELECT min(ord) FROM noisy n WHERE n.series_id = e.series_id AND n.window_no = e.window_no AND n.pos > e.boundary), e.n) END AS append_from,
 coalesce(b.run, 0) AS run, coalesce(b.run >= 2, false) AS spliced FROM ends e LEFT JOIN best b ON b.series_id = e.series_id AND b.seam = e.window_no WHERE e.boundary IS NOT NULL)"""
_TEXT = "array_to_string(ws, ' ')"

ORACLE = {
    "entry_merge_round_trip": f"SELECT doc_id AS series_id, len(ws) AS n_tokens, {_TEXT} AS text FROM ({fx.WORDS}) WHERE len(ws) > 0",
    "b1_plan_windows": f"SELECT series_id, window_no, start, len, start AS frame_offset FROM ({fx.PLAN})",
    "b1_plan_windows_aligned": f"""SELECT series_id, window_no, CASE WHEN tail THEN start // 8 * 8 ELSE start END AS start,
 CASE WHEN tail THEN least({W}, n - start // 8 * 8) ELSE len END AS len, start // 8 AS frame_offset
 FROM (SELECT *, n < {W} OR window_no > (n - {W}) // {W - O} AS tail FROM ({fx.PLAN}))""",
    "b2_assign_windows": f"SELECT series_id, window_no, count(*) AS n, min(pos) AS first, max(pos) AS last, sum(length(piece))::BIGINT AS chars FROM ({fx.TOKENS}) GROUP BY ALL",
    "b2_assign_irregular": f"""WITH d AS (SELECT doc_id AS series_id, ws, len(ws) AS n FROM ({fx.WORDS}) WHERE len(ws) > 0), p AS (SELECT series_id, ws, n, unnest(range(0, n // 20 + 1)) AS window_no FROM d),
 q AS (SELECT *, window_no * 20 + window_no * window_no % 13 AS start, 1 + (window_no * 31 + series_id) % 120 AS len FROM p),
 x AS (SELECT series_id, window_no, start, least(start + len, n) AS stop, ws[start + 1 : least(start + len, n)] AS own FROM q WHERE start < n)
 SELECT series_id, window_no, stop - start AS n, start AS first, stop - 1 AS last, length(array_to_string(own, ''))::BIGINT AS chars FROM x""",
    "b3_pad_windows": f"""SELECT series_id, window_no, count(*) AS valid_len, {W}::BIGINT AS size,
 string_agg(length(piece)::VARCHAR, ',' ORDER BY ord) || repeat(',0', ({W} - count(*))::INT) AS lengths FROM ({fx.TOKENS}) GROUP BY series_id, window_no""",
    "b4_score_windows": f"""WITH t AS ({fx.NOISY}), bad AS (SELECT series_id, window_no FROM t WHERE ord = 0 AND piece = 'zz')
 SELECT series_id, window_no, ord, length(piece) || ':' || piece AS token_id, pos, NULL::VARCHAR AS error FROM t ANTI JOIN bad USING (series_id, window_no)
 UNION ALL SELECT series_id, window_no, NULL, NULL, NULL, 'ValueError: first word lost' FROM bad""",
    "b5_stamp_positions": f"""SELECT series_id, window_no, ord, pos - ord + least(ord * 50 // n, ord * 4) AS pos, (pos - ord + least(ord * 50 // n, ord * 4)) * 80 AS ms
 FROM (SELECT *, count(*) OVER (PARTITION BY series_id, window_no) AS n FROM ({fx.TOKENS}))""",
    "c1_piece_info": f"""SELECT series_id, CASE WHEN length(piece) <= 5 THEN piece[1] = '▁' END AS initial, count(*) AS n FROM ({fx.SUBWORD}) GROUP BY ALL""",
    "c2_detokenize": f"SELECT doc_id AS series_id, {_TEXT} AS text FROM ({fx.WORDS}) WHERE len(ws) > 0",
    "c3_byte_fallback_runs": f"""SELECT doc_id AS series_id, i - 1 AS idx, strlen(w)::BIGINT AS n, w AS piece FROM (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
 FROM ({fx.WORDS}))) WHERE strlen(w) <> length(w)""",
    "c4_segment_words": f"""SELECT doc_id AS series_id, i - 1 AS word_no, i - 1 AS pos, 2 * (i - 1) + CASE WHEN length(ws[i]) >= 4 THEN 2 ELSE 1 END AS tok_end, ws[i] AS word
 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM ({fx.WORDS}))""",
    "c5_word_core": f"SELECT {_CORE.format('w')} AS core, count(*) AS n FROM (SELECT unnest(ws) AS w FROM ({fx.WORDS})) GROUP BY 1",
    "d1_overlap_slices": f"WITH {_SLICES} SELECT series_id, seam, side, count(*) AS n, min(pos) AS first, max(pos) AS last FROM slices GROUP BY ALL",
    "d2_longest_common_run": f"WITH {_SLICES}, {_RUNS.replace("{tol}", str(N_DIFF))} SELECT series_id, seam, i AS left_at, j AS right_at, run FROM best",
    "d3_splice_pairs": f"WITH {_SLICES}, {_RUNS.replace("{tol}", str(N_DIFF))}, {_SPLICE} SELECT series_id, seam, keep_len, append_from, run, spliced FROM splice",
    "d5_segments": f"""WITH {_SLICES.replace(fx.NOISY, fx.TOKENS)}, {_RUNS.replace("{tol}", "0")}, {_SPLICE} SELECT t.series_id, t.window_no AS segment_id, string_agg(piece, ' ' ORDER BY ord) AS text,
 arg_min(pos, ord) * 80 AS start_ms, arg_max(pos, ord) * 80 AS end_ms FROM noisy t LEFT JOIN splice s ON s.series_id = t.series_id AND s.seam = t.window_no
 WHERE ord >= coalesce(append_from, 0) GROUP BY ALL""",
    "d7_seam_audit": f"""WITH {_SLICES}, {_RUNS.replace("{tol}", "0")}, {_SPLICE} SELECT series_id, count(*) AS seams, count(*) FILTER (spliced) AS spliced, count(*) FILTER (NOT spliced) AS fallbacks,
 round(avg(CASE WHEN spliced THEN 0.0 ELSE 1.0 END), 6) AS fallback_rate, max(run) AS longest_run, sum(left_n - keep_len)::BIGINT AS cut_tokens, sum(append_from)::BIGINT AS dropped_tokens
 FROM splice GROUP BY 1""",
    "d8_phrase_audit": """SELECT doc_id, item_id, ((length(t) - length(replace(t, p, ''))) // length(p))::BIGINT AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents),
 (SELECT item_id, lower(text) AS p FROM benchmark) WHERE contains(t, p)""",
    "d9_table_diff": f"""WITH a AS (SELECT doc_id AS k, sum(len(ws))::DOUBLE AS n FROM ({fx.WORDS}) GROUP BY 1), b AS (SELECT k, n + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n FROM a WHERE k % 7 <> 0),
 j AS (SELECT CASE WHEN b.k IS NULL THEN 'missing_right' WHEN abs(a.n - b.n) <= 0.5 THEN 'match' ELSE 'differs' END AS status, abs(a.n - b.n) AS d FROM a LEFT JOIN b ON a.k = b.k)
 SELECT status, count(*) AS n, round(avg(d), 6) AS mean_delta, round(max(d), 6) AS max_delta FROM j GROUP BY 1""",
}
ORACLE["b4_score_batched"] = ORACLE["b4_score_windows"]
