"""The operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S
from overlapkit.llm import chat, embedding_dedup, media, mixing, queries, quality, simhash, token_counts, token_files, toxicity, unigram

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, component string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", "y", "z") for i, t, l, s in rows], DOCS)


EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "b"), (5, "word " * 30_000, "en", "a"),
    (6, "same text of some words here", "de", None), (6, "same text of some words here", "de", None), (None, "same text of some words here", "fr", "c"),
    (7, "日本語 ﷺ 🙂 <0x0A> <|endoftext|> İß ΑΣ", "ja", "c"), (8, "tab\there\r\nand  there ", "en", "c"),
]


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# --- what the operators share


def test_ordered_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g) if g else None, int(o), int(v) if v else None, k) for k, (g, o, v) in enumerate(rng.integers(0, 5, (400, 3)))]
    t = spark.createDataFrame(rows, "g string, o long, v long, k long")
    order = [F.col("o"), F.col("k")]
    for group in ((), ("g",)):
        want, total = {}, defaultdict(int)
        for g, o, v, k in sorted(rows, key=lambda r: (r[1], r[3])):
            own = g if group else None
            want[k] = total[own]
            total[own] += v or 0
        got = S.ordered_sums(t, order, {"before": "v"}, group)
        assert {r.k: r.before for r in got.collect()} == want and got.columns == [*t.columns, "before"]
    assert S.ordered_sums(t.limit(0), order, {"before": "v"}).count() == 0


def test_samples_names_and_schemas(spark):
    t = spark.range(5_000)
    some = {r.id for r in S.bounded_sample(t, 500, "id").collect()}
    assert 400 < len(some) < 600 and some == {r.id for r in S.bounded_sample(t.repartition(7), 500, "id").collect()}
    assert S.bounded_sample(t, 9_000, "id").count() == 5_000
    d = docs(spark, EDGES).withColumn("odd", F.struct(F.lit(1).alias("a b:c"), F.lit("x").alias("d,e")))
    assert S.free_name(d, "SCORE") == "_SCORE" and S.free_name(d, "new") == "new"
    out = simhash.keep_one(d)
    assert out.schema["odd"].dataType == d.schema["odd"].dataType and {tuple(r.odd) for r in out.collect()} == {(1, "x")}
    model = quality.QualityModel(10)
    assert {r.q for r in quality.score_quality(d, model, score_col="q").collect()} == {1.0}


# --- connected components, SimHash


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.component for r in S.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert all(want[n] == c for n, c in got.items())
    assert {n for p in pairs if p[0] != p[1] for n in p} == got.keys()
    assert S.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_golay_keys_find_all_within_four():
    rng = np.random.default_rng(1)
    _, near, counts = simhash.golay_tables()
    assert sorted(set(counts.tolist())) == [1, 6] and (counts == 6).sum() == 1771
    base = rng.integers(0, 2**63, 3_000, dtype=np.uint64)
    for errors in range(5):
        other = base.copy()
        for k in range(len(other)):
            for b in rng.choice(64, errors, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        stored, _, _ = simhash.keys(base.view(np.int64))
        _, asked, owner = simhash.keys(other.view(np.int64))
        looked = defaultdict(set)
        for o, a in zip(owner.tolist(), asked.tolist(), strict=True):
            looked[o].add(a)
        assert all(set(stored[k].tolist()) & looked[k] for k in range(len(base)))


def test_simhash_components_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = queries.op2_simhash_golay(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_simhash_links_dense_groups(spark):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 50)}
    for _ in range(300):
        x = rng.choice(list(fps))
        for b in rng.choice(63, rng.integers(1, 6), replace=False):
            x = int(x) ^ (1 << int(b))
        fps.add(int(x))
    ids = sorted(fps)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    got = {r.fp: r.component for r in simhash.link(spark.createDataFrame([(x,) for x in ids], "fp long")).collect()}
    assert got == want


def test_simhash_edges(spark):
    d = docs(spark, EDGES)
    got = simhash.simhash_components(d)
    assert got.count() == len(EDGES)
    by = {(r.doc_id, r.fp): r.component_id for r in got.collect()}
    assert {by[k] for k in by if k[1] == 0} == {1}
    assert len({r.component_id for r in got.where("doc_id = 6 or doc_id is null").collect()}) == 1
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8]
    assert simhash.keep_one(d.limit(0)).count() == 0


# --- token files


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.full(700, 9), rng.integers(0, 2**32, 5_000), np.r_[rng.integers(100, 110, 3_000), 2**32 - 1, 0], np.arange(513)):
        ids = ids.astype(np.uint32)
        blocks, starts = token_files.encode_blocks(ids)
        payload = b"".join(blocks)
        assert (token_files.decode_blocks(payload, starts, len(ids)) == ids).all()
        if len(blocks) > 2:
            assert (token_files.decode_blocks(payload, starts, len(ids), 1, 2) == ids[512:1024]).all()
    small = np.r_[rng.integers(1000, 1016, 511), 4_000_000].astype(np.uint32)
    assert len(token_files.encode_blocks(small)[0][0]) == 8 + 6 + 4 * 64  # one exception, four bits each


def test_word_encoder_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [x[1] or "" for x in EDGES]
    texts += ["don't can't 'S x's''s _a_ 12½ ²x soft­hyphen", "á combining", "\x1c\x85\xa0 odd", "x<|startoftext|>y", "it's...fine!?,; a.b. I'LL"]
    texts += ["".join(chr(c) + "x " * (c % 7 == 0) for c in range(32, 0x250)), "İstanbul ǄX ŉ"]
    for room in (64_000_000, 5_000):
        enc = token_files.WordEncoder(path, room)
        got = [np.frombuffer(b, "<u4").tolist() for k in range(0, len(texts), 40) for b in enc(texts[k : k + 40])]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files_query(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = {}, 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    got = queries.op3_token_files(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    token_files.write_token_files(docs(spark, EDGES), str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    back = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(back) == len(EDGES) and back[0].doc_id is None and all(r.ids[-1] == 2 for r in back)
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist()


def test_token_files_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(k % 3 or None, f"text {k % 11} of many", "en", "a") for k in range(300)]
    found = []
    for n, order in enumerate((1, -1)):
        at = str(tmp_path / str(n))
        token_files.write_token_files(docs(spark, rows[::order]).repartition(1 + 3 * n), at, P.path("word_bpe_49k.json"))
        found.append(sorted((r.start, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, at).collect()))
    assert found[0] == found[1] and len(found[0]) == 300
    with pytest.raises(TypeError):
        token_files.token_files(docs(spark, rows).withColumn("doc_id", F.lit("x")), P.path("word_bpe_49k.json"))


# --- mixing


def water_fill(sizes, weights=(1, 2, 3)):
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in w if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * w[s] / free for s in w}
        over = {s for s in w if s not in capped and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix_sources(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r.source] += size[r.doc_id]
    target, source = water_fill(by), {r.doc_id: r.source for r in rows}
    got = queries.op4_mix_sources(spark, SF).collect()
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by[s]) and r.taken <= 3 * r.size
        assert abs(r.target - target[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 130 for s in by)
    again = queries.op4_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_shard_counts_are_multinomial_and_sum_to_the_quotas(spark):
    slots = [40_000, 20_000, 3_000, 1, 0, 17_000]
    total, rows, lo = sum(slots), [], 0
    for k, n in enumerate(slots):
        rows.append((k, n, lo))
        lo += n
    t = spark.createDataFrame(rows, "source_no long, slots long, lo long")
    for size in (500, 1024):
        found = mixing.shard_counts(t, total, len(rows), size).collect()
        by, shards = defaultdict(list), -(-total // size)
        for r in found:
            by[r.source_no].append((r.first, r.last, r.shard))
        for k, n in enumerate(slots):  # the slots of a source are cut into its shards' without gaps
            spans = sorted(by[k])
            assert [a for a, _, _ in spans] + [n] == [0] * bool(n) + [b for _, b, _ in spans] if n else not spans
            assert len({x for _, _, x in spans}) == len(spans)
        for k in (0, 1, 2, 5):  # dispersion of a source's counts over whole shards, as multinomial draws have it
            n = {x: b - a for a, b, x in by[k]}
            counts, p = np.array([n.get(x, 0) for x in range(shards - 1)]), slots[k] / total
            chi = ((counts - size * p) ** 2 / (size * p * (1 - p))).sum()
            assert abs(chi - shards) < 4.5 * np.sqrt(2 * shards)


def test_shards_reach_the_result(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    some = [{r.doc_id: (r.taken, r.first_shard, r.last_shard) for r in mixing.mix_sources(d, shard_blocks=n).collect()} for n in (64, 200)]
    assert some[0] != some[1] and max(r[2] for r in some[0].values() if r[2] is not None) > max(r[2] for r in some[1].values() if r[2] is not None)
    out = mixing.mixed_documents(d, shard_blocks=64)
    assert "shard" in out._jdf.queryExecution().optimizedPlan().toString()


def test_targets_at_the_cap(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, None: 20, "d": 0}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = water_fill({s: n for s, n in sizes.items()} | {})
    assert {r.source: round(r.target, 6) for r in got.collect()} == {s: round(x, 6) for s, x in want.items()}


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000):
        t = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(3), F.lit(n).cast("long"))).alias("p"))
        assert sorted(r.p for r in t.collect()) == list(range(n))


def test_mix_edges(spark):
    d = docs(spark, EDGES)
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(EDGES) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(d.limit(0)).count() == 0
    odd = d.withColumnsRenamed({"fp": "shard", "score": "spans", "component": "whole"})
    assert {(r.shard, r.spans, r.whole) for r in mixing.mixed_documents(odd).collect()} == {("x", "y", "z")}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.encode().split())
    plan = defaultdict(int)
    for r in got:
        plan[r.doc_id] += r.taken
    assert {k: v for k, v in plan.items() if v} == dict(words)


# --- media


def test_media_round_trip_and_damage():
    for n in (0, 1, 64, 1024, 1025, 5_000):
        payload = media.padded(bytes(k % 251 for k in range(n)))
        data = media.build(payload)
        found = media.probe(data)
        assert media.payload_of(data, found) == payload and found["codec"] == "ipcm"
        assert found["duration"] == len(payload) and (found["sync"] % media.PER_CHUNK == 0).all()
        for cut in range(0, len(data), max(1, len(data) // 97)):
            try:
                media.probe(data[:cut])
            except ValueError:
                pass
    moved = b"".join([struct.pack(">I4sQ", 1, b"free", 24), bytes(8), data])
    assert media.probe(moved)["codec"] == "ipcm"


def test_media_query_and_edges(spark):
    import hashlib

    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_media_container(spark, SF).collect():
        p = media.padded(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    stored = {r.doc_id: bytes(r.media) for r in media.pack_media(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"]).collect()}
    for r in queries.op5_media_container(spark, SF).collect():
        data, p = stored[r.doc_id], media.padded(text[r.doc_id])
        boxes, at = {}, 0  # the outermost boxes, read again by hand
        while at < len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            boxes[kind] = (at + 8, at + size)
            at += size
        first, last = boxes[b"mdat"]
        assert list(boxes) == [b"ftyp", b"moov", b"mdat"] and at == len(data) and data[first:last] == p
        chunks = -(-len(p) // 1024)
        at = data.index(b"stco") + 8
        offsets = struct.unpack_from(f">{chunks}I", data, at + 4)
        assert struct.unpack_from(">I", data, at)[0] == chunks and list(offsets) == [first + 1024 * k for k in range(chunks)]
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.feature == f"ipcm;{len(p)}/8000;{len(p) // 64};{chunks};{offsets[0]}+64;{offsets[-1]}+64"
    m = media.pack_media(docs(spark, EDGES), keep=["doc_id"])
    assert media.pack_media(docs(spark, []), keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        media.pack_media(docs(spark, EDGES).withColumnRenamed("fp", "n_bytes"), keep=["n_bytes"])
    bad = spark.createDataFrame([(1, None), (2, b""), (3, b"\0\0\0\x08junk"), (4, b"abc")], "doc_id long, media binary")
    assert media.probe_media(m, keep=["doc_id"]).where("error is null").count() == len(EDGES)
    assert media.probe_media(bad, keep=["doc_id"]).where("error is not null").count() == 4


# --- classifiers


def test_toxicity(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op6_toxicity_nnpu(spark, "/root/testdata/sf0.01").join(l, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.9 and np.mean([s >= 0.3 for s in neg]) < 0.05 and np.mean([s >= 0.3 for s in pos]) > 0.55
    edge = docs(spark, EDGES)
    none = toxicity.fit_toxicity(edge, l.limit(0))
    assert {r.score2 for r in toxicity.score_toxicity(edge, none, score_col="score2").collect()} == {0.0}
    some = toxicity.fit_toxicity(d, l)
    got = toxicity.score_toxicity(edge, some, score_col="p")
    assert got.columns == [*edge.columns, "p"] and all(0 <= r.p <= 1 for r in got.collect())
    assert toxicity.score_toxicity(edge.limit(0), some, score_col="p").count() == 0


def test_nnpu_separates_without_negatives():
    rng = np.random.default_rng(0)
    one = np.ones((4_000, 1))
    pos = np.c_[rng.normal(2, 1, (500, 2)), one[:500]]
    hidden = rng.random(4_000) < 0.2
    unl = np.c_[np.where(hidden[:, None], rng.normal(2, 1, (4_000, 2)), rng.normal(-2, 1, (4_000, 2))), one]
    w = toxicity.nnpu(pos, unl, 0.2)
    assert ((unl @ w > 0) == hidden).mean() > 0.95


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    l = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op1_quality_cotraining(spark, sf).join(l, "doc_id").where("held_out").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) > 0.95
    edge = docs(spark, EDGES)
    none = quality.fit_quality(edge, l.limit(0))
    assert {r.q for r in quality.score_quality(edge, none, score_col="q").collect()} == {1.0}
    model = quality.fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), l)
    got = quality.score_quality(edge, model, score_col="q")
    assert got.columns == [*edge.columns, "q"] and all(0 <= r.q <= 1 for r in got.collect())


def test_cells_cover_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3)) * [1, 10, 0.1]
    t = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "text string, x array<double>").repartition(5)
    n, mean = S.cell_sums(t, lambda b: np.array(b.column("x").to_pylist()), ["text", "x"], x[:9], x.std(axis=0))
    assert len(n) <= 9 and n.sum() == 700 and np.allclose((n[:, None] * mean).sum(axis=0), x.sum(axis=0), atol=1e-2)
    near = np.argmin((((x[:, None] - x[None, :9]) / x.std(axis=0)) ** 2).sum(axis=2), axis=1)
    assert n.tolist() == np.bincount(near, minlength=9)[np.unique(near)].tolist()


@pytest.mark.parametrize("cells", [50, 4_096])
def test_few_cells_judge_as_many(spark, cells):
    """The unlabelled side is summed over all texts: far fewer cells than texts change little."""
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = l.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(d, "doc_id")
    model = toxicity.fit_toxicity(queries.learnable(d), queries.learnable(l), cells=cells)
    rows = toxicity.score_toxicity(held, model).select("score", "toxic").collect()
    bad, fine = ([r.score for r in rows if (r.toxic or 0) == k] for k in (1, 0))
    assert np.mean([b > f for b in bad for f in fine]) > 0.93 and np.mean([f >= 0.3 for f in fine]) < 0.05 and np.mean([b >= 0.3 for b in bad]) > 0.6


def test_co_training_never_loses(spark):
    """With few labels and with all, and with few cells for the pool: no fewer right than without rounds; no view weighs against itself."""
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = l.where("quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(d, "doc_id")
    pool = queries.learnable(l)
    for some, cells in ((pool.orderBy(F.xxhash64("doc_id")).limit(100), 4_096), (pool, 4_096), (pool, 60)):
        right = []
        for rounds in (0, 4):
            model = quality.fit_quality(queries.learnable(d), some, rounds=rounds, cells=cells)
            assert (model.mix[:2] >= 0).all()
            rows = quality.score_quality(held, model).select("score", "quality").collect()
            right.append(sum((r.score >= 0.5) == (r.quality > 0) for r in rows))
        assert right[1] >= right[0]


def test_co_training_gains_from_the_other_view():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3_000)
    a, b = (y[:, None] * 2 - 1) * 1.2 + rng.normal(0, 1, (3_000, 3)), (y[:, None] * 2 - 1) * 1.2 + rng.normal(0, 1, (3_000, 3))
    known = np.full(3_000, -1)
    known[:12] = y[:12]
    known[:2] = y[:2] = [0, 1]
    alone = ((quality.fit_logistic(a[:12], y[:12]).raw(a) > 0) == y).mean()
    both = ((quality.co_train(a, b, known, 4, 0.1)[0].raw(a) > 0) == y).mean()
    assert both > 0.93 and both >= alone - 0.01


# --- embeddings


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base] + [base + rng.normal(scale=s, size=base.shape) for s in (0.02, 0.05, 0.1, 0.25)]).astype(np.float32)
    label = np.tile(np.arange(40) % 3, 5).tolist()
    rows = [(k, v.tolist(), y) for k, (v, y) in enumerate(zip(x, label, strict=True))]
    rows += [(900, rows[0][1], label[0]), (901, None, 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [None] * 16, 0), (906, [1.0, 2.0], 0), (907, [], 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(t, pivots=24, prefix=6, list_rows=block).collect()}
    assert len(got) == len(rows)
    ok = [(k, np.array(v, dtype=np.float64), y) for k, v, y in rows if k < 901]
    linked = {(a, b) for i, (a, u, p) in enumerate(ok) for b, v, q in ok[i + 1 :] if p == q and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93}
    n = defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert sum(got[k].n_links for k, _, _ in ok) >= 0.9 * 2 * len(linked)
    assert all(got[k].n_links <= n[k] for k, _, _ in ok)
    if sum(got[k].n_links for k, _, _ in ok) == 2 * len(linked):
        want = components([k for k, _, _ in ok], linked)
        assert {k: got[k].component_id for k, _, _ in ok} == want
    for k in range(901, 908):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[900].n_links >= 1 and got[900].component_id == 0
    assert embedding_dedup.near_duplicates(t.limit(0)).count() == 0


@pytest.mark.parametrize("given", [{}, {"pivots": 512, "prefix": 8}])
def test_embedding_recall(spark, given):
    """Planted pairs at a cosine of 0.93 to 0.97 among 3,000 vectors of two labels, against brute force: at the
    registered parameters, and at those of 16 times as many rows."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(900, 64))
    side -= (side * base[:900]).sum(axis=1, keepdims=True) * base[:900]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = np.repeat([0.931, 0.935, 0.94, 0.96, 0.9299, 0.97], 150)[:, None]
    x = np.concatenate([base, c * base[:900] + np.sqrt(1 - c * c) * side])
    label = np.r_[np.arange(3_000), np.arange(900)] % 2
    t = spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(t, **given).collect()}
    want = np.zeros(len(x), dtype=int)
    for y in (0, 1):
        at = np.flatnonzero(label == y)
        u = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
        want[at] = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 1_500
    assert all(got[k].n_links <= want[k] for k in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.97 * want.sum()
    linked = [(k, 3_000 + k) for k in range(900) if got[k].n_links]
    assert all(got[b].component_id == a and not got[b].kept for a, b in linked)


# --- token counts, pieces, chat


def test_token_counts(spark):
    pattern, path = P.PATTERN, P.path("byte_bpe_50k.tiktoken")
    enc, _ = token_counts.encoding(path, pattern)
    d = docs(spark, [r for r in EDGES if r[0] is not None and r[0] != 6])
    rows = token_counts.count_tokens(d, path, pattern).collect()
    text = {i: t or "" for i, t, _, _ in EDGES}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, rs in by.items():
        rs.sort(key=lambda r: r.section_no)
        assert sum(r.n_tokens for r in rs) == len(enc.encode_ordinary(text[i])) == rs[0].doc_tokens
        assert "".join(text[i][r.first : r.last] for r in rs) == text[i]
    fields = token_counts.count_tokens(d, path, pattern, fields=("source", "text"), sections="fields", rule="split").collect()
    assert len(fields) == 2 * d.count()


def test_token_counts_of_very_long_runs(spark):
    pattern, path = P.PATTERN, P.path("byte_bpe_50k.tiktoken")
    enc, lengths = token_counts.encoding(path, pattern)
    for run in (" ", "\n", "\t\u3000", " \n"):  # as the library, where it survives
        for text in ("{}", "a{}", "{} b", "{}b", "a {}\nb{}7", "{}!{}", "\x1c{}\x1c", "a{}\x85é"):
            for size in (token_counts.LONG // 2 - 1, token_counts.LONG, token_counts.LONG + 1):
                t = text.replace("{}", run * size)
                assert token_counts.encode(enc, t, pattern) == enc.encode_ordinary(t)
    million = [" " * 10**6, "\n" * 10**6, "a" * 10**6, "7" * 10**6, " \t" * 500_000 + "end", "a b " * 250_000]
    t = spark.createDataFrame(list(enumerate(million)), "doc_id long, text string")
    got = token_counts.count_tokens(t, path, pattern, fields=("text",), sections="fields").collect()
    for r in got:
        ids = token_counts.encode(enc, million[r.doc_id], pattern)
        assert r.n_tokens == r.doc_tokens == len(ids) and lengths[np.array(ids)].sum() == 10**6 + (3 if r.doc_id == 4 else 0)
    with pytest.raises(ValueError):
        token_counts.count_tokens(t.withColumnRenamed("doc_id", "first"), path, pattern, id_col="first")


def test_token_counts_query_against_brute_force(spark):
    """Every line's tokens on the given table: a token goes to the line with most of its bytes, the earlier of equals."""
    enc, _ = token_counts.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r.text or ""
        lines = [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]
        lines = lines[:-1] if len(lines) > 1 and not lines[-1] else lines
        ends = np.cumsum([len(x.encode()) for x in lines]).tolist()
        counts, at = [0] * len(lines), 0
        for token in enc.decode_tokens_bytes(enc.encode_ordinary(text)):
            part = {}
            for b in range(at, at + len(token)):
                k = next(k for k, e in enumerate(ends) if b < e) if len(lines) > 1 else 0
                part[k] = part.get(k, 0) + 1
            counts[max(part, key=lambda k: (part[k], -k))] += 1
            at += len(token)
        want |= {(r.doc_id, k): (n, sum(counts)) for k, n in enumerate(counts)}
    got = queries.op8_token_counts(spark, SF).collect()
    assert {(r.doc_id, r.section_no): (r.n_tokens, r.doc_tokens) for r in got} == want and len(got) == len(want)
    d = docs(spark, [(None, "a b\nc", "en", "a"), (6, "x\n", "en", "a"), (6, "x\n", "en", "a")])
    found = token_counts.count_tokens(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.section_no) for r in found) == [(0, 0), (0, 1), (6, 0), (6, 0)]
    assert token_counts.count_tokens(d.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_attribution_rules():
    lengths, bounds = np.array([3, 4, 1, 2]), np.array([0, 4, 4, 6, 10])
    assert token_counts.attribute(lengths, bounds, "first").tolist() == [2, 0, 0, 2]
    assert token_counts.attribute(lengths, bounds, "largest").tolist() == [1, 0, 1, 2]
    assert token_counts.attribute(lengths, bounds, "split").tolist() == [1.25, 0, 0.5, 2.25]


def brute_unigram(tok, word):
    """Best sum of scores over all segmentations, by dictionary lookup."""
    pieces = {p: s for p, s in tok["plain"].items()}
    top, back = [0.0] + [-1e300] * len(word), [None] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = word[i:j]
            s = pieces.get(p, tok["unknown"] if len(p) == 1 else None)
            if s is not None and top[i] + s > top[j]:
                top[j], back[j] = top[i] + s, i
    out, j = [], len(word)
    while j:
        out.append(word[back[j] : j])
        j = back[j]
    return out[::-1]


def test_unigram_against_brute_force(spark):
    path = P.path("piece_bpe_32k.model")
    pieces, scores, kinds = unigram.read_model(path)
    t = unigram.tokenizer(path)
    plain = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k == "normal"}
    tok, number = {"plain": plain, "unknown": min(plain.values()) - 10}, {p: k for k, p in enumerate(pieces)}
    texts = [x[1] or "" for x in EDGES] + [r.text[:3_000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()] + ["x" * 300 + "日" * 40, "  two  lead", "trail  "]
    for text, got in zip(texts, t.encode(texts), strict=True):
        if len(text) > 5_000:
            continue
        want = []
        if text:
            for p in brute_unigram(tok, (" " + text).replace(" ", "▁")):
                want += [number[p]] if p in plain else [number[f"<0x{b:02X}>"] for b in p.encode()]
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want
        assert t.decode(ids) == text
    assert t.decode(np.array([number["<0xE6>"], number["▁the"]])) == "� the"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def read_varint(data, at):
    n = shift = 0
    while data[at] > 127:
        n, shift, at = n | (data[at] & 127) << shift, shift + 7, at + 1
    return n | data[at] << shift, at + 1


def unigram_file(path, scores):
    """The model file with other scores, as one of the library's unigram models."""
    data, at, out, k = open(path, "rb").read(), 0, b"", 0
    while at < len(data):
        tag, start = read_varint(data, at)
        size, start = read_varint(data, start)
        body, at = data[start : start + size], start + size
        if tag >> 3 == 1:  # a piece: its text (1), score (2, a float) and kind (3)
            n, first = read_varint(body, 1)
            kind = body[first + n + 5 :]
            body, k = body[: first + n] + b"\x15" + struct.pack("<f", scores[k]) + kind, k + 1
        elif tag >> 3 == 2:
            body += b"\x18\x01"  # the trainer's model type: unigram
        out += varint(tag) + varint(len(body)) + body
    return out


def test_unigram_against_the_library(spark):
    """Whole texts: ids equal those of the library's unigram mode, or have the same score (it adds in 32 bits)."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    pieces, scores, _ = unigram.read_model(path)
    assert abs(sum(np.exp(s) for s in scores if s < 0) - 1) < 1e-3
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_file(path, scores))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [x[1] or "" for x in EDGES] + ["ab日本" * 500]
    small = unigram.Unigram(*unigram.read_model(path), room=1_000)
    same = 0
    for k, text in enumerate(texts):
        want, ids = sp.encode(text), np.frombuffer(small.encode([text])[0], "<u4").tolist()
        same += ids == want
        assert len(ids) == len(want) and abs(sum(scores[i] for i in ids) - sum(scores[i] for i in want)) <= 1e-6 * len(ids)
    assert same >= 0.95 * len(texts)


def test_pieces_query(spark):
    got = queries.op9_unigram_pieces(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    tok = unigram.Unigram(*unigram.read_model(P.path("piece_bpe_32k.model")))
    want = {}
    for r in rows:
        ids = [k for word in tok.split.findall(" " + r.text) for k in tok.best(word.replace(" ", "▁").encode())] if r.text else []
        want[r.doc_id] = (len(ids), int(tok.is_byte[ids].sum()), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), True)
    assert {r.doc_id: (r.n_tokens, r.n_byte_tokens, r.ids_crc32, r.round_trip) for r in got} == want
    d = docs(spark, EDGES)
    coded = unigram.encode_texts(d, P.path("piece_bpe_32k.model"), keep=["doc_id", "score"])
    back = unigram.decode_ids(coded, P.path("piece_bpe_32k.model"), keep=["doc_id"])
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _, _ in EDGES)
    assert unigram.encode_texts(d.limit(0), P.path("piece_bpe_32k.model"), keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        unigram.encode_texts(d.withColumnRenamed("fp", "ids"), P.path("piece_bpe_32k.model"), keep=["ids"])


def test_chat(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|assistant|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 300, "unknown", "late"), (None, 1, "ann", "n"), (4, 1, "<|user|x>y>", "a"), (4, 2, "b&gt;", "c")]
    t = spark.createDataFrame([(*r, "z", "q") for r in rows], "conv_id long, turn long, role string, text string, place string, lines string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.render_perspectives(t).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, None, 0), (3, "unknown", 0), (None, "ann", 0), (4, "<|user|x>y>", 0), (4, "b&gt;", 0)}
    a = got[1, "ann", 0]
    assert a.text == "<|system|>rules<|end|>\n<|assistant|>hi < |assistant|><|end|>\n<|user|bob>yo<|end|>\n<|assistant|><|end|>\n"
    assert [a.text[m.first : m.last] for m in a.mask] == ["hi < |assistant|><|end|>", "<|end|>"]
    assert got[3, "unknown", 0].text == "<|user|&null;>x<|end|>\n<|assistant|>late<|end|>\n"
    assert got[4, "b&gt;", 0].text.startswith("<|user|< |user|x&gt;y&gt;>a<|end|>") and got[4, "<|user|x>y>", 0].text.endswith("<|user|b&amp;gt;>c<|end|>\n")
    assert chat.render_perspectives(t.limit(0)).count() == 0
    many = spark.createDataFrame([(1, 5, "ann" if k % 2 else "bob", "same") for k in range(600)], "conv_id long, turn long, role string, text string")
    parts = chat.render_perspectives(many, part_turns=100).collect()
    assert sorted((r.part, r.n_turns) for r in parts) == [(k, 100) for k in range(6) for _ in range(2)] and sum(r.n_own for r in parts) == 600


def test_words_of_letters_go_to_the_model_at_once():
    """Only stretches that are cut into pieces pass the tokenizer's normalizer and pattern; ids are those of whole texts."""
    path = P.path("word_bpe_49k.json")
    enc = token_files.WordEncoder(path)
    words = [a + b + c for a in ("ana", "über", "çé", "zz", "ñ") for b in ("tion", "ßung", "ôr", "") for c in ("en", "ity", "ª", "x")]
    marked = [w + m for w in words[::3] for m in (".", "!!", "###", '",', "_", ")")]
    rest = ["it's", "don't.", "3rd", "a-b", "(x", "½x", "²", "x²", "'s", "a'", "--", "x'.", "_", "a_b"]
    texts = [" ".join(words), " ".join(marked), "\n".join(rest), "", "Ana\tÜBER. ÑX!! ŸŽ,"]
    passed, whole = [], enc.tokenizer

    class Counted:
        def encode(self, text, **options):
            passed.extend(text.split())
            return whole.encode(text, **options)

    enc.tokenizer = Counted()
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert enc(texts) == expected
    assert not {x for x in passed if x.isalpha()} - {x for x in rest if x.isalpha()} and not set(marked) & set(passed)
    assert enc(texts[::-1]) == expected[::-1]
