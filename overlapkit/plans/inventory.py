"""Queries of the source and inventory operators over ``pages`` (files), ``events`` (progress, settings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit import sources
from overlapkit.operators import inventory as inv
from overlapkit.plans import read
from overlapkit.plans.fixtures import WORDS

ORDER, TOTAL = ["ts", "event_id"], 500_000


def artifacts(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select((F.col("page_id") % 10).cast("string").alias("model_id"), F.concat(F.lit("p"), F.col("page_id") % 10, F.lit("/"), "page_id").alias("path"),
                    F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha256"), "page_id")


def locked(spark, sf_dir):
    """The tree as found: files missing, grown and altered."""
    a = artifacts(spark, sf_dir).where("page_id % 7 != 0")
    return a.withColumn("size", F.col("size") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).withColumn("sha256", F.when(F.col("page_id") % 13 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")))


def candidates(spark, sf_dir):
    m = artifacts(spark, sf_dir).select("model_id").distinct()
    four = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(s).alias("source")) for k, s in enumerate(("override", "bundle", "dev", "user"))]))
    c = m.select("model_id", four.alias("c")).select("model_id", "c.source", "c.rank").where("source != 'override' or cast(model_id as int) % 5 = 0")
    return c.select("model_id", "source", F.concat("source", F.lit("/"), "model_id").alias("path"), ((F.col("model_id").cast("int") + F.col("rank")) % 3 == 0).alias("found"))


def _manifest(spark, sf_dir):
    """One JSON document a hundred pages: models of ten, roles by page."""
    a = artifacts(spark, sf_dir).withColumn("doc", F.floor(F.col("page_id") / 100))
    models = a.groupBy("doc", "model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("r"), "page_id"), "path")))).alias("assets"))
    entry = F.struct("model_id", F.struct(F.concat(F.lit("d"), "model_id").alias("dir_name"), F.lit("main").alias("revision"), F.lit("any").alias("backend"), F.lit("14.0").alias("min_os"), "assets"))
    docs = models.groupBy("doc").agg(F.to_json(F.struct(F.min("model_id").alias("default"), F.map_from_entries(F.collect_list(entry)).alias("models"))).alias("json"))
    return sources.parse_manifest(docs)


def s2_read_vocab(spark, sf_dir):
    """A vocabulary of every document's words by place, in JSON maps of a document each; one key is no number."""
    d = read(spark, sf_dir, "documents")
    ws = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x0b\x0c]+"), lambda w: w != "")
    pairs = F.transform(ws, lambda w, i: F.struct(i.cast("string").alias("k"), w.alias("v")))
    doc = d.select(F.to_json(F.map_from_entries(F.concat(pairs, F.array(F.struct(F.lit("pad").alias("k"), F.lit("x").alias("v")))))).alias("json"))
    v = sources.parse_vocab(doc, "json", reserved_id=2**31 - 1)
    return v.select("token_id", "piece", "has_byte_fallback")


def s3_read_manifest(spark, sf_dir):
    _, assets = inv.flatten_manifest(_manifest(spark, sf_dir))
    return assets


def s4_scan_artifacts(spark, sf_dir):
    """The pages written out as files, a folder each, and scanned at full depth."""
    at = sources.scratch_dir(spark)
    sources.write_texts(read(spark, sf_dir, "pages").where("html is not null"), at, "page_id", "html")
    f = sources.scan_artifacts(spark, at, full=True)
    page = F.regexp_extract("path", "page_id=([0-9]+)/part-", 1)
    return f.where(page != "").select(page.cast("long").alias("page_id"), "size", "sha256")


def s5_publish_verified(spark, sf_dir):
    """Artifacts published after a check that passes; a second table, whose check fails, leaves them as they are."""
    at, a = sources.scratch_dir(spark), artifacts(spark, sf_dir).select("model_id", "path", "size", "sha256")
    bad = F.col("size").isNull() | (F.length("sha256") != 64)
    first = sources.publish_verified(a, at, lambda t: t.where(bad))
    second = sources.publish_verified(a.withColumn("sha256", F.lit("?")), at, lambda t: t.where(bad))
    out = spark.read.schema(a.schema).parquet(at)
    return out.withColumn("published", F.lit(f"{first}, {second}"))


def s6_upsert_by_key(spark, sf_dir):
    a = artifacts(spark, sf_dir).withColumn("version", F.lit(2))
    new = a.where("cast(model_id as int) < 3 and page_id % 2 = 0").withColumn("size", F.col("size") * 10)
    return sources.upsert_by_key(a, new, ["model_id"], "version").select("model_id", "path", "size")


def s6_upsert_partitions(spark, sf_dir):
    """Artifacts in a folder a model; even pages of the first three models come again ten times as large, and one page anew."""
    a, at = artifacts(spark, sf_dir).select("model_id", "path", "size"), sources.scratch_dir(spark)
    sources.upsert_partitions(spark, at, a, ["path"], "model_id")
    new = artifacts(spark, sf_dir).where("cast(model_id as int) < 3 and page_id % 2 = 0").select("model_id", "path", F.col("size") * 10)
    more = new.groupBy("model_id").agg(F.concat(F.lit("new/"), F.max("path")).alias("path"), F.lit(1).cast("int").alias("size"))
    sources.upsert_partitions(spark, at, new.toDF(*a.columns).unionByName(more).select("model_id", "path", F.col("size").cast(a.schema["size"].dataType).alias("size")), ["path"], "model_id")
    return spark.read.schema(a.schema).parquet(at).select("model_id", "path", "size")


def g1_flatten_manifest(spark, sf_dir):
    models, _ = inv.flatten_manifest(_manifest(spark, sf_dir))
    return models.groupBy("model_id", "is_default").agg(F.count("*").alias("n"), F.sum("position").cast("long").alias("positions"))


def g2_build_lock(spark, sf_dir):
    lock, totals = inv.build_lock(artifacts(spark, sf_dir))
    return lock.join(totals, "model_id").select("model_id", "file_no", "path", "size", "sha256", "total_bytes")


def g3_reconcile(spark, sf_dir):
    return inv.reconcile(artifacts(spark, sf_dir), locked(spark, sf_dir), ["model_id", "path"]).where("problem is not null")


def g4_in_scope(spark, sf_dir):
    a = artifacts(spark, sf_dir)
    declared = a.where("page_id % 10 in (1, 4, 7)").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("component"))
    return inv.in_scope(a, "path", declared, "component").select("path")


def _problems(spark, sf_dir, full):
    lock, _ = inv.build_lock(artifacts(spark, sf_dir))
    n = F.col("model_id").cast("int")
    lock = lock.withColumn("revision", F.lit("main"))
    cars = lock.select("model_id").distinct().where(n != 2).withColumn("revision", F.when(n == 3, F.lit(None)).when(n == 4, "old").otherwise("main"))
    actual = artifacts(spark, sf_dir).where("page_id % 70 != 0 or page_id % 10 != 0").withColumn("size", F.col("size") + (F.col("page_id") % 77 == 5).cast("int"))
    return inv.verify_artifacts(lock, cars, actual.withColumn("sha256", F.when(F.col("page_id") % 13 == 6, F.lit("0" * 64)).otherwise(F.col("sha256"))), full)


def g5_verify_artifacts(spark, sf_dir):
    return _problems(spark, sf_dir, True)


def g5_verify_quick(spark, sf_dir):
    return _problems(spark, sf_dir, False)


def g6_resolve_source(spark, sf_dir):
    return inv.resolve_source(candidates(spark, sf_dir), "model_id")


def _availability(spark, sf_dir):
    n = F.col("model_id").cast("int")
    models = artifacts(spark, sf_dir).select("model_id").distinct().withColumn("min_os", F.when(n == 8, "14").when(n == 7, "15.2").otherwise("14.0"))
    problems = _problems(spark, sf_dir, True).withColumn("io_error", F.when(n == 5, "read failed"))
    wanted = models.select("model_id").unionByName(models.select(F.concat(F.lit("x"), "model_id").alias("model_id")).where("model_id = 'x1'"))
    return inv.availability(models, inv.resolve_source(candidates(spark, sf_dir), "model_id"), problems, "14.4", wanted)


def g7_availability(spark, sf_dir):
    return _availability(spark, sf_dir)


def g8_row_actions(spark, sf_dir):
    return inv.row_actions(_availability(spark, sf_dir), F.col("model_id") == "9").select("model_id", "action", "selectable")


def g9_deletion_plan(spark, sf_dir):
    return inv.deletion_plan(_availability(spark, sf_dir), F.col("model_id") == "0", F.col("model_id") == "3")


def progress(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("file"), "ts", "event_id", F.floor(F.col("value") * 1000).cast("long").alias("bytes"), F.lit(TOTAL).cast("long").alias("total"))


def g10_progress_rollup(spark, sf_dir):
    p = inv.progress_rollup(progress(spark, sf_dir), "user_id", "file", ORDER, "bytes", "total")
    return p.select("user_id", "event_id", "received", F.round("fraction", 6).alias("fraction"), "percent")


def phase_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return e.select("user_id", "ts", "event_id", kind.alias("kind"), F.concat(F.lit("m"), F.col("event_id") % 2).alias("model_id"), (F.col("value") < 50).alias("load_ok"), F.concat(F.lit("e"), "event_id").alias("message"))


def g11_live_ticks(spark, sf_dir):
    return inv.live_ticks(phase_events(spark, sf_dir), "user_id", ORDER).select("user_id", "event_id", "live")


def g11_phase_replay(spark, sf_dir):
    return inv.phase_replay(phase_events(spark, sf_dir), "user_id", ORDER).select("user_id", "event_id", "phase", "active_model", "note")


def g11_override_models(spark, sf_dir):
    """Availability with the model of the last page shown as downloading: one row differs."""
    live = artifacts(spark, sf_dir).agg(F.max_by("model_id", "page_id").alias("model_id")).withColumn("status", F.lit("Downloading"))
    return inv.override_models(_availability(spark, sf_dir), live).select("model_id", "status")


def g12_quarantine_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("n"), "page_id")).when(k == 1, "..").when(k == 2, F.concat(F.lit("a/"), "page_id")).when(k == 3, F.concat(F.lit("b\\"), "page_id")).otherwise("")
    good, bad = inv.quarantine_names(p.select("page_id", name.alias("name")), "name")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


def g13_load_settings(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    body = F.concat(F.lit('{"version": '), F.col("event_id") % 3, F.lit(', "hotkey": "h'), F.col("event_id") % 4, F.lit('", "model": "'), F.col("event_id") % 12, F.lit('", "props": '), F.coalesce("props", F.lit("{}")), F.lit("}"))
    plain = F.concat(F.lit('{"hotkey": "h'), F.col("event_id") % 4, F.lit('", "props": '), F.coalesce("props", F.lit("{}")), F.lit("}"))
    doc = F.when(F.col("event_id") % 19 == 0, F.lit('{"version": ')).when(F.col("event_id") % 5 == 0, plain).otherwise(body)
    s = inv.load_settings(e.select("event_id", doc.alias("json")), "json", artifacts(spark, sf_dir).select("model_id"), "0")
    return s.groupBy("version", "hotkey", "model", "reason").agg(F.count("*").alias("n"))


def g14_manifest_lock_check(spark, sf_dir):
    a, n = artifacts(spark, sf_dir), F.col("model_id").cast("int")
    _, totals = inv.build_lock(a)
    models = totals.where(n != 1).select("model_id", F.concat(F.lit("d"), "model_id").alias("dir_name"), F.lit("main").alias("revision"))
    lock = totals.where(n != 2).select("model_id", F.concat(F.lit("d"), F.when(n == 3, "x").otherwise(F.col("model_id"))).alias("dir_name"), F.when(n == 4, "old").otherwise("main").alias("revision"), (F.col("total_bytes") + (n == 5).cast("int")).alias("total_bytes"))
    files = a.where(n != 6).withColumn("sha256", F.when(n == 7, F.upper("sha256")).otherwise(F.col("sha256")))
    return inv.manifest_lock_check(models, lock, files)


QUERIES = {
    f.__name__: f
    for f in (
        s2_read_vocab, s3_read_manifest, s4_scan_artifacts, s5_publish_verified, s6_upsert_by_key, s6_upsert_partitions, g1_flatten_manifest, g2_build_lock, g3_reconcile, g4_in_scope, g5_verify_artifacts, g5_verify_quick,
        g6_resolve_source, g7_availability, g8_row_actions, g9_deletion_plan, g10_progress_rollup, g11_live_ticks, g11_phase_replay, g11_override_models, g12_quarantine_names, g13_load_settings, g14_manifest_lock_check,
    )
}

_A = "SELECT (page_id % 10)::VARCHAR AS model_id, 'p' || page_id % 10 || '/' || page_id AS path, strlen(html) AS size, sha256(html) AS sha256, page_id FROM pages"
_PROBLEMS = f"""SELECT model_id, CASE WHEN model_id = '2' THEN 'sidecar missing' WHEN model_id = '3' THEN 'sidecar unparsable' WHEN model_id = '4' THEN 'revision mismatch' ELSE p.what END AS problem,
 CASE WHEN model_id IN ('2', '3', '4') THEN '' ELSE p.path END AS path FROM (SELECT model_id, arg_min({{'what': what, 'path': path}}, path) FILTER (what IS NOT NULL) AS p FROM
 (SELECT *, CASE WHEN page_id % 70 = 0 THEN 'file missing' WHEN page_id % 77 = 5 THEN 'size mismatch' WHEN @full AND page_id % 13 = 6 THEN 'hash mismatch' END AS what FROM ({_A})) GROUP BY 1)"""
_C = f"""SELECT model_id, source, source || '/' || model_id AS path, (model_id::INT + rank) % 3 = 0 AS found, rank FROM (SELECT DISTINCT model_id FROM ({_A})),
 (VALUES (0, 'override'), (1, 'bundle'), (2, 'dev'), (3, 'user')) v(rank, source) WHERE source <> 'override' OR model_id::INT % 5 = 0"""
_R = f"""SELECT model_id, arg_min(source, rank) FILTER (found) AS source, arg_min(path, rank) FILTER (found) AS path, CASE WHEN bool_or(found) THEN NULL WHEN model_id::INT % 5 = 0 THEN 'override not found' ELSE 'not found' END AS error,
 CASE WHEN NOT bool_or(found) THEN string_agg(path, ',' ORDER BY rank) END AS tried FROM ({_C}) WHERE model_id::INT % 5 <> 0 OR source = 'override' GROUP BY model_id"""
_AV = f"""SELECT model_id, CASE WHEN model_id = 'x1' THEN 'Failed' WHEN source IS NULL THEN 'Missing' WHEN source = 'user' AND model_id = '5' THEN 'Failed' WHEN source = 'user' AND problem IS NOT NULL THEN 'Missing' ELSE 'Ready' END AS status,
 CASE WHEN model_id = 'x1' THEN 'unknown model' WHEN source = 'user' AND model_id = '5' THEN 'read failed' WHEN source = 'user' THEN problem END AS message, model_id NOT IN ('7', '8', 'x1') AS supported, source
 FROM (SELECT DISTINCT model_id FROM ({_A}) UNION ALL SELECT 'x1') LEFT JOIN ({_R}) USING (model_id) LEFT JOIN ({_PROBLEMS.replace("@full", "true")}) p USING (model_id)"""
_P = f"SELECT *, bytes - lag(bytes, 1, 0) OVER (PARTITION BY user_id, file ORDER BY ts, event_id) AS change FROM (SELECT user_id, event_type AS file, ts, event_id, floor(value * 1000)::BIGINT AS bytes FROM events)"
_PH = "SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind FROM events"
ORACLE = {
    "s2_read_vocab": f"""SELECT (i - 1)::INT AS token_id, max(ws[i]) AS piece, false AS has_byte_fallback FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM ({WORDS})) GROUP BY 1
 UNION ALL SELECT 2147483647, NULL, false""",
    "s3_read_manifest": f"SELECT model_id, 'r' || page_id AS role, path AS file FROM ({_A})",
    "s6_upsert_by_key": f"""SELECT model_id, path, CASE WHEN model_id::INT < 3 THEN size * 10 ELSE size END AS size FROM ({_A}) WHERE model_id::INT >= 3 OR page_id % 2 = 0
 OR model_id NOT IN (SELECT model_id FROM ({_A}) WHERE model_id::INT < 3 AND page_id % 2 = 0)""".replace("CASE WHEN model_id::INT < 3 THEN", "CASE WHEN model_id::INT < 3 AND page_id % 2 = 0 THEN"),
    "s6_upsert_partitions": f"""SELECT model_id, path, CASE WHEN model_id::INT < 3 AND page_id % 2 = 0 THEN size * 10 ELSE size END AS size FROM ({_A})
 UNION ALL SELECT model_id, 'new/' || max(path), 1 FROM ({_A}) WHERE model_id::INT < 3 AND page_id % 2 = 0 GROUP BY 1""",
    "g1_flatten_manifest": f"""SELECT model_id, pos = 0 AS is_default, count(*) AS n, sum(pos)::BIGINT AS positions FROM (SELECT model_id, row_number() OVER (PARTITION BY doc ORDER BY model_id) - 1 AS pos
 FROM (SELECT DISTINCT page_id // 100 AS doc, model_id FROM ({_A}))) GROUP BY ALL""",
    "g2_build_lock": f"SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY path) - 1 AS file_no, path, size, sha256, (sum(size) OVER (PARTITION BY model_id))::BIGINT AS total_bytes FROM ({_A})",
    "g3_reconcile": f"""SELECT model_id, path, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 11 = 0 THEN 'size' ELSE 'hash' END AS problem, CASE WHEN page_id % 7 = 0 THEN 'size' ELSE 'hash' END AS checked
 FROM ({_A}) WHERE page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 13 = 0""",
    "g4_in_scope": f"SELECT path FROM ({_A}) WHERE page_id % 10 IN (1, 4, 7)",
    "g5_verify_artifacts": _PROBLEMS.replace("@full", "true"),
    "g5_verify_quick": _PROBLEMS.replace("@full", "false"),
    "g6_resolve_source": _R,
    "g7_availability": _AV,
    "g8_row_actions": f"""SELECT model_id, CASE WHEN NOT supported THEN 'Unsupported' WHEN status = 'Missing' THEN 'Download' WHEN status = 'Failed' THEN 'Failed' WHEN model_id = '9' THEN 'Selected' WHEN source = 'user' THEN 'Delete'
 ELSE 'Provisioned(' || source || ')' END AS action, status = 'Ready' AND supported AS selectable FROM ({_AV})""",
    "g9_deletion_plan": f"""SELECT model_id, r IS NULL AS "delete", r AS refusal FROM (SELECT model_id, CASE WHEN status <> 'Ready' THEN 'not ready' WHEN coalesce(source, '') <> 'user' THEN 'not user data' WHEN model_id = '3' THEN 'in flight' WHEN model_id = '0' THEN 'selected' END AS r FROM ({_AV}))""",
    "g10_progress_rollup": f"""SELECT user_id, event_id, received, round(received / {TOTAL}.0::DOUBLE, 6) AS fraction, floor(least(greatest(received / {TOTAL}.0::DOUBLE, 0), 1) * 100 + 0.5)::BIGINT AS percent
 FROM (SELECT user_id, event_id, (sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS received FROM ({_P}))""",
    "g11_live_ticks": f"""SELECT user_id, event_id, live FROM (SELECT *, coalesce(last_value(CASE WHEN kind = 'start' THEN true WHEN kind IN ('done', 'failed') THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS live
 FROM ({_PH})) WHERE kind = 'progress'""",
    "g11_override_models": f"""SELECT model_id, CASE WHEN model_id = (SELECT arg_max(model_id, page_id) FROM ({_A})) THEN 'Downloading' ELSE status END AS status FROM ({_AV})""",
    "g11_phase_replay": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM
  (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'progress' END AS kind, 'm' || event_id % 2 AS own, value < 50 AS load_ok, 'e' || event_id AS message FROM events)),
 r AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'NeedsModel' AS phase, NULL::VARCHAR AS active_model, NULL::VARCHAR AS note FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.k, e.event_id,
   CASE WHEN kind = 'start' AND phase <> 'Downloading' THEN 'Downloading' WHEN phase = 'Downloading' AND own = active_model AND kind = 'done' THEN CASE WHEN load_ok THEN 'Ready' ELSE 'LoadingModel' END
    WHEN phase = 'Downloading' AND own = active_model AND kind = 'failed' THEN 'NeedsModel' ELSE phase END,
   CASE WHEN kind = 'start' AND phase <> 'Downloading' THEN own ELSE active_model END,
   CASE WHEN kind = 'start' AND phase <> 'Downloading' THEN NULL WHEN phase = 'Downloading' AND own = active_model AND kind = 'failed' THEN message ELSE note END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
 SELECT user_id, event_id, phase, active_model, note FROM r WHERE k > 0""",
    "s4_scan_artifacts": "SELECT page_id, strlen(html) + 1 AS size, sha256(html || chr(10)) AS sha256 FROM pages WHERE html IS NOT NULL",
    "s5_publish_verified": f"SELECT model_id, path, size, sha256, 'True, False' AS published FROM ({_A})",
    "g12_quarantine_names": r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'n' || page_id WHEN 1 THEN '..' WHEN 2 THEN 'a/' || page_id WHEN 3 THEN 'b\' || page_id ELSE '' END AS name,
 CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'relative' WHEN 4 THEN 'empty' ELSE 'separator' END AS reason FROM pages""",
    "g13_load_settings": """WITH t AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'malformed' WHEN event_id % 5 = 0 OR event_id % 3 = 2 THEN NULL ELSE 'version ' || event_id % 3 END AS reason FROM events)
 SELECT 2::INT AS version, CASE WHEN reason IS NULL THEN 'h' || event_id % 4 ELSE 'default' END AS hotkey, CASE WHEN reason IS NULL AND event_id % 5 <> 0 AND event_id % 12 < 10 THEN (event_id % 12)::VARCHAR ELSE '0' END AS model, reason, count(*) AS n FROM t GROUP BY ALL""",
    "g14_manifest_lock_check": f"""SELECT model_id, CASE model_id WHEN '1' THEN 'not in manifest' WHEN '2' THEN 'not locked' WHEN '3' THEN 'dir' WHEN '4' THEN 'revision' WHEN '5' THEN 'total' WHEN '6' THEN 'no files' WHEN '7' THEN 'hash form' ELSE '' END AS problems FROM (SELECT DISTINCT model_id FROM ({_A}))""",
}
