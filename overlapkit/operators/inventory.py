"""Artifact inventories, their verification, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.operators.scan import RANGE_ROWS, Scan, State

PLAIN_NAME = r"^(?!\.{1,2}$)[^/\\\x00]+\z"


def flatten_manifest(df: DataFrame, manifest: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """(models, assets): models in order (position 0 the default, then by id), and (model_id, role, file)."""
    m = df.where(F.col(manifest).isNotNull()).select(F.col(f"{manifest}.default").alias("_default"), F.col(f"{manifest}.models").alias("_m"))
    ids = F.array_sort(F.transform(F.map_keys("_m"), lambda k: F.struct((k != F.col("_default")).alias("later"), k.alias("id"))))
    rows = m.select("_m", F.posexplode(ids).alias("position", "i"))
    rows = rows.select("position", F.struct("i.later", "i.id", F.col("_m")[F.col("i.id")].alias("v")).alias("m"))
    models = rows.select(F.col("m.id").alias("model_id"), "position", (~F.col("m.later")).alias("is_default"), F.col("m.v.dir_name").alias("dir_name"), F.col("m.v.revision").alias("revision"), F.col("m.v.backend").alias("backend"), F.col("m.v.min_os").alias("min_os"))
    assets = rows.select(F.col("m.id").alias("model_id"), F.explode("m.v.assets").alias("role", "file"))
    return models, assets


def build_lock(artifacts: DataFrame, model: str = "model_id") -> tuple[DataFrame, DataFrame]:
    """(lock, totals): a row per file with its number by path within the model, and totals per model."""
    n = F.row_number().over(Window.partitionBy(model).orderBy("path")) - 1
    lock = artifacts.select(model, n.cast("long").alias("file_no"), "path", "size", "sha256")
    totals = artifacts.groupBy(model).agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))
    return lock, totals


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two file sets: (keys, problem) with missing, extra, size or hash; null where they agree.

    Sizes are compared before hashes, hashes where both sides know one; ``checked`` says which.
    """
    e = expected.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.col("size").alias("_es"), F.col("sha256").alias("_eh"), F.lit(1).alias("_e"))
    a = actual.select(*[F.col(k).alias(f"_a{k}") for k in keys], F.col("size").alias("_as"), F.col("sha256").alias("_ah"), F.lit(1).alias("_a"))
    on: Column = F.lit(True)
    for k in keys:
        on &= F.col(f"_e{k}") == F.col(f"_a{k}")
    j = e.join(a, on, "full_outer")
    both_hashes = F.col("_eh").isNotNull() & F.col("_ah").isNotNull()
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("_es").eqNullSafe(F.col("_as")), "size").when(both_hashes & (F.col("_eh") != F.col("_ah")), "hash")
    return j.select(*[F.coalesce(f"_e{k}", f"_a{k}").alias(k) for k in keys], problem.alias("problem"), F.when(both_hashes, "hash").otherwise("size").alias("checked"))


def in_scope(paths: DataFrame, path: str, components: DataFrame, component: str) -> DataFrame:
    """Rows whose top-level folder or file is declared."""
    c = components.select(F.col(component).alias("_top")).distinct()
    return paths.join(c, F.split_part(path, F.lit("/"), F.lit(1)) == F.col("_top"), "left_semi")


def verify_artifacts(lock: DataFrame, sidecars: DataFrame, actual: DataFrame, full: bool = False) -> DataFrame:
    """(model_id, problem, path): the first problem of each model in lock order; null is verified.

    lock: model_id, revision, file_no, path, size, sha256; sidecars: model_id, revision (null where it
    cannot be parsed); actual: model_id, path, size, and sha256 at full depth only.
    """
    s = sidecars.select("model_id", F.col("revision").alias("_rev"), F.lit(True).alias("_has"))
    columns = ["model_id", "path", F.col("size").alias("_size")] + ([F.col("sha256").alias("_hash")] if full else [])
    a = actual.select(*columns, F.lit(True).alias("_there"))
    j = lock.join(s, "model_id", "left").join(a, ["model_id", "path"], "left")
    head = F.when(F.col("_has").isNull(), F.struct(F.lit(0).alias("rank"), F.lit("sidecar missing").alias("what"), F.lit("").alias("path"))).when(
        F.col("_rev").isNull(), F.struct(F.lit(0).alias("rank"), F.lit("sidecar unparsable").alias("what"), F.lit("").alias("path"))
    ).when(F.col("_rev") != F.col("revision"), F.struct(F.lit(0).alias("rank"), F.lit("revision mismatch").alias("what"), F.lit("").alias("path")))
    what = F.when(F.col("_there").isNull(), "file missing").when(F.col("_size") != F.col("size"), "size mismatch")
    if full:
        what = what.when(~F.col("_hash").eqNullSafe(F.col("sha256")), "hash mismatch")
    found = F.coalesce(head, F.when(what.isNotNull(), F.struct(F.lit(1).alias("rank"), what.alias("what"), F.col("path").alias("path"))))
    first = F.min_by(found, F.when(found.isNotNull(), F.struct(found["rank"], "file_no")))
    return j.groupBy("model_id").agg(first.alias("p")).select("model_id", F.col("p.what").alias("problem"), F.col("p.path").alias("path"))


def resolve_source(candidates: DataFrame, key: str) -> DataFrame:
    """(key, source, path, error, tried): the first candidate there by authority.

    Candidates have source (override, bundle, dev, user), path and found. An override ends the search:
    if it isn't there, that is an error, and nothing else counts.
    """
    rank = F.array_position(F.array(*map(F.lit, ["override", "bundle", "dev", "user"])), F.col("source"))
    c = candidates.withColumn("rank", rank).withColumn("_over", F.max((F.col("source") == "override").cast("int")).over(Window.partitionBy(key)))
    c = c.where("_over = 0 or source = 'override'")
    best = F.min_by(F.struct("source", "path"), F.when(F.col("found"), F.col("rank")))
    g = c.groupBy(key).agg(best.alias("b"), F.max("_over").alias("o"), F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("t"))
    error = F.when(F.col("b").isNotNull(), F.lit(None)).when(F.col("o") == 1, "override not found").otherwise("not found")
    return g.select(key, F.col("b.source").alias("source"), F.col("b.path").alias("path"), error.cast("string").alias("error"), F.when(error.isNotNull(), F.array_join(F.transform("t", lambda x: x["path"]), ",")).alias("tried"))


def supported(min_os: Column, platform: str) -> Column:
    """Whether ``platform`` meets a floor of the exact form MAJOR.MINOR; a malformed floor is not met."""
    form = r"^(\d+)\.(\d+)\z"
    have = F.struct(F.regexp_extract(F.lit(platform), form, 1).cast("int"), F.regexp_extract(F.lit(platform), form, 2).cast("int"))
    want = F.struct(F.regexp_extract(min_os, form, 1).cast("int"), F.regexp_extract(min_os, form, 2).cast("int"))
    return F.coalesce(min_os.rlike(form), F.lit(False)) & (have >= want)


def availability(models: DataFrame, resolved: DataFrame, problems: DataFrame, platform: str, requested: DataFrame | None = None) -> DataFrame:
    """(model_id, status, message, supported, source) of each requested model (default: all).

    Unknown id: Failed. Unresolved: Missing. A user tree is Missing with a problem, Failed with an I/O
    error (``io_error`` of ``problems``); a tree from elsewhere is trusted.
    """
    want = (requested or models).select("model_id").distinct()
    m = models.select("model_id", "min_os", F.lit(True).alias("_known"))
    j = want.join(m, "model_id", "left").join(resolved.select("model_id", "source"), "model_id", "left").join(problems.select("model_id", "problem", "io_error"), "model_id", "left")
    user = F.col("source") == "user"
    status = F.when(F.col("_known").isNull(), "Failed").when(F.col("source").isNull(), "Missing").when(user & F.col("io_error").isNotNull(), "Failed").when(user & F.col("problem").isNotNull(), "Missing").otherwise("Ready")
    message = F.when(F.col("_known").isNull(), "unknown model").when(user & F.col("io_error").isNotNull(), F.col("io_error")).when(user, F.col("problem"))
    return j.select("model_id", status.alias("status"), message.alias("message"), (F.coalesce(F.col("_known"), F.lit(False)) & supported(F.col("min_os"), platform)).alias("supported"), "source")


def row_actions(avail: DataFrame, selected: Column) -> DataFrame:
    """``avail`` with action and selectable."""
    s = F.col("status")
    action = (
        F.when(~F.col("supported"), "Unsupported").when(s == "Missing", "Download").when(s == "Downloading", "Downloading").when(s == "Verifying", "Verifying")
        .when(s == "Failed", "Failed").when(selected, "Selected").when(F.col("source") == "user", "Delete").otherwise(F.concat(F.lit("Provisioned("), "source", F.lit(")")))
    )
    return avail.withColumn("action", action).withColumn("selectable", (s == "Ready") & F.col("supported"))


def deletion_plan(avail: DataFrame, selected: Column, in_flight: Column) -> DataFrame:
    """(model_id, delete, refusal): the first reason of not ready, not user data, in flight, selected."""
    refusal = F.when(F.col("status") != "Ready", "not ready").when(F.coalesce(F.col("source") != "user", F.lit(True)), "not user data").when(in_flight, "in flight").when(selected, "selected")
    return avail.select("model_id", refusal.isNull().alias("delete"), refusal.alias("refusal"))


def progress_rollup(deltas: DataFrame, key: str, file: str, order: list[str], value: str, total: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``deltas`` with ``received`` (sum over files of the latest value so far), ``fraction`` and ``percent``.

    A file's value counts by its change from the file's last one, so the sum runs on without being
    made anew. Rows with a null file are totals and are left out. A key above ``range_rows`` rows is
    scanned by ranges (``scan``).
    """
    s = Scan(deltas.where(F.col(file).isNotNull()), [key], order, range_rows).with_states(_was=State("lag", F.col(value), by=(file,)), _later=State("sum", F.lit(1), by=(file,)))
    change = F.col(value) - F.when(F.col("_later") == 1, F.lit(0)).otherwise(F.col("_was"))
    t = s.with_states(received=State("sum", change)).rows().drop("_was", "_later")
    fraction = F.when(F.col(total) > 0, F.col("received") / F.col(total))
    return t.withColumn("fraction", fraction).withColumn("percent", F.floor(F.least(F.greatest(F.col("fraction"), F.lit(0.0)), F.lit(1.0)) * 100 + 0.5).cast("long"))


def live_ticks(events: DataFrame, key: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Progress rows with ``live``: only while downloading. A tick after an end never revives it."""
    kind = F.col("kind")
    flag = F.when(kind == "start", True).when(kind.isin("done", "failed"), False)
    return Scan(events, [key], order, range_rows).with_states(live=State("last", flag, default=F.lit(False))).where("kind = 'progress'").rows()


def phase_replay(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``events`` with phase, active model and message after each: one download in flight.

    kind: start, progress, done, failed, with model_id and message. A start while one is in flight is
    ignored, and so is anything of a model that isn't in flight; done leads to LoadingModel or, if
    ``load_ok`` says so, Ready; failed to NeedsModel. A fold, for an ignored start depends on all before.
    """
    from overlapkit.functions import fold_rows

    def step(state: dict, row: dict) -> list[dict]:
        kind, own = row["kind"], row["model_id"] == state["model"]
        busy = state["phase"] in ("Downloading", "Verifying")
        if kind == "start" and not busy:
            state.update(phase="Downloading", model=row["model_id"], note=None)
        elif kind == "progress" and busy and own:
            state["phase"] = "Downloading"
        elif kind == "done" and busy and own:
            state.update(phase="Ready" if row["load_ok"] else "LoadingModel")
        elif kind == "failed" and busy and own:
            state.update(phase="NeedsModel", note=row["message"])
        return [row | {"phase": state["phase"], "active_model": state["model"], "note": state["note"]}]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", phase string, active_model string, note string"
    return fold_rows(events, [key], order, lambda: {"phase": "NeedsModel", "model": None, "note": None}, step, schema)


def override_models(models: DataFrame, phase: DataFrame) -> DataFrame:
    """``models`` with the status of the one in ``phase`` (model_id, status) put in the place of its own."""
    p = phase.select("model_id", F.col("status").alias("_live"))
    return models.join(p, "model_id", "left").withColumn("status", F.coalesce("_live", "status")).drop("_live")


def quarantine_names(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): a name is one plain path component; bad ones keep their row and get a reason."""
    ok = F.coalesce(F.col(name).rlike(PLAIN_NAME), F.lit(False))
    reason = F.when(F.col(name).isNull() | (F.col(name) == ""), "empty").when(F.col(name).isin(".", ".."), "relative").otherwise("separator")
    return df.where(ok), df.where(~ok).withColumn("reason", reason)


def load_settings(df: DataFrame, json: str, models: DataFrame, default_model: str, version: int = 2, default_hotkey: str = "default") -> DataFrame:
    """``df`` with version, hotkey, model and reason, from versioned JSON.

    A missing field has its default, a missing version is the current one; malformed JSON, or another
    version, gives all defaults and a reason. Unknown fields are tolerated; an unknown model is the
    default one.
    """
    raw = F.from_json(json, "struct<version: int, hotkey: string, model: string, _corrupt_record: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    t = df.withColumn("_s", raw)
    bad = F.col("_s").isNull() | F.col("_s._corrupt_record").isNotNull()
    reason = F.when(bad, "malformed").when(F.coalesce(F.col("_s.version"), F.lit(version)) != version, F.concat(F.lit("version "), F.col("_s.version").cast("string")))
    t = t.withColumn("reason", reason).withColumn("version", F.lit(version))
    ok = F.col("reason").isNull()
    t = t.withColumn("hotkey", F.coalesce(F.when(ok, F.col("_s.hotkey")), F.lit(default_hotkey))).withColumn("_model", F.when(ok, F.col("_s.model")))
    known = models.select(F.col("model_id").alias("_known")).distinct()
    return t.join(known, F.col("_model") == F.col("_known"), "left").withColumn("model", F.coalesce("_known", F.lit(default_model))).drop("_s", "_model", "_known")


def manifest_lock_check(models: DataFrame, lock_models: DataFrame, lock_files: DataFrame) -> DataFrame:
    """(model_id, problems): what a manifest and its lock disagree on, comma-joined; empty is sound."""
    m = models.select("model_id", F.col("dir_name").alias("_d"), F.col("revision").alias("_r"), F.lit(1).alias("_m"))
    k = lock_models.select("model_id", "dir_name", "revision", "total_bytes", F.lit(1).alias("_k"))
    f = lock_files.groupBy("model_id").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.min(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("_hex"))
    j = m.join(k, "model_id", "full_outer").join(f, "model_id", "left")
    both = F.col("_m").isNotNull() & F.col("_k").isNotNull()
    flags = [
        F.when(F.col("_k").isNull(), "not locked"), F.when(F.col("_m").isNull(), "not in manifest"), F.when(both & (F.col("_d") != F.col("dir_name")), "dir"),
        F.when(both & (F.col("_r") != F.col("revision")), "revision"), F.when(F.col("_k").isNotNull() & F.col("_n").isNull(), "no files"),
        F.when(F.col("_sum") != F.col("total_bytes"), "total"), F.when(~F.col("_hex"), "hash form"),
    ]
    return j.select("model_id", F.concat_ws(",", *flags).alias("problems"))
