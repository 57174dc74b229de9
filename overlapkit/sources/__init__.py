"""Sources and sinks: frames, vocabularies, manifests, artifact trees, verified publishing, upserts."""

from __future__ import annotations

import atexit
import hashlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "struct<default: string, models: map<string, struct<dir_name: string, revision: string, backend: string, min_os: string, assets: map<string, string>>>>"


LARGE, PIECE = 1 << 30, 8 << 20  # bytes of a file that is hashed in pieces, and of a piece

_roots: dict[str, object] = {}  # scratch folders of this driver, with their session's settings; deleted when it ends


@atexit.register
def _clear() -> None:
    jvm = SparkContext._jvm
    for root, settings in _roots.items() if jvm is not None else ():
        try:
            at = jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(settings).delete(at, True)
        except Exception as e:  # the JVM may have ended first; the other folders are still tried
            print(f"scratch folder not deleted: {root} ({type(e).__name__})", file=sys.stderr)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has no such setting, a local master gets a temporary folder; on a cluster that
    is an error. The folder goes when the driver ends.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="overlapkit-"))
        found = context.getCheckpointDir()
    root = f"{found.rstrip('/')}/overlapkit-{context.applicationId}"
    _roots[root] = spark._jsc.hadoopConfiguration()
    return root


def scratch_dir(spark: SparkSession) -> str:
    """A new path in ``shared_dir``."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads, by the file system that Spark has for it."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: its lineage ends there."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_frames(spark: SparkSession, path: str, schema: StructType | None = None, streaming: bool = False, files: int | None = None, once: bool = False) -> DataFrame:
    """Sample or frame rows from Parquet; as a stream, from a directory to which files are added (``files`` a batch).

    ``once``: the stream is the only reader, and files go when a batch has taken them.
    """
    if streaming:
        schema = schema or spark.read.parquet(path).schema
        reader = spark.readStream.schema(schema)
        reader = reader.option("cleanSource", "delete") if once else reader
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def parse_vocab(documents: DataFrame, json: str = "json", reserved_id: int | None = None) -> DataFrame:
    """(token_id, piece, has_byte_fallback) from JSON maps of id to piece.

    Keys that aren't numbers are dropped; ``reserved_id`` has a row, with a null piece if the map
    leaves it out. The flag says whether any piece of the vocabulary is a byte piece.
    """
    rows = documents.select(F.explode(F.from_json(json, "map<string, string>")).alias("k", "piece"))
    rows = rows.select(F.expr("try_cast(k as int)").alias("token_id"), "piece").where("token_id >= 0").groupBy("token_id").agg(F.max("piece").alias("piece"))
    if reserved_id is not None:
        extra = documents.sparkSession.range(1).select(F.lit(reserved_id).cast("int").alias("token_id"), F.lit(None).cast("string").alias("piece"))
        rows = rows.unionByName(extra).groupBy("token_id").agg(F.max("piece").alias("piece"))
    flag = rows.agg(F.coalesce(F.bool_or(F.col("piece").rlike("^<0x..>$")), F.lit(False)).alias("has_byte_fallback"))
    return rows.crossJoin(F.broadcast(flag))  # one row


def read_vocab(spark: SparkSession, path: str, reserved_id: int | None = None) -> DataFrame:
    return parse_vocab(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"), "json", reserved_id)


def parse_manifest(documents: DataFrame, json: str = "json") -> DataFrame:
    """``documents`` with ``manifest``, the typed struct; null where the JSON is malformed."""
    return documents.withColumn("manifest", F.from_json(json, MANIFEST))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a JSON file; its default model must be one of its models."""
    m = parse_manifest(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
    known = F.array_contains(F.map_keys("manifest.models"), F.col("manifest.default"))
    problem = F.when(F.col("manifest").isNull(), F.raise_error("manifest: malformed")).when(~known, F.raise_error("manifest: unknown default model"))
    return m.withColumn("manifest", F.coalesce(problem.cast(MANIFEST), F.col("manifest")))


def scan_artifacts(spark: SparkSession, root: str, full: bool = False, components: list[str] | None = None, large: int = LARGE) -> DataFrame:
    """(path, size, sha256) of every file under ``root``, relative to it; the hash at full depth only.

    At quick depth the content column is pruned, so files are listed and not read. At full depth files up
    to ``large`` bytes are hashed as cells; larger ones, which a cell can't hold, are opened in the task
    and hashed in pieces of 8 MB, by pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select("path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"))
    if full:
        cells = files.where(F.col("length") <= large).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        many = listed.where(F.col("size") > large).select("path", "size").repartition(F.xxhash64("path"))
        listed = cells.unionByName(many.mapInArrow(_hash_in_pieces, "path string, size long, sha256 string"))
    prefix = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in prefix) + "/", "")
    out = listed.select(path.alias("path"), "size", "sha256")
    return out.where(F.split_part("path", F.lit("/"), F.lit(1)).isin(components)) if components else out


def write_texts(df: DataFrame, root: str, by: str, text: str) -> None:
    """Each row's ``text``, a line feed after it, as a file of its own, in a folder ``by=value`` under ``root``.

    On a file system that tasks mount, they write their files themselves and rename them into place, so that
    no file waits for the driver and a task that runs again replaces whole files. Elsewhere Spark's writer
    puts rows of one value and task into one file, which its task commits.
    """
    fs, at = _fs(df.sparkSession, root)
    to = fs.makeQualified(at).toString()
    if not to.startswith("file:"):
        out = df.select(by, F.col(text).alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return out.partitionBy(by).text(root, lineSep="\n")
    to = _local(to)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, value, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{to}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else quote(value, safe='')}"
                os.makedirs(folder, exist_ok=True)
                partial = f"{folder}/.{uuid.uuid4().hex}"
                with open(partial, "wb") as file:
                    file.write(data)
                os.rename(partial, f"{folder}/part-{no}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    fs.mkdirs(at)
    data = F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary")
    rows = df.select(F.monotonically_increasing_id().alias("no"), F.col(by).cast("string").alias("by"), data.alias("data"))
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def _hash_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        hashes = []
        for path in batch.column("path").to_pylist():
            local = path.startswith("file:")
            store, at = (fs.LocalFileSystem(), _local(path)) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_stream(at, buffer_size=0) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(hashes, pa.string())], names=["path", "size", "sha256"])


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish_verified(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame]) -> bool:
    """Write to ``<path>.partial``, verify what is read back, then put it in place by renames.

    ``check`` gives problem rows; if it gives any, nothing is published and what stood at ``path``
    stays. A partial folder left by an earlier run goes first. The checked row count is written as a
    sidecar inside the folder. Returns whether the table was published.
    """
    spark, partial = df.sparkSession, path.rstrip("/") + ".partial"
    fs, at = _fs(spark, partial)
    fs.delete(at, True)
    df.write.parquet(partial)
    written = spark.read.schema(df.schema).parquet(partial)
    if not check(written).isEmpty():
        fs.delete(at, True)
        return False
    written.agg(F.count("*").alias("rows")).write.json(partial + "/_verified")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + f".old-{uuid.uuid4().hex}")
    moved = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(at, target):
        if moved:
            fs.rename(old, target)
        raise OSError(f"{path}: the verified table could not be moved into place")
    if moved:
        fs.delete(old, True)
    return True


def upsert_by_key(current: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """``current`` with the rows of every key in ``new`` replaced by those of ``new``; other keys untouched.

    ``version`` names a column that must hold one value in both; the plan fails where it does not.
    Sort the result by key where a stable order of rows is wanted.
    """
    kept = current.join(new.select(*keys).distinct(), keys, "left_anti")
    out = kept.unionByName(new)
    if version:
        bad: Column = F.min(version) != F.max(version)
        one = current.select(version).unionByName(new.select(version)).agg(F.coalesce(bad, F.lit(False)).alias("_bad"))
        out = out.crossJoin(F.broadcast(one)).where(F.when(F.col("_bad"), F.raise_error(F.lit("upsert: versions differ")).cast("boolean")).otherwise(True)).drop("_bad")  # one row
    return out


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], by: str, version: str | None = None, check: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """``upsert_by_key`` into the table at ``path``, partitioned by ``by``: only partitions of ``new`` are written.

    A key's partition follows from the key. The touched partitions are read, merged and written to a
    folder beside the table; what is read back must hold as many rows as were merged and give no rows of
    ``check``. Then each old partition folder is moved aside and the new one into its place; if a move
    fails, those before it are undone. Other partitions keep their files. Returns the folders replaced.
    A ``version`` column must hold one value in the touched partitions and in ``new``; otherwise nothing
    is written and ValueError is raised. Readers that list the folder between the two moves of a
    partition miss it (on object stores, where a move is a copy, for longer).
    """
    hadoop, root = spark._jvm.org.apache.hadoop.fs.Path, path.rstrip("/")
    fs, at = _fs(spark, root)
    if new.isEmpty():
        return []
    touched = written(new.select(by).distinct())
    current = spark.read.schema(new.schema).parquet(root).select(*new.columns) if fs.exists(at) else new.limit(0)
    known = current.join(touched.select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_semi")
    if version:
        low, high = known.select(version).unionByName(new.select(version)).agg(F.min(version), F.max(version)).first()
        if low != high:
            raise ValueError(f"upsert: versions differ: {low}, {high}")
    side = f"{root}.partial-{uuid.uuid4().hex}"
    merged = written(upsert_by_key(known, new, keys))
    merged.repartition(F.col(by)).write.partitionBy(by).parquet(side)
    back = spark.read.schema(new.schema).parquet(side).select(*new.columns)
    if back.count() != merged.count() or (check is not None and not check(back).isEmpty()):
        fs.delete(hadoop(side), True)
        raise ValueError("upsert: what was written does not verify; nothing is replaced")
    fs.mkdirs(at)
    names = sorted(x.getPath().getName() for x in fs.listStatus(hadoop(side)) if x.isDirectory() and "=" in x.getPath().getName())
    aside, done = f"{root}.old-{uuid.uuid4().hex}", []
    fs.mkdirs(hadoop(aside))
    try:
        for name in names:
            old = fs.exists(hadoop(f"{root}/{name}"))
            if old and not fs.rename(hadoop(f"{root}/{name}"), hadoop(f"{aside}/{name}")):
                raise OSError(f"{name} could not be moved aside")
            done.append((name, old))
            if not fs.rename(hadoop(f"{side}/{name}"), hadoop(f"{root}/{name}")):
                raise OSError(f"{name} could not be moved into place")
    except Exception:
        for name, old in reversed(done):
            fs.delete(hadoop(f"{root}/{name}"), True)
            if old:
                fs.rename(hadoop(f"{aside}/{name}"), hadoop(f"{root}/{name}"))
        raise
    finally:
        fs.delete(hadoop(side), True)
    fs.delete(hadoop(aside), True)
    return names
