"""Readers. Paths are given by the caller; schemas are fixed; the file name supplies missing keys."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text as X
from ..functions import vocab as V
from ..plans.rollouts import labelled_sample
from .blocks import register


#: where a JSON reader puts what it cannot read
BROKEN = "_broken"


def resolve_snapshot(cache: str) -> str:
    """Folder of a cached dataset: the snapshot its ``main`` ref names, else the newest complete one.

    A lookup of a few names on the driver; nothing is read from the data.
    """
    root = Path(cache)
    if (root / "meta" / "info.json").exists():
        return str(root)
    ref = root / "refs" / "main"
    if ref.exists():
        named = root / "snapshots" / ref.read_text().strip()
        if named.exists():
            return str(named)
    found = [p for p in (root / "snapshots").glob("*") if (p / "meta" / "info.json").exists()]
    if not found:
        raise FileNotFoundError(f"no dataset snapshot under {cache}")
    return str(max(found, key=lambda p: p.stat().st_mtime))


def read_tasks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.TASKS).json(f"{root}/meta/tasks.jsonl")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(episode_index, task_index or null, instruction, length): first of ``tasks``, else ``task``."""
    e = spark.read.schema(schemas.EPISODES).json(f"{root}/meta/episodes.jsonl")
    return e.select(
        "episode_index", "task_index", X.strip(F.coalesce(F.get("tasks", F.lit(0)), "task")).alias("instruction"), "length"
    )


def with_task_names(episodes: DataFrame) -> DataFrame:
    """Split ``name: instruction`` texts; the text itself stays as raw_instruction."""
    parts = X.split_task(F.col("instruction"))
    return episodes.withColumns(
        {"raw_instruction": F.col("instruction"), "task_name": parts["task_name"], "instruction": parts["instruction"]}
    )


def _episode_of_path(path: Column) -> Column:
    return F.regexp_extract(path, "episode_(\\d+)\\.[a-z0-9]+$", 1).cast("bigint")


def episode_paths(root: str, episodes: Iterable[int], chunks_size: int = 1000, suffix: str = "parquet") -> list[str]:
    """The files of the given episodes, a pattern for each chunk; nothing is listed to find them."""
    chunks: dict[int, list[str]] = {}
    for e in sorted(set(episodes)):
        chunks.setdefault(e // chunks_size, []).append(f"{e:06d}")
    return [f"{root}/data/chunk-{c:03d}/episode_{{{','.join(some)}}}.{suffix}" for c, some in chunks.items()]


def read_frames(
    spark: SparkSession, root: str, columns: list[str] | None = None, episodes: Iterable[int] | None = None, chunks_size: int = 1000
) -> DataFrame:
    """Per-episode Parquet files as one frame table keyed by (episode, step).

    The rows of one file keep their order through the file's own row index. Where ``episodes`` are given, only
    their files are looked for, by their chunk numbers; without them all files below are listed.
    """
    paths = [f"{root}/data"] if episodes is None else episode_paths(root, episodes, chunks_size)
    df = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    path = F.col("_metadata.file_path")
    keep = columns or df.columns
    return df.select(
        _episode_of_path(path).alias("episode"),
        F.col("_metadata.row_index").alias("step"),
        F.regexp_extract(path, "chunk-(\\d+)", 1).try_cast("int").alias("chunk"),
        *keep,
    )


def chunk_path(episode: Column, chunks_size: int = 1000, suffix: str = "parquet") -> Column:
    """Where an episode's file lies, by its chunk number."""
    return F.format_string(
        f"data/chunk-%03d/episode_%06d.{suffix}", F.floor(episode / chunks_size).cast("bigint"), episode
    )


def _checked(rows: DataFrame, schema: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """``rows`` with the parsed object as ``_e``, and dead letters: the other columns, a reason and the text.

    A text that is no JSON object, or in which a field has another type than the schema gives it, is a letter.
    """
    parsed = F.from_json(text, f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})
    judged = rows.withColumn("_e", F.when(F.ltrim(text).startswith("{"), parsed))
    reason = F.when(F.col("_e").isNull(), "not_an_object").when(F.col(f"_e.{BROKEN}").isNotNull(), "unreadable")
    judged = judged.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").withColumn("_e", F.col("_e").dropFields(BROKEN)).drop("reason", text)
    return good, judged.filter("reason IS NOT NULL").drop("_e")


def read_annotations_checked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Annotation shards of a folder, files named episode_ and six digits with one object each, in two tables.

    The rows of readable shards with their ``source``; and a dead letter (source, value, reason) for any other,
    so that a broken shard neither stops the job nor becomes a row of nulls.
    """
    files = spark.read.option("pathGlobFilter", "episode_*.json").text(folder, wholetext=True)
    named = files.filter(F.col("_metadata.file_name").rlike("^episode_\\d{6}\\.json$"))
    good, letters = _checked(named.select(F.col("_metadata.file_path").alias("source"), "value"), schemas.ANNOTATION)
    return good.select("_e.*", "source"), letters


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """The readable annotation shards of a folder."""
    return read_annotations_checked(spark, folder)[0]


def document_entries(documents: DataFrame, text: str = "value") -> DataFrame:
    """Top-level keys of JSON documents as rows: (source columns, key, value as JSON text)."""
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def is_index(key: Column) -> Column:
    return key.rlike("^\\d+$")


def combined_parts(files: DataFrame, schema: str = schemas.ANNOTATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (source, value) as episode rows, header entries and dead letters (source, key, value, reason).

    A document is one episode or an object of episodes by number; a number supplies a missing episode_index.
    """
    single = F.get_json_object("value", "$.episode_index").isNotNull() & F.get_json_object("value", "$.segments").isNotNull()
    single = F.coalesce(single, F.lit(False))
    no_key = F.lit(None).cast("string").alias("key")
    one = files.filter(single).select("source", no_key, "value")
    read = F.from_json("value", "map<string,string>")
    lost = files.filter(~single & (read.isNull() | ~F.ltrim("value").startswith("{"))).select("source", no_key, "value", F.lit("not_an_object").alias("reason"))
    entries = document_entries(files.filter(~single & F.ltrim("value").startswith("{"))).select("source", "key", "value")
    good, letters = _checked(one.unionByName(entries.filter(is_index(F.col("key")))), schema)
    rows = good.select("source", F.col("key").try_cast("bigint").alias("_k"), "_e.*")
    return (
        rows.withColumn("episode_index", F.coalesce("episode_index", "_k")).drop("_k"),
        entries.filter(~is_index(F.col("key"))),
        letters.unionByName(lost),
    )


def read_combined_checked(spark: SparkSession, path: str, schema: str = schemas.ANNOTATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episode rows, header rows, dead letters) of combined files or single-episode files.

    Every file is read whole by one task, as a JSON object must be; a collection that is too large for that
    lies in part files, which ``read_document_parts`` reads.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return combined_parts(files, schema)


def read_combined(spark: SparkSession, path: str, schema: str = schemas.ANNOTATION) -> tuple[DataFrame, DataFrame]:
    """(episode rows, header rows) of combined files or single-episode files."""
    return read_combined_checked(spark, path, schema)[:2]


def read_document_parts(spark: SparkSession, folder: str, schema: str = schemas.ANNOTATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of one document in part files with an entry a line, as ``sinks.write_document`` leaves it.

    Lines are read apart, so the document may be of any size.
    """
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("source"), F.trim("value").alias("value"))
    body = F.regexp_replace(F.regexp_replace("value", "^,", ""), "^\\{", "")
    inner = lines.withColumn("value", F.when(F.col("value") == "}", "").otherwise(body)).filter("value != ''")
    return combined_parts(inner.withColumn("value", F.concat(F.lit("{"), "value", F.lit("}"))), schema)


def read_target_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(episode, listed, position, target) from gzip lists whose names end in .zip; an empty list is one row."""
    register(spark)
    return spark.read.format("target_lists").option("path", folder).load()


def read_latents(spark: SparkSession, folder: str) -> DataFrame:
    """(episode, step, embedding, shape) from raw blocks with a JSON sidecar of dtype and shape."""
    register(spark)
    return spark.read.format("latent_blocks").option("path", folder).load()


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled text lines: (line, text, known_false) in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    return lines.filter(X.strip(F.col("value")) != "").select("line", labelled_sample(F.col("value")).alias("_s")).select("line", "_s.*")


def read_plan_samples(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), X.strip(F.col("value")).alias("plan"))
    return lines.filter(F.col("plan") != "")


def read_rollouts(spark: SparkSession, path: str, suite: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rollout rows, files of another suite). A file holds one document, or one in each line."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    lines = F.split("value", "\n(?=\\{)")
    f = text.select("source", F.explode(lines).alias("_d")).select("source", F.from_json("_d", schemas.ROLLOUT_FILE).alias("_d")).select("source", "_d.*")
    foreign = f.filter(~F.col("task_suite").eqNullSafe(F.lit(suite))) if suite else f.limit(0)
    own = f.filter(F.col("task_suite") == suite) if suite else f
    rows = own.select("source", "task_suite", "model_name", F.explode("completed_episodes").alias("_e"))
    return rows.select("source", "task_suite", "model_name", "_e.*"), foreign.select("source", "task_suite")


def list_videos(spark: SparkSession, root: str) -> DataFrame:
    """(episode, chunk, stream, path, length) of the per-episode videos; the bytes are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(f"{root}/videos")
    return f.select(
        _episode_of_path(F.col("path")).alias("episode"),
        F.regexp_extract("path", "chunk-(\\d+)", 1).try_cast("int").alias("chunk"),
        F.regexp_extract("path", "chunk-\\d+/([^/]+)/", 1).alias("stream"),
        "path",
        "length",
    )


def image_stream(name: Column) -> Column:
    """Full stream name of an alias; null when unknown."""
    return V.literal_map(V.IMAGE_STREAMS)[name]


def camera_of_stream(name: Column) -> Column:
    return V.literal_map(V.CAMERA_OF_STREAM)[name]


def scene_objects(lines: DataFrame, text: str = "value") -> DataFrame:
    """Object lines ``id - type ; appearance | location`` -> (object_id, type, appearance, location)."""
    head = F.trim(F.substring_index(text, ";", 1))
    comment = F.when(F.instr(F.col(text), ";") > 0, F.substr(F.col(text), F.instr(F.col(text), ";") + 1))
    pattern = "^\\(?\\s*(\\S+)\\s+-\\s+(\\S+?)\\)*$"
    others = [c for c in lines.columns if c != text]
    return lines.filter(head.rlike(pattern)).select(
        *others,
        F.regexp_extract(head, pattern, 1).alias("object_id"),
        F.regexp_extract(head, pattern, 2).alias("type"),
        F.trim(F.get(F.split(comment, "\\|"), F.lit(0))).alias("appearance"),
        F.trim(F.get(F.split(comment, "\\|"), F.lit(1))).alias("location"),
    )


def target_lists_text(rows) -> bytes:
    """One target list as the reader expects it (used by the sink and by tests)."""
    return gzip.compress(json.dumps(rows).encode("ascii"))
