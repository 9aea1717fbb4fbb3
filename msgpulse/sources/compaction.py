"""Compaction of a stored message table: many small files per ticker become few of a target size.

Every insert adds files to the ticker folders it touches; after many small inserts a ticker is
read as hundreds of tiny files. ``compact`` rewrites them, one writer at a time (the same rule as
for inserts), without a table format of its own, in steps that can each be stopped and redone:

1. plan: per ticker folder, the files under ``small_bytes`` are dealt in name order into groups
   of about ``target_bytes``; a group of one file is left alone. The plan is a small Parquet
   table in ``_compaction/<plan>/plan`` (the leading ``_`` hides the folder from readers);
2. stage: one Spark job reads all groups' files (with the table's base path, so ``ticker``
   comes back from the folder names), repartitions by group and writes one folder per group
   under ``_compaction/<plan>/staged``. Nothing visible has changed;
3. commit: an empty ``COMMITTED`` file is created in the plan folder. This is the only step that
   decides: before it, the plan is dropped on recovery; after it, the plan is finished;
4. apply: the sources of each group are deleted and the staged files moved into the group's
   ticker folder under fresh names; then the plan folder is removed.

``recover`` finishes or drops whatever plan a stop left, and ``insert_if_absent`` calls it first,
so an insert never sees a half-applied plan. A stop after the commit and before the end of step 4
leaves rows of the group missing from readers until recovery runs; rows are never doubled and,
once recovered, never lost. File renames are assumed atomic each (HDFS, local and most mounted
stores); nothing else is.

Listing and renaming go through Hadoop's FileSystem on the driver: metadata only, bounded by
the number of files, which is what compaction bounds. Rows only move through Spark tasks.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.schema import MESSAGE_COLUMNS, MESSAGE_SCHEMA

FOLDER = "_compaction"
MARKER = "COMMITTED"
PLAN_SCHEMA = "plan STRING, grp INT, folder STRING, file STRING, bytes BIGINT, folder_name STRING, file_name STRING"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def data_files(spark: SparkSession, path: str) -> dict[str, list[tuple[str, int]]]:
    """Visible Parquet files of each ticker folder: ``{folder: [(file, bytes), ...]}``."""
    fs, root = _fs(spark, path)
    found: dict[str, list[tuple[str, int]]] = {}
    if not fs.exists(root):
        return found
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not folder.isDirectory() or name.startswith(("_", ".")):
            continue
        found[folder.getPath().toString()] = sorted(
            (f.getPath().toString(), f.getLen())
            for f in fs.listStatus(folder.getPath())
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")) and f.getPath().getName().endswith(".parquet")
        )
    return found


def plan(
    files: dict[str, list[tuple[str, int]]], target_bytes: int, small_bytes: int, max_group_files: int = 1000
) -> list[tuple[int, str, str, int]]:
    """``(group, folder, file, bytes)`` of every file to rewrite; groups of one file are left out.

    A group closes at ``target_bytes`` or ``max_group_files`` files, whichever comes first.
    """
    rows, group = [], 0
    for folder in sorted(files):
        held, size = [], 0
        small = [(f, b) for f, b in files[folder] if b < small_bytes]
        for k, (file, length) in enumerate(small):
            held.append((file, length))
            size += length
            if size >= target_bytes or len(held) >= max_group_files or k == len(small) - 1:
                if len(held) > 1:
                    rows += [(group, folder, f, b) for f, b in held]
                    group += 1
                held, size = [], 0
    return rows


def recover(spark: SparkSession, path: str) -> list[str]:
    """Finish committed plans, drop the others; returns the plans finished."""
    fs, root = _fs(spark, f"{path}/{FOLDER}")
    finished = []
    if not fs.exists(root):
        return finished
    for entry in fs.listStatus(root):
        where = entry.getPath().toString()
        if fs.exists(_path(spark, f"{where}/{MARKER}")):
            _apply(spark, where)
            finished.append(entry.getPath().getName())
        fs.delete(entry.getPath(), True)
    return finished


def _apply(spark: SparkSession, where: str) -> None:
    """Step 4 of a committed plan; each part is idempotent."""
    fs, _ = _fs(spark, where)
    rows = spark.read.schema(PLAN_SCHEMA).parquet(f"{where}/plan").collect()  # one row per file planned
    name = where.rstrip("/").rsplit("/", 1)[-1]
    folders = {}
    for row in rows:
        folders[row["grp"]] = row["folder"]
        source = _path(spark, row["file"])
        if fs.exists(source):
            fs.delete(source, False)
    for group, folder in sorted(folders.items()):
        staged = _path(spark, f"{where}/staged/_grp={group}")
        if not fs.exists(staged):
            continue
        for k, part in enumerate(sorted(fs.listStatus(staged), key=lambda s: s.getPath().getName())):
            if part.getPath().getName().endswith(".parquet"):
                fs.rename(part.getPath(), _path(spark, f"{folder}/part-compacted-{name}-{group}-{k}.zstd.parquet"))


def compact(
    spark: SparkSession,
    path: str,
    target_bytes: int = 128 << 20,
    small_bytes: int | None = None,
    max_files: int = 20_000,
    stop_after: str | None = None,
) -> dict:
    """Rewrite the small files of every ticker folder into files of about ``target_bytes``.

    A round rewrites whole groups of at most ``max_files`` files in all, so that the plan, which
    is broadcast, stays under a known size; rounds follow until no group is left.
    ``stop_after`` (``"plan"``, ``"stage"`` or ``"commit"``) ends the call after that step, as a
    crash would; tests use it. Returns the files rewritten, groups written and rounds run.
    """
    done = {"files": 0, "groups": 0, "rounds": 0}
    while True:
        step = _round(spark, path, target_bytes, small_bytes, max_files, stop_after)
        done = {k: done[k] + step.get(k, 0) for k in ("files", "groups")} | {"rounds": done["rounds"] + bool(step["files"])}
        if "stopped" in step or not step["files"]:
            return done | ({"stopped": step["stopped"]} if "stopped" in step else {})


def _round(spark, path, target_bytes, small_bytes, max_files, stop_after) -> dict:
    recover(spark, path)
    small = small_bytes if small_bytes is not None else target_bytes // 2
    rows = plan(data_files(spark, path), target_bytes, small, min(1000, max_files))
    if not rows:
        return {"files": 0, "groups": 0}
    sizes = Counter(g for g, *_ in rows)
    taken, count = set(), 0
    for group in sorted(sizes):  # whole groups while the round holds at most ``max_files`` files
        if count + sizes[group] > max_files:
            break
        taken.add(group)
        count += sizes[group]
    rows = [r for r in rows if r[0] in taken]
    name = uuid.uuid4().hex
    where = f"{path}/{FOLDER}/{name}"
    spark.createDataFrame(
        [(name, g, folder, f, b, folder.rsplit("/", 1)[-1], f.rsplit("/", 1)[-1]) for g, folder, f, b in rows], PLAN_SCHEMA
    ).coalesce(1).write.parquet(
        f"{where}/plan"
    )
    if stop_after == "plan":
        return {"files": len(rows), "groups": 0, "stopped": "plan"}
    groups = spark.read.schema(PLAN_SCHEMA).parquet(f"{where}/plan").select("folder_name", "file_name", F.col("grp").alias("_grp"))
    # Read exactly the planned files; rows find their group by folder and file name as stored.
    stored_at = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    sources = (
        spark.read.schema(MESSAGE_SCHEMA)
        .option("basePath", path)
        .parquet(*[f for _, _, f, _ in rows])
        .select(
            *[c for c in MESSAGE_COLUMNS if c != "ticker"],
            F.element_at(stored_at, -2).alias("folder_name"),
            F.col("_metadata.file_name").alias("file_name"),
        )
    )
    # The plan has one row per planned file: a bounded table, broadcast.
    staged = sources.join(F.broadcast(groups), ["folder_name", "file_name"]).drop("folder_name", "file_name")
    (
        staged.repartition("_grp")
        .sortWithinPartitions("_grp", "created_at", "id")
        .write.option("compression", "zstd")
        .partitionBy("_grp")
        .parquet(f"{where}/staged")
    )
    if stop_after == "stage":
        return {"files": len(rows), "groups": 0, "stopped": "stage"}
    fs, _ = _fs(spark, where)
    fs.createNewFile(_path(spark, f"{where}/{MARKER}"))
    if stop_after == "commit":
        return {"files": len(rows), "groups": len({g for g, *_ in rows}), "stopped": "commit"}
    recover(spark, path)
    return {"files": len(rows), "groups": len({g for g, *_ in rows})}


def files_per_folder(spark: SparkSession, path: str) -> dict[str, int]:
    return {folder.rsplit("/", 1)[-1]: len(found) for folder, found in data_files(spark, path).items()}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)
