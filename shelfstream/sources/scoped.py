"""Rewrites that touch only the files that hold affected rows.

Files are found by ``_metadata.file_path``. Their survivors are written beside
the table, then a plan (which staged file goes where, which old file goes) is
stored, and only then is anything moved. A run that dies before the plan leaves
the table as it was; one that dies later is finished by the next
(:func:`finish`). Readers may see a touched file's rows twice or not at all
while the plan is carried out; a table format has no such moment.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTORY = "_directory"
FILE = "_file"


@dataclass(frozen=True)
class Touched:
    """Files with affected rows, as ``_metadata`` names them, and how many rows these are."""

    files: tuple[str, ...]
    rows: int


def fs_path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def touched_by(df: DataFrame, hit: Column) -> Touched:
    """The files of ``df`` with a row that ``hit`` is true for; one row per file reaches the driver."""
    found = df.filter(hit).groupBy(F.col("_metadata.file_path").alias(FILE)).count().collect()
    return Touched(tuple(sorted(r[FILE] for r in found)), sum(r["count"] for r in found))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of every file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.col("_metadata.file_path").alias("path"), "modificationTime", "length")
    )


def _staging(root: str) -> str:
    return root.rstrip("/") + "__rewrite"


def _plan_path(root: str) -> str:
    return _staging(root) + "/plan.json"


def finish(spark: SparkSession, root: str) -> None:
    """Carry out a stored plan, or clear away what was staged without one. Repeating it does no harm."""
    fs, staging = fs_path(spark, _staging(root))
    if not fs.exists(staging):
        return
    _, stored = fs_path(spark, _plan_path(root))
    if fs.exists(stored):
        stream = fs.open(stored)
        try:
            plan = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        for staged, final in plan["moves"]:
            _, source = fs_path(spark, staged)
            _, target = fs_path(spark, final)
            if fs.exists(source):
                fs.mkdirs(target.getParent())
                if not fs.rename(source, target):
                    raise OSError(f"could not move {staged!r} to {final!r}")
        for old in plan["deletes"]:
            _, path = fs_path(spark, old)
            fs.delete(path, True)
            folder = path.getParent()
            # An empty partition folder would still name its values.
            while str(folder) != str(fs_path(spark, root)[1]) and fs.exists(folder) and not fs.listStatus(folder):
                fs.delete(folder, False)
                folder = folder.getParent()
    fs.delete(staging, True)


def _store_plan(spark: SparkSession, root: str, moves: Sequence[tuple[str, str]], deletes: Sequence[str]) -> None:
    fs, path = fs_path(spark, _plan_path(root))
    _, draft = fs_path(spark, _plan_path(root) + ".draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps({"moves": moves, "deletes": deletes}).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, path):
        raise OSError(f"could not store the plan for {root!r}")


def replace_files(
    spark: SparkSession,
    root: str,
    files: Sequence[str],
    survivors: Callable[[list[str]], DataFrame],
    write: Callable[[DataFrame, str], None],
) -> None:
    """Put the rows of ``survivors(paths)`` in the place of ``files``, each in its file's own folder.

    ``survivors`` adds the column ``_file`` (the row's ``_metadata.file_path``);
    ``write`` stores rows below a path, partitioned by ``_directory``. Rows
    stay in the task that reads them: nothing is shuffled.
    """
    finish(spark, root)
    if not files:
        return
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    numbers = spark.createDataFrame(list(enumerate(folders)), f"{DIRECTORY} int, _folder string")
    rows = survivors([unquote(f) for f in files])
    folder = F.regexp_extract(FILE, "^(.*)/[^/]*$", 1)
    dealt = rows.withColumn("_folder", folder).join(numbers, "_folder").drop("_folder", FILE)
    staging = _staging(root)
    write(dealt, staging + "/rows")
    fs, _ = fs_path(spark, root)
    moves = []
    for number, name in enumerate(folders):
        _, staged = fs_path(spark, f"{staging}/rows/{DIRECTORY}={number}")
        if fs.exists(staged):
            for status in fs.listStatus(staged):
                file = status.getPath().getName()
                if not file.startswith(("_", ".")):
                    moves.append((status.getPath().toString(), f"{unquote(name)}/{file}"))
    _store_plan(spark, root, moves, [unquote(f) for f in files])
    finish(spark, root)
    spark.catalog.refreshByPath(root)


def drop_folders(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    """Delete whole partition folders below ``root``: no row of theirs or of any other is read or written."""
    finish(spark, root)
    fs, _ = fs_path(spark, root)
    for name in names:
        _, path = fs_path(spark, f"{root.rstrip('/')}/{name}")
        if fs.exists(path) and not fs.delete(path, True):
            raise OSError(f"could not delete {path}")
    spark.catalog.refreshByPath(root)
