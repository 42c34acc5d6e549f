"""Layered tables: ``bronze.interactions`` and so on, Parquet paths or a catalogue."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfstream.sources import scoped

# Table name prefix -> partition columns.
PARTITIONS = {
    "bronze.interactions": ("event_date",),
    "silver.interactions": ("event_date",),
    "gold.sequences": ("split",),
}


@dataclass(frozen=True)
class Warehouse:
    """Where tables live. ``fmt`` other than parquet needs its connector jars."""

    spark: SparkSession
    root: str
    fmt: str = "parquet"
    catalog: str | None = None

    def location(self, table: str) -> str:
        layer, _, name = table.partition(".")
        if not layer or not name:
            raise ValueError(f"expected 'layer.name', got {table!r}")
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def _identifier(self, table: str) -> str:
        return f"{self.catalog}.{table}" if self.catalog else table

    def _path(self, where: str):
        return scoped.fs_path(self.spark, where)

    def exists(self, table: str) -> bool:
        if self.fmt == "iceberg":
            return self.spark.catalog.tableExists(self._identifier(table))
        fs, path = self._path(self.location(table))
        return fs.exists(path)

    def read(self, table: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The table, or those of ``columns`` it has."""
        if not self.exists(table):
            raise FileNotFoundError(f"table {table!r} does not exist below {self.root!r}")
        if self.fmt == "iceberg":
            df = self.spark.table(self._identifier(table))
        else:
            df = self.spark.read.format(self.fmt).load(self.location(table))
        return df if columns is None else columns_present(df, columns)

    def partitions_for(self, table: str, df: DataFrame) -> list[str]:
        for prefix, names in PARTITIONS.items():
            if table == prefix or table.startswith(prefix + "_"):
                return [c for c in names if c in df.columns]
        return []

    def write(
        self,
        table: str,
        df: DataFrame,
        mode: str = "overwrite",
        partition_by: Sequence[str] | None = None,
    ) -> None:
        """Write the table partitioned by those of the wanted columns it has."""
        wanted = self.partitions_for(table, df) if partition_by is None else partition_by
        parts = [c for c in wanted if c in df.columns]
        if self.fmt == "iceberg":
            writer = df.writeTo(self._identifier(table)).using("iceberg")
            if parts:
                writer = writer.partitionedBy(*[F.col(c) for c in parts])
            writer.append() if mode == "append" and self.exists(
                table
            ) else writer.createOrReplace()
            return
        if parts:
            # A task then writes few partitions, and AQE splits a large one.
            df = df.hint("rebalance", *parts)
        writer = df.write.format(self.fmt).mode(mode)
        (writer.partitionBy(*parts) if parts else writer).save(self.location(table))

    def observed_partitions(self, table: str) -> list[str]:
        """Partition columns the stored table really has, read off its directories."""
        fs, path = self._path(self.location(table))
        names: list[str] = []
        while fs.exists(path):
            children = [s for s in fs.listStatus(path) if s.isDirectory()]
            keyed = [s for s in children if "=" in s.getPath().getName()]
            if not keyed:
                break
            names.append(keyed[0].getPath().getName().split("=", 1)[0])
            path = keyed[0].getPath()
        return names

    def partition_folders(self, table: str, column: str) -> list[tuple[str, str | None]]:
        """(folder, value as text) of a table partitioned by ``column`` first; a null value is None."""
        if self.fmt == "iceberg" or self.observed_partitions(table)[:1] != [column]:
            return []
        fs, path = self._path(self.location(table))
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        values = [(n, unquote(n.split("=", 1)[1])) for n in names if n.startswith(column + "=")]
        return [(n, None if v == "__HIVE_DEFAULT_PARTITION__" else v) for n, v in values]

    def drop_partitions(self, table: str, folders: Sequence[str]) -> None:
        scoped.drop_folders(self.spark, self.location(table), folders)

    def files(self, table: str) -> DataFrame:
        """path, modificationTime, length of the table's files."""
        return scoped.stored_files(self.spark, self.location(table))

    def delete_where(self, table: str, hit: Column) -> scoped.Touched:
        """Remove the rows that ``hit`` is true for; files without such a row keep their name and time.

        Only touched files are read and written again, in their partition
        folder and without a shuffle. The condition is pushed into the search
        for them, so row groups without a match are skipped.
        """
        hit = F.coalesce(hit, F.lit(False))
        if self.fmt == "iceberg":
            df = self.read(table)
            removed = df.filter(hit).count()
            if removed:
                self.write(table, df.filter(~hit))
            return scoped.Touched((), removed)
        root = self.location(table)
        scoped.finish(self.spark, root)
        df = self.read(table)
        touched = scoped.touched_by(df, hit)
        parts = self.observed_partitions(table)

        def survivors(paths: list[str]) -> DataFrame:
            rows = self.spark.read.schema(df.schema).format(self.fmt).option("basePath", root).load(paths)
            return rows.filter(~hit).withColumn(scoped.FILE, F.col("_metadata.file_path")).drop(*parts)

        def write(rows: DataFrame, where: str) -> None:
            rows.write.format(self.fmt).partitionBy(scoped.DIRECTORY).mode("overwrite").save(where)

        scoped.replace_files(self.spark, root, touched.files, survivors, write)
        return touched

    def swap(self, target: str, staging: str) -> None:
        """Put the folder ``staging`` in the place of ``target``.

        Two renames: between them readers find no folder, and on an object
        store a rename copies; a table format has neither fault. What an
        interrupted swap left behind is put right first: with the table gone
        its old copy comes back, with the table there the old copy goes.
        """
        fs, path = self._path(target)
        _, staged = self._path(staging)
        _, aside = self._path(target.rstrip("/") + "__old")
        if fs.exists(aside):
            if fs.exists(path):
                fs.delete(aside, True)
            elif not fs.rename(aside, path):
                raise OSError(f"could not restore {target!r}")
        if not fs.rename(path, aside):
            raise OSError(f"could not set {target!r} aside")
        if not fs.rename(staged, path):
            fs.rename(aside, path)
            raise OSError(f"could not move {staging!r} into place")
        fs.delete(aside, True)

    def rewrite(self, table: str, df: DataFrame) -> None:
        """Replace a table by a frame that was derived from it.

        The new rows are written beside the table and then take its place (see
        :meth:`swap`), so the frame may read the table it replaces.
        """
        if self.fmt == "iceberg":
            self.write(table, df)
            return
        parts = self.observed_partitions(table)
        target = self.location(table)
        staging = target + "__staging"
        writer = df.write.format(self.fmt).mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).save(staging)
        self.swap(target, staging)
        self.spark.catalog.refreshByPath(target)


def columns_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def _aligned(df: DataFrame, name: str, size: Column, filler: Column) -> Column:
    """The array when it has ``size`` elements, otherwise ``filler``."""
    if name not in df.columns:
        return filler
    return F.when(F.size(name) == size, F.col(name)).otherwise(filler)


def aligned_sequences(df: DataFrame) -> DataFrame:
    """Repair per-user arrays that do not line up, with neutral values.

    Missing actions become padding, missing times the event ordinal, missing
    return labels "not a purchase".
    """
    n = F.size("input_tokens")
    m = F.size("target_tokens")
    ordinal = F.transform(F.col("input_tokens"), lambda _, i: i.cast("long"))
    ids = F.array_repeat(F.lit(0), n)
    actions = _aligned(df, "input_actions", n, F.array_repeat(F.lit("").cast("string"), n))
    from shelfstream.functions.actions import ACTION_ID, PADDING_ACTION, UNKNOWN_ACTION, lookup

    table = {**ACTION_ID, "": PADDING_ACTION}
    encoded = F.transform(actions, lambda a: lookup(table, a, UNKNOWN_ACTION))
    return df.select(
        "user_id",
        "input_tokens",
        F.coalesce(encoded, ids).alias("input_actions"),
        F.coalesce(_aligned(df, "input_ts", n, ordinal), ordinal).alias("input_ts"),
        F.coalesce(
            _aligned(df, "input_returned", n, F.array_repeat(F.lit(-1), n)),
            F.array_repeat(F.lit(-1), n),
        ).alias("input_returned"),
        "target_tokens",
        F.coalesce(
            _aligned(df, "target_actions", m, F.array_repeat(F.lit(0), m)),
            F.array_repeat(F.lit(0), m),
        ).alias("target_actions"),
        *[c for c in ("split",) if c in df.columns],
    )


def load_variant(warehouse: Warehouse, variant: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and repaired sequences of one granularity variant."""
    vocab = warehouse.read(f"gold.vocab_{variant}")
    return vocab, aligned_sequences(warehouse.read(f"gold.sequences_{variant}"))


def tables_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that are in only one of two tables (duplicates count)."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


__all__ = ["PARTITIONS", "Warehouse", "aligned_sequences", "columns_present", "load_variant", "tables_differ"]
