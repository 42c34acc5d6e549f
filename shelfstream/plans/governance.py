"""Retention, erasure and identifier reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfstream.functions.privacy import (
    IDENTIFIER_FIELDS,
    has_identifier_shape,
    pseudonym_of,
)
from shelfstream.sources import scoped
from shelfstream.sources.tables import Warehouse

REPORT = (
    "table string, status string, cutoff string, rows_before long, rows_removed long, "
    "rows_after long, delete_share double, partitions_dropped long, files_rewritten long"
)


# -- identifiers --------------------------------------------------------------


def _leaves(schema: T.StructType) -> list[tuple[str, T.DataType, Callable]]:
    """(path, type, ask) of every plain value in the schema, however deep.

    ``ask(test)`` is a column: whether any value at the path passes ``test``.
    Arrays, map keys and map values are entered by ``exists``.
    """
    found: list[tuple[str, T.DataType, Callable]] = []

    def enter(kind: T.DataType, path: str, ask: Callable) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                enter(field.dataType, f"{path}.{field.name}", lambda test, n=field.name: ask(lambda v: test(v[n])))
        elif isinstance(kind, T.ArrayType):
            enter(kind.elementType, path, lambda test: ask(lambda v: F.exists(v, lambda e: test(e))))
        elif isinstance(kind, T.MapType):
            enter(kind.keyType, path, lambda test: ask(lambda v: F.exists(F.map_keys(v), lambda e: test(e))))
            enter(kind.valueType, path, lambda test: ask(lambda v: F.exists(F.map_values(v), lambda e: test(e))))
        else:
            found.append((path, kind, lambda test: F.coalesce(ask(test), F.lit(False))))

    for field in schema.fields:
        enter(field.dataType, field.name, lambda test, n=field.name: test(F.col(f"`{n}`")))
    return found


def find_identifiers(df: DataFrame, names: Sequence[str] = IDENTIFIER_FIELDS) -> DataFrame:
    """(path, reason, rows) where identifiers survive: by field name or by value shape.

    Fields inside structs, arrays and maps count like top-level ones. One
    aggregate over all columns.
    """
    asked: dict[tuple[str, str], Column] = {}
    for path, kind, ask in _leaves(df.schema):
        text = isinstance(kind, T.StringType)
        if any(part in names for part in path.split(".")):
            key = (path, "field name")
            hit = ask((lambda v: v.isNotNull() & (v != "")) if text else (lambda v: v.isNotNull()))
        elif text:
            key, hit = (path, "value shape"), ask(has_identifier_shape)
        else:
            continue
        # A map has two leaves at one path.
        asked[key] = asked[key] | hit if key in asked else hit
    if not asked:
        return df.sparkSession.createDataFrame([], "path string, reason string, rows long")
    wide = df.agg(*[F.count_if(hit).alias(f"c{i}") for i, hit in enumerate(asked.values())])
    cells = [
        F.struct(F.lit(p).alias("path"), F.lit(r).alias("reason"), F.col(f"c{i}").alias("rows"))
        for i, (p, r) in enumerate(asked)
    ]
    return wide.select(F.inline(F.array(*cells))).filter("rows > 0")


def scrub(df: DataFrame, names: Sequence[str] = IDENTIFIER_FIELDS) -> DataFrame:
    """Replace identifier fields by their presence or size, inside structs too."""

    def columns(schema: T.StructType, parent: Column | None) -> list[Column]:
        out = []
        for field in schema.fields:
            value = F.col(field.name) if parent is None else parent[field.name]
            if field.name in names:
                if isinstance(field.dataType, (T.ArrayType, T.MapType)):
                    size = F.when(value.isNotNull(), F.size(value))
                    out.append(size.alias(f"n_{field.name}"))
                else:
                    out.append(F.when(value.isNotNull(), True).alias(f"has_{field.name}"))
            elif isinstance(field.dataType, T.StructType):
                inner = F.struct(*columns(field.dataType, value))
                out.append(F.when(value.isNotNull(), inner).alias(field.name))
            elif isinstance(field.dataType, T.ArrayType) and isinstance(
                field.dataType.elementType, T.StructType
            ):
                kind = field.dataType.elementType
                out.append(
                    F.transform(value, lambda e, k=kind: F.struct(*columns(k, e))).alias(field.name)
                )
            else:
                out.append(value.alias(field.name))
        return out

    return df.select(*columns(df.schema, None))


# -- retention ----------------------------------------------------------------


class RetentionRefused(RuntimeError):
    """The window covers more of a table than the configured share."""


def instant(events: DataFrame | None, clock: str = "wall", column: str = "event_ts") -> datetime:
    """What a window is measured back from: now, or with ``data`` the newest event.

    ``data`` has to be asked for: in production it would keep everything for ever.
    """
    if clock not in ("wall", "data"):
        raise ValueError(f"clock must be 'wall' or 'data', not {clock!r}")
    newest = None
    if clock == "data" and events is not None:
        seconds = events.agg(F.max(F.unix_timestamp(column))).first()[0]
        newest = None if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)
    return newest or datetime.now(timezone.utc)


def cutoff(
    events: DataFrame | None, days: int, clock: str = "wall", column: str = "event_ts"
) -> datetime:
    """Instant before which rows are past their window."""
    return instant(events, clock, column) - timedelta(days=days)


def recent_rows(df: DataFrame, column: str, at: datetime) -> DataFrame:
    return df.filter(F.col(column) >= F.lit(at.date()))


def recent_users(sequences: DataFrame, at: datetime) -> DataFrame:
    """Whole users whose last event is inside the window; a sequence is never cut."""
    return sequences.filter(F.array_max("input_ts") >= int(at.timestamp()))


def prune(
    warehouse: Warehouse,
    table: str,
    keep: Column,
    at: datetime,
    max_share: float = 0.5,
    dry_run: bool = False,
    column: str | None = None,
) -> dict:
    """Drop rows that fail ``keep``, unless that is too large a share of the table.

    Where ``column`` is the table's first partition column, partitions past the
    window go as folders and nothing is read or written. Elsewhere only files
    that hold a row to drop are written again.
    """
    step = {"table": table, "cutoff": at.date().isoformat()}
    if not warehouse.exists(table):
        return {**step, "status": "absent"}
    df = warehouse.read(table)
    if column is not None and column not in df.columns:
        return {**step, "status": f"no {column} column"}
    total, kept = df.agg(F.count("*"), F.count_if(keep)).first()
    removed = total - kept
    step.update(rows_before=total, rows_removed=removed, rows_after=kept)
    if total == 0:
        return {**step, "status": "empty"}
    share = removed / total
    step["delete_share"] = round(share, 4)
    if share > max_share:
        raise RetentionRefused(
            f"{table}: {removed} of {total} rows ({share:.1%}) are past the window, "
            f"over the limit of {max_share:.0%}"
        )
    if dry_run:
        return {**step, "status": "would prune"}
    if removed == 0:
        return {**step, "status": "nothing to prune"}
    folders = warehouse.partition_folders(table, column) if column else []
    if folders:
        past = [name for name, value in folders if value is None or date.fromisoformat(value) < at.date()]
        warehouse.drop_partitions(table, past)
        return {**step, "status": "pruned", "partitions_dropped": len(past), "files_rewritten": 0}
    touched = warehouse.delete_where(table, ~F.coalesce(keep, F.lit(False)))
    return {**step, "status": "pruned", "partitions_dropped": 0, "files_rewritten": len(touched.files)}


def retention(
    warehouse: Warehouse,
    dated: Mapping[str, int],
    sequences: Mapping[str, int] | None = None,
    clock: str = "wall",
    max_share: float = 0.5,
    dry_run: bool = False,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Apply windows in days to dated tables (``event_date``) and sequence tables.

    One report row per table; a refusal stops the run and is its last row. The
    ``data`` clock reads ``newest``, by default the bronze interactions.
    """
    if newest is None and clock == "data" and warehouse.exists("bronze.interactions"):
        newest = warehouse.read("bronze.interactions", ["event_ts"])
    # Asked for once: the table that tells the time may itself be pruned on the way.
    now = instant(newest, clock)
    steps: list[dict] = []
    plan = [(t, d, "event_date") for t, d in dated.items()]
    plan += [(t, d, "input_ts") for t, d in (sequences or {}).items()]
    for table, days, column in plan:
        if days <= 0:
            steps.append({"table": table, "status": "no window configured"})
            continue
        at = now - timedelta(days=days)
        keep = (
            F.array_max("input_ts") >= int(at.timestamp())
            if column == "input_ts"
            else F.col(column) >= F.lit(at.date())
        )
        try:
            steps.append(prune(warehouse, table, keep, at, max_share, dry_run, column))
        except RetentionRefused as refusal:
            steps.append({"table": table, "status": f"refused: {refusal}"})
            break
    names = [part.split()[0] for part in REPORT.split(", ")]
    return warehouse.spark.createDataFrame([tuple(s.get(n) for n in names) for s in steps], REPORT)


# -- erasure ------------------------------------------------------------------

# Stores an erasure cannot reach, and what bounds them.
UNERASABLE = (
    ("event log", "append-only and not compacted by user", "topic retention of 7 days"),
    ("model weights", "parameters stay fitted to removed data", "the next training run"),
    ("backups", "outside the reach of this library", "unknown"),
)


def subject_identifiers(user_id: str, key: bytes | None = None, length: int = 32) -> list[str]:
    """The id itself and, where pseudonyms are in use, its pseudonym."""
    return [user_id] + ([pseudonym_of(user_id, key, length)] if key else [])


def mentions(df: DataFrame, identifiers: Sequence[str]) -> Column:
    """Whether any string of the row, however deep, contains an identifier.

    Every string is searched, because derived values such as a session id can
    embed the user id.
    """
    verdict = F.lit(False)
    for _, kind, ask in _leaves(df.schema):
        if isinstance(kind, T.StringType):
            for identifier in identifiers:
                verdict = verdict | ask(lambda v, i=identifier: v.contains(i))
    return verdict


def strings_of(df: DataFrame) -> Column:
    """All strings of a row, however deep, as one array without nulls."""

    def inside(kind: T.DataType, value: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(value)
        if isinstance(kind, T.StructType):
            parts = [inside(f.dataType, value[f.name]) for f in kind.fields]
            parts = [p for p in parts if p is not None]
            return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else None
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType):
                return value
            if inside(kind.elementType, F.lit(None)) is None:
                return None
            return F.flatten(F.transform(value, lambda e: F.coalesce(inside(kind.elementType, e), none)))
        if isinstance(kind, T.MapType):
            parts = [
                inside(T.ArrayType(k), values)
                for k, values in ((kind.keyType, F.map_keys(value)), (kind.valueType, F.map_values(value)))
            ]
            parts = [p for p in parts if p is not None]
            return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else None
        return None

    none = F.array().cast("array<string>")
    found = [inside(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields]
    return F.array_compact(F.concat(none, *[F.coalesce(c, none) for c in found if c is not None]))


def subject_mentions(df: DataFrame, subjects: Mapping[str, Sequence[str]], also: Column | None = None) -> DataFrame:
    """(subject, matches): rows that mention each subject, all subjects in one scan.

    One automaton over all identifiers runs along every string of a row, so the
    scan costs the same for one subject and for thousands. A row counts once
    for a subject, whichever of the identifiers it holds and how often.
    ``also`` is one more string to search.
    """
    owners: dict[str, list[str]] = {}
    for subject, identifiers in subjects.items():
        for identifier in identifiers:
            if identifier:
                owners.setdefault(identifier, []).append(subject)
    held = df.sparkSession.sparkContext.broadcast(owners)
    texts = strings_of(df) if also is None else F.concat(strings_of(df), F.array_compact(F.array(also)))

    def search(batches):
        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        for identifier, names in held.value.items():
            automaton.add_word(identifier, names)
        automaton.make_automaton()
        total: dict[str, int] = {}
        for batch in batches:
            for row in batch["texts"]:
                for name in {n for text in row for _, names in automaton.iter(text) for n in names}:
                    total[name] = total.get(name, 0) + 1
        yield pd.DataFrame({"subject": list(total), "matches": list(total.values())}).astype({"subject": str, "matches": "int64"})

    if not owners:
        return df.sparkSession.createDataFrame([], "subject string, matches long")
    return df.select(texts.alias("texts")).mapInPandas(search, "subject string, matches long").groupBy("subject").agg(
        F.sum("matches").alias("matches")
    )


def verify_subjects(
    warehouse: Warehouse,
    subjects: Mapping[str, Sequence[str]],
    raw_paths: Sequence[str] = (),
    layers: Sequence[str] = ("bronze", "silver", "gold", "online"),
) -> DataFrame:
    """(subject, where, matches) for every subject and file set that still mentions them.

    ``subjects`` maps each to its identifiers (see :func:`subject_identifiers`).
    As :func:`verify_erased`, for many subjects in one scan per file set, and
    with files that are not Parquet: these are searched line by line, compressed
    ones unpacked.
    """
    spark, found = warehouse.spark, []
    for layer in layers:
        fs, folder = warehouse._path(f"{warehouse.root.rstrip('/')}/{layer}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            name = f"{layer}.{status.getPath().getName()}"
            for df in _readers(spark, status.getPath().toString()):
                named = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "/[^/]*$", "/")
                inside = F.regexp_extract(named, "((/[^/=]+=[^/]*)*)/$", 1)
                found.append(subject_mentions(df, subjects, inside).withColumn("where", F.lit(name)))
    for path in raw_paths:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
        found.append(subject_mentions(lines, subjects).withColumn("where", F.lit(path)))
    if not found:
        return spark.createDataFrame([], "subject string, where string, matches long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("subject", "where").agg(F.sum("matches").alias("matches"))


def _readers(spark, path: str) -> list[DataFrame]:
    """Frames that together hold every file below ``path``."""
    out = []
    ends = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .agg(F.count_if(F.col("path").endswith(".parquet")), F.count_if(~F.col("path").endswith(".parquet"))).first()
    )
    everything = spark.read.option("recursiveFileLookup", True)
    if ends[0]:
        out.append(everything.option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(path))
    if ends[1]:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
        out.append(lines.filter(~F.col("_metadata.file_name").endswith(".parquet")))
    return out


def without_subject(df: DataFrame, identifiers: Sequence[str], column: str = "user_id"):
    return df.filter(~F.coalesce(F.col(column).isin(*identifiers), F.lit(False)))


def erase_table(
    warehouse: Warehouse, table: str, identifiers: Sequence[str], column: str, dry_run: bool
) -> dict:
    step = {"store": table}
    if not warehouse.exists(table):
        return {**step, "status": "absent", "rows_removed": 0}
    df = warehouse.read(table)
    if column not in df.columns:
        return {**step, "status": f"no {column} column", "rows_removed": 0}
    theirs = F.col(column).isin(*identifiers)
    if dry_run:
        hits = df.filter(theirs).count()
        return {**step, "status": "would erase" if hits else "nothing to erase", "rows_removed": hits}
    hits = warehouse.delete_where(table, theirs).rows
    return {**step, "status": "rewritten" if hits else "nothing to erase", "rows_removed": hits}


def erase_raw_csv(
    warehouse: Warehouse, path: str, schema: str, identifiers: Sequence[str], dry_run: bool,
    column: str = "user_id",
) -> dict:
    """Rewrite raw CSV files without the subject's rows; all other lines stay as they are.

    Only files with a row of theirs are written again, in their own folder.
    Lines are kept as text, with columns the schema doesn't know and numbers as
    written. The files must share a header and have one record per line. Where
    no line of any file is left, one file with the header stays.
    """
    spark = warehouse.spark
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    titles = lines.limit(1).first()
    if titles is None or column not in header:
        return {"store": path, "status": f"no {column} column", "rows_removed": 0}
    fields = ", ".join(f"_c{i} string" for i in range(len(header)))
    owner = F.from_csv("value", fields)[f"_c{header.index(column)}"]
    theirs = F.coalesce(owner.isin(*identifiers), F.lit(False))
    if dry_run:
        hits = lines.filter(theirs).count()
        return {"store": path, "status": "would erase" if hits else "nothing to erase", "rows_removed": hits}
    scoped.finish(spark, path)
    touched = scoped.touched_by(lines, theirs)
    if not touched.rows:
        return {"store": path, "status": "nothing to erase", "rows_removed": 0}

    def write(rows: DataFrame, where: str) -> None:
        # One column whose name is the header line: each file starts with it, and
        # with quoting and trimming off the lines pass unchanged.
        named = rows.withColumnRenamed("value", titles["value"])
        parts = [c for c in rows.columns if c != "value"]
        named.write.partitionBy(*parts).mode("overwrite").options(
            header=True, quote="", sep="\u0001", emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        ).csv(where)

    kept = ~theirs & (F.col("value") != titles["value"])
    if lines.filter(kept).isEmpty():
        staging = path.rstrip("/") + "__staging"
        write(lines.filter(kept).coalesce(1), staging)
        warehouse.swap(path, staging)
    else:
        scoped.replace_files(
            spark, path, touched.files,
            lambda files: spark.read.text(files).filter(kept).withColumn(scoped.FILE, F.col("_metadata.file_path")),
            write,
        )
    return {"store": path, "status": "rewritten", "rows_removed": touched.rows}


def verify_erased(
    warehouse: Warehouse,
    identifiers: Sequence[str],
    raw_paths: Sequence[str] = (),
    layers: Sequence[str] = ("bronze", "silver", "gold", "online"),
) -> DataFrame:
    """(where, matches) for every file set that still mentions the subject.

    All files below a table's folder are read, also ones no query would list,
    with the columns that any of them has; partition values in folder names
    are searched too. Raw text is searched line by line.
    """
    spark, found = warehouse.spark, []
    for layer in layers:
        fs, folder = warehouse._path(f"{warehouse.root.rstrip('/')}/{layer}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            files = spark.read.option("recursiveFileLookup", True).option(
                "pathGlobFilter", "*.parquet"
            ).option("mergeSchema", True)
            df = files.parquet(f"{warehouse.root.rstrip('/')}/{layer}/{name}")
            folder_of = F.url_decode(F.col("_metadata.file_path"))
            named = F.lit(False)
            for identifier in identifiers:
                named = named | folder_of.contains(f"={identifier}/")
            found.append((f"{layer}.{name}", df.filter(mentions(df, identifiers) | named).count()))
    for path in raw_paths:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
        found.append((path, lines.filter(mentions(lines, identifiers)).count()))
    return spark.createDataFrame(found, "where string, matches long")


def erase(
    warehouse: Warehouse,
    user_id: str,
    tables: Sequence[str],
    raw: Mapping[str, str] | None = None,
    key: bytes | None = None,
    length: int = 32,
    dry_run: bool = False,
) -> DataFrame:
    """Remove one subject everywhere and prove it; the receipt does not name them.

    Raw files go first because every table derives from them; derived user
    tails go last. ``raw`` maps a CSV path to its schema.
    """
    identifiers = subject_identifiers(user_id, key, length)
    steps = [
        erase_raw_csv(warehouse, path, schema, identifiers, dry_run)
        for path, schema in (raw or {}).items()
    ]
    steps += [erase_table(warehouse, t, identifiers, "user_id", dry_run) for t in tables]
    left = verify_erased(warehouse, identifiers, list(raw or {})) if not dry_run else None
    return receipt(warehouse, user_id, steps, left, key)


def subject_digest(user_id: str, key: bytes | None = None) -> str:
    """A handle for the receipt; only the keyed form resists guessing."""
    if key:
        return pseudonym_of(user_id, key, 16)
    return hashlib.sha256(user_id.encode("utf-8")).hexdigest()[:16]


def receipt(
    warehouse: Warehouse, user_id: str, steps: Sequence[dict], left: DataFrame | None, key
) -> DataFrame:
    survived = {} if left is None else {
        r["where"]: r["matches"] for r in left.filter("matches > 0").collect()
    }
    complete = left is not None and not survived
    digest = subject_digest(user_id, key)
    rows = [(digest, bool(key), complete, "step", s["store"], s["status"], s["rows_removed"]) for s in steps]
    rows += [(digest, bool(key), complete, "survived", w, "found", n) for w, n in survived.items()]
    rows += [
        (digest, bool(key), complete, "unerasable", store, f"{why}; bound: {bound}", None)
        for store, why, bound in UNERASABLE
    ]
    return warehouse.spark.createDataFrame(
        rows,
        "subject_digest string, digest_keyed boolean, complete boolean, kind string, "
        "store string, status string, rows long",
    )
