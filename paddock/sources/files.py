"""Per-event CSV files as one typed table, and tables by (year, round).

File names hold the key: ``table_YEAR_ROUND[_SESSION][_DRIVER].csv``; a folder of that name is what Spark writes. Files are grouped by their header line, as Spark reads
all files of one call by one header; each group is read with its own names and the groups are united by name.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pick

NAME = r"[a-z_]_(\d{4}_\d{1,2}(?:_(?:FP1|FP2|FP3|Q|SQ|SS|S|R))?(?:_[A-Z0-9]{3})?)\.csv(?:/part-[^/]*)?$"
SESSIONS = ("FP1", "FP2", "FP3", "Q", "SQ", "SS", "S", "R")


def with_name_key(df: DataFrame, path: Column) -> DataFrame:
    """year, round, session and file_driver of a file's path. This is done for each row, so it is one search in the path's last two
    names: the key has no slash but that before a part."""
    said = F.split(F.regexp_extract(F.substring_index(path, "/", -2), NAME, 1), "_")
    part = lambda i: F.get(said, F.lit(i))
    session = F.when(part(2).isin(*SESSIONS), part(2))
    driver = F.when(session.isNull(), part(2)).otherwise(part(3))
    return df.withColumns({"year": F.nullif(part(0), F.lit("")).cast("int"), "round": part(1).cast("int"), "session": F.coalesce(F.when(session == "SS", "SQ").otherwise(session), F.lit("R")), "file_driver": driver})


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, table, year, round, session, file_driver of the files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    return with_name_key(files, F.col("path")).withColumn("table", F.regexp_extract("path", r"([a-z_]+?)_\d{4}_\d{1,2}[^/]*$", 1)).filter("year is not null")


def last_pair(name: Column) -> tuple[Column, Column]:
    """Year and round of the last ``YEAR_ROUND`` in a name; null if there is none."""
    pair = F.get(F.reverse(F.regexp_extract_all(name, F.lit(r"(?:19|20)\d{2}_\d{1,2}"), 0)), 0)
    return tuple(F.get(F.split(pair, "_"), i).cast("int") for i in (0, 1))


def available_rounds(files: DataFrame, tables: list[str]) -> DataFrame:
    return files.filter(F.col("table").isin(tables)).select("year", "round").distinct()


def discover_rounds(files: DataFrame, races: DataFrame | None = None, allow: list[str] | None = None, tables: list[str] = ("laps", "results", "qualifying")) -> DataFrame:
    """year, round of the files of these tables, else of the table of races; only those whose tag ``YEAR_ROUND`` is allowed."""
    allowed = lambda df: df.filter(F.concat_ws("_", "year", "round").isin(allow)) if allow else df
    found = allowed(available_rounds(files, list(tables)))
    if races is None:
        return found
    some = F.broadcast(found.select(F.lit(1).alias("_some")).limit(1))
    return found.unionByName(allowed(races.select("year", "round").distinct()).join(some, F.lit(True), "left_anti"))


def saved_rounds(spark: SparkSession, folder: str, prefix: str, skip: list[str] = ()) -> DataFrame:
    """The tables ``PREFIX_YEAR_ROUND.parquet`` or ``.csv`` of a folder as one, with year and round of their names; of two files of
    a round the Parquet one counts, rounds whose tag is in ``skip`` don't. Names are listed, contents read by Spark."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    chosen: dict[str, str] = {}
    for name in sorted(names, key=lambda n: not n.endswith(".parquet")):
        if m := re.fullmatch(rf"{re.escape(prefix)}_(\d{{4}}_\d{{1,2}})\.(parquet|csv)", name):
            chosen.setdefault(m[1], name)
    frames = []
    for kind in ("parquet", "csv"):
        paths = [f"{folder}/{n}" for tag, n in sorted(chosen.items()) if n.endswith(kind) and tag not in skip]
        if paths:
            rows = spark.read.option("mergeSchema", True).parquet(*paths) if kind == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(paths)
            file = F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(prefix)}_(\d{{4}})_(\d{{1,2}})\.", 1), F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(prefix)}_(\d{{4}})_(\d{{1,2}})\.", 2)
            frames.append(rows.withColumns({"year": file[0].cast("int"), "round": file[1].cast("int")}))
    return united(frames) if frames else spark.createDataFrame([], "year int, round int")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder has a path of this pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """All files of a pattern as one table, each read by its own header, with their paths (_path); None if there are none.
    Values stay text."""
    where = f"{folder.rstrip('/')}/{pattern}"
    if not exists(spark, where):
        return None
    lines = spark.read.text(where).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    headers = lines.groupBy("path").agg(F.min_by("value", F.struct("start", "n")).alias("header")).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    frames = []
    for h in headers:
        part = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(list(h.paths))
        frames.append(part.withColumn("_path", F.col("_metadata.file_path")))
    return united(frames) if frames else None


def read_events(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files of a table with their key columns; an absent table is an empty frame. Values stay text."""
    out = read_files(spark, folder, f"{table}_[0-9]*.csv")
    return with_name_key(out, F.col("_path")).drop("_path") if out is not None else spark.createDataFrame([], "year int, round int, session string, file_driver string")


def normalise(df: DataFrame, spec: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Canonical columns by lists of aliases, leniently typed: a value that doesn't parse is null."""
    keys = [c for c in ("year", "round", "session", "file_driver") if c in df.columns]
    return df.select(*keys, *[pick(df, names, kind).alias(out) for out, (names, kind) in spec.items() if out not in keys])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by the ending."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def write_rounds(df: DataFrame, path: str) -> None:
    """Replaces the rounds that df has and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "round").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Durations (day-time intervals) and arrays as text."""
    plain = df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.typeName() in ("daytimeinterval", "interval", "array")})
    plain.write.mode("overwrite").option("header", True).csv(path)


def write_events(df: DataFrame, folder: str, table: str) -> None:
    """One ``table_YEAR_ROUND[_SESSION].csv`` for each round and session of df (year, round, session): a folder, as Spark writes them.
    What it had of these rounds is replaced. The rows of a file are written by one task; the renames are as many as the files."""
    spark, root = df.sparkSession, folder.rstrip("/")
    name = F.concat(F.lit(f"{table}_"), F.col("year").cast("string"), F.lit("_"), F.col("round").cast("string"), F.when(F.col("session") == "R", "").otherwise(F.concat(F.lit("_"), "session")), F.lit(".csv"))
    work = f"{root}/_writing-{uuid.uuid4().hex}"
    rows = df.withColumn("_file", name).drop("year", "round", "session").repartition("_file")
    rows.write.partitionBy("_file").option("header", True).option("escape", '"').csv(work)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(work)):
        if status.isDirectory() and status.getPath().getName().startswith("_file="):
            target = path(f"{root}/{status.getPath().getName().removeprefix('_file=')}")
            fs.delete(target, True)
            fs.rename(status.getPath(), target)
    fs.delete(path(work), True)


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_rounds(schedule: DataFrame, present: DataFrame, sessions: list[str], now: Column) -> DataFrame:
    """The rounds whose listed sessions all lie in the past and that are not present."""
    done = F.least(*[F.coalesce(F.col(s) <= now, F.lit(True)).cast("int") for s in sessions], F.lit(1)) == 1
    known = F.coalesce(*[F.col(s) for s in sessions]).isNotNull()
    return schedule.filter(done & known).select("year", "round").distinct().join(present.select("year", "round").distinct(), ["year", "round"], "left_anti")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a folder of its own only where none is set, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="paddock-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Scratch tables go when the driver ends; a session that has stopped leaves them to the folder's owner."""
    if spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
