"""Folders of sessions, manifests, versioned documents and vocabularies as DataFrames."""

from __future__ import annotations

import tomllib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SESSION_ID = "^[0-9]{8}-[0-9]{6}(-[1-9][0-9]*)?$"


def is_session_id(c: Column) -> Column:
    return F.coalesce(c.rlike(SESSION_ID), F.lit(False))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_or_empty(spark: SparkSession, path: str, schema: StructType, version: tuple[int, int] | None = None) -> DataFrame:
    """A JSON document of a fixed schema; empty where the file is missing. Reading fails on a version outside the range."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if version:
        low, high = version
        v = F.col("schema_version")
        df = df.withColumn("schema_version", F.when(v.between(low, high), v).otherwise(F.raise_error(F.concat(F.lit("unsupported version "), v))))
    return df


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Valid session folders under root in order, by what they hold: transcribed, valid or orphaned; none where root is missing.

    Folders are listed by name, so empty ones count; what they hold is read off the paths of a scan that opens no file.
    """
    if not _exists(spark, root):
        return spark.createDataFrame([], "session string, state string")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    folders = spark.createDataFrame([(s.getPath().getName(),) for s in listed if s.isDirectory()], "session string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", "([^/]+)/([^/]+)$", 1).alias("session"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    has = lambda name: F.bool_or(F.coalesce(F.col("file") == name, F.lit(False)))
    state = F.when(has("transcript.json"), "transcribed").when(has("session.json"), "valid").otherwise("orphaned")
    return folders.filter(is_session_id(F.col("session"))).join(files, "session", "left").groupBy("session").agg(state.alias("state")).orderBy("session")


def sessions_report(found: DataFrame) -> DataFrame:
    """How many sessions are in each state, with their names in order."""
    return found.groupBy("state").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("session")).alias("sessions"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated speaker, session, wav; blank lines and lines that begin with # go. One row for each pair, its files in the
    order of their lines, which the parsed position in the file gives however the file is split."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))
    lines = text.filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = F.split("value", "\t")
    rows = lines.select(F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields in line "), F.col("ord") + 1))).alias("p"), "ord")
    return rows.select(F.col("p")[0].alias("speaker"), F.col("p")[1].alias("session"), F.col("p")[2].alias("wav"), "ord").groupBy("speaker", "session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "wav"))), lambda x: x.wav).alias("wavs"))


def embedding_cache(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """A table of vectors, which all have to have one length: reading fails on a row of another length than the first by name."""
    df = spark.read.parquet(path)
    sizes = [r["n"] for r in df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).distinct().orderBy("n").limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths, such as {sizes[0]} and {sizes[1]}")
    return df


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """profile, match_title, terms of a TOML file; global terms come first in each profile. A pattern that the engine's matcher
    does not take fails here, with the line that holds it. The file is small by nature and read through Spark."""
    content = spark.read.text(path, wholetext=True).first()["value"]
    doc = tomllib.loads(content)
    rows = []
    for name, profile in doc.get("profiles", {}).items():
        if pattern := profile.get("match_title"):
            try:
                spark.range(1).select(F.lit("").rlike(pattern)).collect()
            except Exception as error:
                line = next((i for i, x in enumerate(content.splitlines(), 1) if "match_title" in x and pattern.replace("\\", "\\\\") in x or pattern in x), 0)
                raise ValueError(f"line {line}: match_title of {name} is no pattern: {pattern}") from error
        rows.append((name, pattern, [*doc.get("terms", []), *profile.get("terms", [])]))
    return spark.createDataFrame(rows, "profile string, match_title string, terms array<string>")


def allocated_ids(starts: DataFrame, base: str, order: str) -> DataFrame:
    """Collision-free ids: the second and later rows of one base get -1, -2, ..."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return starts.withColumn("session", F.when(n > 0, F.concat(F.col(base), F.lit("-"), n)).otherwise(F.col(base)))


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str | None) -> None:
    """Make a version the current one by one rename over the pointer; None takes the pointer away."""
    over, fs = _hadoop(spark, f"{path}/CURRENT")
    if version is None:
        fs.delete(over, False)
        return
    jvm = spark.sparkContext._jvm
    written, _ = _hadoop(spark, f"{path}/_next-{version}")
    out = fs.create(written, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(over.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(written), context.makeQualified(over), option)


def _write_version(df: DataFrame, path: str) -> str:
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    return version


def _clear_versions(spark: SparkSession, path: str, stay: tuple[str | None, ...]) -> None:
    top, fs = _hadoop(spark, path)
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in stay:
            fs.delete(status.getPath(), True)


def replace(df: DataFrame, path: str) -> str:
    """Write a new version of the table beside the others, then point to it; a reader sees the old or the new version, whole.

    Versions are folders under path; the pointer is a file `CURRENT` with the version's name, replaced by one rename over it,
    and the version before stays until the one after this is written, for those who read it. Gives the version's name.
    """
    return replace_all({path: df}, df.sparkSession)[path]


class NotReverted(RuntimeError):
    """A commit failed, and so did pointing some of its tables back."""


def replace_all(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, str]:
    """Replace several tables (path: rows) as one: all new versions are written before any pointer moves, and where a pointer
    can't be moved, those moved before go back to what they said.

    A failure while writing leaves every table as it was, with a version that nothing points to and that goes too. A table
    that can't be pointed back is named in NotReverted, with what failed first as its cause. Without tables nothing
    happens. Gives each path's version. The pointers move one after the other: a reader between two of them sees the first
    table's new version beside the second's old one, but each table whole.
    """
    before = {path: current(spark, path) for path in tables}
    written: dict[str, str] = {}
    moved: list[str] = []
    try:
        for path, df in tables.items():
            written[path] = _write_version(df, path)
        for path, version in written.items():
            moved.append(path)  # a move that fails may have happened
            _point(spark, path, version)
    except Exception as error:
        stuck = []
        for path in reversed(moved):
            try:
                _point(spark, path, before[path])
            except Exception:  # noqa: BLE001  named below
                stuck.append(path)
        if stuck:
            raise NotReverted(f"these tables may have their new versions: {', '.join(stuck)}") from error
        for path in written:
            _clear_versions(spark, path, (before[path],))
        raise
    for path, version in written.items():
        _clear_versions(spark, path, (version, before[path]))
    return written


def documents(spark: SparkSession, sessions_: DataFrame, root: str, name: str, schema: StructType, version: tuple[int, int], needed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """JSON documents root/session/name of the sessions (session), and the sessions whose document can't be used.

    The first has session and the schema's columns, the second session and why: missing, not JSON of this form, an
    unsupported version (schema_version outside the range), or without one of the `needed` fields. One bad file costs its own
    session only. A file is read whole by one task; paths are matched with sessions by their folder's name.
    """
    raw = StructType([*schema.fields]).add("_corrupt_record", "string")
    where, _ = _hadoop(spark, root)
    if not _exists(spark, root):
        read = spark.createDataFrame([], "path string, value string")
    else:
        read = spark.read.text(where.toString(), wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("path"), "value")
    found = read.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("_of"), F.from_json("value", raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), F.lit(True).alias("_there"))
    all_ = sessions_.select("session").distinct().join(found, F.col("session") == F.col("_of"), "left")
    v = F.col("d.schema_version")
    absent = [F.when(F.col(f"d.{c}").isNull(), F.lit(c)) for c in needed]
    why = (
        F.when(F.col("_there").isNull(), F.lit("missing")).when(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull(), F.lit("not JSON of this form"))
        .when(v.isNull(), F.lit("no version")).when(~v.between(*version), F.concat(F.lit("unsupported version "), v.cast("string")))
    )
    if absent:
        why = why.when(F.coalesce(*absent).isNotNull(), F.concat(F.lit("without "), F.coalesce(*absent)))
    judged = all_.withColumn("why", why)
    return judged.filter("why IS NULL").select("session", "d.*").drop("_corrupt_record"), judged.filter("why IS NOT NULL").select("session", "why")


def current(spark: SparkSession, path: str) -> str | None:
    """The version that replace() wrote last, or none."""
    if not _exists(spark, f"{path}/CURRENT"):
        return None
    return spark.read.text(f"{path}/CURRENT", wholetext=True).first()["value"].strip()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace() wrote last."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{version}")
