"""Transaction tables in and out: CSV and Parquet with a declared schema, staged publication, verification."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NULL_TOKENS, no_nan, no_token
from ..operators.schema import check_schema

_NTZ = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-work-")
        _own_dirs[spark.sparkContext.applicationId] = shared
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: computed once, whatever reads it and how often."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Quotes inside quoted fields are doubled, and such fields may hold line breaks; a backslash is a letter like others, spaces stay.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**_CSV, multiLine=True).csv(path).columns


def _strict(name: str, kind: T.DataType) -> Column:
    """A text as the type; a text that is none raises, in ANSI mode or not."""
    made = F.col(name).try_cast(kind)
    said = F.concat(F.lit(f"unreadable {kind.simpleString()} in {name}: "), F.col(name))
    return F.when(F.col(name).isNotNull() & made.isNull(), F.raise_error(said).cast(kind)).otherwise(made)


def read_transactions(spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "csv", mode: str = "FAILFAST",
                      null_tokens: tuple[str, ...] = NULL_TOKENS, preview: int | None = None, corrupt: str | None = None, multiline: bool = True) -> DataFrame:
    """A table with exactly the schema's columns, in any order in the file.

    Quoted fields may hold separators, doubled quotes and line breaks. Since a line break may be inside a field, a CSV file
    is read by one task; multiline=False splits large files by lines, for input without such fields.

    CSV fields that are null tokens are null, numbers out of range or unreadable fail (PERMISSIVE: are null, and the row
    is kept as text in `corrupt` if that is named); lines with too many or too few fields fail too (PERMISSIVE: what is
    there is read, the rest is null). NaN is null. preview: that many rows, all as text, unchecked.
    A path that is not there raises FileNotFoundError.
    """
    try:
        if fmt == "csv":
            header = _header(spark, path)
            text = T.StructType([T.StructField(c, T.StringType()) for c in header])
            if preview:
                return spark.read.options(**_CSV, multiLine=multiline).csv(path, schema=text).limit(preview)
            check_schema(header, schema.names)
            df = spark.read.options(**_CSV, multiLine=multiline, enforceSchema=False, mode=mode).csv(path, schema=text)
        else:
            df = spark.read.format(fmt).load(path)
            if preview:
                return df.select(*[F.col(c).cast("string") for c in df.columns]).limit(preview)
            check_schema(df.columns, schema.names)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no transaction table at {path}") from e
        raise
    if fmt == "csv":
        clean = df.select(*[no_token(F.col(c), null_tokens).alias(c) for c in df.columns])
        get = _strict if mode == "FAILFAST" else (lambda c, t: F.col(c).try_cast(t))
        typed = {f.name: F.col(f.name) if isinstance(f.dataType, T.StringType) else get(f.name, f.dataType) for f in schema}
        bad = F.lit(False)
        for f in schema:
            bad = bad | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
        extra = [F.when(bad, F.to_csv(F.struct(*[F.col(c) for c in clean.columns]))).alias(corrupt)] if corrupt and mode != "FAILFAST" else []
        df = clean.select(*[typed[f.name].alias(f.name) for f in schema], *extra)
    else:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    return df.select(*[no_nan(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_gold(df: DataFrame, path: str, *, fmt: str = "parquet", run_id: str | None = None) -> str:
    """Publish a table: write beside the target, move the old one away, move the new one in, drop the old one.

    A failed write leaves the old table as it was and the draft beside it. Between the two renames there is no table
    for a moment; where that matters, publish versions (see snapshots.py). Returns the path.
    """
    spark = df.sparkSession
    run_id = run_id or uuid.uuid4().hex
    path = path.rstrip("/")
    draft, old = f"{path}__staging/{run_id}", f"{path}__old/{run_id}"
    w = df.write.mode("error")
    if fmt == "csv":
        w.options(**_CSV, timestampNTZFormat=_NTZ).csv(draft)
    else:
        w.format(fmt).save(draft)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had:
        fs.mkdirs(at(old).getParent())
        if not fs.rename(at(path), at(old)):
            raise OSError(f"cannot move {path} away; the new table is at {draft}")
    if not fs.rename(at(draft), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"cannot move the new table to {path}; it is at {draft}")
    if had:
        fs.delete(at(old), True)
    # the folders of drafts and old tables go once they are empty; other runs' drafts stay
    for folder in (at(draft).getParent(), at(old).getParent()):
        if fs.exists(folder) and not len(fs.listStatus(folder)):
            fs.delete(folder, False)
    return path


def verify_gold(spark: SparkSession, path: str, expected: dict[str, float], target: str, *, fmt: str = "parquet") -> DataFrame:
    """(check, expected, actual, ok) of a written table, see verify."""
    df = spark.read.options(**_CSV, multiLine=True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return verify(df, expected, target)


def verify(df: DataFrame, expected: dict[str, float], target: str) -> DataFrame:
    """(check, expected, actual, ok): rows, columns, missing_values_total, positive_rows as far as expected names them."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), missing.alias("missing_values_total"),
                 F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).alias("positive_rows"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(float(v)).alias("expected"), F.col(k).cast("double").alias("actual"),
                                                  (F.col(k).cast("double") == float(v)).alias("ok")) for k, v in expected.items()])))
