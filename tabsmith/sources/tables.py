"""Reading tables: csv, json and parquet, with one notion of a missing value."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import ref

# Texts that pandas reads as missing in a csv file.
NA_TEXTS = (
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SUFFIXES = (".csv", ".json", ".parquet")


def strip_names(df: DataFrame) -> DataFrame:
    """Trim white space around column names."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after trimming: {sorted(n for n in names if names.count(n) > 1)}")
    return df if names == df.columns else df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: NaN in float columns becomes NULL."""
    out = []
    for f in df.schema:
        c = ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def clean_table(df: DataFrame) -> DataFrame:
    return nan_to_null(strip_names(df))


def _na_texts_to_null(df: DataFrame) -> DataFrame:
    na = [t for t in NA_TEXTS if t.strip()]
    return df.select(*[
        F.when(~ref(f.name).isin(na) & (F.trim(ref(f.name)) != ""), ref(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else ref(f.name)
        for f in df.schema
    ])


def _typed(df: DataFrame) -> DataFrame:
    """Types of all-string columns: whole numbers, then numbers, then booleans, else text.

    One aggregate decides for every column, after missing texts are gone; dates stay text,
    and column roles recognise them later.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(ref(c))
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count(F.when(v.rlike(r"^[+-]?\d{1,18}$"), 1)).alias(f"i{i}"),
                 F.count(v.try_cast("double")).alias(f"d{i}"),
                 F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n, v = r[f"n{i}"], F.trim(ref(c))
        if n and r[f"i{i}"] == n:
            out.append(v.cast("long").alias(c))
        elif n and r[f"d{i}"] == n:
            out.append(v.cast("double").alias(c))
        elif n and r[f"b{i}"] == n:
            out.append(v.cast("boolean").alias(c))
        else:
            out.append(ref(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """csv with a header.  Give ``schema`` for big files: inferring types costs one scan."""
    reader = spark.read.option("header", True).option("multiLine", False).option("escape", '"')
    if schema is not None:
        return clean_table(reader.schema(schema).option("nullValue", "").csv(path))
    return clean_table(_typed(_na_texts_to_null(strip_names(reader.csv(path)))))


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """json lines, or files that each hold one array of records (``multi_line``).

    Without ``multi_line`` the first character of the data decides.
    """
    if multi_line is None:
        head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        multi_line = bool(head) and head[0][0].lstrip().startswith("[")
    return clean_table(spark.read.option("multiLine", multi_line).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_table(spark.read.parquet(path))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a table by its file suffix."""
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, str(path))
    if suffix == ".json":
        return read_json(spark, str(path))
    if suffix == ".parquet":
        return read_parquet(spark, str(path))
    raise ValueError(f"Unsupported file type {suffix!r}; supported: {', '.join(SUFFIXES)}")


def resolve_target(df: DataFrame, target: str) -> str:
    """The target's actual column name: exact, else ignoring case."""
    target = target.strip()
    if target in df.columns:
        return target
    same = [c for c in df.columns if c.lower() == target.lower()]
    if same:
        return same[0]
    raise ValueError(f"target column {target!r} not found; columns: {df.columns}")


def drop_null_target(df: DataFrame, target: str, datetime_col: str | None = None) -> DataFrame:
    """Rows with a target, without the datetime column that only marks a time series."""
    out = df.where(ref(target).isNotNull())
    if datetime_col and datetime_col in out.columns and datetime_col != target:
        out = out.drop(datetime_col)
    return out


def require_columns(df: DataFrame, needed) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns: {missing}")
