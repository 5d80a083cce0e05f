"""Sample panel / clinical metadata (S3, S16) and person-level filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelo.functions.genotype import bmi, sentinel_double, sex_code


def _records(spark: SparkSession, path: str, header_lines: int, sep: str) -> DataFrame:
    """Delimited records as ``ARRAY<STRING>`` after dropping ``header_lines`` lines per file.

    One header line is handled by the parallel CSV reader; more than one is
    handled per file (``wholetext``), which is meant for metadata files only.
    """
    if header_lines <= 1:
        df = spark.read.option("sep", sep).option("header", header_lines == 1).option("quote", '"') \
            .option("inferSchema", False).csv(path)
        return df.select(F.array(*[F.col(f"`{c}`") for c in df.columns]).alias("f"))
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("ln", "line")) \
        .where((F.col("ln") >= header_lines) & (F.col("line") != ""))
    fields = F.transform(F.split("line", sep), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return lines.select(fields.alias("f"))


def read_panel(spark: SparkSession, path: str, header_lines: int = 1, sep: str = "\t",
               null_string: str = "NA", id_col: int = 0, pop_col: int = 1, weight_col: int = -1,
               height_col: int = -1, sex_col: int = -1, super_col: int | None = None,
               extra_cols: tuple[int, int, int, int] | None = None, ignore_case: bool = False) -> DataFrame:
    """S3: person metadata projected by column ordinal.

    Output ``individual, population, super_population, extra1..4, weight,
    height, bmi, sex``.  Missing weight/height (the null string) are 0, BMI 0
    when unknown, sex -1 when unknown.  ``super_col=None`` falls back to the
    population column explicitly (the original silently did so for ordinal 0).
    """
    f = F.col("f")
    rec = _records(spark, path, header_lines, sep)

    def at(i: int) -> Column:
        return f[i] if i is not None and i >= 0 else F.lit(None).cast("string")

    weight = sentinel_double(at(weight_col), null_string) if weight_col >= 0 else F.lit(0.0)
    height = sentinel_double(at(height_col), null_string) if height_col >= 0 else F.lit(0.0)
    extras = extra_cols or (pop_col, pop_col, pop_col, pop_col)
    sex = sex_code(at(sex_col), ignore_case) if sex_col >= 0 else F.lit(-1)
    out = rec.select(
        at(id_col).alias("individual"), at(pop_col).alias("population"),
        (at(super_col) if super_col is not None else at(pop_col)).alias("super_population"),
        *[at(e).alias(f"extra{i + 1}") for i, e in enumerate(extras)],
        weight.alias("weight"), height.alias("height"), sex.alias("sex"))
    return out.select("*", bmi("height", "weight").alias("bmi"))


def filter_groups(df: DataFrame, include=(), exclude=(), col: str = "population") -> DataFrame:
    """Include AND NOT exclude on population; empty or ``[""]`` lists mean no filter."""
    inc = [x for x in include] if include and list(include)[0] != "" else []
    exc = [x for x in exclude] if exclude and list(exclude)[0] != "" else []
    cond = F.lit(True)
    if inc:
        cond = cond & F.col(col).isin(inc)
    if exc:
        cond = cond & ~F.col(col).isin(exc)
    return df.where(cond)


def bmi_known(df: DataFrame) -> DataFrame:
    """People with BMI > 0."""
    return df.where(F.col("bmi") > 0)


def sex_known(df: DataFrame) -> DataFrame:
    """P10: people with a known sex code."""
    return df.where(F.col("sex") > -1)


def agree_filter(df: DataFrame, cols=("extra1", "extra2", "extra3", "extra4")) -> DataFrame:
    """Keep rows whose four extra columns agree."""
    a = F.col(cols[0])
    return df.where(F.col(cols[1]).eqNullSafe(a) & F.col(cols[2]).eqNullSafe(a) & F.col(cols[3]).eqNullSafe(a))


def barcode_split(df: DataFrame, key_col: str, keep_type: str = "NORMAL") -> DataFrame:
    """Key ``ID_TYPE`` -> id (first 12 chars) and sample type; keep one type."""
    parts = F.split(F.col(key_col), "_")
    out = df.select("*", F.substring(parts[0], 1, 12).alias("barcode_id"), parts[1].alias("sample_type"))
    return out.where(F.col("sample_type") == keep_type) if keep_type else out


def read_ped(spark: SparkSession, path: str, sample_col: int = 1, population_col: int = 6) -> DataFrame:
    """Pedigree TSV -> ``(sample, population)``."""
    df = spark.read.option("sep", "\t").option("header", False).csv(path)
    cols = df.columns
    return df.select(F.col(cols[sample_col]).alias("sample"), F.col(cols[population_col]).alias("population"))
