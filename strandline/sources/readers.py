"""Readers with declared schemas.  Nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import decode_nulls
from strandline.layout import NULL_TOKENS
from strandline.operators.skew import lookup_join


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, keep: Sequence[str] | None = None, header: bool = False, quote: str = '"') -> DataFrame:
    """Delimited text with a given layout; a malformed row stops the read.

    Empty strings, quoted or not, are null.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("emptyValue", None).option("nullValue", "")
    df = reader.csv(path, header=header, quote=quote, enforceSchema=not header)
    empty = lambda f: F.when(F.col(f.name) != "", F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.col(f.name)
    return df.select(*[empty(f).alias(f.name) for f in schema if keep is None or f.name in keep])


def read_with_null_tokens(spark: SparkSession, path: str, schema: T.StructType, tokens: Sequence[str] = NULL_TOKENS, header: bool = True, quote: str = '"') -> DataFrame:
    """Every listed spelling of missing becomes null before the cast to the declared type."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = read_delimited(spark, path, as_text, header=header, quote=quote)
    return raw.select(
        *[decode_nulls(F.trim(F.col(f.name)), tuple(tokens)).cast(f.dataType).alias(f.name) for f in schema]
    )


def read_all_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header text files, also compressed, with every column as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_delimited(spark, path, schema, header=True)


def repair_ragged(lines: DataFrame, columns: Sequence[str], line: str = "value") -> DataFrame:
    """Split lines into columns; surplus fields go back into the last one.

    A line with too few fields stops the job.
    """
    n = len(columns)
    parts = F.split(F.col(line), ",")
    checked = F.when(F.size(parts) < n, F.raise_error(F.concat(F.lit("short row: "), F.col(line))).cast("array<string>")).otherwise(parts)
    split = lines.select(checked.alias("_p"))
    last = F.concat_ws(",", F.slice("_p", F.lit(n), F.size("_p")))
    return split.select(*[F.col("_p")[i].alias(c) for i, c in enumerate(columns[:-1])], last.alias(columns[-1]))


def read_ragged(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return repair_ragged(spark.read.text(path), columns)


def read_json_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pretty-printed JSON objects one after the other, not one per line.

    An object ends with a closing brace at the start of a line, so the file can
    still be split between tasks.  Anything that is no object stops the job.
    """
    raw = spark.read.option("lineSep", "\n}\n").text(path).where(F.trim("value") != "")
    value = F.col("value")
    # the separator takes the closing brace away, except at an unfinished last line
    closed = F.when(value.rlike(r"\n\}\s*$"), value).otherwise(F.concat(value, F.lit("\n}")))
    checked = F.when(value.rlike(r"^\s*\{"), closed).otherwise(
        F.raise_error(F.lit("not a JSON object")).cast("string")
    )
    return raw.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_years(spark: SparkSession, path: str, years: Sequence[int], columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Year-partitioned table: only the named years, columns and rows are read."""
    df = spark.read.parquet(path).where(F.col("year").isin(list(years)))
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_related(admissions: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of the listed entities; an empty list is an error."""
    wanted = keys.select(*on).distinct()
    if wanted.isEmpty():
        raise ValueError("no entity to read rows for")
    return lookup_join(admissions, wanted, list(on), "left_semi")


def read_first(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, for a smoke run."""
    return df.limit(rows)


def union_years(*parts: DataFrame) -> DataFrame:
    """Tables of several years, matched by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
