"""Table contracts: checks that count violations in one pass and fail closed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names that identify a person or an encounter directly.
DIRECT_IDENTIFIERS = (
    "subject_id", "hadm_id", "patient_id", "encounter_id", "hospital_id", "mrn",
    "name", "address", "phone", "email", "date_of_birth", "dob",
)


class ContractError(ValueError):
    """A table does not keep its contract."""


def schema_problems(df: DataFrame, schema: T.StructType, exact: bool = True) -> list[str]:
    """Differences between a table and its declared schema."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    out = [f"missing column {c}" for c in want if c not in have]
    out += [
        f"column {c} is {have[c].simpleString()}, not {want[c].simpleString()}"
        for c in want
        if c in have and have[c] != want[c]
    ]
    if exact:
        out += [f"unexpected column {c}" for c in have if c not in want]
    return out


def require_schema(df: DataFrame, schema: T.StructType, exact: bool = True) -> DataFrame:
    problems = schema_problems(df, schema, exact)
    if problems:
        raise ContractError("; ".join(problems))
    return df


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Stop the job where one of the columns is null.

    For keys of joins and groups: a null key would meet no partner, and its
    rows would silently go missing.  Label missing levels first.
    """
    guard = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} must not be null"))).otherwise(F.col(c))
    return df.withColumns({c: guard(c) for c in dict.fromkeys(columns)})


def require_no_columns(df: DataFrame, forbidden: Sequence[str] = DIRECT_IDENTIFIERS, tokens: Sequence[str] = ()) -> DataFrame:
    """No forbidden column, and none whose name contains a forbidden token."""
    bad = [
        c
        for c in df.columns
        if c.strip().lower() in forbidden or any(t in c.strip().lower() for t in tokens)
    ]
    if bad:
        raise ContractError(f"restricted columns: {bad}")
    return df


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Number of rows breaking each rule, in one aggregate; null breaks a rule."""
    broken = lambda rule: F.count_if(~F.coalesce(rule, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[broken(r).alias(name) for name, r in rules.items()])


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    found = violations(df, rules).first().asDict()
    n = found.pop("n_rows")
    bad = {name: count for name, count in found.items() if count}
    if not n or bad:
        raise ContractError("empty table" if not n else f"rows breaking the contract: {bad}")
    return df


def require_partition(df: DataFrame, year: str, years: Sequence[int], partition: str, label: str, key: str) -> DataFrame:
    """Every row lies in the allowed years and partition; keys are present and unique."""
    require(
        df,
        {
            "year": F.col(year).isin(list(years)),
            "partition": F.col(partition) == label,
            "key": F.col(key).isNotNull(),
        },
    )
    if key_repeats(df, key).first()["duplicates"]:
        raise ContractError(f"{key} repeats")
    return df


def key_repeats(df: DataFrame, *key: str) -> DataFrame:
    """Rows, distinct keys and their difference."""
    n, distinct = F.count(F.lit(1)), F.countDistinct(*key)
    return df.agg(n.alias("n_rows"), distinct.alias("n_keys"), (n - distinct).alias("duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def is_binary(c: Column, allow_null: bool = False) -> Column:
    ok = c.isNotNull() & c.cast("int").isin(0, 1)
    return ok | c.isNull() if allow_null else ok


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def is_probability(c: Column) -> Column:
    return is_finite(c) & (c >= 0) & (c <= 1)


def set_rules(mask: str, size: str | None = None, abstain: str | None = None, classes: int = 5) -> dict[str, Column]:
    """Rules for a class-set mask with its size and abstention columns."""
    m = F.col(mask)
    bits = F.bit_count(m)
    rules = {f"{mask}_range": (m >= 0) & (m < (1 << classes))}
    if size:
        rules[f"{size}_is_bit_count"] = F.col(size) == bits
    if abstain:
        rules[f"{abstain}_covers_non_singletons"] = (bits == 1) | F.col(abstain).cast("boolean")
    return rules


def hierarchy_rules(parent: str, leaf: str, causes: Sequence[str]) -> dict[str, Column]:
    """Parent = leaf above 0, causes exclusive and equal to their leaf number."""
    total = sum((F.col(c).cast("int") for c in causes), F.lit(0))
    return {
        "leaf_range": F.col(leaf).between(0, 4),
        "parent_is_leaf": F.col(parent).cast("int") == (F.col(leaf) > 0).cast("int"),
        "causes_exclusive": total <= 1,
        "causes_match_leaf": total == F.col(leaf).between(1, len(causes)).cast("int"),
    }


def observed_count(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while another action runs; read it from the observation later."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def require_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.count(), after.count()
    if a != b:
        raise ContractError(f"{a} rows went in, {b} came out")
    return after


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content sum.

    Each row is hashed with md5 over its columns as text; the leading 15 hex
    digits are added up as decimals, so the sum cannot overflow.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\u0001", *parts)), 1, 15), 16, 10)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("content"),
    )
