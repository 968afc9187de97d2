"""Vocabularies, code sets, code maps and event flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import normalize_code
from strandline.functions.values import ratio
from strandline.layout import EMPTY_ID, FIRST_CODE_ID, UNSEEN_ID
from strandline.operators.ordering import dense_index
from strandline.operators.skew import BROADCAST_ROWS, keyed_join, lookup_join
from strandline.session import materialise


# vocabulary ---------------------------------------------------------------

def code_rows(df: DataFrame, key: Sequence[str], codes: str) -> DataFrame:
    """One row per array position: key, pos, normalised code ('' when missing)."""
    exploded = df.select(*key, F.posexplode(codes).alias("pos", "code"))
    return exploded.withColumn("code", normalize_code(F.col("code")))


def fit_vocabulary(rows: DataFrame, year: str, training_years: Sequence[int]) -> DataFrame:
    """Ids from 4 on for every code of the training years.

    Order: year of first use, then the code text.  That does not depend on how
    the input is partitioned.  Columns: code, first_year, n, id.
    """
    seen = (
        rows.where(F.col(year).isin(list(training_years)) & (F.col("code") != ""))
        .groupBy("code")
        .agg(F.min(year).alias("first_year"), F.count(F.lit(1)).alias("n"))
        .withColumn("_lead", F.substring("code", 1, 2))
    )
    # numbering reads its rows twice
    numbered = dense_index(materialise(seen, "codes-seen"), [], ["first_year", "_lead"], ["code"])
    return numbered.select("code", "first_year", "n", (F.col("index") + FIRST_CODE_ID).cast("int").alias("id"))


def encode_rows(rows: DataFrame, vocabulary: DataFrame, unseen: int = UNSEEN_ID) -> DataFrame:
    """Add ``id``: 3 for an empty code, ``unseen`` for one outside the vocabulary."""
    known = lookup_join(rows, vocabulary.select("code", F.col("id").alias("_id")), ["code"], "left")
    return known.withColumn(
        "id", F.when(F.col("code") == "", EMPTY_ID).otherwise(F.coalesce("_id", F.lit(unseen)))
    ).drop("_id")


def _id_lookup(vocabulary: DataFrame, rows: int, unseen: int = UNSEEN_ID):
    """Function from arrays of normalised codes to arrays of ids, or None for a vocabulary above ``rows`` codes.

    A vocabulary is part of the model; it goes to the tasks with the function.
    """
    known = vocabulary.select("code", "id").limit(rows + 1).toPandas()
    if len(known) > rows or known["code"].duplicated().any() or known.isna().any(axis=None):
        return None
    codes, ids = pa.array(known["code"], pa.string()), pa.array(known["id"], pa.int32())

    @F.arrow_udf("array<int>")
    def found(arrays: pa.Array) -> pa.Array:
        # a slice of a batch may begin after the first value; flattened values count from its first offset
        values = arrays.flatten().cast(pa.string())
        offsets = pc.subtract(arrays.offsets, arrays.offsets[0]).cast(pa.int32())
        known_ids = pc.fill_null(pc.take(ids, pc.index_in(values, value_set=codes)), unseen)
        return pa.ListArray.from_arrays(offsets, pc.if_else(pc.equal(values, ""), pa.scalar(EMPTY_ID, pa.int32()), known_ids))

    return found


def encode_arrays(df: DataFrame, key: str, columns: Mapping[str, tuple[DataFrame, str]], keep: bool = True, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Code arrays to id arrays, position by position.

    ``columns`` maps an array column to its vocabulary and the name of the ids.
    Arrays are encoded where they are when no vocabulary has more than ``rows`` codes
    and no key is missing or repeated.  Else all arrays of a row are taken apart
    together, so their rows move once to be grouped again and once to meet the table.
    Without ``keep`` the code arrays are left out of the result, and only their
    lengths go into that join.
    """
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        lookups = {c: _id_lookup(vocabulary, rows) for c, (vocabulary, _) in columns.items()}
        if all(lookups.values()):
            clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_code)
            # beside an array that is missing, the codes of another have no ids
            alone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
            ids = {out: F.when(F.col(c).isNull() | ~alone | (F.size(c) == 0), lookups[c](clean(c))) for c, (_, out) in columns.items()}
            found = df.withColumns(ids)
            return found if keep else found.drop(*columns)
    rows = df.select(key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_z"))
    for column, (vocabulary, out) in columns.items():
        rows = rows.withColumn("code", normalize_code(F.col("_z")[column]))
        rows = encode_rows(rows, vocabulary).withColumnRenamed("id", out).drop("code")
    outs = [out for _, out in columns.values()]
    arrays = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *outs))).alias("_a"))
    sizes = {c: f"_size_{c}" for c in columns}
    sized = df.withColumns({size: F.size(c) for c, size in sizes.items()})
    joined = keyed_join(sized if keep else sized.drop(*columns), arrays, [key], "left")
    empty = F.array().cast("array<int>")
    # a shorter array was filled up beside a longer one
    ids = {out: F.when(F.col(sizes[c]) > 0, F.slice(F.col("_a")[out], F.lit(1), F.col(sizes[c]))).otherwise(empty) for c, (_, out) in columns.items()}
    return joined.withColumns(ids).drop("_a", *sizes.values())


def encode_array(df: DataFrame, key: str, codes: str, vocabulary: DataFrame, out: str) -> DataFrame:
    return encode_arrays(df, key, {codes: (vocabulary, out)})


def unseen_audit(encoded: DataFrame) -> DataFrame:
    """How often each code outside the vocabulary occurs."""
    return encoded.where(F.col("id") == UNSEEN_ID).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_faults(vocabulary: DataFrame) -> DataFrame:
    """One row of counts that are all zero for a sound vocabulary."""
    n = F.count(F.lit(1))
    return vocabulary.agg(
        (n - F.countDistinct("id")).alias("repeated_ids"),
        (n - F.countDistinct(normalize_code(F.col("code")))).alias("repeated_codes"),
        F.count_if(F.col("id") < FIRST_CODE_ID).alias("reserved_ids_used"),
        (F.max("id") - F.lit(FIRST_CODE_ID - 1) - n).alias("gaps"),
    )


def frequent_codes(df: DataFrame, ids: str, minimum: int) -> DataFrame:
    """Real ids that occur in at least ``minimum`` rows, numbered by id."""
    counts = (
        df.select(F.explode(F.array_distinct(ids)).alias("id"))
        .where(F.col("id") > EMPTY_ID)
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= minimum)
        .withColumn("_block", F.floor(F.col("id") / 4096))
    )
    return dense_index(counts, [], ["_block"], ["id"], "column").drop("_block")


def code_set_ids(code_sets: DataFrame, vocabulary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group of a code list: the ids of its codes, and how many had none.

    A list is a reference table of one year and one purpose, not data.
    """
    listed = code_sets.select(*groups, normalize_code(F.col("code")).alias("code")).distinct()
    return (
        lookup_join(listed, vocabulary.select("code", "id"), ["code"], "left")
        .groupBy(*groups)
        .agg(
            F.sort_array(F.collect_list("id")).alias("ids"),
            F.count(F.lit(1)).alias("source_codes"),
            F.count("id").alias("known_codes"),
        )
    )


# code maps ----------------------------------------------------------------

def inconsistent_codes(mapping: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Codes mapped to more than one category; must be empty."""
    return mapping.groupBy(*keys).agg(F.countDistinct(value).alias("categories")).where(F.col("categories") > 1)


def code_map(mapping: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact duplicates dropped; a code with two categories is an error."""
    clash = inconsistent_codes(mapping, keys, value).limit(1).collect()
    if clash:
        raise ValueError(f"code maps to more than one category: {clash[0].asDict()}")
    return mapping.groupBy(*keys).agg(F.min(value).alias(value))


def encode_hierarchy(vocabulary: DataFrame, mapping: DataFrame) -> DataFrame:
    """Category and domain ids per code; 0 stands for unmapped.

    ``mapping`` has code, category, domain.  Ids count from 1 in text order.
    """
    pairs = vocabulary.select("code", "id").join(mapping.select("code", "category", "domain"), "code", "left")

    def numbered(name: str) -> DataFrame:
        levels = pairs.where(F.col(name).isNotNull()).select(name).distinct()
        cut = levels.withColumn("_lead", F.substring(name, 1, 1))
        return dense_index(cut, [], ["_lead"], [name]).select(
            name, (F.col("index") + 1).cast("int").alias(f"{name}_id")
        )

    out = pairs
    for name in ("category", "domain"):
        out = lookup_join(out, numbered(name), [name], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("code", "id", "category", "domain", zero("category_id"), zero("domain_id"))


def hierarchy_coverage(encoded: DataFrame, minimum: float = 0.95) -> DataFrame:
    mapped = F.count_if(F.col("category_id") > 0)
    share = ratio(mapped, F.count(F.lit(1)))
    return encoded.agg(
        F.count(F.lit(1)).alias("codes"),
        mapped.alias("mapped"),
        share.alias("coverage"),
        F.when(share >= minimum, "PASS").otherwise("REVIEW").alias("status"),
    )


def expand_code_sets(specs: DataFrame, mapping: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Codes of active categories plus directly listed codes, if in the catalogue.

    specs: year, table, system, kind ('category' or 'code'), value, active.
    mapping: year, system, code, category.  catalogue: year, system, code.
    """
    active = specs.where("active")
    by_category = active.where(F.col("kind") == "category").withColumnRenamed("value", "category")
    expanded = by_category.join(mapping, ["year", "system", "category"]).select("year", "table", "system", "code")
    direct = active.where(F.col("kind") == "code").select("year", "table", "system", F.col("value").alias("code"))
    return (
        expanded.unionByName(direct).distinct().join(catalogue.distinct(), ["year", "system", "code"], "left_semi")
    )


def direct_codes_outside(specs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Directly listed active codes that the catalogue of their year lacks."""
    direct = specs.where(F.col("active") & (F.col("kind") == "code")).select(
        "year", "table", "system", F.col("value").alias("code")
    )
    return direct.join(catalogue.distinct(), ["year", "system", "code"], "left_anti")


def ontology_rows(catalogue: DataFrame, label: str, subtype: Column, priority: int) -> DataFrame:
    """One row per code: newest description and the years it is valid in."""
    return (
        catalogue.withColumn("subtype", subtype)
        .where(F.col("subtype").isNotNull())
        .groupBy("subtype", "code")
        .agg(
            F.max_by("description", "year").alias("description"),
            F.array_join(F.array_sort(F.collect_set("year")).cast("array<string>"), ";").alias("valid_years"),
        )
        .select(
            F.lit(label).alias("label"), "subtype", F.lit(priority).alias("priority"),
            "code", "description", "valid_years",
        )
    )


def unfounded_claims(codebook: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(system, year, code) claims of a code book that the catalogue lacks.

    ``years`` of the code book is text such as ``1995;1997``.
    """
    years = F.filter(F.split("years", ";"), lambda y: y != "").cast("array<int>")
    claims = codebook.select("system", "code", F.explode(years).alias("year"))
    return claims.join(catalogue.select("system", "code", "year"), ["system", "code", "year"], "left_anti")


# flags --------------------------------------------------------------------

def planned_columns(
    principal: Column,
    procedures: Column,
    sets: Mapping[str, Column],
    known_principal: Column,
    known_procedure,
) -> dict[str, Column]:
    """Planned-event rule: P1 or P2 or (P3 and not P4).

    ``sets`` holds array columns ``p1`` .. ``p4`` (p1 and p3 list procedures, p2
    and p4 principal codes).  The state is -1 when the principal code is empty
    or unmapped, or any procedure is unmapped.
    """
    real = F.filter(F.coalesce(procedures, F.array().cast("array<string>")), lambda c: c != "")
    p1, p3 = F.arrays_overlap(real, sets["p1"]), F.arrays_overlap(real, sets["p3"])
    p2, p4 = F.array_contains(sets["p2"], principal), F.array_contains(sets["p4"], principal)
    yes = lambda c: F.coalesce(c, F.lit(False))
    p1, p2, p3, p4 = yes(p1), yes(p2), yes(p3), yes(p4)
    unknown_principal = (F.coalesce(principal, F.lit("")) == "") | ~yes(known_principal)
    unknown_procedures = F.size(F.filter(real, lambda c: ~known_procedure(c)))
    unknown = unknown_principal | (unknown_procedures > 0)
    planned = p1 | p2 | (p3 & ~p4)
    return {
        "p1": p1,
        "p2": p2,
        "p3": p3,
        "p4": p4,
        "unknown_principal": unknown_principal,
        "unknown_procedures": unknown_procedures,
        "planned_unknown": unknown,
        "planned_status": F.when(unknown, -1).otherwise(planned.cast("int")),
    }


def cause_code(flags: Sequence[Column]) -> Column:
    """1-based number of the first flag that holds, else one more than their count."""
    out = F.lit(len(flags) + 1)
    for number, flag in reversed(list(enumerate(flags, 1))):
        out = F.when(flag, number).otherwise(out)
    return out


def consensus(states: DataFrame, keys: Sequence[str], state: str, years: int) -> DataFrame:
    """Stable state over all rule years, else unknown.

    ``states`` has one row per key and rule year with 1 planned, 0 unplanned,
    -1 unknown.
    """
    n = F.count(F.lit(1))
    every = lambda v: (n == years) & F.every(F.col(state) == v)
    return states.groupBy(*keys).agg(
        F.when(every(1), "stable_planned")
        .when(every(0), "stable_unplanned")
        .otherwise("algorithm_unknown")
        .alias("consensus")
    )
