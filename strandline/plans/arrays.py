"""Array columns: code counts, timing, model sequences, masked samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions.values import label_total
from strandline.operators.features import fit_levels, fit_numeric, one_hot, scaled
from strandline.plans.bindings import LINE_ORDER, class_scores, encoded, id_space, table
from strandline.plans.codes import hierarchy
from strandline.plans.linkage import episodes, histories
from strandline.plans.registry import cte, query, rnd, sql
from strandline.session import materialise

LIMIT = 128  # entries of a visit sequence
SINGLE_LIMIT, SINGLE_FIRST = 128, 64
# ids of the second vocabulary move behind the first one, and their sum is the range of ids
SHIFT = "(SELECT coalesce(max(id), 3) - 3 FROM vocab WHERE side = 'dx')::INT"
ID_RANGE = f"({SHIFT} + (SELECT coalesce(max(id), 3) + 1 FROM vocab WHERE side = 'pr'))::INT"

_BUCKET = """CASE WHEN d IS NULL OR d <= -90 OR d = -66 THEN 0 WHEN d < 0 THEN 1 WHEN d > greatest(stay, 0) THEN 6 WHEN d = 0 THEN 2
 WHEN d <= 2 THEN 3 WHEN d <= 7 THEN 4 ELSE 5 END"""

cte(
    "pairs",
    f"""SELECT *, {_BUCKET} AS bucket, (d IS NOT NULL AND d > -90 AND d <> -66 AND d <= 0) AS early FROM (
  SELECT enc_id, stay, unnest(range(0, len(pr_ids))) AS pos, unnest(pr_ids) AS id, unnest(prday) AS d FROM encoded)""",
    "encoded",
)


@query(
    "id_counts",
    sql(
        """SELECT enc_id, len(list_filter(dx_ids, lambda x: x > 3))::INT AS dx_known, len(list_filter(pr_ids, lambda x: x > 3))::INT AS pr_known,
  len(list_filter(dx_ids, lambda x: x = 2))::INT AS dx_unseen, len(list_filter(pr_ids, lambda x: x = 2))::INT AS pr_unseen,
  list_filter(dx_ids, lambda x: x > 3) AS dx_real FROM encoded""",
        "encoded",
    ),
)
def id_counts(spark, sf_dir):
    dx, pr = F.col("dx_ids"), F.col("pr_ids")
    return encoded(spark, sf_dir).select(
        "enc_id",
        A.count_real(dx).alias("dx_known"),
        A.count_real(pr).alias("pr_known"),
        A.count_unseen(dx).alias("dx_unseen"),
        A.count_unseen(pr).alias("pr_unseen"),
        A.real_ids(dx).alias("dx_real"),
    )


@query(
    "position_columns_to_array",
    """WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
SELECT l_orderkey, list_resize(list(l_partkey ORDER BY pos), (SELECT max(pos) FROM n)) AS parts FROM n GROUP BY 1""",
)
def position_columns_to_array(spark, sf_dir):
    """A wide table with one column per position, of as many positions as any order has, back to arrays."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(order).alias("pos"))
    lines = materialise(lines, "positions")
    positions = range(1, (lines.agg(F.max("pos")).first()[0] or 0) + 1)
    wide = lines.groupBy("l_orderkey").pivot("pos", list(positions)).agg(F.max("l_partkey"))
    return wide.select("l_orderkey", F.array(*[F.col(str(k)) for k in positions]).alias("parts"))


TIMING = ("before_count", "day0_count", "day1_2_count", "day3plus_count", "missing_count", "after_end_count")


@query(
    "timing_counts",
    sql(
        """SELECT e.enc_id, count(*) FILTER (WHERE bucket = 1)::INT AS before_count, count(*) FILTER (WHERE bucket = 2)::INT AS day0_count,
  count(*) FILTER (WHERE bucket = 3)::INT AS day1_2_count, count(*) FILTER (WHERE bucket IN (4, 5))::INT AS day3plus_count,
  count(*) FILTER (WHERE bucket = 0)::INT AS missing_count, count(*) FILTER (WHERE bucket = 6)::INT AS after_end_count
FROM encoded e LEFT JOIN (SELECT * FROM pairs WHERE id > 3) p USING (enc_id) GROUP BY 1""",
        "pairs",
    ),
)
def timing_counts(spark, sf_dir):
    counts = A.timing_counts(F.col("pr_ids"), F.col("prday"), F.col("stay"))
    return encoded(spark, sf_dir).select("enc_id", *[counts[c].alias(c) for c in TIMING])


# sequences ------------------------------------------------------------------------

cte(
    "seq_all",
    f"""SELECT enc_id, 0 AS visit, 0 AS kind, pos, id, 0 AS bucket FROM
  (SELECT enc_id, unnest(range(0, len(dx_ids))) AS pos, unnest(dx_ids) AS id FROM encoded) WHERE id > 3
UNION ALL SELECT enc_id, 0, 1, pos, id + {SHIFT}, bucket FROM pairs WHERE id > 3
UNION ALL SELECT enc_id, 1, 0, pos, id, 0 FROM (SELECT enc_id, unnest(range(0, len(prior_dx_ids_180d))) AS pos, unnest(prior_dx_ids_180d) AS id FROM hist)
UNION ALL SELECT enc_id, 1, 1, pos, id + {SHIFT}, 0 FROM (SELECT enc_id, unnest(range(0, len(prior_pr_ids_180d))) AS pos, unnest(prior_pr_ids_180d) AS id FROM hist)""",
    "pairs",
    "hist",
    "vocab",
)
cte(
    "seq_cut",
    f"""SELECT s.*, row_number() OVER (PARTITION BY s.enc_id, s.visit ORDER BY s.kind, s.pos) AS r,
  least(n.n_now, {LIMIT} - (n.n_prior > 0)::INT) AS room
FROM seq_all s JOIN (SELECT enc_id, count(*) FILTER (WHERE visit = 0) AS n_now, count(*) FILTER (WHERE visit = 1) AS n_prior
                     FROM seq_all GROUP BY 1) n USING (enc_id)""",
    "seq_all",
)


@query(
    "visit_sequences",
    sql(
        f"""SELECT h.enc_id, coalesce(x.token_ids, [3]) AS token_ids, coalesce(x.kinds, [0]) AS kinds,
  coalesce(x.times, [0]) AS times, coalesce(x.visits, [0]) AS visits
FROM hist h LEFT JOIN (SELECT enc_id, list(id ORDER BY visit, kind, pos) AS token_ids, list(kind ORDER BY visit, kind, pos) AS kinds,
   list(bucket ORDER BY visit, kind, pos) AS times, list(visit ORDER BY visit, kind, pos) AS visits
   FROM seq_cut WHERE (visit = 0 AND r <= room) OR (visit = 1 AND r <= {LIMIT} - room) GROUP BY 1) x USING (enc_id)""",
        "seq_cut",
    ),
)
def visit_sequences(spark, sf_dir):
    rows = histories(spark, sf_dir).select("enc_id", "prior_dx_ids_180d", "prior_pr_ids_180d").join(
        encoded(spark, sf_dir).select("enc_id", "dx_ids", "pr_ids", "prday", "stay"), "enc_id"
    )
    sequence = A.visit_sequence(
        F.col("dx_ids"), F.col("pr_ids"), F.col("prday"), F.col("stay"),
        F.col("prior_dx_ids_180d"), F.col("prior_pr_ids_180d"), id_space(spark, sf_dir)[0], LIMIT,
    )
    built = rows.select("enc_id", sequence.alias("s"))
    return built.select(
        "enc_id",
        A.field(F.col("s"), "id").alias("token_ids"),
        A.field(F.col("s"), "kind").alias("kinds"),
        A.field(F.col("s"), "time").alias("times"),
        A.field(F.col("s"), "visit").alias("visits"),
    )


cte(
    "single_seq",
    f"""SELECT e.enc_id, CASE WHEN len(ids) = 0 THEN [3] ELSE ids[1:{SINGLE_LIMIT}] END AS token_ids,
  CASE WHEN len(ids) = 0 THEN [false] ELSE early[1:{SINGLE_LIMIT}] END AS early FROM (SELECT e.enc_id,
  list_filter(e.dx_ids, lambda x: x > 3)[1:{SINGLE_FIRST}] || coalesce(p.ids, []::INT[]) AS ids,
  list_transform(list_filter(e.dx_ids, lambda x: x > 3)[1:{SINGLE_FIRST}], lambda x: false) || coalesce(p.early, []::BOOLEAN[]) AS early
  FROM encoded e LEFT JOIN (SELECT enc_id, list(id + {SHIFT} ORDER BY pos) AS ids, list(early ORDER BY pos) AS early FROM pairs WHERE id > 3 GROUP BY 1) p USING (enc_id)) e""",
    "pairs",
    "vocab",
)


def single_sequences(shift):
    columns = [F.col(c) for c in ("dx_ids", "pr_ids", "prday", "stay")]
    return A.single_visit_sequence(*columns, shift, SINGLE_LIMIT, first_limit=SINGLE_FIRST)


@query(
    "training_frame",
    sql(
        """SELECT s.enc_id, s.token_ids, s.early, (e.year - 1995)::INT AS slot,
  round((e.age - m.mu) / m.sd, 6) + 0.0 AS age_scaled,
  list_transform(['0', '1', '__MISSING__', '__OOV__'], lambda l: (l = e.female::VARCHAR)::INT::DOUBLE) AS sex_hot,
  (coalesce(e.charge, 0) > 250000)::INT AS high_cost, (e.charge > 0) AS high_cost_known, (e.stay > 5)::INT AS long_stay,
  (e.died = 1)::INT AS death
FROM single_seq s JOIN encoded e USING (enc_id),
  (SELECT avg(age) AS mu, stddev_pop(age) AS sd FROM encoded WHERE year <= 1998) m""",
        "single_seq",
        "encoded",
    ),
)
def training_frame(spark, sf_dir):
    """Token sequence, auxiliary labels with masks, and static inputs of every encounter."""
    enc = encoded(spark, sf_dir)
    development = enc.where("year <= 1998")
    age = fit_numeric(development, ["age"])["age"]
    sexes = fit_levels(development, ["female"])["female"]
    built = enc.withColumn("s", single_sequences(id_space(spark, sf_dir)[0]))
    return built.select(
        "enc_id",
        A.field(F.col("s"), "id").alias("token_ids"),
        A.field(F.col("s"), "early").alias("early"),
        (F.col("year") - 1995).alias("slot"),
        rnd(scaled(age, "mean")[0]).alias("age_scaled"),
        one_hot("female", sexes).alias("sex_hot"),
        label_total(F.col("charge") > 250000).alias("high_cost"),
        (F.col("charge") > 0).alias("high_cost_known"),
        label_total(F.col("stay") > 5).alias("long_stay"),
        label_total(F.col("died") == 1).alias("death"),
    )


MASK_SEED = 11
_U = lambda use: f"('0x' || substr(md5('{MASK_SEED}:' || enc_id || ':' || pos || ':{use}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
cte(
    "mask_rows",
    f"""SELECT *, {_U('pick')} AS u, {_U('how')} AS how,
  (4 + ('0x' || substr(md5('{MASK_SEED}:' || enc_id || ':' || pos || ':id'), 1, 12))::BIGINT % ({ID_RANGE} - 4))::INT AS other
FROM (SELECT enc_id, unnest(range(0, len(token_ids))) AS pos, unnest(token_ids) AS id FROM single_seq)""",
    "single_seq",
)


@query(
    "masked_token_sample",
    sql(
        """SELECT enc_id, list(CASE WHEN NOT picked THEN id WHEN how < 0.8 THEN 1 WHEN how < 0.9 THEN other ELSE id END ORDER BY pos) AS inputs,
  list(CASE WHEN picked THEN id END ORDER BY pos) AS labels FROM (
  SELECT m.*, m.id > 3 AND (m.u < 0.15 OR (l.lowest_u >= 0.15 AND m.pos = l.lowest_pos)) IS TRUE AS picked
  FROM mask_rows m LEFT JOIN (SELECT enc_id, min(u) AS lowest_u, arg_min(pos, {'u': u, 'p': pos}) AS lowest_pos FROM mask_rows WHERE id > 3 GROUP BY 1) l USING (enc_id))
GROUP BY 1""",
        "mask_rows",
    ),
)
def masked_token_sample(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    shift, size = id_space(spark, sf_dir)
    rows = enc.select("enc_id", A.field(single_sequences(shift), "id").alias("ids"))
    sample = A.masked_sample(F.col("enc_id"), F.col("ids"), MASK_SEED, size)
    built = rows.select("enc_id", sample.alias("s"))
    return built.select(
        "enc_id", A.field(F.col("s"), "input").alias("inputs"), A.field(F.col("s"), "label").alias("labels")
    )


@query(
    "unified_category_ids",
    sql(
        """SELECT h.code, h.category_id, (h.category_id + 50)::INT AS shifted FROM hier h WHERE h.category_id > 0""",
        "hier",
    ),
)
def unified_category_ids(spark, sf_dir):
    """Category ids of a second hierarchy moved behind the first one."""
    rows = hierarchy(spark, sf_dir).where("category_id > 0")
    return rows.select("code", "category_id", (F.col("category_id") + 50).alias("shifted"))


@query(
    "map_lookup",
    sql(
        """SELECT vec_id, CASE WHEN sex = '0' THEN s0 ELSE s1 END AS by_sex, s0 > 0.2 AS abstain FROM classes""",
        "classes",
    ),
)
def map_lookup(spark, sf_dir):
    """A nested map of levels and dimensions, read by key."""


    entry = lambda s: F.struct(s.alias("score"), (F.col("s0") > 0.2).alias("abstain"))
    nested = F.create_map(
        F.lit("90"), F.create_map(F.lit("0"), entry(F.col("s0")), F.lit("1"), entry(F.col("s1")))
    )
    rows = class_scores(spark, sf_dir).withColumn("conformal", nested)
    found = F.col("conformal")["90"][F.col("sex")]
    return rows.select("vec_id", found["score"].alias("by_sex"), found["abstain"].alias("abstain"))


@query(
    "post_event_attributes",
    sql("SELECT enc_id, follow_up_any_1, follow_up_any_2, follow_up_any_3 FROM eps WHERE any_follow_up", "eps"),
)
def post_event_attributes(spark, sf_dir):
    columns = [f"follow_up_any_{k}" for k in (1, 2, 3)]
    return episodes(spark, sf_dir).where("any_follow_up").select("enc_id", *columns)
