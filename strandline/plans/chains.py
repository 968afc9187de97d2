"""Chains of timestamp stays: collapse, eligibility, events, history and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.text import normalize_code, parse_timestamp
from strandline.layout import FIRST_CODE_ID
from strandline.operators import chains as C
from strandline.operators import metrics as M
from strandline.operators import resample as S
from strandline.operators.draws import draws_sql, plan_draws
from strandline.operators.history import with_stay_history
from strandline.operators.linkage import running_max
from strandline.operators.skew import lookup_join
from strandline.plans.bindings import stays, table
from strandline.plans.evaluation import metrics_sql, tidy
from strandline.plans.registry import cte, query, rnd, rounded, sql
from strandline.plans.stages import planned, staged
from strandline.session import materialise

# source rows, some of them unusable -----------------------------------------------------

cte(
    "raw_stays",
    """SELECT *, CASE WHEN stay_id % 211 = 0 THEN 'missing_ids' WHEN stay_id % 101 = 0 OR stay_id % 103 = 0 THEN 'invalid_or_missing_timestamps'
   WHEN stay_id % 97 = 0 AND end_ts > begin_ts THEN 'end_before_begin' END AS reason FROM stays""",
    "stays",
)


def raw_stays(spark, sf_dir):
    """Stays as text, with blank ids, unreadable times and ends before begins."""
    rows = stays(spark, sf_dir)
    key = F.col("stay_id")
    swap = F.pmod(key, F.lit(97)) == 0
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    begin = F.when(swap, F.col("end_ts")).otherwise(F.col("begin_ts"))
    end = F.when(swap, F.col("begin_ts")).otherwise(F.col("end_ts"))
    return rows.withColumns(
        {
            "subject_id": F.when(F.pmod(key, F.lit(211)) == 0, " ").otherwise(F.col("subject_id").cast("string")),
            "begin_ts": F.when(F.pmod(key, F.lit(101)) == 0, "soon").otherwise(as_text(begin)),
            "end_ts": F.when(F.pmod(key, F.lit(103)) == 0, F.lit(None).cast("string")).otherwise(as_text(end)),
        }
    )


@query(
    "row_validity_reasons",
    sql("SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM raw_stays GROUP BY 1", "raw_stays"),
)
def row_validity_reasons(spark, sf_dir):
    return C.reason_counts(C.parse_stays(raw_stays(spark, sf_dir)))


# chains ------------------------------------------------------------------------------------

cte(
    "ends",
    """SELECT *, max({'e': end_ts, 'k': stay_id, 'p': to_place}) OVER (PARTITION BY subject_id ORDER BY begin_ts, end_ts, stay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
FROM stays""",
    "stays",
)
cte(
    "opens",
    """SELECT *, (prev IS NULL OR NOT (begin_ts <= prev.e OR (begin_ts - prev.e <= INTERVAL 24 HOURS
   AND (from_place = ' acute  hospital' OR prev.p = 'Transfer to other hospital')))) AS opens FROM ends""",
    "ends",
)
cte(
    "islands",
    "SELECT *, sum(opens::INT) OVER (PARTITION BY subject_id ORDER BY begin_ts, end_ts, stay_id ROWS UNBOUNDED PRECEDING) AS island FROM opens",
    "opens",
)
cte(
    "linked",
    "SELECT *, first_value(stay_id) OVER (PARTITION BY subject_id, island ORDER BY begin_ts, end_ts, stay_id) AS chain_id FROM islands",
    "islands",
)
cte(
    "chains",
    "SELECT subject_id, chain_id, min(begin_ts) AS begin_ts, max(end_ts) AS end_ts, count(*) AS n_stays FROM linked GROUP BY 1, 2",
    "linked",
)


@staged
def linked(spark, sf_dir):
    return C.link_chains(stays(spark, sf_dir))


@query("chain_links", sql("SELECT stay_id, subject_id, chain_id FROM linked", "linked"))
def chain_links(spark, sf_dir):
    return linked(spark, sf_dir).select("stay_id", "subject_id", "chain_id")


@query("chain_table", sql("SELECT subject_id, chain_id, begin_ts, end_ts, n_stays FROM chains", "chains"))
def chain_table(spark, sf_dir):
    out = C.chain_table(linked(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin_ts", "end_ts")})


@query(
    "running_latest_end",
    sql("SELECT stay_id, prev.e AS latest_end, prev.k AS owner FROM ends", "ends"),
)
def running_latest_end(spark, sf_dir):
    rows = stays(spark, sf_dir).withColumn("_hour", F.date_trunc("hour", "begin_ts"))
    latest = F.struct(F.col("end_ts").alias("e"), F.col("stay_id").alias("k"))
    out = running_max(rows, ["subject_id"], "_hour", ["begin_ts", "end_ts", "stay_id"], latest, "prev")
    return out.select("stay_id", F.col("prev.e").cast("timestamp_ntz").alias("latest_end"), F.col("prev.k").alias("owner"))


# codes of the stays ----------------------------------------------------------------------------

cte(
    "stay_codes",
    """SELECT stay_id, 'C' || (k % 30) AS code, CASE WHEN k % 4 = 0 THEN '2' ELSE '1' END AS seq_num, '10' AS version, begin_ts + to_days((k % 5)::INT) AS at FROM stays
UNION ALL SELECT stay_id, 'C' || (k % 7), '2', CASE WHEN k % 3 = 0 THEN '9' ELSE '10' END, begin_ts + to_days((k % 2)::INT) FROM stays
UNION ALL SELECT stay_id, 'C' || (k % 7), '2', CASE WHEN k % 3 = 0 THEN '9' ELSE '10' END, begin_ts + to_days((k % 2)::INT) FROM stays WHERE k % 6 = 0""",
    "stays",
)


@staged
def stay_codes(spark, sf_dir):
    """Two codes per stay, some rows repeated; dates as text."""
    rows = stays(spark, sf_dir)
    k = F.col("k")
    day = lambda n: F.date_format(F.col("begin_ts") + F.make_dt_interval((k % n).cast("int")), "yyyy-MM-dd HH:mm:ss")
    first = rows.select(
        "stay_id",
        F.concat(F.lit(" c"), (k % 30).cast("string")).alias("code"),
        F.when(k % 4 == 0, "2").otherwise("1").alias("seq_num"),
        F.lit("10").alias("version"),
        day(5).alias("at"),
    )
    second = rows.select(
        "stay_id",
        F.concat(F.lit("c"), (k % 7).cast("string")).alias("code"),
        F.lit("2").alias("seq_num"),
        F.when(k % 3 == 0, "9").otherwise("10").alias("version"),
        day(2).alias("at"),
        (k % 6 == 0).alias("_again"),
    )
    again = second.where("_again").drop("_again")
    return first.unionByName(second.drop("_again")).unionByName(again).withColumn("code", normalize_code(F.col("code")))


cte(
    "principals",
    """SELECT subject_id, chain_id, arg_min(code, {'b': begin_ts, 'e': end_ts, 's': stay_id, 'c': code}) AS principal
FROM linked JOIN stay_codes USING (stay_id) WHERE seq_num = '1' GROUP BY 1, 2""",
    "linked",
    "stay_codes",
)


def principals(spark, sf_dir):
    return C.principal_code(linked(spark, sf_dir), stay_codes(spark, sf_dir), "code", "seq_num")


@query("principal_code_pick", sql("SELECT subject_id, chain_id, principal FROM principals", "principals"))
def principal_code_pick(spark, sf_dir):
    return principals(spark, sf_dir)


cte(
    "chain_events",
    """SELECT DISTINCT l.subject_id, l.chain_id, s.code, s.version, s.seq_num AS rank, CASE WHEN l.stay_id % 17 = 0 THEN 'unknown' ELSE strftime(s.at, '%Y-%m-%d %H:%M:%S') END AS raw_date
FROM linked l JOIN stay_codes s USING (stay_id) JOIN chains c USING (subject_id, chain_id)
WHERE l.stay_id % 17 = 0 OR date_trunc('second', s.at) <= c.end_ts""",
    "chains",
    "stay_codes",
)


def chain_events(spark, sf_dir):
    """Distinct events of a chain up to its end; undated ones stay."""
    ends = C.chain_table(linked(spark, sf_dir)).select("subject_id", "chain_id", F.col("end_ts").alias("chain_end"))
    members = linked(spark, sf_dir).join(ends, ["subject_id", "chain_id"])
    codes = stay_codes(spark, sf_dir)
    date = F.when(F.pmod("stay_id", F.lit(17)) == 0, "unknown").otherwise(F.col("at"))
    return C.distinct_events(
        members, codes, F.col("code"), F.col("version"), F.col("seq_num"), date, F.col("chain_end")
    )


@query("distinct_chain_events", sql("SELECT subject_id, chain_id, code, version, rank, raw_date FROM chain_events", "chain_events"))
def distinct_chain_events(spark, sf_dir):
    return chain_events(spark, sf_dir).drop("event_ts")


@query(
    "chain_code_join",
    sql(
        "SELECT l.subject_id, l.chain_id, s.code, count(*) AS n FROM linked l JOIN stay_codes s USING (stay_id) GROUP BY 1, 2, 3",
        "linked",
        "stay_codes",
    ),
)
def chain_code_join(spark, sf_dir):
    joined = linked(spark, sf_dir).select("subject_id", "chain_id", "stay_id").join(stay_codes(spark, sf_dir), "stay_id")
    return joined.groupBy("subject_id", "chain_id", "code").agg(F.count(F.lit(1)).alias("n"))


cte(
    "common_stay_codes",
    """SELECT code FROM (SELECT code, count(*) AS n FROM stay_codes GROUP BY 1) WHERE n >= (SELECT count(*) / count(DISTINCT code)::DOUBLE FROM stay_codes)""",
    "stay_codes",
)


@query(
    "unseen_codes_per_chain",
    sql(
        """SELECT subject_id, chain_id, count(*) AS n_events, count(*) FILTER (WHERE code NOT IN (SELECT code FROM common_stay_codes)) AS unseen FROM chain_events GROUP BY 1, 2""",
        "chain_events",
        "common_stay_codes",
    ),
)
def unseen_codes_per_chain(spark, sf_dir):
    """Events whose code a vocabulary does not have; this source maps them to id 3."""
    counts = materialise(stay_codes(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code-counts")
    common = counts.agg(F.sum("n") / F.count(F.lit(1))).first()[0]
    known = counts.where(F.col("n") >= F.lit(common)).select("code", F.lit(FIRST_CODE_ID).alias("id"))
    events = lookup_join(chain_events(spark, sf_dir), known, ["code"], "left")
    return events.groupBy("subject_id", "chain_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("id").isNull()).alias("unseen")
    )


# people and eligibility ----------------------------------------------------------------------------

cte(
    "people",
    """SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE (20 + c_custkey % 80)::VARCHAR END AS anchor_age, '2020' AS anchor_year,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' f' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE 'm ' END AS gender,
  CASE WHEN c_custkey % 19 = 0 THEN TIMESTAMP '2024-01-10' END AS dod FROM customer""",
)
cte(
    "eligible_chains",
    """WITH anchor AS (SELECT subject_id, chain_id, arg_min(l.begin_ts, {'b': l.begin_ts, 's': l.stay_id}) AS anchor_begin FROM linked l
  WHERE EXISTS (SELECT 1 FROM stay_codes s WHERE s.stay_id = l.stay_id AND s.seq_num = '1' AND s.version = '10' AND s.code LIKE 'C1%') GROUP BY 1, 2)
SELECT c.*, a.anchor_begin, (try_cast(p.anchor_age AS INT) + year(a.anchor_begin) - p.anchor_year::INT)::INT AS age, upper(trim(p.gender)) = 'F' AS female
FROM chains c JOIN anchor a USING (subject_id, chain_id) JOIN people p USING (subject_id)
WHERE try_cast(p.anchor_age AS INT) + year(a.anchor_begin) - p.anchor_year::INT BETWEEN 18 AND 120 AND upper(trim(p.gender)) IN ('F', 'M')
  AND (p.dod IS NULL OR p.dod > c.end_ts)""",
    "chains",
    "stay_codes",
    "people",
)


def people(spark, sf_dir):
    key = F.col("c_custkey")
    five = F.pmod(key, F.lit(5))
    return table(spark, sf_dir, "customer").select(
        key.alias("subject_id"),
        F.when(F.pmod(key, F.lit(13)) == 0, "x").otherwise((20 + F.pmod(key, F.lit(80))).cast("string")).alias("anchor_age"),
        F.lit("2020").alias("anchor_year"),
        F.when(five == 1, " f").when(five == 2, "M").when(five == 3, "F").when(five == 4, "m ").alias("gender"),
        F.when(F.pmod(key, F.lit(19)) == 0, "2024-01-10").alias("dod"),
    )


@staged
def eligible(spark, sf_dir):
    """Chains with an index code in some stay, a known adult and no death before the end.

    The first stay by (begin, key) whose principal code qualifies is the anchor.
    """
    first = stay_codes(spark, sf_dir).where(
        (F.col("seq_num") == "1") & (F.col("version") == "10") & F.col("code").startswith("C1")
    )
    members = linked(spark, sf_dir)
    anchors = (
        members.join(first.select("stay_id").distinct(), "stay_id", "left_semi")
        .groupBy("subject_id", "chain_id")
        .agg(F.min(F.struct("begin_ts", "stay_id"))["begin_ts"].alias("anchor_begin"))
    )
    rows = C.chain_table(members).join(anchors, ["subject_id", "chain_id"]).join(people(spark, sf_dir), "subject_id")
    age = F.col("anchor_age").try_cast("int") + F.year("anchor_begin") - F.col("anchor_year").try_cast("int")
    sex = F.upper(F.trim("gender"))
    death = parse_timestamp(F.col("dod"))
    alive = F.col("dod").isNull() | (death > F.col("end_ts"))
    return (
        rows.withColumns({"age": age.cast("int"), "female": sex == "F"})
        .where(F.col("age").between(18, 120) & sex.isin("F", "M") & alive)
        .select("subject_id", "chain_id", "begin_ts", "end_ts", "n_stays", "anchor_begin", "age", "female")
    )


@query(
    "timestamp_eligibility",
    sql("SELECT subject_id, chain_id, age, female, n_stays, date_diff('microsecond', anchor_begin, end_ts) / 86400000000.0::DOUBLE AS stay_days FROM eligible_chains", "eligible_chains"),
)
def timestamp_eligibility(spark, sf_dir):
    days = (F.unix_micros("end_ts") - F.unix_micros("anchor_begin")) / 86_400e6
    return eligible(spark, sf_dir).select("subject_id", "chain_id", "age", "female", "n_stays", days.alias("stay_days"))


# history and labels -------------------------------------------------------------------------------

cte(
    "chain_flags",
    """SELECT c.*, coalesce(f.emergency, 0)::INT AS emergency FROM chains c JOIN (SELECT subject_id, chain_id, max((from_place = 'Emergency Room')::INT) AS emergency FROM linked GROUP BY 1, 2) f USING (subject_id, chain_id)""",
    "chains",
)
cte(
    "stay_history",
    """SELECT i.subject_id, i.chain_id, count(r.chain_id) FILTER (WHERE i.begin_ts - r.end_ts <= INTERVAL 30 DAYS) AS prior_count_30d,
  count(r.chain_id) FILTER (WHERE i.begin_ts - r.end_ts <= INTERVAL 90 DAYS) AS prior_count_90d, count(r.chain_id) FILTER (WHERE i.begin_ts - r.end_ts <= INTERVAL 180 DAYS) AS prior_count_180d,
  count(r.chain_id) FILTER (WHERE year(r.end_ts) = year(i.begin_ts)) AS prior_count_ytd, coalesce(sum(r.emergency) FILTER (WHERE i.begin_ts - r.end_ts <= INTERVAL 180 DAYS), 0)::BIGINT AS prior_emergency_180d,
  coalesce(sum(date_diff('microsecond', r.begin_ts, r.end_ts)) FILTER (WHERE i.begin_ts - r.end_ts <= INTERVAL 180 DAYS), 0)::DOUBLE / 86400000000.0::DOUBLE AS prior_stay_days_180d,
  date_diff('microsecond', max(r.end_ts), any_value(i.begin_ts)) / 86400000000.0::DOUBLE AS days_since_prior,
  (any_value(i.begin_ts) - (SELECT min(c.begin_ts) FROM chains c WHERE c.subject_id = i.subject_id) >= INTERVAL 30 DAYS)::INT AS seen_30d,
  (any_value(i.begin_ts) - (SELECT min(c.begin_ts) FROM chains c WHERE c.subject_id = i.subject_id) >= INTERVAL 90 DAYS)::INT AS seen_90d
FROM eligible_chains i LEFT JOIN chain_flags r ON r.subject_id = i.subject_id AND r.end_ts < i.begin_ts GROUP BY 1, 2""",
    "eligible_chains",
    "chain_flags",
)
STAY_HISTORY = (
    "prior_count_30d", "prior_count_90d", "prior_count_180d", "prior_count_ytd", "prior_emergency_180d",
    "prior_stay_days_180d", "days_since_prior", "seen_30d", "seen_90d",
)


@query("history_timestamps", sql(f"SELECT subject_id, chain_id, {', '.join(STAY_HISTORY)} FROM stay_history", "stay_history"))
def history_timestamps(spark, sf_dir):
    emergency = F.max((F.col("from_place") == "Emergency Room").cast("int")).alias("emergency")
    chains = C.chain_table(linked(spark, sf_dir), [emergency])
    out = with_stay_history(eligible(spark, sf_dir), chains, ["emergency"])
    return out.select("subject_id", "chain_id", *STAY_HISTORY)


cte(
    "chain_states",
    """SELECT c.*, CASE coalesce(p.principal, 'C9') WHEN 'C9' THEN 'algorithm_unknown' ELSE CASE WHEN c.chain_id % 3 = 0 THEN 'stable_planned' WHEN c.chain_id % 11 = 0 THEN 'algorithm_unknown' ELSE 'stable_unplanned' END END AS state,
  CASE WHEN p.principal LIKE 'C1%' THEN 'ap' WHEN p.principal LIKE 'C2%' THEN 'biliary' WHEN p.principal IS NOT NULL THEN 'other' END AS cause
FROM chains c LEFT JOIN principals p USING (subject_id, chain_id)""",
    "chains",
    "principals",
)
cte(
    "chain_labels",
    """SELECT subject_id, chain_id, CASE WHEN open THEN 'algorithm_unknown' WHEN u IS NULL THEN 'none' WHEN u.cause IS NOT NULL THEN 'qualified' ELSE 'cause_unknown' END AS label_status,
  CASE WHEN NOT open THEN (u IS NOT NULL)::INT END AS any_follow_up, CASE WHEN NOT open THEN CASE WHEN u IS NULL THEN 'none' ELSE u.cause END END AS leaf,
  CASE WHEN open THEN 0 ELSE (u IS NOT NULL)::INT END AS if_unknown_planned, CASE WHEN open THEN 1 ELSE (u IS NOT NULL)::INT END AS if_unknown_unplanned
FROM (SELECT *, x IS NOT NULL AND (u IS NULL OR (x.b, x.c) < (u.b, u.c)) AS open FROM (
  SELECT i.subject_id, i.chain_id, min({'b': r.begin_ts, 'c': r.chain_id, 'cause': r.cause}) FILTER (WHERE r.state = 'stable_unplanned') AS u,
    min({'b': r.begin_ts, 'c': r.chain_id}) FILTER (WHERE r.state = 'algorithm_unknown') AS x
  FROM eligible_chains i LEFT JOIN chain_states r ON r.subject_id = i.subject_id AND r.begin_ts > i.end_ts AND r.begin_ts - i.end_ts <= INTERVAL 30 DAYS GROUP BY 1, 2))""",
    "eligible_chains",
    "chain_states",
)


@staged
def chain_labels(spark, sf_dir):
    chains = C.chain_table(linked(spark, sf_dir)).join(principals(spark, sf_dir), ["subject_id", "chain_id"], "left")
    principal, key = F.col("principal"), F.col("chain_id")
    state = (
        F.when(F.coalesce(principal, F.lit("C9")) == "C9", "algorithm_unknown")
        .when(F.pmod(key, F.lit(3)) == 0, "stable_planned")
        .when(F.pmod(key, F.lit(11)) == 0, "algorithm_unknown")
        .otherwise("stable_unplanned")
    )
    # cause by code lists on the principal code; without one it stays unknown
    cause = F.when(principal.startswith("C1"), "ap").when(principal.startswith("C2"), "biliary").when(principal.isNotNull(), "other")
    chains = chains.withColumns({"state": state, "cause": cause})
    return C.with_chain_label(eligible(spark, sf_dir), chains, "state", "cause")


LABELS = ("label_status", "any_follow_up", "leaf", "if_unknown_planned", "if_unknown_unplanned")


@query("follow_up_label_bounds", sql(f"SELECT subject_id, chain_id, {', '.join(LABELS)} FROM chain_labels", "chain_labels"))
def follow_up_label_bounds(spark, sf_dir):
    return chain_labels(spark, sf_dir).select("subject_id", "chain_id", *LABELS)


@query(
    "extreme_bound_scenarios",
    sql(
        """SELECT scenario, count(*) AS n, sum(y)::BIGINT AS events, round(avg(y), 6) AS rate FROM (
  SELECT 'unknown_dropped' AS scenario, any_follow_up AS y FROM chain_labels WHERE any_follow_up IS NOT NULL UNION ALL
  SELECT 'unknown_planned', if_unknown_planned FROM chain_labels UNION ALL SELECT 'unknown_unplanned', if_unknown_unplanned FROM chain_labels) GROUP BY 1""",
        "chain_labels",
    ),
)
def extreme_bound_scenarios(spark, sf_dir):
    y = F.col("any_follow_up")
    row = lambda name, c: F.struct(F.lit(name).alias("scenario"), c.alias("y"))
    long = chain_labels(spark, sf_dir).select(
        F.inline(
            F.array(
                row("unknown_dropped", y),
                row("unknown_planned", F.coalesce(y, F.lit(0))),
                row("unknown_unplanned", F.coalesce(y, F.lit(1))),
            )
        )
    )
    by = long.where("y IS NOT NULL").groupBy("scenario")
    return rounded(by.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.avg("y").alias("rate")))


@query(
    "hierarchy_cause_lookup",
    sql("SELECT subject_id, chain_id, cause FROM chain_states", "chain_states"),
)
def hierarchy_cause_lookup(spark, sf_dir):
    """Cause of a chain from label lists joined on its principal code, else 'other'."""
    codes = stay_codes(spark, sf_dir).select("code").distinct()
    lists = codes.withColumn(
        "cause", F.when(F.col("code").startswith("C1"), "ap").when(F.col("code").startswith("C2"), "biliary")
    ).where("cause IS NOT NULL")
    chains = C.chain_table(linked(spark, sf_dir)).join(principals(spark, sf_dir), ["subject_id", "chain_id"], "left")
    found = lookup_join(chains, lists.withColumnRenamed("code", "principal"), ["principal"], "left")
    cause = F.when(F.col("principal").isNotNull(), F.coalesce("cause", F.lit("other")))
    return found.select("subject_id", "chain_id", cause.alias("cause"))


@query(
    "transfer_metrics",
    sql(
        metrics_sql(
            "(SELECT any_follow_up AS y, round(1 / (1 + exp(-(chain_id % 40 - 20) / 10.0::DOUBLE)), 6) AS p FROM chain_labels WHERE any_follow_up IS NOT NULL)", "", "1.0::DOUBLE"
        ),
        "chain_labels",
    ),
)
def transfer_metrics(spark, sf_dir):
    """Metrics on rows whose label is known."""
    score = F.round(1 / (1 + F.exp(-(F.pmod("chain_id", F.lit(40)) - 20) / 10.0)), 6)
    known = chain_labels(spark, sf_dir).where("any_follow_up IS NOT NULL").withColumn("p", score)
    return tidy(M.binary_metrics(known, [], "p", "any_follow_up"))


# transfer evaluation: subjects are drawn, not chains ------------------------------------------------

TRANSFER_SEED, TRANSFER_REPS = 31, 1000
_SCORES = {"a": ("% 40", 20, 10.0), "b": ("* 7 % 40", 20, 8.0)}
cte(
    "unseen_codes",
    """SELECT subject_id, chain_id, count(*) FILTER (WHERE code NOT IN (SELECT code FROM common_stay_codes)) AS unseen FROM chain_events GROUP BY 1, 2""",
    "chain_events",
    "common_stay_codes",
)
cte(
    "transfer_rows",
    " UNION ALL ".join(
        f"""SELECT subject_id, chain_id, any_follow_up AS y, '{m}' AS model, round(1 / (1 + exp(-((chain_id {step}) - {middle}) / {scale}::DOUBLE)), 6) AS p,
  CASE WHEN coalesce(unseen, 0) = 0 THEN 'none' ELSE 'some' END AS unseen_codes
FROM chain_labels LEFT JOIN unseen_codes USING (subject_id, chain_id) WHERE any_follow_up IS NOT NULL"""
        for m, (step, middle, scale) in _SCORES.items()
    ),
    "chain_labels",
    "unseen_codes",
)
cte("transfer_draws", draws_sql("transfer_rows", "", "subject_id", TRANSFER_REPS, TRANSFER_SEED), "transfer_rows")
cte("transfer_drawn", "SELECT t.*, d.replicate, d.mult FROM transfer_rows t JOIN transfer_draws d USING (subject_id)", "transfer_draws")


@staged
def transfer_rows(spark, sf_dir):
    """Chains with a known label, two scores, and whether a code of theirs is outside the vocabulary."""
    labels = chain_labels(spark, sf_dir).where("any_follow_up IS NOT NULL")
    rows = labels.join(unseen_codes_per_chain(spark, sf_dir).select("subject_id", "chain_id", "unseen"), ["subject_id", "chain_id"], "left")
    score = lambda place, scale: F.round(1 / (1 + F.exp(-(place - 20) / scale)), 6)
    key = F.col("chain_id")
    scores = {"a": score(F.pmod(key, F.lit(40)), 10.0), "b": score(F.pmod(key * 7, F.lit(40)), 8.0)}
    entries = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in scores.items()])
    return rows.select(
        "subject_id", "chain_id", F.col("any_follow_up").alias("y"),
        F.when(F.coalesce("unseen", F.lit(0)) == 0, "none").otherwise("some").alias("unseen_codes"), F.inline(entries),
    )


@planned
def transfer_draws(spark, sf_dir):
    return plan_draws(transfer_rows(spark, sf_dir), [], "subject_id", TRANSFER_REPS, TRANSFER_SEED)


@staged
def transfer_replicates(spark, sf_dir):
    return S.replicate_metrics(transfer_rows(spark, sf_dir), transfer_draws(spark, sf_dir), ["model"], "p", "y")


CURVE_POINTS = [0.01 + i * (0.49 / 99) for i in range(99)] + [0.5]


@query(
    "transfer_decision_curve",
    sql(
        """WITH points AS (SELECT unnest(range(0, 99)) AS i UNION ALL SELECT 99),
counted AS (SELECT model, i, CASE WHEN i = 99 THEN 0.5::DOUBLE ELSE 0.01::DOUBLE + i * (0.49::DOUBLE / 99) END AS threshold FROM points, (SELECT DISTINCT model FROM transfer_rows)),
sums AS (SELECT model, threshold, count(*) AS n, avg(y) AS rate, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp
  FROM counted JOIN transfer_rows USING (model) GROUP BY 1, 2)
SELECT model, round(threshold, 8) AS threshold, round((tp - fp * threshold / (1 - threshold)) / n, 8) + 0.0 AS net_benefit,
  round(rate - (1 - rate) * threshold / (1 - threshold), 8) + 0.0 AS treat_all_net_benefit, 0.0::DOUBLE AS treat_none_net_benefit, n FROM sums""",
        "transfer_rows",
    ),
)
def transfer_decision_curve(spark, sf_dir):
    """Net benefit of both scores at 100 thresholds from 0.01 to 0.50, on the chains with a known label."""
    rows = transfer_rows(spark, sf_dir).withColumn("w", F.lit(1.0))
    curve = M.decision_curve(rows, ["model"], "p", "y", "w", CURVE_POINTS)
    sizes = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return rounded(lookup_join(curve, sizes, ["model"], "inner"), 8)


_TRANSFER = ("auroc", "auprc", "brier")
_BOUNDS = ", ".join(
    f"round(quantile_cont({m}, 0.025), 5) AS {m}_low, round(quantile_cont({m}, 0.975), 5) AS {m}_high, count({m}) AS {m}_defined" for m in _TRANSFER
)
_drawn_metrics = lambda groups: metrics_sql("transfer_drawn", groups, "mult").replace(", 6)", ", 12)")


@query(
    "transfer_intervals",
    sql(f"SELECT model, {_BOUNDS} FROM ({_drawn_metrics('replicate, model')}) GROUP BY 1", "transfer_drawn"),
)
def transfer_intervals(spark, sf_dir):
    """Bounds of metrics over replicates of subjects."""
    return rounded(S.intervals(transfer_replicates(spark, sf_dir), ["model"], _TRANSFER), 5)


@query(
    "transfer_paired_difference",
    sql(
        f"""WITH m AS ({_drawn_metrics('replicate, model')}), d AS (SELECT a.auroc - b.auroc AS difference FROM m a JOIN m b USING (replicate) WHERE a.model = 'a' AND b.model = 'b')
SELECT round(avg(difference), 6) + 0.0 AS mean_difference, round(quantile_cont(difference, 0.025), 5) + 0.0 AS low,
  round(quantile_cont(difference, 0.975), 5) + 0.0 AS high, count(difference) AS n_defined FROM d""",
        "transfer_drawn",
    ),
)
def transfer_paired_difference(spark, sf_dir):
    """The two scores compared in the same replicates of subjects."""
    found = S.paired_difference(transfer_replicates(spark, sf_dir), [], "model", "a", "b", "auroc")
    low, high = S.percentile_bounds("difference")
    return found.agg(
        rnd(F.avg("difference")).alias("mean_difference"), rnd(low, 5).alias("low"), rnd(high, 5).alias("high"), F.count("difference").alias("n_defined")
    )


@query(
    "transfer_intervals_by_unseen_codes",
    sql(f"SELECT unseen_codes, model, {_BOUNDS} FROM ({_drawn_metrics('replicate, unseen_codes, model')}) GROUP BY 1, 2", "transfer_drawn"),
)
def transfer_intervals_by_unseen_codes(spark, sf_dir):
    """The same bounds for chains without and with codes outside the vocabulary."""
    groups = ["unseen_codes", "model"]
    found = S.replicate_metrics(transfer_rows(spark, sf_dir), transfer_draws(spark, sf_dir), groups, "p", "y")
    return rounded(S.intervals(found, groups, _TRANSFER), 5)
