"""Codes of stays, which several queries read."""

from pyspark.sql import functions as F

from strandline.plans import chains


def test_codes_of_stays_are_made_once(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, f"2024-01-{1 + i:02d} 08:00:00", "view", float(i), '{"k": %d}' % i) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    made, normal = [], chains.normalize_code
    monkeypatch.setattr(chains, "normalize_code", lambda c: made.append(1) or normal(c))
    counted = sum(r.n_events for r in chains.unseen_codes_per_chain(spark, str(tmp_path)).collect())
    first = chains.stay_codes(spark, str(tmp_path))
    assert len(made) == 1 and counted > 0
    assert first.count() == 20 + 20 + sum(i % 6 == 0 for i in range(20))
