import duckdb
import pytest

from strandline.llm import licenses as L

BODY = "Permission is hereby granted to any\nperson obtaining a copy\n\nof this work to use it freely and share it"
OWN = {"Own-1": BODY, "Line": "Free for any use by anyone at all.", "Twin": "Free for any use by anyone at all!", "Short": "Free"}


def plain(docs, templates, threshold):
    out = []
    for doc_id, text in docs:
        for kind, line, unit in L.units(text) if text else ():
            a = L.pairs_of(L.words_of(unit))
            for name, body in templates.items():
                b = L.pairs_of(L.words_of(body))
                if a and b and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                    out.append((doc_id, kind, line, name, round(2 * len(a & b) / (len(a) + len(b)), 6)))
    return sorted(out)


DOCS = [
    (1, f"Intro words here.\n\n{BODY}"),
    (2, BODY),
    (3, "Some prose\nFREE for any use, by anyone at all\nmore prose"),
    (4, "free for any use by anyone"),
    (5, None),
    (6, ""),
    (7, "Free"),
    (2, BODY),
    (8, "\n\n\n"),
    (9, "free for any use by any person at all " * 2_000),
    (10, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."),
]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
@pytest.mark.parametrize("templates", [OWN, L.TEMPLATES, {}])
def test_pruning_changes_nothing(spark, templates, threshold):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = sorted(map(tuple, L.scan(df, templates=templates, threshold=threshold).collect()))
    assert got == plain(DOCS, templates, threshold)


def test_twin(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", DOCS)
    assert sorted(con.execute(L.scan_sql(OWN)).fetchall()) == plain(DOCS, OWN, 0.8)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "y", 2)], "doc_id long, text string, license string, line int")
    assert L.scan(df).count() == 0 and L.scan(df.limit(0)).count() == 0
