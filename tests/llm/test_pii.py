import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.%+-_ 0123456789()é\n", max_size=60))
def test_base_rules_match_the_plain_rules(text):
    assert P.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("run", ["a", "1", ".", "1.", "+1", "@", "a@", "a.", "1 ", "=", "a1"])
def test_long_runs_take_linear_time(run):
    text = run * (200_000 // len(run))
    P.candidates(text, P.base_spans(text))


@pytest.mark.parametrize("number,good", [("4111111111111111", True), ("4111111111111112", False), ("79927398713", True)])
def test_luhn(number, good):
    assert P.luhn(number) is good


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def found(df, **limits):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.find(df, **limits).collect()}


def test_patterns_of_seeds_discover_other_values(spark):
    seeds = [f"log in with password={h} and go" for h in ("a1b2c3d4e5f60718", "ffeeddccbbaa0099", "0011aabb22cc33dd", "1234567890abcdef")]
    hidden, elsewhere, other = "my password=Zebra-77-moon here", "again Zebra-77-moon without a key", "the word Zebra-78-moon is free"
    got = found(frame(spark, [*seeds, hidden, elsewhere, other]))
    assert got[4] == [("secret", 12, 25)] and hidden[12:25] == "Zebra-77-moon"
    assert got[5] == [("secret", 6, 19)]
    assert got[6] == []
    assert all(got[i] for i in range(4))


def test_mixed_contexts_are_not_accepted(spark):
    common = ["see the a@b.org now", "see the 10.0.0.1 now", "see the +1 555 123 4567 now", "see the widget-2024-x now", "see the gadget-2025-y now"]
    got = found(frame(spark, common))
    assert got[3] == [] and got[4] == []


def test_base_spans_stay_and_order_is_by_start_then_kind(spark):
    text = "x 4111 1111 1111 1111 y +4111 1111 1111 111 a@b.co 1.2.3.4 300.1.1.1"
    row = P.find(frame(spark, [text])).first()
    spans = [(s.kind, s.start, s.end) for s in row.base]
    rank = {k: i for i, k in enumerate(P.KINDS)}
    assert spans == sorted(plain_spans(text), key=lambda s: (s[1], rank[s[0]]))
    assert set(spans) <= {(s.kind, s.start, s.end) for s in row.spans}


def test_redaction(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.org or 1.2.3.4.", 24, "x"), (None, "mail a@b.org or 1.2.3.4.", 24, "y"), (2, None, None, "z"), (3, "", 0, None)],
        "doc_id long, text string, n_chars long, text_key string",
    )
    out = {(r.doc_id, r.text_key): (r.text, r.n_chars) for r in P.redact(df).collect()}
    clean = "mail <EMAIL> or <IP>."
    assert out == {(1, "x"): (clean, len(clean)), (None, "y"): (clean, len(clean)), (2, "z"): (None, None), (3, None): ("", 0)}
    assert P.cut("abcdefgh", [{"kind": "card", "start": 1, "end": 4}, {"kind": "phone", "start": 3, "end": 6}]) == "a<CARD>gh"


def test_empty_table(spark):
    assert P.find(frame(spark, ["x"]).limit(0)).count() == 0 and P.redact(frame(spark, ["x"]).limit(0)).count() == 0


def test_a_long_chain_of_patterns_is_followed_to_its_end(spark):
    """Each value is reached only through the one before it."""
    seeds = ["a1b2c3d4e5f60718", "ffeeddccbbaa0099", "0011aabb22cc33dd"]
    value = lambda k: f"Zebra-{k}-moon"
    texts = [f"chain1={v}" for v in (*seeds, value(1))]
    for k in range(2, 7):
        texts += [f"chain{k}={v}" for v in (*seeds[:2], value(k - 1), value(k))]
    got = found(frame(spark, texts))
    assert all(got[i] == [("secret", 7, len(t))] for i, t in enumerate(texts))
    with pytest.raises(RuntimeError):
        found(frame(spark, texts), rounds=3)
