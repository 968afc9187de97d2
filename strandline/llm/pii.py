"""Personal data by fixed rules, and more of it by bootstrapped context patterns.

The base kinds (email, ip, card, phone) are found by rule.  They, and values
that have the form of a key or token (kind secret), are the seeds.  The words
around an instance, or a key glued to it (``password=``), are its lexical
patterns.  Spark scores the graph of patterns and instances in rounds: a pattern
is accepted for a kind when enough known instances of that kind occur in it and
they are most of what occurs in it; an instance is accepted when its accepted
patterns together make it likely; accepted instances are known in the next
round.  Rounds go on until one accepts nothing new; since known instances are only
added to, that comes, and more than ``ROUNDS`` rounds are an error, not an end.  All
occurrences of accepted instances are spans beside the base ones.

Candidates are words with a digit or an at sign and eight characters or more,
outside base spans.  The graph holds hashes of instances, not their text.

Defined cases: null text is empty text and has no span.  Equal rows give equal
rows.  Offsets are code points, ends are exclusive.  Spans of different kinds
may overlap.  Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import free_name, in_arrow, slices
from strandline.operators.skew import lookup_join
from strandline.session import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS, SUPPORT, PRECISION, CONFIDENCE = 1_000, 3, 0.6, 0.6
MIN_VALUE = 8

# Possessive runs and look-behinds keep long runs linear; they match what the plain rules match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGES = "\"'`()[]{}<>.,;:!?"
_NOT_DIGIT = {ord(c): None for c in " ().+-"}
CONTEXT = 96  # characters around an instance in which its context words are sought


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), kind by kind."""
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].translate(_NOT_DIGIT)
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(m[0].translate(_NOT_DIGIT)) <= 15:
            out.append(("phone", *m.span()))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before; the words on both sides; a key glued to the front."""
    head = text[max(0, start - CONTEXT) : start].lower()
    tail = text[end : end + CONTEXT].lower()
    glued = "" if not head or head[-1].isspace() else head.split()[-1]
    before = head[: len(head) - len(glued)].split()
    glued = glued.strip("\"'`(<[{")
    out = []
    if glued and glued[-1] in "=:":
        out.append(f"key {glued}")
    if len(before) >= 2:
        out.append(f"left {before[-2]} {before[-1]}")
    after = tail.split(None, 1)
    if before and after:
        out.append(f"around {before[-1]} _ {after[0]}")
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """(kind of a seed or None, start, end) of identifier-like words outside ``taken``."""
    out = []
    taken = merged(taken)
    at = 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        cut = max(text.rfind("=", start, end - 1), text.rfind(":", start, end - 1)) + 1
        start = max(start, cut)
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if end - start < MIN_VALUE:
            continue
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        out.append(("secret" if _SECRET.fullmatch(text, start, end) else None, start, end))
    return out


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


_INSTANCE = pa.struct(
    [("inst", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()),
     ("patterns", pa.list_(pa.string()))]
)
_INSTANCE_SQL = "array<struct<inst:long,kind:string,base:boolean,start:int,end:int,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` number, ``doc_id``, ``text_key`` and all instances of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(2).to_pylist():
                found = []
                if text:
                    base = base_spans(text)
                    for kind, start, end, is_base in [(*b, True) for b in base] + [(*c, False) for c in candidates(text, base)]:
                        key = xxhash.xxh64_intdigest(text[start:end].lower().encode("utf-8", "surrogatepass")) >> 1
                        found.append(
                            {"inst": key, "kind": kind, "base": is_base, "start": start, "end": end, "patterns": patterns(text, start, end)}
                        )
                rows.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(_INSTANCE))], names=["doc_id", "text_key", "found"]
            )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("body")
    )
    rows = in_arrow(source, work, f"doc_id long, text_key string, found {_INSTANCE_SQL}")
    return rows.withColumn("row", F.monotonically_increasing_id())


def text_key(text: Column) -> Column:
    """Names a text, so that its spans can be brought back to it."""
    return F.md5(F.coalesce(text, F.lit("")))


def bootstrap(
    scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, precision: float = PRECISION, confidence: float = CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Known instances (inst, kind) and accepted patterns (pattern, kind, score).

    Edges are counted once per pattern and instance before anything is joined,
    so a passage that a third of the rows repeat weighs no more than another.
    """
    each = scanned.select(F.explode("found").alias("f")).select("f.*")
    known = materialise(each.where("kind IS NOT NULL").groupBy("inst").agg(F.min("kind").alias("kind")).withColumn("p", F.lit(1.0)), "pii-known")
    edges = materialise(each.select("inst", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    accepted = None
    for _ in range(rounds):
        scored = (
            edges.join(known, "inst")
            .groupBy("pattern", "kind")
            .agg(F.sum("p").alias("weight"), F.count(F.lit(1)).alias("known"))
            .where(F.col("known") >= support)
            .join(sizes, "pattern")
            .withColumn("score", F.round(F.col("weight") / F.col("n"), 6))
            .where(F.col("score") >= precision)
        )
        best = F.max(F.struct("score", "kind")).alias("best")
        accepted = materialise(scored.groupBy("pattern").agg(best).select("pattern", "best.kind", "best.score"), "pii-patterns")
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.99))))
        found = (
            edges.join(accepted, "pattern")
            .groupBy("inst", "kind")
            .agg(F.round(1 - F.exp(doubt), 6).alias("p"))
            .where(F.col("p") >= confidence)
            .groupBy("inst")
            .agg(F.max(F.struct("p", "kind")).alias("best"))
            .select("inst", "best.kind", "best.p")
            .join(known, "inst", "left_anti")
        )
        found = materialise(found, "pii-found")
        if found.isEmpty():
            break
        known = materialise(known.unionByName(found), "pii-known")
    else:
        raise RuntimeError(f"instances were still accepted after {rounds} rounds")
    return known.select("inst", "kind"), accepted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: ``base`` and ``spans``, arrays of (start, rank, kind, end) in order."""
    scanned = materialise(scan(docs, id_col, text_col), "pii-scan")
    known, _ = bootstrap(scanned, **limits)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    more = (
        scanned.select("row", F.explode("found").alias("f"))
        .where("NOT f.base")
        .select("row", "f.inst", "f.start", "f.end")
        .join(known, "inst")
        .select("row", F.struct("start", rank.alias("rank"), "kind", "end").alias("span"))
        .groupBy("row")
        .agg(F.collect_list("span").alias("more"))  # spans of one text
    )
    base = F.array_sort(
        F.transform(
            F.filter("found", lambda f: f.base),
            lambda f: F.struct(
                f.start.alias("start"),
                F.array_position(F.array(*map(F.lit, KINDS)), f.kind).cast("int").alias("rank"),
                f.kind.alias("kind"),
                f.end.alias("end"),
            ),
        )
    )
    rows = scanned.select("row", "doc_id", "text_key", base.alias("base")).join(more, "row", "left")
    return rows.select(
        "doc_id",
        "text_key",
        "base",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **limits) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    The spans come back by the text itself, so rows without an id are redacted
    too.  ``length_col``, where there is one, follows the new text.
    """
    found = find(docs, id_col, text_col, **limits).where(F.size("spans") > 0)
    key, held = free_name(docs.columns, "text_key"), free_name(docs.columns, "spans")
    spans = materialise(found.groupBy("text_key").agg(F.first("spans").alias(held)), "pii-spans")
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = lookup_join(keyed, spans.withColumnRenamed("text_key", key), [key], "left").select(*docs.columns, F.col(held))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [cut(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = in_arrow(joined, work, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def cut(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])
