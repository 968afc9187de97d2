import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import alignment as A

pytestmark = pytest.mark.skipif(not os.path.isdir(A.TOKENIZER_DIR), reason="no tokenizer files")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def sides():
    return [A.tokenizer(f"{A.TOKENIZER_DIR}/{v}") for v in (A.VERSION_A, A.VERSION_B)]


def plain(text, sides):
    """(A ids, B ids, links, group text) of one text, token pair by token pair."""
    if not text:
        return [], [], [], ""
    tokenizer, processor = sides[0].tokenizer, sides[1].processor
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = processor.encode(text)
    spans = []
    for ids, side in ((a, sides[0]), (b, sides[1])):
        ends = np.cumsum([len(side.spelled[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends)))
        if b"".join(side.spelled[i] for i in ids) != (" " + text).encode():
            return [], [], [], ""
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for cut in cuts:
        sides_of = [[str(i) for i, (s, e) in zip(ids, own) if start <= s and e <= cut] for ids, own in zip((a, b), spans)]
        groups.append("|".join(map(",".join, sides_of)))
        start = cut
    return a, b, links, ";".join(groups)


TEXTS = [
    "", None, " ", "  two  spaces ", "Hello world", "naïve café — 東京 123's", "a▁b", "<|endoftext|> </s> <unk>", "tab\tand\nline\r\n",
    "\x00\x01", "unbelievably internationalization", "🙂🙂 emoji", "'s 't don't", "x" * 300, "１２３ ﬁ ①", "é combining",
]


def test_alphabet_of_bytes(sides):
    table = A.byte_characters()
    assert sorted(table.values()) == list(range(256)) and table["Ġ"] == 32 and table["a"] == 97


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_links_and_groups_against_all_pairs(spark, sides, lane):
    rng = random.Random(lane)
    texts = TEXTS + ["".join(rng.choice(["ab", " ", "tion", "é", "日", "\n", "Z", "9"]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    names = tuple(A.COLUMNS)
    for r in A.align(df, names, lane=lane).collect():
        a, b, links, groups = plain(texts[r.doc_id], sides)
        assert (r.a_ids, r.b_ids, r.groups) == (a, b, groups), texts[r.doc_id]
        assert list(zip(r.link_a, r.link_b)) == links
        assert (r.n_a, r.n_b, r.n_links) == (len(a), len(b), len(links))
        assert r.n_groups == len(r.cuts) == (groups.count(";") + 1 if groups else 0)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert dict(zip(zip(r.pair_a, r.pair_b), r.pair_n)) == Counter((a[i], b[j]) for i, j in links)
        if a:
            assert r.cuts[-1] == len((" " + texts[r.doc_id]).encode())


@pytest.mark.parametrize("size", [1, 5, 40])
def test_pieces_of_long_texts_give_the_same_ids(sides, size):
    rng = random.Random(size)
    words = ["Hello", "don't", "  ", "café", "\n", "東京", "x", "\t ", "1,234.5", "ﬁ", " ", "'ll", "Ünder▁score" if size == 5 else "end."]
    for _ in range(40):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(30))
        whole = [A.encoded([text], s, 1 << 30) for s in sides]
        assert [A.encoded([text], s, size) for s in sides] == whole
        assert "".join(A.text_pieces(text, size)) == " " + text


def test_both_libraries_give_the_same_ids(sides):
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x300)]
    texts = [f" {x}{c}{y}" for c in letters for x in ("", "a", " ", "1", "'", c) for y in ("b", " ", f"{c} x", f"\n{c}")]
    common = letters + list(" \n\t'sdtrevemlation") * 40
    texts += [" " + "".join(rng.choice(common) for _ in range(150)) for _ in range(3_000)]
    words = "".join(sides[0].spelled[i].decode("utf-8", "ignore") for i in rng.choices(range(50_000), k=20_000))
    texts += [" " + words[i : i + 400] for i in range(0, len(words), 400) if not A._BEYOND.search(words[i : i + 400])]
    side = sides[0]
    assert side.ranked is not None
    slow = [e.ids for e in side.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert side.encode(texts) == slow


def expected(rows, sides):
    found = [plain(t, sides) for _, t in rows]
    counts = Counter((a[i], b[j]) for a, b, links, _ in found for i, j in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc, _), (a, b, links, groups) in zip(rows, found):
        held = [(b[j], counts[a[i], b[j]]) for i, j in links]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((doc, len(a), len(b), n_groups, len(links), sum(n == best[y] for y, n in held), sum(n for _, n in held), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [1, 20, A.FREQUENT])
def test_scores_for_any_number_of_broadcast_pairs(spark, sides, frequent):
    rng = random.Random(frequent)
    words = ["token", "tokenizer", "align", "café", "unaligned", "東京", "the", "of"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(1, "the the of"), (1, "the the of"), (None, "align"), (None, None), (99, "a▁b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("row", "a", "b", "n", "count", "best", "body", "n_a")})
    got = [tuple(r) for r in A.scored(df, frequent=frequent).collect()]
    assert sorted(got, key=str) == expected(rows, sides)


def test_long_text_and_empty_table(spark):
    long = "Alignment of long texts, word by word. " * 50_000
    [row] = A.align(spark.createDataFrame([(1, long)], SCHEMA), ("n_a", "n_b", "n_groups", "n_links", "cuts")).collect()
    assert row.cuts[-1] == len(long) + 1 and row.n_links == row.n_a + row.n_b - row.n_groups
    assert A.scored(spark.createDataFrame([], SCHEMA)).count() == 0
