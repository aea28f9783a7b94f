import random

import pytest

from sylvaspark.llm import encoding as E
from sylvaspark.llm import packing as P


@pytest.fixture(scope="module")
def made():
    tokens = E.load_ranks(E.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    return E.Encoder(tokens, E.split_table(tokens))


def test_equal_to_the_public_library(made):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = ["".join(r.choice("ab cd的了学 \n\té😀​12 the<|endoftext|>'s") for _ in range(r.randint(1, 90))) for _ in range(2000)] + ["a" * 3000, "学" * 2000, " " * 999]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert made.encode(text) == want.ids
        assert made.decode(want.ids) == text


def test_rows(spark):
    rows = [(1, "hello 世界", "c"), (2, None, "c"), (3, "", None), (1, "hello 世界", "c"), (4, "x" * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = E.encode(df)
    by = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    assert got.count() == 5 and by[2] == [] and by[3] == []
    texts = {r["doc_id"]: r["text"] for r in E.decode(got).collect()}
    assert texts[1] == "hello 世界" and texts[4] == "x" * 100_000 and texts[2] == ""
    assert {r["doc_id"]: r["n_tokens"] for r in E.encode(df, lengths_only=True).collect()} == {k: len(v) for k, v in by.items()}
    assert E.encode(df.limit(0)).count() == 0


def test_plan_uses_each_item_once():
    r = random.Random(5)
    for _ in range(30):
        cap = r.randint(5, 60)
        counts = {s: r.randint(1, 9) for s in r.sample(range(1, cap + 1), r.randint(1, cap))}
        left = dict(counts)
        for combo, times in P.plan(counts, cap):
            assert sum(combo) <= cap and times > 0
            for s in combo:
                left[s] -= times
        assert not any(left.values())


def test_sums_against_search():
    """A gap is filled exactly whenever one, two or three sizes in stock have that sum."""
    from collections import Counter
    from itertools import combinations_with_replacement

    r = random.Random(8)
    for _ in range(60):
        cap = r.randint(3, 40)
        counts = {s: r.randint(1, 3) for s in r.sample(range(1, cap + 1), r.randint(1, min(cap, 9)))}
        sums = P.Sums(counts, cap)
        left = Counter(counts)
        while +left:
            for gap in range(1, cap + 1):
                possible = any(sum(c) == gap and not Counter(c) - left for k in (1, 2, 3) for c in combinations_with_replacement(sorted(+left), k))
                found = sums.fill(gap, Counter())
                assert bool(found) == possible and (not found or sum(found) == gap and not Counter(found) - left), (left, gap, found)
            gone = Counter([r.choice(sorted((+left).elements()))])
            sums.use(gone, 1)
            left -= gone


def test_pack(spark):
    r = random.Random(9)
    rows = [(i, r.randint(1, 30), "a") for i in range(500)] + [(500, 0, "a"), (501, None, "a"), (502, 95, "a"), (503, 20, None), (503, 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, part string")
    got = P.pack(df, capacity=40).collect()
    assert sorted(x["doc_id"] for x in got if x["doc_id"] != 502) == sorted(x[0] for x in rows if x[0] != 502)
    assert sorted(x["n_tokens"] for x in got if x["doc_id"] == 502) == [15, 40, 40]
    used = {}
    for x in got:
        used[x["container_id"]] = used.get(x["container_id"], 0) + x["n_tokens"]
    assert max(used.values()) <= 40 and set(used) == set(range(len(used)))
    assert len(used) <= -(-sum(used.values()) // 40) + 1
    assert P.pack(df.limit(0)).count() == 0
    assert {x["container_id"] for x in P.pack(df.where("doc_id in (500, 501)"), capacity=40).collect()} == {0}
