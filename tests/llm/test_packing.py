from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tieout.llm.packing import fill, fullest, packed
from tieout.llm.tokens import DEFAULT, encoding, sizes


@given(st.lists(st.integers(1, 30), max_size=9), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_fullest_against_all_subsets(others, seed):
    best = max(sum(c) for n in range(len(others) + 1) for c in combinations(others, n) if sum(c) + seed <= 40)
    got = fullest(Counter(others), 40, seed)
    assert sum(got) - seed == best and not Counter(got) - Counter([*others, seed])


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_fill_keeps_to_capacity(lengths):
    got = fill(lengths, 50)
    load = Counter()
    for i, x in zip(got, lengths):
        load[i] += x
    assert all(v <= 50 for v in load.values()) and set(load) == set(range(len(load)))
    assert len(load) <= max(1, 2 * -(-sum(lengths) // 50))


def test_packed(spark):
    rows = spark.createDataFrame([(1, 25), (2, 6), (3, 4), (4, 0), (5, None), (6, 10), (7, 10), (8, 20)], "doc_id long, n_tokens long")
    limits = spark.createDataFrame([("s", 10), ("m", 12)], "limit_name string, capacity_tokens int")
    got = packed(rows, limits).collect()
    for name, cap in (("s", 10), ("m", 12)):
        mine = [r for r in got if r.limit_name == name]
        load = Counter()
        for r in mine:
            load[r.container_id] += r.n_tokens
        assert max(load.values()) <= cap
        by = Counter()
        for r in mine:
            by[r.doc_id] += r.n_tokens
        assert by == Counter({1: 25, 2: 6, 3: 4, 6: 10, 7: 10, 8: 20, 4: 0, 5: 0}) and {r.doc_id for r in mine} == set(range(1, 9))
        assert sorted(r.piece for r in mine if r.doc_id == 1) == [0, 1, 2]
        assert all(len([r for r in mine if r.doc_id == d]) == 1 for d in (2, 3, 4, 5, 6, 7))
    short = [r for r in got if r.limit_name == "s"]
    assert len({r.container_id for r in short}) == 8  # 75 tokens in containers of 10


def test_packed_edges(spark):
    rows = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long")
    limits = spark.createDataFrame([("s", 10)], "limit_name string, capacity_tokens int")
    assert packed(rows.limit(0), limits).count() == 0 and packed(rows, limits.limit(0)).count() == 0
    assert packed(rows.unionAll(rows), limits).count() == 2
    with pytest.raises(ValueError):
        packed(rows, spark.createDataFrame([("s", 0)], "limit_name string, capacity_tokens int"))


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 20000, "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in sizes(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(encoding(DEFAULT).encode_ordinary("word " * 20000))
