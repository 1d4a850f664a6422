import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tieout.llm.splitting import boundary_levels, cut_texts, pieces, starts, successors
from tieout.llm.tokens import encoding

ENC = encoding()
TEXTS = st.lists(st.sampled_from(["word ", "Sentence ends. ", "\n\n", "line\n", "žluťoučký ", "日本語", "aGVsbG8gd29ybGQ", "  ", "!", "12,345.67 ", "🙂"]), min_size=1, max_size=120).map("".join)


def check(text, capacity, overlap):
    tokens = ENC.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    rows = list(cut_texts([(7, text.encode(), tokens)], ("x", capacity, overlap)))
    if len(tokens) <= capacity:
        assert not rows
        return
    assert rows[0][3] == 0 and rows[-1][4] == len(tokens) and [r[2] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r[5] <= capacity and text[r[6] : r[7]] == r[8]
    for p, q in zip(rows, rows[1:]):
        assert p[3] < q[3] <= p[4] - overlap and q[4] > p[4]
    assert "".join(r[8][(rows[i - 1][7] - r[6]) if i else 0 :] for i, r in enumerate(rows)) == text


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_nothing_lost(text):
    check(text, 32, 8)
    check(text, 40, 0)


def test_long_text_without_blanks():
    check("abcdefghij" * 3000, 256, 32)
    check("é" * 4000, 64, 16)


def test_natural_boundaries():
    text = "One two three four. " * 3 + "\n\n" + "Five six seven. " * 12
    tokens = ENC.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
    rows = list(cut_texts([(1, text.encode(), tokens)], ("x", 24, 0)))
    assert all(r[8].rstrip().endswith(".") for r in rows if r[8].strip())
    assert rows[0][8].endswith("\n\n") or rows[0][8].rstrip().endswith("four.")


def test_doubling_visits_what_steps_do():
    rng = np.random.default_rng(3)
    n = 400
    follow = np.minimum(np.arange(n) + rng.integers(1, 9, n), n - 1)
    at, want = 0, {0}
    while follow[at] != at:
        at = int(follow[at])
        want.add(at)
    assert set(starts(follow, np.array([0])).tolist()) == want


def test_successors_progress():
    levels = boundary_levels(ENC.encode_to_numpy("x" * 5000, disallowed_special=()).astype(np.int64))
    end, follow = successors(levels, 64, 16)
    at = np.arange(len(levels))
    assert (end[:-1] > at[:-1]).all() and (follow[:-1] > at[:-1]).all() and follow[-1] == at[-1]


def test_pieces(spark):
    docs = spark.createDataFrame([(1, "short", 1), (2, "word " * 700, 1), (3, None, 1), (4, "", 1), (5, "word " * 700, 1)], "doc_id long, text string, piece int")
    limits = spark.createDataFrame([("a", 256, 32), ("b", 64, 0)], "limit_name string, capacity_tokens int, overlap_tokens int")
    got = pieces(docs, limits).collect()
    assert {r.doc_id for r in got} == {2, 5} and {r.limit_name for r in got} == {"a", "b"}
    assert [r.text for r in got if r.doc_id == 2] == [r.text for r in got if r.doc_id == 5]
    assert pieces(docs.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        pieces(docs, spark.createDataFrame([("a", 10, 5)], "limit_name string, capacity_tokens int, overlap_tokens int"))
