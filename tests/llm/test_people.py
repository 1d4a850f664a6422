import math
import random

import numpy as np
import pytest

from tieout.llm import entities, names, queries, variants
from tieout.llm.components import components
from tieout.llm.people import employee_groups
from tieout.llm.survivor import name_votes, survivors
from tieout.llm.variants import alike_names, linked

CENSUS = "pack_id long, rec_id long, employee_id string, employee_first_name string, employee_last_name string, gross_annual_taxable_wages double, group_health_monthly double, other_monthly_pretax double, retirement_401k_monthly double"


def test_groups(spark):
    rows = [
        (1, 10, "0012", "Anna", "Lee", 100.0, 5.0, None, None), (1, 11, "12.0", "Anna", "Leigh", 100.0, 5.0, None, None), (1, 5, None, "ANNA", "Lee", 100.0, None, None, None), (1, 12, "N/A", "Bo", "Ray", 50.0, None, None, None),
        (1, 13, None, "bo", "ray", 50.0, None, None, None), (2, 20, "12", "Cy", "Day", 1.0, None, None, None), (1, 14, None, None, None, None, None, None, None), (1, 15, None, "", " ", None, None, None, None), (None, 16, "12", "x", "y", None, None, None, None),
    ]
    got = {r.rec_id: r.group_id for r in employee_groups(spark.createDataFrame(rows, CENSUS)).collect()}
    assert got == {10: 5, 11: 5, 5: 5, 12: 12, 13: 12, 20: 20, 14: 14, 15: 15, 16: 16}
    assert employee_groups(spark.createDataFrame([], CENSUS)).count() == 0


def vote(*values, freq=1):
    rows = [(v, str(i), 1, f"{i:03d}", freq) for i, v in enumerate(values)]
    score = {}
    for v, _, w, _ in name_votes(rows):
        score[v] = score.get(v, 0) + w
    return max(score, key=lambda v: (score[v], v), default=None)


@pytest.mark.parametrize("values,want", [(("Pat", "Patricia", "Patric1a"), "Patricia"), (("Ravum", "Ravumlund"), "Ravumlund"), (("Ulmumkova", "Orrolund", "Orrolund"), "Orrolund"), (("CHARLES", "Charles"), "Charles"), (("UlmÃ\xadtvedt", "UlmÃ\xadtvedt", "Ulmítvedt"), "Ulmítvedt"), (("Osksson", "Oskssson", "Osksson"), "Osksson"), ((None, "", " "), None), (("Elkw?rth", "Elkworth"), "Elkworth"), (("Ulmarby-Osklow", "Ulmarby?Osklow"), "Ulmarby-Osklow"), (("R", "Raymond", "raymond"), "Raymond")])
def test_name_votes(values, want):
    assert vote(*values) == want


def test_survivors(spark):
    rows = spark.createDataFrame(
        [(1, "a", "1", "Ann", "10"), (1, "b", "2", "ANN", "11"), (1, "b", "3", "Anne", "12"), (2, "a", "1", None, None), (3, "c", "1", "Solo", "9"), (1, "a", "1", "Ann", "10")],
        "g long, src string, seq string, name string, pay string",
    )
    got = {r.group_id: r for r in survivors(rows, {"name": "name", "pay": "plain"}, group="g", source="src", last="seq").collect()}
    assert set(got) == {1, 2, 3} and got[1].name in ("Ann", "Anne") and got[1].pay == "12" and got[2].name is None and got[3].pay == "9"


def test_trust_decides(spark):
    """Two sources say different things of the disputed groups; a third shows elsewhere which of them can be trusted."""
    rows = [(g, src, "1", v) for g in range(20) for src, v in (("good", f"v{g}"), ("bad", f"x{g}"), ("third", f"v{g}"))]
    rows += [(g, src, "1", v) for g in range(100, 130) for src, v in (("good", f"v{g}"), ("bad", f"x{g}"))]
    df = spark.createDataFrame(rows, "g long, src string, seq string, state string")
    say = lambda **k: {r.group_id: r.state for r in survivors(df, {"state": "plain"}, group="g", source="src", last="seq", **k).collect()}
    truth = {g: f"v{g}" for g in (*range(20), *range(100, 130))}
    assert say() == truth
    untrusting = say(rounds=0)
    assert all(untrusting[g] == f"x{g}" for g in range(100, 130))
    with pytest.raises(RuntimeError):
        say(rounds=1, settled=-1.0)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    home = {}

    def root(x):
        home.setdefault(x, x)
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        home[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: root(x) for x in home}
    assert components(df.limit(0)).count() == 0


def test_alike_names_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    first, last = ["Robert", "Anna", "Gwendolyn", "Samuel"], ["Ulmerdorf", "Hargecroft", "Zolenquist", "Branlow", "Wendhagen"]
    left = [(i % 2, f"{rng.choice(first)} {rng.choice(last)}") for i in range(30)]
    right = []
    for w, n in left:
        i = rng.randrange(len(n))
        right.append((w, n[:i] + n[i + 1 :]))
    nodes = spark.createDataFrame([(*x, 0) for x in left] + [(*x, 1) for x in right] + [(0, "", 1), (0, None, 0)], "w int, name string, side int")
    every = {(w, *sorted((x, y))) for w, x in left + right for v, y in right if w == v}
    want = {p for p in every if names.name_likeness(names.tokens(p[1]), names.tokens(p[2])) >= 0.9}
    got = {(r.w, r.a, r.b) for r in alike_names(nodes, within="w", least=0.9).collect()}
    assert len(got & want) >= 0.97 * len(want) and got <= want
    monkeypatch.setattr(variants, "CELL", 3)
    assert {(r.w, r.a, r.b) for r in alike_names(nodes, within="w", least=0.9).collect()} == got


NODES = "pack_id long, node long, side int, name string, pay double"


def test_variants_meet_through_a_third(spark):
    a, b, c = "Robert Ulmerdorf", "Bob Ulmerdorf", "Bqob Ulmerdorf"
    apart = [names.compared(names.tokens(x), names.tokens(y))[1] for x, y in ((a, b), (b, c), (a, c))]
    assert apart[0] >= variants.WORST and apart[2] < variants.WORST_WITH_PAY <= apart[1]
    rows = [(1, 10, 0, a, 50000.0), (1, 20, 1, b, 50000.0), (1, 21, 1, c, 50000.0), (1, 11, 0, "Vera Quennell", 41000.0), (1, 22, 1, "V. Quennell", 41000.0), (1, 23, 1, "Yoram Zolen", None), (2, 24, 1, b, 50000.0)]
    got = {r.node: r.component for r in linked(spark.createDataFrame(rows, NODES), within="pack_id").collect()}
    assert got == {10: 10, 20: 10, 21: 10, 11: 11, 22: 11}


def test_conflicts_are_split(spark):
    rows = [
        (1, 10, 0, "Anna Ulmerdorf", 50000.0), (1, 11, 0, "Anne Ulmerdorf", 52000.0), (1, 20, 1, "Ann Ulmerdorf", None), (1, 21, 1, "Anna Ulmerdorf", 50000.0), (1, 22, 1, "Anne Ulmerdorf", 52000.0), (1, 23, 1, "Anna Ulmerdorf", None),
    ]
    got = {r.node: r.component for r in linked(spark.createDataFrame(rows, NODES), within="pack_id").collect()}
    assert got[10] == got[21] == got[23] == 10 and got[11] == got[22] == 11 and got[20] in (10, 11)
    assert linked(spark.createDataFrame([], NODES), within="pack_id").count() == 0


def test_index_recall_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    syllables = ["har", "zol", "bran", "quen", "ulm", "wend", "orr", "kes", "nev", "dask", "lund", "croft", "shaw", "mere", "fell", "by"]
    firsts = list(names.NICKNAMES)[:30]
    people = [f"{rng.choice(firsts)} {''.join(rng.choice(syllables) for _ in range(3))}" for _ in range(900)]

    def dirt(n):
        i = rng.randrange(len(n))
        return n[:i] + n[i + 1 :] if rng.random() < 0.5 else n.upper()

    rows = [(1, 0, i, n, [30000 + i], 1800) for i, n in enumerate(people)] + [(1, 1, 10_000 + i, dirt(n), [], 1800) for i, n in enumerate(people)]
    monkeypatch.setattr(entities, "BLOCK", 120)
    assert entities.bits_for(1800) == 4
    index = entities.Index([entities.record_tokens(r[3], r[4]) for r in rows[::3]])
    shapes = spark.createDataFrame(rows, "pack_id long, side int, shape long, name string, pays array<int>, size long")
    import pyarrow as pa

    table = pa.Table.from_pandas(shapes.toPandas()).to_batches(max_chunksize=500)
    signed = pa.Table.from_batches(list(entities.signer(index)(iter(table)))).sort_by([("pack_id", "ascending"), ("tab", "ascending"), ("bucket", "ascending")])
    pairs = [p for b in entities.block_pairs(index)(iter(signed.to_batches(max_chunksize=300))) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(pairs) == len(set(pairs))
    true = {(i, 10_000 + i) for i in range(len(people))}
    assert len(true & set(pairs)) >= 0.9 * len(true)


@pytest.mark.parametrize("bits", [4, 11, 14, 16])
def test_tables_hold_their_recall(bits):
    """Pairs at the cosine that the tables are made for meet in one, however many hyperplanes a table has."""
    rng = np.random.default_rng(bits)
    a = rng.standard_normal((1500, entities.DIM))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = entities.COSINE * a + math.sqrt(1 - entities.COSINE**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    index, n = entities.Index([]), entities.tables_for(bits)
    x, y = (index.buckets(np.round(v * 127).astype(np.int8), bits, n) for v in (a, b))
    assert (x == y).any(axis=1).mean() >= 0.99
    # A record falls into the same buckets wherever it is asked: alone, in a batch, for fewer tables.
    assert (index.buckets(np.round(a[:3] * 127).astype(np.int8), bits, n - 1) == x[:3, :-1]).all()


def test_training_finds_what_letters_do_not(monkeypatch):
    """Forenames with unlisted short forms, which only records of equal pay tie together: with vectors that no walk has
    trained, fewer of the held-out people find their other spelling."""
    rng = random.Random(3)
    syllables = ["har", "zol", "bran", "quen", "ulm", "wend", "orr", "kes", "nev", "dask", "lund", "croft", "shaw", "mere", "fell", "by", "tor", "vig"]
    firsts = list(names.NICKNAMES)
    short = {f: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(2)) for f in firsts}
    people = [(rng.choice(firsts), "".join(rng.choice(syllables) for _ in range(3)), 30000 + 7 * i) for i in range(1000)]
    one = [f"{f} {last}" for f, last, _ in people]
    two = [f"{short[f]} {last[1:]}" for f, last, _ in people]
    sample = [entities.record_tokens(n, [p]) for side in (one, two) for n, (_, _, p) in list(zip(side, people))[:700]]

    def first_hits(index):
        none = np.zeros(0, np.int64), np.zeros(300, np.int64)
        c = index.vectors(two[700:], *none) @ index.vectors(one[700:], *none).T
        return float((c.argmax(axis=1) == np.arange(300)).mean())

    trained = first_hits(entities.Index(sample))
    monkeypatch.setattr(entities, "train", lambda records: {t: entities.base_vector(t) for r in records for t in r})
    assert trained >= first_hits(entities.Index(sample)) + 0.2


SHAPES = "pack_id long, side int, shape long, name string, pays array<int>, size long"


def test_index_is_of_all_records(spark, monkeypatch):
    """Weights and the middle are those of every record, however they are cut into chunks and partitions."""
    rng = random.Random(6)
    sized = {1: 40, 2: 3, 3: 30}
    rows = [(k, i % 2, 100 * k + i, f"{rng.choice(list(names.NICKNAMES))} {rng.choice('bdgk')}{rng.choice('aeio')}lund", [30000 + rng.randrange(20), -5] if i % 7 else [], n) for k, n in sized.items() for i in range(n)]
    rows.append((2, 1, 299, "?", [], 3))
    records = [entities.record_tokens(r[3], r[4]) for r in rows]
    count = {t: sum(t in r for r in records) for t in {t for r in records for t in r if t[:2] != "p:"}}
    monkeypatch.setattr(entities, "CHUNK", 35, raising=False)
    shapes = spark.createDataFrame(rows, SHAPES)
    index = entities.fitted(shapes.repartition(3))
    assert index.weight == pytest.approx({t: math.log(1 + len(rows) / c) for t, c in count.items()}) and set(index.tokens) == set(count)
    pays = np.array([p for r in rows for p in r[4]])
    raw = index.raw([r[3] for r in rows], pays, np.cumsum([len(r[4]) for r in rows]))
    assert np.allclose(index.middle, raw.mean(axis=0), atol=1e-5)
    assert any(not np.allclose(v, index._scaled(t, entities.base_vector(t)), atol=1e-5) for t, v in index.tokens.items())
    again = entities.fitted(shapes.orderBy("name").repartition(2))
    assert all((again.tokens[t] == v).all() for t, v in index.tokens.items()) and (again.middle == index.middle).all()
    assert entities.fitted(shapes.limit(0)).tokens == {}


def test_every_record_is_in_a_chunk(spark, monkeypatch):
    """Counted once; records of a pack that share a reading of pay are trained on together, also where it is split."""
    monkeypatch.setattr(entities, "CHUNK", 10, raising=False)
    rows = [(1, i % 2, i, f"n{i}", [i // 2, 1000 + i // 3], 60) for i in range(59)] + [(1, 0, 59, "n59", [], 60)] + [(2, 0, 60 + i, f"n{60 + i}", [i], 4) for i in range(4)]
    got = entities.chunks(spark.createDataFrame(rows, SHAPES), len(rows)).collect()
    assert sorted(r.name for r in got if r.own) == sorted(r[3] for r in rows) and len({r.chunk for r in got}) > 3
    at = {r[3]: {x.chunk for x in got if x.name == r[3]} for r in rows}
    assert all(at[x[3]] & at[y[3]] for x in rows for y in rows if x[0] == y[0] and set(x[4]) & set(y[4]))
    assert len(set.union(*(at[f"n{60 + i}"] for i in range(4)))) == 1


def test_confidence_is_calibrated(spark):
    """Pairs of a known share of matches in every band, whose pay agrees in four fifths of the matches."""
    rng = random.Random(5)
    rows = []
    for _ in range(30_000):
        s = rng.uniform(-6, 6)
        match = rng.random() < 1 / (1 + math.exp(-2 * s))
        rows.append((s, 2 if rng.random() < (0.8 if match else 0.01) else -1, match))
    df = spark.createDataFrame(rows, "by_name double, pay int, match boolean")
    got = df.withColumn("c", entities.confidence(df)).selectExpr("floor(c * 5) k", "c", "cast(match as int) m").groupBy("k").agg({"c": "avg", "m": "avg", "*": "count"}).collect()
    for r in got:
        assert r["count(1)"] < 300 or abs(r["avg(c)"] - r["avg(m)"]) < 0.12
    assert df.limit(0).select(entities.confidence(df.limit(0))).count() == 0


def test_index_edges():
    index = entities.Index([])
    v = index.vectors(["", "Anna Lee", None, "1"], np.array([5, -3, 7]), np.array([0, 2, 2, 3]))
    assert v.shape == (4, entities.DIM) and np.allclose((v * v).sum(axis=1), [0, 1, 0, 1], atol=1e-5)
    assert entities.tables_for(0) == 1 and entities.bits_for(0) == 0 and entities.tables_for(4) > 1
    assert entities.pay_likeness([100], [103]) == 1 and entities.pay_likeness([], [1]) == 0 and entities.pay_likeness([100], [500]) == -1 and entities.pay_likeness([-7], [-7]) == 2


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.count() > 0


def test_found_columns(spark, tiny):
    want = {"p2_found": [("id_a", "bigint"), ("id_b", "bigint")], "p3_found": [("group_id", "bigint"), ("first_name", "string"), ("last_name", "string")], "p6_found": [("id_a", "bigint"), ("id_b", "bigint")], "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, tiny).dtypes == columns
    pairs = queries.QUERIES["p2_found"](spark, tiny).collect()
    assert len(pairs) == len(set(pairs)) and all(r.id_a < r.id_b for r in pairs)
