import numpy as np
from pyspark.sql import functions as F

from tieout.functions import money
from tieout.operators import estimate
from tieout.queries import reconcile, texts


def test_every_statement_is_fitted(spark, tiny):
    p = spark.read.parquet(f"{tiny}/paycheck.parquet")
    got = texts.identity_solve(spark, tiny)
    assert got.count() == p.count()
    # Statements that the first identity can't judge, or finds no fault with.
    rest = got.join(p.where("not coalesce(abs(gross - total_deductions - net_pay) > 2, false)").select("rec_id"), "rec_id")
    assert rest.where(F.size("fitted") > 0).count() > 0
    assert rest.where("suspect is not null").count() > 0


def test_many_fits_are_those_of_one(spark, tiny):
    p = spark.read.parquet(f"{tiny}/paycheck.parquet").select(*estimate.FIELDS).toPandas().to_numpy(dtype=float, na_value=np.nan)
    x, sd, _ = estimate.fit_many(p)
    for y, fitted, spread in zip(p, x, sd):
        one, one_sd, _ = estimate.fit_one({f: v for f, v in zip(estimate.FIELDS, y) if v == v})
        assert one.keys() == {f for f, v in zip(estimate.FIELDS, fitted) if v == v}
        assert all(abs(one[f] - fitted[i]) < 0.011 and abs(one_sd[f] - spread[i]) < 0.0002 for i, f in enumerate(estimate.FIELDS) if f in one)


def test_alternatives_are_the_misreadings(spark):
    for v in (1500.0, 0.0, -12.34, 7.05, 123456.78):
        want = spark.range(1).select(money.misreadings(F.lit(v), 400)).first()[0]
        got = estimate.alternatives(v)
        assert sorted((round(x, 2), round(w, 6)) for x, w in got) == sorted((x.value, round(x.weight, 6)) for x in want)


def test_what_was_read_is_a_candidate(spark):
    kind = "k int, " + ", ".join(f"{f} double" for f in (*estimate.FIELDS, *estimate.UNFITTED)) + ", e double"
    rest = {"federal": 100.0, "state": 50.0, "social_security": 93.0, "medicare": 21.75, "retirement": 35.25, "other_total": 0.0, "total_deductions": 300.0}
    figures = [
        (1, rest | {"gross": 1500.0, "net_pay": 1200.0}, 1400.0),  # a raise: all ties
        (2, rest | {"gross": 1500.0, "net_pay": 1500.0}, 1800.0),  # 8 read as 5
        (3, rest | {"gross": 1500.0, "net_pay": 1200.0, "federal": 600.0}, 1500.0),  # gross is as expected
        (4, {"gross": 1500.0}, 1501.0),  # nothing is in doubt
    ]
    rows = spark.createDataFrame([(k, *(x.get(f) for f in (*estimate.FIELDS, *estimate.UNFITTED)), e) for k, x, e in figures], kind)
    got = {(r.k, r.field): r for r in estimate.readings(rows, "k", {"gross": ("e", 10.0)}).collect()}
    assert got[1, "gross"].value == 1500.0
    assert got[2, "gross"].value == 1800.0 and got[2, "gross"].decisive
    assert {k for k, _ in got} == {1, 2, 3} and (3, "gross") not in got


def test_likely_reading_of_all_fields(spark, tiny):
    got = texts.likely_reading(spark, tiny)
    assert {"gross", "retirement", "net_pay"} <= {r.field for r in got.select("field").distinct().collect()}
    read = spark.read.parquet(f"{tiny}/paycheck.parquet").select("rec_id", F.col("gross").alias("read"))
    assert got.where("field = 'gross'").join(read, "rec_id").where("value = read").count() > 0


def test_intervals_widen_with_doubt(spark):
    rows = spark.createDataFrame([(1, 1000.0, 1100.0, 100.0, 12, 0.0), (2, 1000.0, 1100.0, 100.0, 12, 0.5), (3, 1000.0, 1050.0, 100.0, 24, 0.0)], "k int, b double, a double, p double, pp int, bad double")
    got = {r.k: r for r in estimate.intervals(rows, ["k"], "b", "a", "p", 0.05, periods="pp", before_bad="bad", after_bad="bad").collect()}
    assert got[1].high - got[1].low < 0.5 and got[1].material == 0
    # Of the misreadings of both 3.19 of 6.19 by weight are off by over 25: 1 - (1 - 0.5 * 0.515) ** 2, less what cancels out.
    assert got[2].high - got[2].low > 25 and 0.4 < got[2].material < 0.46
    # Two pays a month: the deviations double too.
    assert abs((got[3].high - got[3].low) / (got[1].high - got[1].low) - 2) < 0.01 and abs(got[3].low) < 0.5
    # The draws of numpy's own choice.
    rng = np.random.default_rng(12345)
    v, w = np.array(estimate.alternatives(1000.0, 40)).T
    noise, other, bad = rng.normal(0, 0.05, 4000), rng.choice(v, 4000, p=w / w.sum()), rng.random(4000) < 0.5
    assert np.allclose(estimate.drawn(1000.0, 0.5, 0.05, *estimate.draw(4000, 12345, [True, True])[0]), np.where(bad, other, 1000.0 + noise))


def test_wrong_shares():
    seen = np.full((3, len(estimate.FIELDS)), np.nan)
    at = [estimate.FIELDS.index(f) for f in ("gross", "total_deductions", "net_pay")]
    seen[0, at], seen[1, at], seen[2, at[2]] = (9000.0, 2000.0, 7000.0), (9000.0, 2000.0, 1000.0), 7000.0
    tied, broken, alone = estimate.wrong_shares(seen, "net_pay", 0)
    assert tied == 0 and 0 < broken <= 1 and alone == estimate.OUTLIER_RATE


def test_intervals_of_all_employees(spark, tiny):
    got = texts.monte_carlo(spark, tiny)
    e = reconcile.measures(spark, tiny).where("gap is not null")
    assert got.count() == e.count() and got.join(e.where("abs(gap) <= 2"), ["pack_id", "id"]).count() > 0
    assert got.select(F.round(F.col("high") - F.col("low"), 2)).distinct().count() > 5


def test_deviations(spark):
    df = spark.createDataFrame([("gross", False, False), ("gross", True, None), ("fee", True, False), ("federal", True, True), (None, None, None)], "f string, d boolean, p boolean")
    got = [r.sd for r in df.select(estimate.observation_sd(F.col("f"), {"gross": 0.2, "federal": 0.3}, F.col("d"), F.col("p")).alias("sd")).collect()]
    assert got == [0.2, 0.4, 0.1, 0.05, 0.05]


def test_decisive_readings_are_corrected_once(spark, tiny):
    from tieout.queries import doubt, full

    asked = doubt.uncertainty(spark, tiny)
    assert asked.where("abs(identity_gap) <= 2").count() == 0
    plain = {(r.pack_id, r.id): r for r in full.measures_all(spark, tiny).collect()}
    got = doubt.corrected_measures(spark, tiny).collect()
    assert {(r.pack_id, r.id) for r in got} == plain.keys() and len(got) == len(plain)
    same = lambda r: all(r[c] == plain[r.pack_id, r.id][c] for c in full.MEASURES)
    assert all(same(r) for r in got if not r.n_corrected)
    changed = {(r.pack_id, r.id) for r in got if r.n_corrected}
    assert changed <= {(r.pack_id, r.id) for r in asked.collect()}
