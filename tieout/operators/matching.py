"""Joins of records: last and first wins, tiers of keys, orphans, near hashes, codes by sets."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null key are left out. An aggregate, combined before the
    shuffle, where ``order`` and the rest travel as one struct, so a hot key gathers nowhere."""
    rest = [c for c in rows.columns if c not in key]
    some = rows.dropna(subset=list(key))
    picked = some.groupBy(*key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_r"))
    return picked.select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in rest))


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str], position: str = "position") -> DataFrame:
    """One row per key, the last by ``order``, at the place of the key's first row; rows with a null or blank key are
    never merged. ``position`` is the first row's order as a struct."""
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in key))
    rest = [c for c in rows.columns if c not in key and c not in order]
    merged = rows.where(~blank).groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"), F.min(F.struct(*order)).alias(position))
    out = merged.select(*key, *(F.col(f"_r.`{c}`").alias(c) for c in (*order, *rest)), position)
    return out.unionByName(rows.where(blank).withColumn(position, F.struct(*order)))


def tiered(left: DataFrame, right: DataFrame, tiers: Sequence[tuple[Column, Column]], *, left_id: str, right_id: str, within: str, order: Sequence[str]) -> DataFrame:
    """(left_id, right_id, tier): each left row with the right row of the first tier of keys that finds one, all within
    ``within``; null where none does. On each key the first right row by ``order`` stands. A right row may be found by
    several left rows. Null keys find nothing."""
    out = left.select(left_id, within, *(k.alias(f"_k{i}") for i, (k, _) in enumerate(tiers)))
    for i, (_, key) in enumerate(tiers):
        found = right.select(F.col(within).alias("_w"), key.alias("_key"), F.struct(*dict.fromkeys([*order, right_id])).alias("_o")).dropna(subset=["_key"]).groupBy("_w", "_key").agg(F.min("_o").alias("_o"))
        found = found.select("_w", "_key", F.col(f"_o.{right_id}").alias(f"_r{i}"))
        out = out.join(found, (out[within] == found["_w"]) & (out[f"_k{i}"] == found["_key"]), "left").drop("_w", "_key")
    hit = F.coalesce(*(F.col(f"_r{i}") for i in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.col(f"_r{i}").isNotNull(), i + 1) for i in range(len(tiers))))
    return out.select(left_id, hit.alias(right_id), tier.alias("tier"))


def near_hashes(rows: DataFrame, key: Sequence[str], hash_: str, id_: str, most: int = 4, bits: int = 32) -> DataFrame:
    """(id_, near_id, distance): for each row the nearest other row with equal ``key`` whose hash differs in at most
    ``most`` bits, of equals the smallest id. Exact: with one more band of bits than may differ, some band is equal, so
    rows meet by an equi-join on bands. Rows with equal hashes are one row of the join, whatever their number."""
    bands = most + 1
    width = -(-bits // bands)
    one = rows.dropna(subset=[hash_]).groupBy(*key, hash_).agg(F.min(id_).alias("_least"))
    banded = one.withColumn("_band", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.shiftright(F.col(hash_), i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v")) for i in range(bands)))))
    a = banded.select(*key, "_band", F.col(hash_).alias("_ha"))
    b = banded.select(*key, "_band", F.col(hash_).alias("_hb"), F.col("_least").alias("_ib"))
    pairs = a.join(b, [*key, "_band"]).where("_ha <> _hb").withColumn("_d", F.bit_count(F.col("_ha").bitwiseXOR(F.col("_hb")))).where(F.col("_d") <= most)
    best = pairs.groupBy(*key, "_ha").agg(F.min(F.struct("_d", "_ib")).alias("_best"))
    second = rows.dropna(subset=[hash_]).groupBy(*key, hash_).agg(F.min(id_).alias("_m"), F.count("*").alias("_n"))
    nxt = rows.join(second, [*key, hash_]).where(F.col(id_) > F.col("_m")).groupBy(*key, hash_).agg(F.min(id_).alias("_second"))
    own = rows.join(second, [*key, hash_]).join(nxt, [*key, hash_], "left").join(best.withColumnRenamed("_ha", hash_), [*key, hash_], "left")
    twin = F.when(F.col("_n") > 1, F.when(F.col(id_) == F.col("_m"), F.col("_second")).otherwise(F.col("_m")))
    return own.select(id_, F.coalesce(twin, F.col("_best._ib")).alias("near_id"), F.when(twin.isNotNull(), 0).otherwise(F.col("_best._d")).cast("int").alias("distance")).where("near_id is not null")


def new_codes(before: DataFrame, after: DataFrame, within: str, code: str, amount: str) -> DataFrame:
    """(within, code, total, part): the codes that only the later run has, with their totals: ``reimbursement`` if it
    undoes another new code, ``premium`` for the greatest positive, ``fee`` for the rest."""
    fresh = after.groupBy(within, code).agg(F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("total")).join(before.select(within, code).distinct(), [within, code], "left_anti")
    top = fresh.groupBy(within).agg(F.max(F.struct("total", code)).alias("_top"))
    undone = fresh.select(within, F.round("total", 2).alias("_back")).where("_back > 0").distinct()
    back = F.round(-F.col("total"), 2)
    out = fresh.join(top, within).join(undone.withColumnRenamed(within, "_w"), (F.col(within) == F.col("_w")) & (back == F.col("_back")), "left")
    part = F.when((F.col("total") < 0) & F.col("_back").isNotNull(), "reimbursement").when((F.col("total") > 0) & (F.col(f"_top.{code}") == F.col(code)), "premium").otherwise("fee")
    return out.select(within, code, "total", part.alias("part"))


def same_payers(rows: DataFrame, within: str, code: str, payer: str, amount: str) -> DataFrame:
    """(within, code_a, code_b, n_payers): pairs of codes, a < b, that the same payers pay in the same amounts. The sets
    are compared by digests of their sorted members, so that the join carries no sets."""
    one = rows.groupBy(within, code, payer).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("_s"))
    sets = one.groupBy(within, code).agg(
        F.count("*").alias("n_payers"),
        F.sum(F.xxhash64(payer, F.abs("_s")).cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor(F.xxhash64(F.lit(7), payer, F.abs("_s"))).alias("_xor"),
    )
    a, b = sets.withColumnRenamed(code, "code_a"), sets.withColumnRenamed(code, "code_b")
    return a.join(b, [within, "n_payers", "_sum", "_xor"]).where("code_a < code_b").select(within, "code_a", "code_b", "n_payers")


def accounted(expected: DataFrame, found: DataFrame, within: str, amount: str, near: float = 1.0) -> DataFrame:
    """``expected`` with ``state``: ``exact`` if ``found`` has the amount to the cent in the same ``within``, ``near`` if it
    has one within ``near``, ``missing`` else; null amounts are ``unknown``. The range meets by an equi-join on whole
    steps of ``near`` and their neighbours; amounts are distinct before it, so that copies don't multiply."""
    have = found.select(F.col(within).alias("_w"), F.col(amount).cast("decimal(18,2)").alias("_v")).dropna().distinct().withColumn("_s", F.floor(F.col("_v").cast("double") / near).cast("long"))
    asked = expected.select(within, F.col(amount).cast("decimal(18,2)").alias("_a")).dropna().distinct()
    wide = asked.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a").cast("double") / near).cast("long") - 1, F.floor(F.col("_a").cast("double") / near).cast("long") + 1)))
    best = wide.join(have, (F.col(within) == F.col("_w")) & (wide["_s"] == have["_s"])).groupBy(within, "_a").agg(F.min(F.abs(F.col("_a") - F.col("_v"))).alias("_d"))
    best = best.select(F.col(within).alias("_w"), F.col("_a").alias("_amount"), "_d")
    out = expected.join(best, (F.col(within) == F.col("_w")) & (F.col(amount).cast("decimal(18,2)") == F.col("_amount")), "left")
    state = F.when(F.col(amount).isNull(), "unknown").when(F.col("_d") == 0, "exact").when(F.col("_d") <= near, "near").otherwise("missing")
    return out.withColumn("state", state).drop("_w", "_amount", "_d")
