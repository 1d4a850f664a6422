"""Filling containers of fixed capacity with items: minimum bin slack by bitset subset sums."""

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that one task fills: about so many, so that a shard's histogram and loop stay small at any size of data.
SHARD = 512


def fullest(counts: Counter, capacity: int, seed: int) -> list[int]:
    """The lengths of the fullest container that holds ``seed``, from a histogram of lengths without it.

    A bitset has bit s set if some combination sums to s. Lengths enter from the longest down, each in powers of two of
    its count; it ends once the container can be full. The combination is read back from the sets before each entry."""
    room = capacity - seed
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [seed]
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * k
            at -= length * k
    return out


def fill(lengths: list[int], capacity: int) -> list[int]:
    """A container number for each length, all between 1 and ``capacity``: the longest item left opens a container, the
    fullest combination with it is taken out, as often as the histogram holds it, until nothing is left."""
    counts = Counter(lengths)
    waiting: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        waiting.setdefault(x, []).append(i)
    out, number = [0] * len(lengths), 0
    for seed in sorted(counts, reverse=True):
        while counts.get(seed):
            counts[seed] -= 1
            if not counts[seed]:
                del counts[seed]
            chosen = Counter(fullest(counts, capacity, seed))
            counts[seed] += 1
            for _ in range(min(counts[x] // n for x, n in chosen.items())):
                for x, n in chosen.items():
                    counts[x] -= n
                    for _ in range(n):
                        out[waiting[x].pop()] = number
                number += 1
            for x in chosen:
                if not counts[x]:
                    del counts[x]
    return out


PACKED = "limit_name string, doc_id long, piece int, token_start long, n_tokens long, container_id string"


def packed(sizes: DataFrame, limits: DataFrame, shard: int = SHARD) -> DataFrame:
    """PACKED of ``sizes`` (doc_id, n_tokens) for each of ``limits`` (limit_name, capacity_tokens): the container of
    every item. An item over the capacity fills containers of its own, and its rest is an item as any other; no other is
    split. Items without tokens lie in the first container of their shard. A null size counts as 0; a null or
    non-positive capacity is an error. Items of equal size are interchangeable; repeated doc_ids are items of their own.

    Items are spread over shards by a hash, as many as the total needs at ``shard`` containers each, so that tasks are
    equal whatever the documents are; a shard leaves at most its last containers unfilled. Only sizes are shuffled."""
    named = [(r.limit_name, r.capacity_tokens) for r in limits.select("limit_name", "capacity_tokens").collect()]
    if any(c is None or c <= 0 for _, c in named):
        raise ValueError("capacities must be positive")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    spark = sizes.sparkSession
    if not named:
        return spark.createDataFrame([], PACKED)
    # The limits are a few literals beside every item, not a join.
    known = F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(c).cast("long").alias("capacity"), F.lit(max(1, math.ceil(total / (c * shard)))).cast("long").alias("shards")) for n, c in named))
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), F.explode(known).alias("l")).select("doc_id", "n", "l.*")
    whole = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / F.col("capacity"))
    placed = items.withColumns({"whole": whole.cast("long"), "shard": F.pmod(F.xxhash64("doc_id", "n"), "shards")})
    own = placed.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    alone = own.select("limit_name", "doc_id", F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "doc_id", "k").alias("container_id"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        capacity, at = int(df["capacity"].iloc[0]), int(df["shard"].iloc[0])
        some = df["n_tokens"] > 0
        numbers = fill(df["n_tokens"][some].astype(int).tolist(), capacity) + [0] * int((~some).sum())
        return df.assign(container_id=[f"{at}-{i}" for i in numbers])[["limit_name", "doc_id", "piece", "token_start", "n_tokens", "container_id"]]

    rest = placed.select("limit_name", "doc_id", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("capacity")).alias("token_start"), (F.col("n") - F.col("whole") * F.col("capacity")).alias("n_tokens"), "capacity", "shard")
    return alone.unionByName(rest.groupBy("limit_name", "shard").applyInPandas(run, PACKED))
