"""Best representative of each duplicate group (problem 6).

Within a group a record dominates another if it is at least as good in every measure
(completeness, recency, trust) and better in one. `skyline` finds the undominated records,
`survivor` picks one of them by a lexicographic policy and fills its missing fields from the
following dominance layers.

Completeness takes few values (0 to the number of fields), so the skyline needs no pairs: the
distinct measure vectors of a group are ordered by recency, and for every completeness level a
running maximum of trust tells whether a better vector came before. Groups of more than
`HOT_GROUP` records are first reduced to local skylines in salted parts, which is exact because
a dominated record stays dominated in the whole. The layers of a group are numbered in one pass
over its sorted vectors. No group is collected.

Defined results: null recency and null trust rank lowest; repeated rows (same id) count once;
rows with a null group key, and excluded keys, belong to no group; a group may have one row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import materialize

#: Writings that stand for a missing value (fixed values of the data).
PLACEHOLDERS = ("", "-", "n/a", "na", "none", "null", "tbd", "unknown", "unk", "not stated", "not available", "pending", "?", "--", "nil", "nan", "xxx")
HOT_GROUP = 50_000
SALTS = 64
#: Null trust ranks below every number, infinities included in neither.
LOWEST = -1.7e308


def is_real(c: Column) -> Column:
    """Whether a value is neither null, blank nor a placeholder writing."""
    return F.coalesce(~F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(*PLACEHOLDERS), F.lit(False))


def measured(df: DataFrame, key: str, record: str, recency: str, trust: str, fields: list[str]) -> DataFrame:
    """(key, record, recency, trust, complete) of each distinct record of a group."""
    complete = reduce(lambda a, b: a + b, [is_real(F.col(f)).cast("int") for f in fields], F.lit(0))
    return (
        df.where(F.col(key).isNotNull() & F.col(record).isNotNull())
        .select(
            F.col(key).alias("key"),
            F.col(record).alias("record"),
            F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**63) + 1)).alias("recency"),
            F.coalesce(F.col(trust).cast("double"), F.lit(LOWEST)).alias("trust"),
            complete.alias("complete"),
        )
        .distinct()
    )


def _undominated(df: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Rows of `df` whose vector no vector of the same keys dominates; equal vectors stay together.

    Rows come in descending order of (recency, complete, trust), so only rows before can dominate.
    `_bestN` is the best (trust, recency, complete) so far among rows of completeness N or more:
    if that is not the row's own vector, it dominates the row.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("recency"), F.desc("complete"), F.desc("trust"))
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    vector = F.struct("trust", "recency", "complete")
    best = [F.max(F.when(F.col("complete") >= n, vector)).over(before).alias(f"_best{n}") for n in range(levels + 1)]
    names = [f"_best{n}" for n in range(levels + 1)]
    return df.select("*", *best).where(F.element_at(F.array(*names), F.col("complete") + 1) == vector).drop(*names)


def hot_keys(rows: DataFrame, hot: int) -> DataFrame:
    """Keys of more than `hot` rows; there are at most rows / hot of them."""
    return materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "hot-groups")


def skyline(rows: DataFrame, levels: int, hot: int = HOT_GROUP, salts: int = SALTS) -> DataFrame:
    """Undominated rows of `rows(key, record, recency, trust, complete, ...)`, group by group."""
    large = hot_keys(rows, hot)
    if not large.take(1):
        return _undominated(rows, ["key"], levels)
    cold = rows.join(large, "key", "left_anti")
    parts = rows.join(large, "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)))
    local = _undominated(parts.repartition("key", "salt"), ["key", "salt"], levels).drop("salt")
    return _undominated(cold.unionByName(local), ["key"], levels)


def dominating(rows: DataFrame, levels: int, hot: int = HOT_GROUP) -> DataFrame:
    """(key, record, records): of each group, the record that no other exceeds in any measure, if there is one.

    That is the case exactly when the skyline is a single vector; the smallest record of it is taken.
    """
    vector = F.struct("recency", "trust", "complete")
    best = (
        skyline(rows, levels, hot)
        .groupBy("key")
        .agg(F.min(vector).alias("low"), F.max(vector).alias("high"), F.min("record").alias("record"))
        .where("low = high")
    )
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("records"))
    return best.join(sizes, "key").select("key", "record", "records")


class _Depths:
    """Dominance layers of the vectors of one group, which come sorted as in `_undominated`.

    A vector's layer is the greatest depth (layer + 1) among vectors before it of at least its
    completeness and trust. For each completeness n, `trusts[n]` rises and `depths[n]` falls: the
    steps of that greatest depth by trust. So the state grows with the steps, not with the group.
    """

    def __init__(self, levels: int) -> None:
        self.trusts: list[list[float]] = [[] for _ in range(levels + 1)]
        self.depths: list[list[int]] = [[] for _ in range(levels + 1)]
        self.last: tuple | None = None
        self.at = 0

    def layer(self, recency: int, complete: int, trust: float) -> int:
        trust = float("inf") if trust != trust else trust
        if (recency, complete, trust) == self.last:
            return self.at
        i = bisect_left(self.trusts[complete], trust)
        self.at, self.last = self.depths[complete][i] if i < len(self.trusts[complete]) else 0, (recency, complete, trust)
        for trusts, depths in zip(self.trusts[: complete + 1], self.depths):
            i = bisect_left(trusts, trust)
            if i < len(trusts) and depths[i] > self.at:
                continue
            end = i + (i < len(trusts) and trusts[i] == trust)
            while i and depths[i - 1] <= self.at + 1:
                i -= 1
            trusts[i:end], depths[i:end] = [trust], [self.at + 1]
        return self.at


def numbered(rows: DataFrame, levels: int) -> DataFrame:
    """`rows(key, recency, trust, complete, ...)` with the `layer` of each; groups pass as a stream, none is held."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, depths = None, _Depths(levels)
        for b in batches:
            out = []
            for k, r, c, t in zip(b["key"], b["recency"].tolist(), b["complete"].tolist(), b["trust"].tolist()):
                if k != key:
                    key, depths = k, _Depths(levels)
                out.append(depths.layer(r, c, t))
            yield b.assign(layer=out)

    ordered = rows.repartition("key").sortWithinPartitions("key", F.desc("recency"), F.desc("complete"), F.desc("trust"))
    return ordered.mapInPandas(number, T.StructType([*ordered.schema.fields, T.StructField("layer", T.LongType())]))


def survivor(df: DataFrame, key: str, record: str, recency: str, trust: str, fields: list[str], hot: int = HOT_GROUP, salts: int = SALTS) -> DataFrame:
    """(key, record, layers, records, fields...): one surviving record per group, built field by field.

    The record is the first of the skyline by recency, trust, completeness and smallest record.
    A field it lacks comes from the first record, by (dominance layer, the same policy), that has it.
    `layers` and `records` count all dominance layers and all records of the group, at any size.
    `salts` is without effect here and stays for callers.
    """
    levels = len(fields)
    base = measured(df, key, record, recency, trust, fields)
    values = df.where(F.col(key).isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(key).alias("key"), *[F.when(is_real(F.col(f)), F.trim(f)).alias(f) for f in fields]).distinct()
    rows = base.join(values, ["key", "record"])
    large = hot_keys(base, hot)
    if not large.take(1):
        layered = numbered(rows, levels)
    else:
        cold = numbered(rows.join(large, "key", "left_anti"), levels)
        # of a hot group only the distinct vectors pass through one task; its records stay spread
        vector = ["key", "recency", "trust", "complete"]
        layers = numbered(base.join(large, "key", "left_semi").select(*vector).distinct(), levels)
        layered = cold.unionByName(rows.join(large, "key", "left_semi").join(layers, vector))
    policy = F.struct("layer", (-F.col("recency")).alias("r"), (-F.col("trust")).alias("t"), (-F.col("complete")).alias("c"), "record")
    return layered.groupBy("key").agg(
        F.min_by("record", policy).alias("record"),
        (F.max("layer") + 1).alias("layers"),
        F.count(F.lit(1)).alias("records"),
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), policy)).alias(f) for f in fields],
    )
