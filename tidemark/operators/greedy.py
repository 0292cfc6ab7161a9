"""Greedy selections whose answers are those of one loop over ordered candidates, without sending them through one.

Accepting under clashes (`accept`): whether a candidate is taken depends only on earlier ones with which it shares something.
In each round every undecided candidate that comes first wherever it could clash is decided, all at once; whatever the new
choices rule out goes at the same time. Candidates are looked at in slices of the order, some for each one still wanted.

Keeping to a budget (`pace`): every choice depends on all before it, by two things of bounded size, the number accepted and
the union of their sets. The order is cut into ranges; one task after another takes a range and the state that the last one
left in the shared folder, and the ranges after the target are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.running import cut, shared_folder

#: Candidates looked at together, for each one still wanted.
SLICE = 8


@dataclass(frozen=True)
class Rules:
    """Pools and how many of each an accepted candidate takes: the least by `pick`, a column of id and doc."""

    needs: dict[str, int]
    pick: Column


@dataclass
class _State:
    """What accepted candidates hold, with their place in the order: docs in a role, docs that are forbidden, marks."""

    roles: DataFrame
    forbidden: DataFrame
    marks: DataFrame

    @staticmethod
    def empty(rows: DataFrame, touches: DataFrame) -> _State:
        none = lambda df, *c: df.select(*c).limit(0)
        return _State(none(touches, "doc", F.col("place").alias("by"), "id", "role"), none(touches, "doc", F.col("place").alias("by")), none(_marks(rows), "mark", F.col("place").alias("by")))


def _marks(rows: DataFrame) -> DataFrame:
    return rows.select("place", F.explode("marks").alias("mark"))


def _hit(rows: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """The rows (place, on, ...) for which an earlier candidate holds `on`."""
    first = held.groupBy(on).agg(F.min("by").alias("by"))
    return rows.join(first, on).where("by < place")


def _ruled_out(rows: DataFrame, touches: DataFrame, s: _State) -> DataFrame:
    """(place) of candidates that earlier accepted ones exclude, whatever is still open: by mark, gold or guard."""
    gold, guard = touches.where("role = 'gold'"), touches.where("role = 'guard'")
    out = [_hit(_marks(rows), s.marks, "mark"), _hit(gold, s.roles, "doc"), _hit(gold, s.forbidden, "doc"), _hit(guard, s.roles, "doc")]
    places = out[0].select("place")
    for df in out[1:]:
        places = places.unionByName(df.select("place"))
    return places.distinct()


def _usable(touches: DataFrame, rules: Rules) -> DataFrame:
    """touches less the pool documents that a candidate guards or has as gold; one of several pools serves the first. Pools get ranks `r`."""
    held = touches.where(F.col("role").isin("gold", "guard"))
    pool = touches.where(~F.col("role").isin("gold", "guard")).join(held.select("place", "doc"), ["place", "doc"], "left_anti")
    pool = pool.groupBy("place", "id", "doc").agg(F.min("role").alias("role"))
    ranked = pool.withColumn("r", F.row_number().over(Window.partitionBy("place", "role").orderBy(rules.pick, "doc")))
    return held.withColumn("r", F.lit(0)).unionByName(ranked)


def _need(rules: Rules) -> Column:
    return F.coalesce(*[F.when(F.col("role") == k, F.lit(n)) for k, n in rules.needs.items()], F.lit(0))


def _within_reach(touches: DataFrame, s: _State, rules: Rules) -> DataFrame:
    """touches less the pool documents that a candidate will not come to.

    A document that no earlier undecided candidate touches and no earlier choice holds is certain; behind as many certain
    ones as a pool needs, none can be taken.
    """
    first = touches.groupBy("doc").agg(F.min("place").alias("first"))
    gone = s.roles.select("doc", "by").unionByName(s.forbidden).groupBy("doc").agg(F.min("by").alias("by"))
    rows = touches.join(first, "doc").join(gone, "doc", "left")
    certain = ((F.col("first") == F.col("place")) & (F.col("by").isNull() | (F.col("by") > F.col("place")))).cast("int")
    before = Window.partitionBy("place", "role").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.coalesce(F.sum(certain).over(before), F.lit(0)))
    return rows.where((F.col("r") == 0) | (F.col("_n") < _need(rules))).select(*touches.columns)


def _first(rows: DataFrame, touches: DataFrame) -> DataFrame:
    """The rows that no earlier undecided one could clash with: in a mark, or in a document that either might take."""
    marks = _marks(rows)
    behind = marks.join(marks.groupBy("mark").agg(F.min("place").alias("lead")), "mark").where("lead < place").select("place")
    takes = F.when(F.col("role") != "guard", F.col("place"))
    by_doc = touches.groupBy("doc").agg(F.min("place").alias("any"), F.min(takes).alias("taker"))
    blocked = touches.join(by_doc, "doc").where(F.when(F.col("role") == "guard", F.col("taker") < F.col("place")).otherwise(F.col("any") < F.col("place"))).select("place")
    return rows.join(blocked.unionByName(behind).distinct(), "place", "left_anti")


def _decided(free: DataFrame, touches: DataFrame, s: _State, rules: Rules) -> DataFrame:
    """(place, doc, role, id) of the documents that accepted rows of `free` take: the gold and their share of each pool."""
    own = touches.join(free.select("place"), "place")
    taken = s.roles.select("doc", "by").unionByName(s.forbidden).groupBy("doc").agg(F.min("by").alias("by"))
    pool = own.where("r > 0").join(taken, "doc", "left").where("by IS NULL OR by > place")
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("place", "role").orderBy("r")))
    share = ranked.where(F.col("_r") <= _need(rules))
    full = share.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") == sum(rules.needs.values())).select("place")
    gold = own.where("role = 'gold'").join(full, "place")
    return gold.select("place", "doc", "role", "id").unionByName(share.join(full, "place").select("place", "doc", "role", "id"))


def accept(candidates: DataFrame, details: DataFrame, rules: Rules, limit: int, touch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, doc, role): the first `limit` candidates that a loop in their order accepts, with the documents each takes.

    candidates: id, place (its place in the order, unique) and marks, an array of what only one accepted candidate may have.
    touch gives what rows of `details` touch: id, doc and role, which is `gold` (one each), `guard`, or a pool in rules.needs. A candidate is accepted if its marks are
    unused, its gold is neither in a role nor guarded by an accepted one, no guarded document of its own is in a role, and each
    pool, without guarded and used documents, has as many as it needs; those are then in a role.
    """
    return accept_ranges([(candidates, details, touch)], rules, limit)


def accept_ranges(ranges: Iterable[tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]], rules: Rules, limit: int) -> DataFrame:
    """As accept, of candidates in ranges of their order, one after the other: (candidates, details, touch) each. Ranges after the limit are not asked for."""
    s, left = None, limit
    for candidates, details, touch in ranges:
        s, left = _accepted(candidates, details, rules, limit, left, touch, s)
        if left <= 0:
            break
    if s is None:
        return touch(details).select("id", "doc", "role").limit(0)
    kept = s.roles.where("role = 'gold'").orderBy("by").limit(limit).select("id")
    return s.roles.join(kept, "id").select("id", "doc", "role")


def _accepted(candidates: DataFrame, details: DataFrame, rules: Rules, limit: int, left: int, touch: Callable[[DataFrame], DataFrame], s: _State | None) -> tuple[_State | None, int]:
    """What is held, and how many are still wanted, after the candidates."""
    after = None
    while left > 0:
        rest = candidates if after is None else candidates.where(F.col("place") > after)
        slice_ = cut(rest.orderBy("place").limit(SLICE * left))
        last = slice_.agg(F.max("place")).first()[0]
        if last is None:
            break
        own = touch(details.join(slice_.select("place"), "place")).join(slice_.select("id", "place"), "id").select("place", "id", "doc", "role").distinct()
        own = cut(_usable(cut(own), rules))
        if s is None:
            s = _State.empty(slice_, own)
        live = cut(slice_.join(_ruled_out(slice_, own, s), "place", "left_anti"))
        while not live.isEmpty():
            mine = cut(_within_reach(own.join(live.select("place"), "place"), s, rules))
            free = cut(_first(live, mine))
            taken = cut(_decided(free, mine, s, rules))
            good = free.join(taken.select("place").distinct(), "place")
            s = _State(
                cut(s.roles.unionByName(taken.select("doc", F.col("place").alias("by"), "id", "role"))),
                cut(s.forbidden.unionByName(mine.where("role = 'guard'").join(good.select("place"), "place").select("doc", F.col("place").alias("by")))),
                cut(s.marks.unionByName(_marks(good).select("mark", F.col("place").alias("by")))),
            )
            live = live.join(free.select("place"), "place", "left_anti")
            live = cut(live.join(_ruled_out(live, mine, s), "place", "left_anti"))
        after = last
        left = limit - s.roles.where("role = 'gold'").count()
    return s, left


def _paced(budget: float, target: int):
    def run(state: pa.Table, rows: pa.Table) -> pa.Table:
        held = state.column("doc").drop_null().to_pylist()
        union, n = set(held), max(state.column("accepts").drop_null().to_pylist(), default=0)
        keys, accepts, sizes, new = [], [], [], []
        rows = rows.sort_by("place")
        for key, docs in zip(rows.column("key").to_pylist(), rows.column("docs").to_pylist(), strict=True):
            if n == target:
                break
            fresh = [x for x in dict.fromkeys(docs or ()) if x not in union]
            if len(union) + len(fresh) <= budget * (n + 1) / target:
                union.update(fresh)
                n += 1
                keys.append(key)
                accepts.append(n)
                sizes.append(len(union))
                new += fresh
        kind = rows.schema.field("key").type
        doc = rows.schema.field("docs").type.value_type
        return pa.table({
            "key": pa.array(keys + [None] * len(new), kind), "accepts": pa.array(accepts + [None] * len(new), pa.int64()),
            "used": pa.array(sizes + [None] * len(new), pa.int64()), "doc": pa.array([None] * len(keys) + new, doc),
        })

    return run


def pace(rows: DataFrame, order: list[Column], budget: float, target: int, *, key: str = "key", docs: str = "docs", parts: int | None = None) -> DataFrame:
    """(key, accepts, used): the rows that a loop in the order accepts, until `target` are.

    A row is accepted if with it the union of the accepted sets has at most budget * (accepts + 1) / target members; accepts
    counts it, and used is the size of the union then. Null sets are empty; null members do not count. The order, of plain
    columns, rises with nulls first and must be total. The state is at most `budget` members and `target` keys.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = F.array_compact(F.coalesce(F.col(docs), F.array().cast(dict(rows.dtypes)[docs])))
    by = [f"o{i}" for i in range(len(order))]
    ranged = rows.select(F.col(key).alias("key"), F.array_distinct(clean).alias("docs"), *[c.alias(n) for c, n in zip(order, by, strict=True)]).where(F.size("docs") <= budget)
    ranged = ranged.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    folder = f"{shared_folder(spark)}/pace-{uuid.uuid4().hex}"
    ranged = ranged.drop(*by)
    ranged.write.partitionBy("_part").parquet(f"{folder}/rows")
    ranged = spark.read.schema(ranged.schema).parquet(f"{folder}/rows")
    member = dict(ranged.dtypes)["docs"].removeprefix("array<").removesuffix(">")
    schema = f"key {dict(ranged.dtypes)['key']}, accepts long, used long, doc {member}"
    state = spark.createDataFrame([], schema)
    done = 0
    for (part,) in sorted(tuple(r) for r in ranged.select("_part").distinct().collect()):
        own = ranged.where(F.col("_part") == part).select("key", "docs", "place")
        held = state.select("accepts", "doc").where("doc IS NOT NULL").unionByName(state.agg(F.max("accepts").alias("accepts")).withColumn("doc", F.lit(None).cast(member)))
        step = held.withColumn("_one", F.lit(0)).groupBy("_one").cogroup(own.withColumn("_one", F.lit(0)).groupBy("_one")).applyInArrow(_paced(budget, target), schema)
        step.write.parquet(f"{folder}/state/part={part}")
        state = spark.read.schema(schema).parquet(*[f"{folder}/state/part={p}" for p in range(part + 1) if _there(spark, f"{folder}/state/part={p}")])
        done = state.agg(F.coalesce(F.max("accepts"), F.lit(0))).first()[0]
        if done >= target:
            break
    return state.where("accepts IS NOT NULL").select(F.col("key").alias(key), "accepts", "used")


def _there(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
