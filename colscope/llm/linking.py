"""Connected groups of a verified similarity, from pigeonhole signatures, without all pairs of a bucket.

``signatures`` hold (key, id): ids that are similar share a key. The hub of a bucket is its smallest id. First
each id is compared with one hub, the one it shares most keys with: that connects groups of near copies with one
comparison per member. Then the hubs it is not yet connected with follow. Only buckets whose members are still in
different groups are joined with themselves, for pairs of different groups that pass a cheap lower bound of
the distance; no link is lost, as pairs within a group need no more links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import companions, components, roots, stored


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups."""
    for end in ("a", "b"):
        group = groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
        pairs = pairs.join(group, end, "left")
    known = F.coalesce("a_group", "a") == F.coalesce("b_group", "b")
    return pairs.filter(~known).select("a", "b")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups joined by links between them; only the links' groups are looked at."""
    if links.isEmpty():
        return groups
    for end in ("a", "b"):
        group = groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_group"))
        links = links.join(group, end, "left")
    between = links.select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    wider = stored(components(between)).withColumnRenamed("component", "wider")
    renamed = groups.join(wider.withColumnRenamed("id", "component"), "component", "left")
    renamed = renamed.select("id", F.coalesce("wider", "component").alias("component"))
    alone = wider.join(groups.select("id"), "id", "left_anti").select("id", F.col("wider").alias("component"))
    return stored(renamed.unionByName(alone))


def connected(
    signatures: DataFrame,
    sketches: DataFrame,
    possible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    need: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of every id that is linked with another.

    ``sketches`` hold one row per id; ``possible(l, r)`` is a condition on two of them that all similar pairs meet;
    ``verify`` keeps the similar pairs (a, b) among the given ones. ``need`` (id, need) tells how many keys an id has at
    least in common with every similar one; an id that shares fewer keys with all others together is similar to none.
    """
    shared = stored(companions(signatures, "key", "id"))
    if need is not None:
        keys = shared.groupBy("id").agg(F.count(F.lit(1)).alias("keys"))
        enough = stored(keys.join(need, "id").filter("keys >= need").select("id"))
        shared = stored(companions(shared.select("key", "id").join(enough, "id", "left_semi"), "key", "id"))
    names = [c for c in sketches.columns if c != "id"]

    def side(mark: str) -> DataFrame:
        return sketches.select(F.col("id").alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in names])

    def condition() -> Column:
        return possible(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("b"), "b").join(side("a"), "a").filter(condition()).select("a", "b")
        near = stored(near)
        return near if near.isEmpty() else stored(verify(near))

    hubs = stored(shared.filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n")))
    closest = F.max_by("hub", F.struct("n", -F.col("hub")))
    trees = linked(hubs.groupBy(F.col("id").alias("b")).agg(closest.alias("a")))
    groups = stored(roots(trees.select(F.col("b").alias("id"), F.col("a").alias("parent"))))
    far = _apart(hubs.select(F.col("hub").alias("a"), F.col("id").alias("b")), groups)
    groups = _merged(groups, linked(far))
    # buckets that still hold several groups
    placed = shared.select("key", "id").join(groups, "id", "left")
    placed = stored(placed.select("key", "id", F.coalesce("component", "id").alias("component")))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    # in a bucket of two, the one pair was the hub's
    open_keys = open_keys.filter("lo < hi AND n > 2").select("key")
    members = placed.join(open_keys, "key").join(sketches.withColumnRenamed("id", "sid"), F.col("id") == F.col("sid"))
    members = stored(members.drop("sid"))
    if members.isEmpty():
        return groups

    def member(mark: str) -> DataFrame:
        return members.select("key", F.col("id").alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in ["component", *names]])

    apart = F.col("a_component") < F.col("b_component")
    pairs = member("a").join(member("b"), "key").filter(apart & condition()).select("a", "b").distinct()
    return _merged(groups, linked(pairs))
