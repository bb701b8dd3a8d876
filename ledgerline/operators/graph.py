"""Composition and inheritance over edges, in rounds of joins.

A round joins the frontier with the edges; what it finds is new or the rounds end.  Rounds are as many as the longest chain has steps, each is
written below the shared folder (spark.checkpoint.dir), so neither plans nor lineage grow, and no driver or task holds more than a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stores import counted, dealt, grown, written, written_with


def ring_nodes(edges: DataFrame) -> DataFrame:
    """node: nodes on rings of edges (parent, child), or on the way from one ring to another.

    Edges are peeled: those from nodes that nothing leads to, and those to nodes that lead nowhere, until none goes.  Peeled edges are gone, so rounds get smaller."""
    (left, now), n = counted(edges.select("parent", "child").distinct(), "edges"), -1
    while now not in (0, n):
        n, left = now, dealt(left)
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        left, now = counted(inner.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "edges")
    return left.select(F.col("parent").alias("node")).unionByName(left.select(F.col("child").alias("node"))).distinct()


def mount_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, path: every chain of mounts from a root (node, path) over edges (parent, child, prefix); chains that come back are cut.

    A round keeps each node and path once, however many chains lead there; what a chain has seen is carried for nodes of rings alone, since only those can be met again.
    All joins are dealt out, however few the rows, so that nothing of them passes the driver: paths and what was seen get longer with each round."""
    rings = grown(ring_nodes(edges).withColumn("ring", F.lit(True)), "rings")[0]
    none = F.array().cast(f"array<{edges.schema['child'].dataType.simpleString()}>")
    mounts = written(edges.select("parent", "child", "prefix").distinct().join(rings.withColumnRenamed("node", "child"), "child", "left"), "mounts")
    begun = roots.select("node", "path").distinct().join(rings, "node", "left")
    front, some = grown(begun.select("node", "path", F.when(F.col("ring"), F.array("node")).otherwise(none).alias("seen")), "walk")
    found = front.select("node", "path")
    while some:
        step = front.join(mounts, F.col("node") == F.col("parent")).where(~F.array_contains("seen", F.col("child")))
        seen = F.when(F.col("ring"), F.array_sort(F.array_append("seen", F.col("child")))).otherwise(F.col("seen"))
        front, some = grown(step.select(F.col("child").alias("node"), F.concat("path", "prefix").alias("path"), seen.alias("seen")).distinct(), "walk")
        found = found.unionByName(front.select("node", "path"))
    return found.distinct()


def first_mounts(edges: DataFrame, nodes: DataFrame, root: str = "is_root") -> DataFrame:
    """node, path, resolved over the first mount of each node (edges parent, child, prefix, ord; nodes node, prefix, is_root).

    resolved: the chain ends at a root; where it ends elsewhere or comes back the node keeps its own prefix.  Pointers double in each round, so a chain of n
    mounts takes log n joins.  Which chains end at a root is found first, with pointers alone: what still points somewhere after log n rounds leads into a ring."""
    first = edges.groupBy("child").agg(F.min_by(F.struct("parent", "prefix"), "ord").alias("m")).select(F.col("child").alias("node"), F.col("m.parent").alias("up"), F.col("m.prefix").alias("mount"))
    linked = nodes.select("node", F.col("prefix").alias("own"), F.col(root).alias("is_root")).join(first, "node", "left")
    path = F.when(F.col("is_root"), F.col("own")).otherwise(F.concat(F.coalesce("mount", F.lit("")), "own"))
    linked, _ = grown(linked.select("node", "own", "is_root", F.when(~F.col("is_root"), F.col("up")).alias("up"), path.alias("path")), "mounts")

    def doubled(now: DataFrame, carried: str, both: Column) -> tuple[DataFrame, bool]:
        """Every pointer to where its goal points, and whether any is left; carried: from the node's value (mine) and its goal's (theirs)."""
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col(carried).alias("theirs"))
        step = now.withColumnRenamed(carried, "mine").join(above, "up", "left")
        return grown(step.select("node", F.col("further").alias("up"), both.alias(carried)), "mounts", F.col("up").isNotNull())

    reach, rounds = linked.select("node", "up", F.col("is_root").alias("resolved")), linked.count().bit_length() + 1
    for _ in range(rounds):
        reach, some = doubled(reach, "resolved", F.coalesce("theirs", "mine"))
        if not some:
            break
    good = reach.where("up is null and resolved").select("node")
    paths = dealt(linked.join(good, "node", "left_semi").select("node", "up", "path"))
    for _ in range(rounds):
        paths, some = doubled(paths, "path", F.concat(F.coalesce("theirs", F.lit("")), "mine"))
        if not some:
            break
    out = linked.select("node", "own").join(paths.select("node", "path"), "node", "left")
    return out.select("node", F.coalesce("path", "own").alias("path"), F.col("path").isNotNull().alias("resolved"))


def ancestors(classes: DataFrame) -> DataFrame:
    """cls, owner, depth: each class and all classes above it over (cls, base), with the least number of steps.

    The whole closure, for those who ask for it; fields and resolution go without."""
    up = classes.where("base is not null").select(F.col("cls").alias("owner"), F.col("base").alias("next")).distinct()
    front = written(classes.select("cls", F.col("cls").alias("owner"), F.lit(0).alias("depth")).distinct(), "up")
    found, depth = front, 0
    while not front.isEmpty():
        depth += 1
        step = front.select("cls", "owner").join(up, "owner").select("cls", F.col("next").alias("owner")).distinct()
        front = written(step.join(found.select("cls", "owner"), ["cls", "owner"], "left_anti").withColumn("depth", F.lit(depth)), "up")
        found = found.unionByName(front)
    return found


def inherited_fields(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """cls, field, owner, depth: own and inherited fields over classes (cls, base); of one name the nearest owner's, then the least owner.

    Rounds double the reach: what a class has within n steps, and what the classes n steps above it have within n, is what it has within 2 * n.  Each class and field is held once in a round,
    with its nearest owner, so rows are never more than in the result; steps above are pairs of a class and those exactly n steps above, one a class where each has one base."""
    up = classes.where("base is not null").select("cls", "base").distinct()
    known = classes.select("cls").distinct()
    up, some = written_with(up, "above")
    held = written(fields.select(F.col("owner").alias("cls"), "field", "owner", F.lit(0).alias("depth")).distinct(), "fields")
    for k in range(known.count().bit_length() + 1):  # no way without a ring has more steps than there are classes
        if not some:
            break
        above = up.join(held.withColumnRenamed("cls", "base"), "base").select("cls", "field", "owner", (F.col("depth") + (1 << k)).alias("depth"))
        nearest = held.unionByName(above).groupBy("cls", "field").agg(F.min(F.struct("depth", "owner")).alias("n"))
        held = written(nearest.select("cls", "field", "n.owner", "n.depth"), "fields")
        up, some = written_with(up.join(up.select(F.col("cls").alias("base"), F.col("base").alias("_far")), "base").select("cls", F.col("_far").alias("base")).distinct(), "above")
    return held.join(known, "cls", "left_semi")


def resolved_classes(classes: DataFrame, inert: list) -> DataFrame:
    """cls, fully_resolved: whether each base above a class is itself a class here, or one of the inert ones, which bring no fields.

    Chains of classes with one base are first shortened to where they end, a class with several bases, in rounds that double their reach; then what is unresolved spreads downwards over those that
    are left, a round a step.  A chain of n classes takes log n rounds; one that runs in a ring is resolved if all around it are."""
    known = classes.select(F.col("cls").alias("base")).distinct().withColumn("_known", F.lit(True))
    steps = written(classes.distinct().join(known, "base", "left").select("cls", F.when(F.col("_known"), F.col("base")).alias("base"), (F.col("base").isNull() | F.col("_known").isNotNull() | F.col("base").isin(inert)).alias("ok")), "classes")
    shape = written(steps.groupBy("cls").agg(F.bool_and("ok").alias("ok"), F.count_distinct("base").alias("n"), F.min("base").alias("base")), "classes")
    many = shape.where("n > 1").select("cls")
    ways = written(shape.select("cls", "ok", F.when(F.col("n") == 1, F.col("base")).alias("up"), F.col("cls").alias("top")), "classes")
    for _ in range(max(1, shape.count()).bit_length() + 1):
        above = ways.select(F.col("cls").alias("up"), F.col("ok").alias("_ok"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        both = ways.join(above, "up", "left")
        ways, some = written_with(both.select("cls", (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")), "classes", F.col("up").isNotNull())
        if not some:
            break
    links = steps.join(many, "cls", "left_semi").where("base is not null").select(F.col("cls").alias("sub"), F.col("base").alias("cls")).join(ways.select("cls", "ok", "top"), "cls")
    over = written(links.select("sub", F.col("top").alias("cls"), "ok").join(many, "cls", "left_semi").select("sub", "cls").distinct(), "links")
    bad, some = written_with(links.where("not ok").select(F.col("sub").alias("cls")).unionByName(shape.where("n > 1 and not ok").select("cls")).distinct(), "bad")
    front = bad
    while some:
        front, some = written_with(front.join(over, "cls").select(F.col("sub").alias("cls")).distinct().join(bad, "cls", "left_anti"), "bad")
        bad = bad.unionByName(front)
    return ways.join(dealt(bad.distinct().select(F.col("cls").alias("top"), F.lit(True).alias("_bad"))), "top", "left").select("cls", (F.col("ok") & F.col("_bad").isNull()).alias("fully_resolved"))
