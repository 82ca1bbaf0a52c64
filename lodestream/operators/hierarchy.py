"""Recursion over graphs with cycles: strongly connected components, CONNECT BY walks, interval labels of forests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import prefix_scan
from lodestream.sources.writers import scratch_table

ROUNDS = 10_000


def _keep(df: DataFrame) -> DataFrame:
    return scratch_table(df.sparkSession, df)[0]


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): each node's greatest label among those of all nodes that lead to it. Only nodes that changed in a round send in the next one."""
    now, front = labels, labels
    for _ in range(ROUNDS):
        sent = front.join(edges, front.node == edges.a).groupBy(F.col("b").alias("node")).agg(F.max("label").alias("sent"))
        new = _keep(now.join(sent, "node", "left").select("node", F.greatest("label", "sent").alias("label"), (F.coalesce("sent", "label") > F.col("label")).alias("moved")))
        now, front = new.select("node", "label"), new.filter("moved").select("node", "label")
        if front.isEmpty():
            return now
    raise RuntimeError(f"labels did not settle in {ROUNDS} rounds")


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component): nodes that lead to each other, named by the least of them; numbers or texts.

    In rounds over what is left: nodes without a way in or out are components alone and go first. Each other node takes the greatest node that leads to it as its colour (forward); a
    node of its own colour is a root, and the nodes of its colour that lead back to it (backward) are its component. Edges between colours, and those of settled nodes, go. At least
    the greatest node left settles in each round, as a rule most do. A null end makes no edge; loops and repeated edges change nothing.
    """
    both = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null")
    nodes = _keep(both.select(F.col("a").alias("node")).union(both.select("b")).distinct())
    left, settled = _keep(both.filter("a <> b").distinct()), []
    for _ in range(ROUNDS):
        while True:  # an edge stays if something leads to its beginning and its end leads on
            inner = _keep(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if inner.count() == left.count():
                break
            left = inner
        if left.isEmpty():
            break
        colours = _spread(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node")), left)
        a, b = colours.toDF("a", "ca"), colours.toDF("b", "cb")
        within = _keep(left.join(a, "a").join(b, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("colour")))
        found = front = _keep(colours.filter("node = label").select("node", F.col("label").alias("colour")))
        for _ in range(ROUNDS):
            back = within.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = _keep(back.join(found, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            found = _keep(found.union(front))
        settled.append(found)
        gone = found.select("node")
        left = _keep(within.select("a", "b").join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    if not settled:
        return nodes.withColumn("component", F.col("node"))
    of = settled[0]
    for more in settled[1:]:
        of = of.union(more)
    names = of.groupBy("colour").agg(F.min("node").alias("component"))
    return nodes.join(of.join(names, "colour").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensation(edges: DataFrame, source: str, target: str, components: DataFrame) -> DataFrame:
    """(a, b) distinct edges between components: a graph without cycles."""
    ends = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    return ends.join(components.toDF("__s", "a"), "__s").join(components.toDF("__t", "b"), "__t").filter("a <> b").select("a", "b").distinct()


def connect_by(edges: DataFrame, starts: DataFrame, parent: str = "parent", child: str = "child", nocycle: bool = True, most_levels: int = ROUNDS) -> DataFrame:
    """CONNECT BY PRIOR child = parent, START WITH ``starts`` (node): a row for each walk down, with ``root`` (CONNECT_BY_ROOT), ``node``, ``level``, ``path`` (an array, for SYS_CONNECT_BY_PATH),
    ``is_leaf`` (CONNECT_BY_ISLEAF) and ``is_cycle`` (CONNECT_BY_ISCYCLE: a child is its own ancestor or itself).

    Level by level: each level's walks meet the edges once, and a step into the walk's own path is not taken; without ``nocycle`` it is an error. Each level is a table, so the plan does
    not grow. Repeated edges give repeated rows; null parents or children are no edges; a start that no edge knows is a leaf.
    """
    steps = _keep(edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).filter("node is not null and next is not null"))  # else each level makes the edges anew
    front = _keep(starts.select(F.col("node").alias("root"), "node", F.array("node").alias("path")).filter("node is not null").withColumn("__walk", F.monotonically_increasing_id()))
    done: list[DataFrame] = []
    for level in range(1, most_levels + 1):
        if front.isEmpty():
            break
        again = F.array_contains("path", F.col("next"))
        if not nocycle:
            again = F.when(again, F.raise_error(F.concat(F.lit("a cycle in the walk to "), F.col("next").cast("string")))).otherwise(F.lit(False))
        # the only table of a level: its steps, of which the next level's walks are those not taken back
        tried = _keep(front.join(steps, "node").select("root", "path", "next", "__walk", again.alias("__again"), F.monotonically_increasing_id().alias("__step")))
        ends = tried.groupBy("__walk").agg(F.max((~F.col("__again")).cast("int")).alias("on"), F.max(F.col("__again").cast("int")).alias("cycle"))
        told = front.join(ends, "__walk", "left")
        done.append(told.select("root", "node", F.lit(level).alias("level"), "path", (1 - F.coalesce("on", F.lit(0))).alias("is_leaf"), F.coalesce("cycle", F.lit(0)).alias("is_cycle")))
        front = tried.filter("not __again").select("root", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.col("__step").alias("__walk"))
    else:
        raise RuntimeError(f"walks did not end in {most_levels} levels")
    if not done:
        return front.select("root", "node", F.lit(0).alias("level"), "path", F.lit(0).alias("is_leaf"), F.lit(0).alias("is_cycle"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def interval_labels(forest: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, root, level, low, high) of a forest: a node is an ancestor of another, or that one itself, if low <= the other's low < high.

    Subtrees are counted from the deepest level up; then labels go down, a level at a time: a child's begins after its parent's own and those of the siblings before it. The sum over these
    siblings is a prefix scan of the whole level less what it holds before the parent's first child, so a parent of very many children is no task of its own. A node on a cycle is reached from no root and left out.
    """
    rows = _keep(forest.select(F.col(node).alias("node"), F.col(parent).alias("parent")))
    levels = [_keep(rows.filter("parent is null").select("node", "parent", F.col("node").alias("root")))]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("node").alias("parent"), "root")
        levels.append(_keep(rows.join(above, "parent").select("node", "parent", "root")))
        if len(levels) > ROUNDS:
            raise RuntimeError(f"the forest is deeper than {ROUNDS} levels")
    sized: list[DataFrame] = []
    below = None
    for rows in reversed(levels[:-1]):
        size = F.lit(1).cast("long")
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("below"))
            rows, size = rows.join(sums, "node", "left"), F.coalesce("below", F.lit(0)) + 1
        below = _keep(rows.select("node", "parent", "root", size.alias("size")))
        sized.append(below)
    out, above = [], None
    for level, rows in enumerate(reversed(sized), 1):
        scanned = _keep(prefix_scan(rows, ["parent", "node"], {"upto": F.col("size")}).withColumn("before", F.col("upto") - F.col("size")))
        if above is None:
            low: Column = F.col("before")
        else:
            first = scanned.groupBy("parent").agg(F.min("before").alias("first"))
            scanned = scanned.join(first.join(above.select(F.col("node").alias("parent"), F.col("low").alias("parent_low")), "parent"), "parent")
            low = F.col("parent_low") + 1 + F.col("before") - F.col("first")
        above = _keep(scanned.select("node", "root", F.lit(level).alias("level"), low.alias("low"), (low + F.col("size")).alias("high")))
        out.append(above)
    if not out:
        return levels[0].select("node", "root", F.lit(0).alias("level"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    labels = out[0]
    for more in out[1:]:
        labels = labels.unionByName(more)
    return labels
