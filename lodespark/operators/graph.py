"""Graph operators on edge relations (src, dst). Loops cut their lineage with checkpoints and stop on convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import cut


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed edges without self loops and nulls."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edge rows at a node; a self loop counts once. Summed before any shuffle of rows."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.where(~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("dst").alias("node")))
    return ends.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def coverage(imports: DataFrame) -> DataFrame:
    """One row: imports, internal (with a target), external, unresolved, internal_pct = 100 internal / (internal + unresolved).

    ``imports``: to_file_id, resolution. External imports don't count in the percentage; it is null if there is nothing to resolve.
    """
    r = F.col("resolution")
    counts = imports.agg(
        F.count(F.lit(1)).alias("imports"), F.count_if(F.col("to_file_id").isNotNull()).alias("internal"),
        F.count_if(r == "external").alias("external"), F.count_if(r == "unresolved").alias("unresolved"),
    )
    return counts.withColumn("internal_pct", F.round(100 * F.col("internal") / F.nullif(F.col("internal") + F.col("unresolved"), F.lit(0)), 1))


def pagerank(edges: DataFrame, rounds: int = 40, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """node, rank; ranks of nodes without outgoing edges are spread over all. Stops when ranks move by less than ``tolerance`` in sum.

    Contributions are summed map-side before they are shuffled, so a node with a third of all edges makes
    no large task.
    """
    e = cut(simple_edges(edges))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(e.join(out, "src").select("src", "dst", "out"))
    nodes = nodes_of(e)
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = cut(nodes.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        loose = ranks.where("out = 0").agg(F.sum("rank")).first()[0] or 0.0
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = ranks.join(given, "node", "left").select(
            "node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"), F.abs(F.col("rank") - ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n))).alias("moved")
        )
        new = cut(new)
        moved = new.agg(F.sum("moved")).first()[0]
        ranks = new.drop("moved")
        if moved < tolerance:
            break
    return ranks.select("node", "rank")


def walk_with_restart(edges: DataFrame, anchors: DataFrame, restart: float = 0.2, rounds: int = 3) -> DataFrame:
    """node, score of a random walk from the anchors (node, weight) over weighted undirected edges (src, dst, weight)."""
    e = edges.where(F.col("src") != F.col("dst"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    total = e.groupBy("src").agg(F.sum("weight").alias("total"))
    step = cut(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    seed = cut(anchors.groupBy("node").agg(F.sum("weight").alias("w")))
    mass = seed.agg(F.sum("w")).first()[0]
    if not mass:
        return seed.select("node", F.col("w").alias("score"))
    seed = seed.select("node", (F.col("w") / mass).alias("s"))
    now = seed.select("node", F.col("s").alias("score"))
    for _ in range(rounds):
        moved = step.join(now.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p") * (1 - restart)).alias("score"))
        now = cut(moved.unionByName(seed.select("node", (F.col("s") * restart).alias("score"))).groupBy("node").agg(F.sum("score").alias("score")))
    return now


def reach(edges: DataFrame, starts: DataFrame, hops: int, reverse: bool = False) -> DataFrame:
    """node, hop: nodes within ``hops`` of the starts (node, hop 0), by shortest distance. Only the frontier is joined."""
    e = simple_edges(edges)
    e = cut(e.select(F.col("dst").alias("node"), F.col("src").alias("next")) if reverse else e.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    seen = cut(starts.select("node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        front = cut(front.select("node").join(e, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the undirected graph, by large-star and small-star contraction.

    Neighbour lists are reduced to their minimum before they are shuffled, so hubs make no large task.
    """
    e = cut(undirected(simple_edges(edges)))
    label = cut(nodes_of(e).select("node", F.col("node").alias("component")))
    while True:
        near = e.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("least"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"))
        # pointer jumping: a label's own label
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = not new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        label = new
        if not changed:
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of mutually reachable nodes.

    Trims nodes without an edge in or out, then spreads the smallest label forwards; within a colour the
    nodes that reach the label backwards are its component. Rounds repeat until no node is left.
    """
    e = cut(simple_edges(edges))
    done = None
    left = cut(nodes_of(e))
    while not left.isEmpty():
        # trimming
        while True:
            both = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            single = cut(left.join(both, "node", "left_anti"))
            if single.isEmpty():
                break
            add = single.select("node", F.col("node").alias("component"))
            done = add if done is None else done.unionByName(add)
            left = cut(left.join(single, "node", "left_anti"))
            e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = cut(left.select("node", F.col("node").alias("colour")))
        while True:
            got = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            new = cut(colour.join(got, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") < F.col("colour")).alias("changed")))
            changed = not new.where("changed").isEmpty()
            colour = new.drop("changed")
            if not changed:
                break
        # backwards from each label within its colour
        same = cut(
            e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        )
        found = cut(colour.where("node = colour"))
        front = found
        while True:
            front = cut(same.join(front.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct().join(found.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        add = found.select("node", F.col("colour").alias("component"))
        done = add if done is None else done.unionByName(add)
        left = cut(left.join(found, "node", "left_anti"))
        e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done if done is not None else left.select("node", F.col("node").alias("component"))


def layers(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, layer: the longest path from a source in the graph of components (0 for sources)."""
    c = components
    e = simple_edges(
        edges.select("src", "dst").join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
        .join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    e = cut(e)
    layer = cut(c.select("component").distinct().withColumn("layer", F.lit(0)))
    while True:
        up = e.join(layer.withColumnRenamed("component", "src"), "src").groupBy(F.col("dst").alias("component")).agg((F.max("layer") + 1).alias("up"))
        new = cut(layer.join(up, "component", "left").select("component", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), (F.coalesce("up", "layer") > F.col("layer")).alias("changed")))
        changed = not new.where("changed").isEmpty()
        layer = new.drop("changed")
        if not changed:
            return layer


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, label: synchronous label propagation on the undirected graph; the most frequent label of the neighbours, the smallest of equals.

    All nodes change at once, unlike a sequential sweep, so two sides of an edge may swap labels for ever:
    the number of rounds is fixed and the result is that of the last one.
    """
    e = cut(undirected(simple_edges(edges)))
    label = cut(nodes_of(e).select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = e.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        new = votes.groupBy("node").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))
        new = cut(new)
        same = new.join(label.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        label = new
        if same:
            break
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``q``: modularity of a labelling (node, label) on the undirected simple graph; 0 without edges."""
    e = undirected(simple_edges(edges))
    x = e.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per = x.groupBy("a").agg(F.count(F.lit(1)).alias("ends"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    return per.agg(F.coalesce(F.sum("inside") / F.sum("ends") - F.sum(F.col("ends").cast("double") * F.col("ends")) / (F.sum("ends").cast("double") * F.sum("ends")), F.lit(0.0)).alias("q"))


def sinks(edges: DataFrame, **options) -> DataFrame:
    """node, rank: PageRank of the reversed graph: what everything leads to."""
    return pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), **options)


def common_directory(paths: Column) -> Column:
    """The longest directory that all paths of an array share; empty if there is none."""
    folder = lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.lit(0), F.size(F.split(p, "/")) - 1))
    shared = lambda a, b: F.slice(a, 1, F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))) - 1)
    parts = F.transform(paths, folder)
    return F.coalesce(F.when(F.size(paths) > 0, F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], shared), "/")), F.lit(""))


def ripple(edges: DataFrame, starts: DataFrame, tests: DataFrame, partners: DataFrame, hops: int = 4) -> DataFrame:
    """node, hop, evidence: what a change of the starts (node) may touch, with all reasons why.

    ``imports`` for nodes that reach a start within ``hops`` imports (hop 1 and up), ``test`` for tests (target_id, test_id) of a start, ``cochange``
    for what changed together with one (src, dst). Starts are left out; hop is null where no import leads there.
    """
    begin = cut(starts.select("node").distinct())
    near = reach(edges, begin, hops, reverse=True).where("hop > 0").select("node", "hop", F.lit("imports").alias("e"))
    none = F.lit(None).cast("int").alias("hop")
    test = tests.join(begin.withColumnRenamed("node", "target_id"), "target_id", "left_semi").select(F.col("test_id").alias("node"), none, F.lit("test").alias("e"))
    with_ = partners.join(begin.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"), none, F.lit("cochange").alias("e"))
    rows = near.unionByName(test).unionByName(with_).join(begin, "node", "left_anti")
    return rows.groupBy("node").agg(F.min("hop").alias("hop"), F.array_sort(F.collect_set("e")).alias("evidence"))


def architecture(edges: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """section, place, name, value: cycles (largest first), hubs and sinks by rank, layers from the top, clusters (largest first, named by their common directory) and their modularity.

    ``edges``: src, dst; ``files``: id, path. At most ``k`` rows a section; ``value`` is a size or a rank.
    """
    e = cut(simple_edges(edges))
    paths = files.select(F.col("id").alias("node"), "path").distinct()
    parts = cut(strong_components(e))

    def top(df: DataFrame, section: str) -> DataFrame:
        w = Window.partitionBy(F.lit(1)).orderBy(F.col("value").desc(), "name")
        short = df.orderBy(F.col("value").desc(), "name").limit(k)  # k rows are all that the window sees
        return short.withColumn("place", F.row_number().over(w)).select(F.lit(section).alias("section"), "place", "name", F.col("value").cast("double").alias("value"))

    cycles = parts.groupBy("component").agg(F.count(F.lit(1)).alias("value")).where("value > 1").join(paths.withColumnRenamed("node", "component"), "component").select(F.col("path").alias("name"), "value")
    ranked = lambda df: df.join(paths, "node").select(F.col("path").alias("name"), F.col("rank").alias("value"))
    levels = layers(e, parts).groupBy("layer").agg(F.count(F.lit(1)).alias("value")).select(F.lpad(F.col("layer").cast("string"), 4, "0").alias("name"), "value")
    labels = cut(label_propagation(e))
    # a cluster's directory is that of its first and last path: what these share, all in between share
    named = labels.join(paths, "node").groupBy("label").agg(F.count(F.lit(1)).alias("value"), F.min("path").alias("a"), F.max("path").alias("b"))
    clusters = named.select(F.concat(common_directory(F.array("a", "b")), F.lit(" #"), F.col("label").cast("string")).alias("name"), "value")
    out = top(cycles, "cycle").unionByName(top(ranked(pagerank(e)), "hub")).unionByName(top(ranked(sinks(e)), "sink")).unionByName(top(levels, "layer")).unionByName(top(clusters, "cluster"))
    quality = modularity(e, labels).select(F.lit("quality").alias("section"), F.lit(1).alias("place"), F.lit("modularity").alias("name"), F.col("q").alias("value"))
    return out.unionByName(quality)
