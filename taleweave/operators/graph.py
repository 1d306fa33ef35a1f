"""Graph operators over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.session import cut


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): connected components of undirected edges (src, dst), each
    named by its least id.

    Alternating large-star and small-star steps: edges are rewired to the least
    neighbour until nothing changes, in a number of rounds logarithmic in the size of
    the largest component. A hub costs one aggregated row per neighbour, never a
    collected group. Self-loops are ignored; an empty edge table gives no rows."""
    now = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a vertex go to its least neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex and its neighbours below go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = cut(small)
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() or now.join(new, ["u", "v"], "left_anti").limit(1).count()
        now = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def undirected(relations: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(u, v, weight): edges by sorted pair, self-loops dropped, counted before the
    shuffle; the weight is the number of relations."""
    x = relations.filter(f"{a} is not null and {b} is not null and {a} <> {b}")
    return x.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.count("*").alias("weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    """(node, degree): the sum of the weights of incident edges."""
    return edges.select(F.col("u").alias("node"), "weight").unionAll(edges.select("v", "weight")).groupBy("node").agg(F.sum("weight").alias("degree"))


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within depth edges of each start, without itself.
    Breadth-first; each round meets only the nodes found in the last one."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select("start", F.col("node").alias("u")).join(both, "u").select("start", F.col("v").alias("node")).distinct()
        frontier = cut(step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_edges: int = 3) -> DataFrame:
    """(a, b, length, path): one shortest path of at most max_edges edges for each pair
    (a, b), the least in node order; equal ends give the node itself; no row if none."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    now = pairs.select("a", "b").distinct().withColumn("node", F.col("a")).withColumn("path", F.array("a"))
    found = now.filter("a = b")
    now = now.filter("a <> b")
    for _ in range(max_edges):
        step = now.join(both, now.node == both.u).filter("not array_contains(path, v)").select("a", "b", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
        # one path to a node is enough: the least of this length
        now = cut(step.groupBy("a", "b", "node").agg(F.min("path").alias("path")))
        found = found.unionByName(now.filter("node = b"))
    best = found.groupBy("a", "b").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("m"))
    return best.select("a", "b", (F.col("m.n") - 1).alias("length"), F.col("m.path").alias("path"))


def _moved(both: DataFrame, labels: DataFrame, degree: DataFrame, total: float, resolution: float, parity: int) -> DataFrame:
    """(node, community) after the nodes of one parity took the neighbouring community
    of the greatest gain in modularity; ties and no gain keep the least label or the own."""
    sums = labels.join(degree, "node").groupBy("community").agg(F.sum("degree").alias("s"))
    links = both.filter("u <> v").join(labels.withColumnRenamed("node", "v"), "v").groupBy("u", "community").agg(F.sum("weight").alias("k"))
    own = labels.select(F.col("node").alias("u"), "community", F.lit(0.0).alias("k"))
    every = links.unionByName(own).groupBy("u", "community").agg(F.sum("k").alias("k")).join(sums, "community")
    every = every.join(labels.select(F.col("node").alias("u"), F.col("community").alias("now")), "u").join(degree.withColumnRenamed("node", "u"), "u")
    rest = F.col("s") - F.when(F.col("community") == F.col("now"), F.col("degree")).otherwise(0.0)
    gain = F.round(F.col("k") - resolution * F.col("degree") * rest / (2.0 * total), 9)
    moves = F.pmod(F.xxhash64("u"), F.lit(2)) == parity
    best = every.filter(moves | (F.col("community") == F.col("now"))).withColumn("g", gain)
    return best.groupBy("u").agg(F.min(F.struct((-F.col("g")).alias("g"), (F.col("community") != F.col("now")).alias("away"), "community")).alias("m")).select(F.col("u").alias("node"), F.col("m.community").alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 3, levels: int = 3, least_gain: float = 1e-3) -> DataFrame:
    """(node, community): Louvain's method as joins. In a round first one half of the nodes
    (by a hash, so that neighbours seldom swap at once), then the other moves to the
    neighbouring community of the greatest gain; a round that gains less than least_gain
    of modularity is undone and ends its level, as does the last of the rounds. The
    communities become the nodes of the next level. A community is named by its least
    node; the result depends on no partitioning."""
    start = cut(edges.select("u", "v", F.col("weight").cast("double").alias("weight")).filter("u <> v"))
    total = start.agg(F.sum("weight").alias("m")).first().m
    home = start.select(F.col("u").alias("node")).union(start.select("v")).distinct().withColumn("community", F.col("node"))
    if not total:
        return home
    home, now = cut(home), start
    for _ in range(levels):
        # a self-edge holds the weight inside a node of a higher level, once
        both = cut(now.select("u", "v", "weight").unionAll(now.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
        degree = cut(both.groupBy(F.col("u").alias("node")).agg(F.sum(F.col("weight") * F.when(F.col("u") == F.col("v"), 2.0).otherwise(1.0)).alias("degree")))
        labels, moved = cut(degree.select("node", F.col("node").alias("community"))), False
        best = modularity(now, labels, resolution)
        for _ in range(rounds):
            new = labels
            for parity in (0, 1):
                new = cut(_moved(both, new, degree, total, resolution, parity))
            q = modularity(now, new, resolution)
            if q <= best + least_gain:
                break
            labels, best, moved = new, q, True
        if not moved:
            break
        home = cut(home.join(labels.select(F.col("node").alias("community"), F.col("community").alias("c")), "community").select("node", F.col("c").alias("community")))
        a, b = (labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
        now = cut(now.join(a, "u").join(b, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight")))
    named = home.groupBy("community").agg(F.min("node").alias("least"))
    return home.join(named, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (node, community) of weighted edges; a self-edge lies inside."""
    a, b = (labels.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "uv")
    ends = edges.join(a, "u").join(b, "v")
    per = ends.select(F.col("cu").alias("c"), "weight", F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0).alias("inside")).unionAll(ends.select("cv", "weight", F.lit(0.0)))
    got = per.groupBy("c").agg(F.sum("weight").alias("d"), F.sum("inside").alias("i")).agg(F.sum("d").alias("two_m"), F.sum("i").alias("inside"), F.sum(F.col("d") * F.col("d")).alias("s")).first()
    return got.inside / (got.two_m / 2) - resolution * got.s / got.two_m**2 if got.two_m else 0.0


def large_communities(labels: DataFrame, min_size: int = 3) -> DataFrame:
    """(node, community, size, nth) of the communities of at least min_size nodes,
    numbered from 1 by their size, the greatest first, then by name."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    numbered = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
    return labels.join(numbered, "community").select("node", "community", "size", "nth")
