"""Queries and fixpoints on an edge table (kind, src, dst, attrs)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from lexiloom.functions import hashing
from lexiloom.session import settle


def of_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth): nodes reachable from ``seeds`` (id) with their smallest depth, seeds at 0.

    Frontier rounds: each joins only the last layer with the edges and drops visited nodes.
    """
    frontier = settle(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    layers = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
        fresh = step.select(F.col("dst").alias("id")).distinct().join(layers.select("id"), "id", "left_anti")
        frontier = settle(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return layers
        layers = layers.unionByName(frontier)
        if depth % 8 == 0:
            layers = settle(layers)
    return layers


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def depth_from_leaves(edges: DataFrame) -> DataFrame:
    """(id, depth): 0 for nodes without successors, else one more than the deepest successor.

    Nodes on a cycle, or that lead into one, cannot be ordered and get a null depth. Each round
    passes the nodes settled last to their predecessors, so every edge is used once.
    """
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())
    open_nodes = settle(links.groupBy("src").agg(F.count(F.lit(1)).alias("waiting")).withColumn("best", F.lit(0)))
    leaves = links.select(F.col("dst").alias("id")).distinct().join(
        open_nodes.select(F.col("src").alias("id")), "id", "left_anti"
    )
    frontier = settle(leaves.withColumn("depth", F.lit(0)))
    done = frontier
    for depth in count(1):
        news = (
            links.join(frontier.select(F.col("id").alias("dst"), "depth"), "dst")
            .groupBy("src")
            .agg(F.count(F.lit(1)).alias("settled"), (F.max("depth") + 1).alias("offer"))
        )
        merged = settle(
            open_nodes.join(news, "src", "left").select(
                "src",
                (F.col("waiting") - F.coalesce("settled", F.lit(0))).alias("waiting"),
                F.greatest("best", F.coalesce("offer", F.lit(0))).alias("best"),
            )
        )
        frontier = merged.where("waiting = 0").select(F.col("src").alias("id"), F.col("best").alias("depth"))
        open_nodes = merged.where("waiting > 0")
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
        if depth % 8 == 0:
            done = settle(done)
    return done.unionByName(open_nodes.select(F.col("src").alias("id"), F.lit(None).cast("int").alias("depth")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes that lie on a cycle; the smallest member names the component.

    Trims nodes without predecessors or successors, colours the rest with the smallest id that
    reaches them, then collects, inside each colour, what leads back to the colour's root.
    """
    links = settle(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        links = _trim(links)
        if links.isEmpty():
            break
        nodes = links.select(F.col("src").alias("id")).distinct()
        colour = settle(nodes.withColumn("c", F.col("id")))
        while True:
            offers = links.join(colour.toDF("src", "c"), "src").select(F.col("dst").alias("id"), "c")
            fresh = settle(colour.unionByName(offers).groupBy("id").agg(F.min("c").alias("c")))
            moved = fresh.join(colour.withColumnRenamed("c", "old"), "id").where("c <> old")
            still = moved.isEmpty()
            colour = fresh
            if still:
                break
        inside = (
            links.join(colour.toDF("src", "c"), "src")
            .join(colour.toDF("dst", "c2"), "dst")
            .where("c = c2")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        members = reach(settle(inside), colour.where("id = c").select("id")).select("id")
        labelled = settle(members.join(colour, "id").select("id", F.col("c").alias("component")))
        found = labelled if found is None else found.unionByName(labelled)
        links = settle(
            links.join(labelled.select(F.col("id").alias("src")), "src", "left_anti").join(
                labelled.select(F.col("id").alias("dst")), "dst", "left_anti"
            )
        )
    if found is None:
        return links.select(F.col("src").alias("id"), F.col("src").alias("component")).where(F.lit(False))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("id", "component")


def _trim(links: DataFrame) -> DataFrame:
    left = links.count()
    while True:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = settle(kept.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = kept.count()
        links = kept
        if now == left:
            return links
        left = now


def circular_edges(edges: DataFrame) -> DataFrame:
    """Edges whose two ends lie on one cycle, self-loops included."""
    comp = settle(strong_components(edges))
    inner = (
        edges.select("src", "dst")
        .distinct()
        .join(comp.toDF("src", "c1"), "src")
        .join(comp.toDF("dst", "c2"), "dst")
        .where("c1 = c2 AND src <> dst")
        .select("src", "dst")
    )
    return inner.unionByName(edges.select("src", "dst").where("src = dst").distinct())


def merge_graphs(*graphs: DataFrame) -> DataFrame:
    """Nodes (id, ...) of several graphs; the first graph that holds an id supplies its row."""
    marked = [g.withColumn("_rank", F.lit(i)) for i, g in enumerate(graphs)]
    every = marked[0]
    for g in marked[1:]:
        every = every.unionByName(g)
    cols = [c for c in graphs[0].columns if c != "id"]
    best = every.groupBy("id").agg(F.min_by(F.struct(*cols), "_rank").alias("row"))
    return best.select("id", "row.*")


def rewrite_endpoints(edges: DataFrame, rewrites: DataFrame, drop_loops_of: str = "depends_on") -> DataFrame:
    """Replaces endpoints by ``rewrites`` (old, new); self-loops of one kind disappear."""
    a = rewrites.select(F.col("old").alias("src"), F.col("new").alias("new_src"))
    b = rewrites.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    fixed = both.select("kind", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"))
    return fixed.where(~((F.col("kind") == drop_loops_of) & (F.col("src") == F.col("dst"))))


def repair_endpoints(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, resolved): a call (src, module, name) gets the symbol of that module and name;
    an unknown one points to an external module."""
    known = symbols.groupBy("module", "name").agg(F.min("id").alias("symbol"))
    both = calls.join(known, ["module", "name"], "left")
    outside = F.concat(F.lit("external:"), F.col("module"))
    return both.select("src", F.coalesce("symbol", outside).alias("dst"), F.col("symbol").isNotNull().alias("resolved"))


def wrappers(calls: DataFrame) -> DataFrame:
    """(wrapper, delegate): units with exactly one callee."""
    one = calls.select("src", "dst").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("delegate"))
    return one.where("n = 1").select(F.col("src").alias("wrapper"), "delegate")


def wrapper_call_sites(calls: DataFrame) -> DataFrame:
    """(caller, wrapper, delegate) for every call of a wrapper."""
    sites = calls.select(F.col("src").alias("caller"), F.col("dst").alias("wrapper")).distinct()
    return sites.join(wrappers(calls), "wrapper").select("caller", "wrapper", "delegate")


def function_units(symbols: DataFrame, calls: DataFrame, depths: DataFrame) -> DataFrame:
    """One row per symbol: (id, file, callers, callees, neighbourhood, depth).

    Caller and callee sets stay in the edge table; here stand their sizes and an order-free
    digest, so a symbol called from everywhere costs one aggregate row.
    """
    links = calls.select("src", "dst").distinct()
    incoming = links.groupBy(F.col("dst").alias("id")).agg(
        F.count(F.lit(1)).alias("callers"), hashing.set_digest(F.col("src")).alias("caller_digest")
    )
    outgoing = links.groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("callees"), hashing.set_digest(F.col("dst")).alias("callee_digest")
    )
    both = symbols.join(incoming, "id", "left").join(outgoing, "id", "left").join(depths, "id", "left")
    return both.select(
        "id",
        "file",
        F.coalesce("callers", F.lit(0)).alias("callers"),
        F.coalesce("callees", F.lit(0)).alias("callees"),
        hashing.content_hash(
            F.concat_ws("|", "source_hash", F.coalesce("caller_digest", F.lit("")), F.coalesce("callee_digest", F.lit("")))
        ).alias("context_hash"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def hubs(links: DataFrame, minimum: int = 2, top: int = 10) -> DataFrame:
    """(target, incoming) of the most linked targets; ``links``: (page, target)."""
    counts = links.select("page", "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("incoming"))
    return counts.where(F.col("incoming") >= minimum).orderBy(F.desc("incoming"), "target").limit(top)


def first_symbols(symbols: DataFrame, per_module: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("module").orderBy("name", "id"))
    return symbols.withColumn("rank", rank).where(F.col("rank") <= per_module)
