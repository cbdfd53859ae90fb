"""Entities as clusters of names that aliases link, with four guards against runaway merging.

1. Only edges with hard evidence, or of at least ``merge`` weight, join names; weaker ones
   widen candidates elsewhere and merge nothing.
2. A component of over ``most`` names is rejected as a whole: each of its names stays alone.
3. Names with different identifiers never share a cluster: edges join names strongest first,
   and one that would bring two identifiers together is flagged instead. On a path between
   two such names it is the weakest.
4. Every edge comes back with what became of it and in which cluster, so that a cluster can be
   explained and an edge retracted.

Components are found by joins. Guard 2 comes before guard 3, so the groups in which
edges are tried one by one have at most ``most`` names and, repeats being merged, ``most`` squared edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermark.functions.order import checkpointed

HARD = ("gstin", "cin", "human")
EDGES = "component string, a string, b string, weight double, evidence string, cluster string, status string"


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``edges(a, b)`` -> ``name, component``, the least name that can be reached.

    Each round every name takes the least label of itself and its neighbours, and then
    its label's label, so labels travel twice as far each round. Both steps are grouped minima.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("low")).select("name", F.least("name", "low").alias("component")))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("component").alias("low"))
        hop = label.join(near, "name").select("name", F.col("component").alias("old"), F.least("component", "low").alias("new"))
        up = label.select(F.col("name").alias("new"), F.col("component").alias("root"))
        # a name's old label learns the new one too, which carries it past the name's own neighbours
        told = hop.groupBy(F.col("old").alias("name")).agg(F.min("new").alias("told"))
        now = hop.join(up, "new", "left").join(told, "name", "left").select("name", "old", F.least("new", F.coalesce("root", "new"), F.coalesce("told", "new")).alias("component"))
        now = checkpointed(now)
        moved = not now.where("component <> old").isEmpty()
        label = now.select("name", "component")
        if not moved:
            return label
    raise RuntimeError(f"no components after {rounds} rounds")


def _tried(pdf):
    """Edges of one component of bounded size, strongest first; one that would bring two identifiers together is flagged."""
    root, ids = {}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in pdf.itertuples():
        for name, own in ((r.a, r.a_id), (r.b, r.b_id)):
            root.setdefault(name, name)
            ids[name] = own if isinstance(own, str) else None
    pdf = pdf.assign(soft=~pdf["evidence"].isin(HARD)).sort_values(["soft", "weight", "a", "b"], ascending=[True, False, True, True], na_position="last", kind="stable")
    status = []
    for r in pdf.itertuples():
        x, y = sorted((find(r.a), find(r.b)))
        clash = ids[x] is not None and ids[y] is not None and ids[x] != ids[y]
        status.append("flagged" if clash else "merged")
        if not clash and x != y:
            root[y] = x
            ids[x] = ids[x] or ids[y]
    # the least name is the root, as the lesser of two roots stays one
    return pdf.assign(status=status, cluster=[find(a) if s == "merged" else None for a, s in zip(pdf["a"], status, strict=True)])[["component", "a", "b", "weight", "evidence", "cluster", "status"]]


def clustered(names: DataFrame, edges: DataFrame, merge: float = 0.85, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """``names(name, identifier)`` and ``edges(a, b, weight, evidence)`` -> names with their cluster, and edges with what became of them.

    Names: ``name, identifier, cluster, state``, the cluster being its least name and the
    state ``single``, ``clustered`` or ``oversized``. Edges: ``a, b, weight, evidence, cluster,
    status``, the status ``merged``, ``flagged``, ``oversized`` or ``weak``; ``a`` < ``b``, and of edges
    between the same names with the same evidence the strongest counts. Edges of a name with itself, with a null or of
    unknown names are left out; a name that is given twice has its least identifier; an empty identifier is none.
    """
    names = checkpointed(names.where("name is not null").groupBy("name").agg(F.min(F.when(F.col("identifier") != "", F.col("identifier"))).alias("identifier")))
    known = lambda end: names.select(F.col("name").alias(end), F.col("identifier").alias(f"{end}_id"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"), "evidence").where("a <> b")
    edges = checkpointed(edges.groupBy("a", "b", "evidence").agg(F.max("weight").alias("weight")).join(known("a"), "a").join(known("b"), "b"))
    strong = F.coalesce(F.col("evidence").isin(*HARD), F.lit(False)) | F.coalesce((F.col("weight") >= merge) & ~F.isnan("weight"), F.lit(False))
    found = checkpointed(components(edges.where(strong)))
    sizes = found.groupBy("component").agg((F.count("*") > most).alias("over"))
    found = checkpointed(found.join(sizes, "component"))
    at = edges.where(strong).join(found.select(F.col("name").alias("a"), "component", "over"), "a")
    tried = checkpointed(at.where("not over").drop("over").groupBy("component").applyInPandas(_tried, EDGES))
    cols = ["a", "b", "weight", "evidence", "cluster", "status"]
    lost = at.where("over").withColumn("cluster", F.lit(None).cast("string")).withColumn("status", F.lit("oversized"))
    weak = edges.where(~strong).withColumn("cluster", F.lit(None).cast("string")).withColumn("status", F.lit("weak"))
    merged = tried.where("status = 'merged'")
    homes = merged.select(F.col("a").alias("name"), "cluster").union(merged.select("b", "cluster")).distinct()
    out = names.join(homes, "name", "left").join(found.select("name", "over"), "name", "left")
    state = F.when(F.col("over"), "oversized").when(F.col("cluster").isNotNull(), "clustered").otherwise("single")
    return out.select("name", "identifier", F.coalesce("cluster", "name").alias("cluster"), state.alias("state")), tried.select(*cols).union(lost.select(*cols)).union(weak.select(*cols))
