"""Consolidating pairwise links into families: connected components by shrinking the graph.

The graph is made smaller until little of it is left, the rest is solved, and the labels go back:

1. *strip*: a vertex of degree one leaves the graph with a pointer to its only neighbour;
2. *compress*: paths of degree-two vertices are ranked by pointer doubling over half-edges, replaced
   by one edge between their two ends, and their vertices point to one end (a ring of such vertices
   is a component of its own and points to its least vertex);
3. *core*: what still has edges is solved by alternating large-star and small-star steps;
4. *restore*: the pointers are followed backwards, newest first.

Links come as a star for each shared form (all to the least record that has it), so a form of a
third of all records adds one edge a record, never the pairs within it. Degrees are aggregated
before the shuffle and removed edges are taken out by the pair of their ends, a key that is never
hot. Each step is cut with a checkpoint, every loop ends when nothing changes, nothing but counts
reaches the driver.

Defined results: self-links and repeated links count once, null ids and empty forms link nothing;
the label of a family is its least id; vertices without links don't come out; empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.operators.components import stars
from lexiforge.runtime import cut

#: The graph is shrunk while a pass removes at least this share of the edges.
WORTHWHILE = 0.2
SALTS, HOT_FORMS = 16, 1024


def _undirected(links: DataFrame, a: str, b: str) -> DataFrame:
    pairs = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    both = F.col("a").isNotNull() & (F.col("a") != F.col("b"))
    return pairs.where(both).distinct()


def _halves(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("v", "u")


def _degrees(edges: DataFrame) -> DataFrame:
    """``v, deg, n1, n2``: degree, least and greatest neighbour."""
    return _halves(edges).groupBy("v").agg(F.count("*").alias("deg"), F.min("u").alias("n1"), F.max("u").alias("n2"))


def strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those of degree-one vertices, and ``v, p``: the pointers of the vertices removed."""
    leaves = _degrees(edges).where("deg = 1").select(F.least("v", "n1").alias("a"), F.greatest("v", "n1").alias("b"), "v")
    gone = leaves.groupBy("a", "b").agg(F.max("v").alias("v"))  # of a pair of leaves the greater goes
    gone = cut(gone.select("a", "b", "v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("p")))
    return cut(edges.join(gone.select("a", "b"), ["a", "b"], "left_anti")), gone.select("v", "p")


def compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with each path of degree-two vertices made one edge, and the pointers of the vertices removed."""
    inner = cut(_degrees(edges).where("deg = 2").select("v", "n1", "n2"))
    if inner.isEmpty():
        return edges, inner.select("v", F.col("n1").alias("p"))
    way = inner.select(F.col("n1").alias("f"), F.col("v").alias("at"), F.col("n2").alias("to")).unionByName(
        inner.select(F.col("n2").alias("f"), F.col("v").alias("at"), F.col("n1").alias("to"))
    )
    onward = inner.select(F.col("v").alias("to"), F.lit(True).alias("more"))
    # a half-edge f -> at goes on to at -> to; jf, jt: the half-edge it has jumped to; low: least vertex passed
    state = way.join(onward, "to", "left").select("f", "at", F.col("at").alias("jf"), F.col("to").alias("jt"), F.coalesce("more", F.lit(False)).alias("more"), F.col("at").alias("low"))
    state = cut(state)
    left, lows = None, None
    while True:
        now = state.agg(F.count_if("more").alias("n"), F.sum(F.when(F.col("more"), F.xxhash64("low").cast("decimal(38,0)"))).alias("s")).first()
        if not now["n"] or (now["n"], now["s"]) == (left, lows):  # done, or only rings are left and their least is everywhere
            break
        left, lows = now["n"], now["s"]
        ahead = state.select(F.col("f").alias("jf"), F.col("at").alias("jt"), F.col("jf").alias("f2"), F.col("jt").alias("t2"), F.col("more").alias("m2"), F.col("low").alias("l2"))
        moving = state.where("more").join(ahead, ["jf", "jt"]).select("f", "at", F.col("f2").alias("jf"), F.col("t2").alias("jt"), F.col("m2").alias("more"), F.least("low", "l2").alias("low"))
        state = cut(state.where(~F.col("more")).unionByName(moving))
    chain = cut(
        state.groupBy("at").agg(F.min(F.when(~F.col("more"), F.col("jt"))).alias("e1"), F.max(F.when(~F.col("more"), F.col("jt"))).alias("e2"), F.min("low").alias("low"))
    )
    pointers = chain.select(F.col("at").alias("v"), F.coalesce("e1", "low").alias("p")).where("v != p")
    gone = _halves(inner.select(F.col("v").alias("a"), F.col("n1").alias("b")).unionByName(inner.select(F.col("v").alias("a"), F.col("n2").alias("b")))).toDF("a", "b")
    kept = edges.join(gone.where("a < b").distinct(), ["a", "b"], "left_anti")
    bridges = chain.where("e1 is not null and e1 != e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    return cut(kept.select("a", "b").unionByName(bridges).distinct()), pointers


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label``: every linked vertex with the least vertex of its component."""
    edges = cut(_undirected(links, a, b))
    pointers: list[DataFrame] = []
    size = edges.count()
    while size:
        for step in (strip, compress):
            edges, gone = step(edges)
            pointers.append(gone)
        left = edges.count()
        if left > size * (1 - WORTHWHILE):
            break
        size = left
    labels = stars(edges)
    for gone in reversed(pointers):
        known = labels.select(F.col("v").alias("p"), "rep")
        labels = labels.unionByName(gone.join(known, "p", "left").select("v", F.coalesce("rep", "p").alias("rep")))
        labels = cut(labels)
    least = labels.groupBy("rep").agg(F.min("v").alias("m")).select("rep", F.least("rep", "m").alias("label"))
    of_reps = least.select(F.col("rep").alias("v"), "label")
    return labels.join(least, "rep").select("v", "label").unionByName(of_reps)


def family_links(groups: DataFrame) -> DataFrame:
    """``a, b``: each record linked to the least record of the same position that shares a form with it.

    A record whose ``edge_types`` are not empty and name nothing but ``gate`` or ``cross_lang`` was
    held back: only its ``canonical`` counts. A null position is a position of its own.
    """
    kinds = F.coalesce("edge_types", F.array().cast("array<string>"))
    held = (F.size(kinds) > 0) & F.forall(kinds, lambda k: F.coalesce(F.trim(F.lower(k)).isin("gate", "cross_lang"), F.lit(False)))
    variants = F.when(held, F.array().cast("array<string>")).otherwise(F.coalesce("variants", F.array().cast("array<string>")))
    rows = groups.select("group_id", "pos", F.array_distinct(F.transform(F.concat(F.array("canonical"), variants), strings.bare_form)).alias("forms"))
    keyed = rows.select("group_id", F.coalesce("pos", F.lit("\0")).alias("pos"), F.explode("forms").alias("form"))
    keyed = keyed.where((F.length("form") > 0) & F.col("group_id").isNotNull())
    least = keyed.groupBy("pos", "form").agg(F.min("group_id").alias("b"), F.max("group_id").alias("top"), F.count("*").alias("n")).where("b != top")
    least = cut(least.select("pos", "form", "b", "n"))
    # no more than HOT_FORMS forms can each have a HOT_FORMS-th of all rows: those meet their records in SALTS tasks each
    most = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("n") > max(SALTS, most / HOT_FORMS)
    spread = least.select("pos", "form", "b", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    marked = keyed.join(F.broadcast(least.where(hot).select("pos", "form", F.lit(True).alias("hot"))), ["pos", "form"], "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("group_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(spread, ["pos", "form", "salt"]).select(F.col("group_id").alias("a"), "b").where("a != b")


def families(groups: DataFrame) -> DataFrame:
    """``group_id, cluster_id`` of every record in a family of two or more."""
    got = components(family_links(groups))
    return got.select(F.col("v").alias("group_id"), F.col("label").alias("cluster_id"))
