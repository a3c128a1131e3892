"""Topological order and cycles of large dependency graphs, without their closure.

Nodes with one edge in and one out form chains; these are contracted by pointer
doubling, so a chain of any length takes as many steps as its length has binary digits.
What is left is peeled: nodes that nothing precedes any more go, level by level, the
same from the other end, and the core that remains is split into its strongly connected
parts by colours that spread forward and are confirmed backward.  Each step writes at most
one row for each node that is left; the number of steps is that of the longest path
after contraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.links import checkpointed


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of distinct (src, dst): (edges (src, dst, steps), members (id, chain, place), chains (chain, head, next), loops (id, ring)).

    A chain's members lie between head and next, place counting from 1; its edge has as many
    steps as edges lay there.  loops are rings of nothing but such nodes, ring their largest id.
    """
    degrees = edges.select(F.col("src").alias("id"), F.lit(0).alias("come"), F.lit(1).alias("go")).union(edges.select("dst", F.lit(1), F.lit(0)))
    inner = checkpointed(degrees.groupBy("id").agg(F.sum("come").alias("come"), F.sum("go").alias("go")).where("come = 1 and go = 1").select("id"))
    is_inner = lambda side: inner.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_inner"))
    marked = checkpointed(edges.join(is_inner("src"), "src", "left").join(is_inner("dst"), "dst", "left").na.fill(False, ["src_inner", "dst_inner"]))
    # a pointer goes to the chain's first member, past so many others
    inside = F.col("src_inner")
    jumps = checkpointed(marked.where("dst_inner").select(F.col("dst").alias("id"), F.when(inside, F.col("src")).otherwise(F.col("dst")).alias("at"), inside.cast("long").alias("past"), (~inside).alias("done"), "dst").withColumnRenamed("dst", "top"))
    most = jumps.count().bit_length()
    for _ in range(most):
        if not jumps.where("not done").take(1):
            break
        far = jumps.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("past").alias("more"), F.col("done").alias("ends"), F.col("top").alias("seen"))
        moved = jumps.where("not done").join(far, "at").select("id", F.col("far").alias("at"), (F.col("past") + F.col("more")).alias("past"), F.col("ends").alias("done"), F.greatest("top", "seen").alias("top"))
        jumps = checkpointed(jumps.where("done").union(moved))
    loops = jumps.where("not done").select("id", F.col("top").alias("ring"))
    members = jumps.where("done").select("id", F.col("at").alias("chain"), (F.col("past") + 1).alias("place"))
    heads = marked.where("dst_inner and not src_inner").select(F.col("dst").alias("chain"), F.col("src").alias("head"))
    ends = marked.where("src_inner and not dst_inner").select(F.col("src").alias("id"), F.col("dst").alias("next")).join(members, "id").select("chain", "next", "place")
    chains = checkpointed(heads.join(ends, "chain"))
    kept = marked.where("not src_inner and not dst_inner").select("src", "dst", F.lit(1).cast("long").alias("steps"))
    edged = kept.union(chains.select(F.col("head").alias("src"), F.col("next").alias("dst"), F.col("place") + 1))
    return checkpointed(edged.groupBy("src", "dst").agg(F.max("steps").alias("steps"))), members, chains.select("chain", "head", "next"), loops


def _peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, level) of the nodes that peeling reaches, those that it leaves); level is the longest way from a node that nothing precedes."""
    come = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    left = checkpointed(nodes.join(come, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0).cast("long").alias("level")))
    done = left.where("need = 0").select("id", "level")
    found = [done]
    while done.take(1):
        passed = edges.join(done.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("steps")).alias("via"))
        left = checkpointed(left.where("need > 0").join(passed, "id", "left").select("id", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"), F.greatest("level", F.coalesce("via", F.lit(0))).alias("level")))
        done = left.where("need = 0").select("id", "level")
        found.append(done)
        if len(found) == 32:  # a plan of bounded size
            found = [checkpointed(_all(found))]
    return _all(found), left.select("id")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between the given nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "steps")


def _spread(held: DataFrame, step) -> DataFrame:
    """held after step() has been taken until it changes nothing; step gives rows with a column ``changed``."""
    while True:
        held = checkpointed(step(held))
        if not held.where("changed").take(1):
            return held.drop("changed")
        held = held.drop("changed")


def _strong(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ring) of the nodes on a cycle: ring is the largest id of their strongly connected part, of a graph whose every node has edges in and out."""
    found, core = None, nodes
    while core.take(1):
        inside = checkpointed(_within(core, edges))

        def forward(held):
            best = inside.join(held.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("seen"))
            return held.join(best, "id", "left").select("id", F.greatest("colour", "seen").alias("colour"), F.coalesce(F.col("seen") > F.col("colour"), F.lit(False)).alias("changed"))

        coloured = _spread(core.select("id", F.col("id").alias("colour")), forward)
        shade = lambda side: coloured.select(F.col("id").alias(side), F.col("colour").alias(f"{side}_colour"))
        same = checkpointed(inside.join(shade("src"), "src").join(shade("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))

        def backward(held):
            reached = same.join(held.where("reached").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("now", F.lit(True))
            return held.join(reached, "id", "left").select("id", "colour", (F.col("reached") | F.coalesce("now", F.lit(False))).alias("reached"), (~F.col("reached") & F.coalesce("now", F.lit(False))).alias("changed"))

        parts = _spread(coloured.withColumn("reached", F.col("id") == F.col("colour")), backward)
        strong = parts.where("reached").select("id", F.col("colour").alias("ring"))
        size = strong.groupBy("ring").agg(F.count("*").alias("n"))
        itself = inside.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("itself"))
        real = strong.join(size, "ring").join(itself, "id", "left").where("n > 1 or itself").select("id", "ring")
        found = real if found is None else found.union(real)
        core = parts.where("not reached").select("id")
        core = _peeled(core, _turned(checkpointed(_within(core, same.withColumn("steps", F.lit(1))))))[1]
    return found if found is not None else nodes.select("id", F.col("id").alias("ring"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "steps")


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, ring) of every distinct node id, and of those that only edges (src, dst) name.

    level is the number of edges on the longest way to a node; ordered by it, and id, a graph is
    in topological order.  It is null on a cycle and for what a cycle leads to.  ring is the
    smallest id of a node's strongly connected part, for nodes on a cycle, itself included; null
    for others.  Null ids and edges with a null end take no part; repeated ones count once.
    """
    pairs = checkpointed(_pairs(edges))
    everyone = nodes.where("id is not null").select("id").union(pairs.select("src")).union(pairs.select("dst")).distinct()
    short, members, chains, loops = contracted(pairs)
    apart = checkpointed(everyone.join(members.select("id").union(loops.select("id")), "id", "left_anti"))
    levels, rest = _peeled(apart, short)
    levels = checkpointed(levels)
    core = _peeled(rest, _turned(checkpointed(_within(rest, short))))[1]
    rings = checkpointed(_strong(core, short))
    ends = chains.join(levels.withColumnRenamed("id", "head"), "head", "left")
    ring_of = lambda side: rings.select(F.col("id").alias(side), F.col("ring").alias(f"{side}_ring"))
    ends = ends.join(ring_of("head"), "head", "left").join(ring_of("next"), "next", "left")
    ends = checkpointed(ends.select("chain", "level", F.when(F.col("head_ring") == F.col("next_ring"), F.col("head_ring")).alias("ring")))
    inner = members.join(ends, "chain").select("id", (F.col("level") + F.col("place")).alias("level"), "ring")
    nowhere = F.lit(None).cast("long").alias("level")
    outer = checkpointed(apart.join(levels, "id", "left").join(rings, "id", "left").select("id", "level", "ring"))
    out = checkpointed(outer.union(inner).union(loops.select("id", nowhere, "ring")))
    on = out.where("ring is not null")
    named = checkpointed(on.groupBy("ring").agg(F.min("id").alias("name")))
    return out.where("ring is null").union(on.join(named, "ring").select("id", "level", F.col("name").alias("ring")))


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): what the edges (src, dst) lead to from the start ids, a start only if a cycle leads back to it; by frontiers, each node once."""
    pairs = checkpointed(_pairs(edges))
    step = lambda rows: pairs.join(rows.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    seen = front = checkpointed(step(starts))
    while front.take(1):
        front = checkpointed(step(front).join(seen, "id", "left_anti"))
        seen = checkpointed(seen.union(front))
    return seen


def blocked_by(edges: DataFrame, refuted: DataFrame) -> DataFrame:
    """Descendants of refuted ids that are not refuted themselves."""
    return descendants(edges, refuted).join(refuted.select("id"), "id", "left_anti")


def graph_findings(claims: DataFrame) -> DataFrame:
    """(rule, id, target) of (id, dependencies): a row for each id on a cycle with its cycle's smallest id, each dependency that is no id, each id that several claims have."""
    deps = claims.select("id", F.explode("dependencies").alias("target")).where("target is not null").distinct()
    known = claims.select(F.col("id").alias("target")).distinct()
    rings = topology(claims, deps.join(known, "target", "left_semi").select(F.col("target").alias("src"), F.col("id").alias("dst"))).where("ring is not null")
    twice = claims.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    rule = lambda rows, name, target: rows.select(F.lit(name).alias("rule"), "id", target.alias("target"))
    return rule(rings, "cyclic", F.col("ring")).union(rule(deps.join(known, "target", "left_anti"), "dangling", F.col("target"))).union(rule(twice, "duplicate", F.col("id")))


def graph_summary(findings: DataFrame) -> DataFrame:
    """One row (acyclic, cyclic, dangling, duplicates, valid) of graph_findings."""
    count = lambda name: F.count_if(F.col("rule") == name).alias(name)
    out = findings.agg(count("cyclic"), count("dangling"), count("duplicate").alias("duplicates"))
    return out.select((F.col("cyclic") == 0).alias("acyclic"), "cyclic", "dangling", "duplicates", (F.col("cyclic") + F.col("dangling") + F.col("duplicates") == 0).alias("valid"))
