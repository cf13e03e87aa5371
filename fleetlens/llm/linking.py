"""Exact links between members of common buckets, and connected components.

Both parts are made of joins and aggregations with partial sums, so a bucket, a
leader or a component may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.workspace import Workspace


SLICES = 4  # parts of the elements of open buckets that are shuffled one after the other
WORDS = 16  # of 64 bits in the sketch of a set
BLOCK = 4096  # members of an open group that a task holds against the others
FEW = 1 << 18  # pairs that are checked at once


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """Rows (id, component) for every end of ``edges`` (a, b); component is the smallest id reachable.

    Distributed union-find: rounds of large stars (each larger neighbour moves to
    the smallest id of the neighbourhood) and small stars (the smaller neighbours
    do), until no edge changes; then every edge leads to its root. A null end or a
    loop is no edge; no edges give an empty table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = ws.store(edges, f"{name}-0")
    state = _checksum(now)
    for k in count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(low, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = f"{name}-{k - 1}", ws.store(small, f"{name}-{k}")
        ws.drop(before)
        if state == (state := _checksum(now)):
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def rare_pairs(sets: DataFrame, ws: Workspace, num: int, den: int, block: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (id, component, set) of different components that hold every link between such.

    Elements are put in one order for all sets: those that one component holds alone, which no
    such pair shares (they are only counted), then those that the fewest hold. A link
    shares num/den of either set, so at most n - ceil(num/den * n) elements of a set of n
    are not shared, and the first ones up to one more hold the first shared element of
    both. What follows that element bounds the intersection. Both are exact: no link is lost.
    Elements, then sets, are shuffled a quarter at a time.
    """
    each = sets.select("id", "component", F.explode("set").alias("h"))

    def united(name: str, build: Callable[[int], DataFrame]) -> DataFrame:
        tables = [ws.store(build(g), f"{name}-{g}") for g in range(SLICES)]
        return reduce(DataFrame.unionByName, tables)

    def count_held(g: int) -> DataFrame:
        held = each.where(F.pmod("h", F.lit(SLICES)) == g).groupBy("h")
        held = held.agg(F.count(F.lit(1)).alias("times"), F.min("component").alias("low"), F.max("component").alias("high"))
        return held.where("low <> high").select("h", "times")

    held = united("held", count_held)

    def prefixes(g: int) -> DataFrame:
        here = F.pmod(F.xxhash64("id"), F.lit(SLICES)) == g
        order = each.where(here).select("id", "h").join(held, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("order"))
        order = order.join(sets.where(here).select("id", "component", F.size("set").alias("n")), "id").withColumn("own", F.col("n") - F.size("order"))
        some = F.greatest(F.col("n") - F.ceil(F.col("n") * num / den - 1e-9).cast("int") + 1 - F.col("own"), F.lit(0))
        first = order.select("id", "component", "n", "own", F.posexplode(F.slice("order", F.lit(1), some)).alias("at", "e"))
        return first.select("id", F.col("e.h").alias("h"), (F.col("n") - F.col("own") - F.col("at")).alias("left"), "n", "component")

    first = united("prefixes", prefixes)
    ws.drop(*(f"held-{g}" for g in range(SLICES)))
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    several = several.where("low <> high").select("h", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    first = first.join(several, "h")
    carried = ("id", "component", "left", "n")
    x = first.select("h", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"), *(F.col(c).alias(f"a_{c}") for c in carried))
    y = first.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in carried))
    near = F.least("a_left", "b_left") * (den + num) >= (F.col("a_n") + F.col("b_n")) * num
    both = x.join(y, ["h", "part"]).where((F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component")) & near)
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """(id, n, s0, s1, ...) of rows (id, set): its size, and a bit for each residue of hashed elements that tells whether an odd number have it.

    An element of both sets changes both sketches alike, so two sets differ in at least as many elements as their sketches in bits.
    """
    each = sets.select("id", F.explode("set").alias("h")).select("id", F.xxhash64("h").alias("h"))
    each = each.select("id", F.expr(f"shiftright(h, 6) & {WORDS - 1}").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    odd = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(WORDS)]
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *odd)


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(WORDS)))


def _may_link(apart: Column, both: Column, num: int, den: int) -> Column:
    """False only where sets of ``both`` elements that differ in ``apart`` of them or more can't be linked."""
    return apart.cast("long") * (den + num) <= both * (den - num)


def _ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (id, ...) for both, named a_ and b_."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in table.columns if c != "id")), end)
    return pairs


def open_pairs(members: DataFrame, shapes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b, a_component, b_component, apart): pairs of one group and different components that their sketches don't rule out.

    ``members``: (leader, id, component) of the groups, ``shapes``: what ``sketches`` returns. Every pair of a group is held against
    each other inside the join, so that only what may be a link leaves it, in the first group that has both. Large groups are dealt out in blocks.
    """
    members = members.join(members.groupBy("id").agg(F.collect_set("leader").alias("leaders")), "id")
    sizes = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    full = members.join(sizes, "leader").join(shapes, "id")
    carried = ("id", "component", "leaders", *(c for c in shapes.columns if c != "id"))
    x = full.select("leader", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("part"), *(F.col(c).alias(f"a_{c}") for c in carried))
    y = full.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *(F.col(c).alias(f"b_{c}") for c in carried))
    apart = _apart("a_", "b_")
    near = (F.col("a_n") * den >= F.col("b_n") * num) & (F.col("b_n") * den >= F.col("a_n") * num) & _may_link(apart, F.col("a_n") + F.col("b_n"), num, den)
    near &= F.array_min(F.array_intersect("a_leaders", "b_leaders")) == x["leader"]
    same = (x["leader"] == y["leader"]) & (x["part"] == y["part"]) & (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
    both = x.join(y, same & near)
    share = (apart / (F.col("a_n") + F.col("b_n"))).cast("float")
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_component", "b_component", share.alias("apart"))


def settle(pairs: DataFrame, check: Callable[[DataFrame, str], DataFrame], ws: Workspace, few: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (see ``open_pairs``) that connect whatever all links among them connect.

    ``check`` returns those of its pairs that are links. While there are more than ``few`` pairs, each component's nearest one is checked first
    and what becomes one component needs no further check, so that a dense group isn't checked pair by pair. The others all are.
    """
    done: list[DataFrame] = []
    for k in count():
        if pairs.count() <= few:
            break
        ends = pairs.select(F.col("a_component").alias("c"), "apart", "a", "b").unionByName(pairs.select(F.col("b_component").alias("c"), "apart", "a", "b"))
        best = ends.groupBy("c").agg(F.min(F.struct("apart", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
        best = ws.store(best, f"nearest-{k}")
        links = check(best, f"links-{k}")
        done.append(links)
        joined = components(links.join(pairs, ["a", "b"]).select(F.col("a_component").alias("a"), F.col("b_component").alias("b")), ws, f"merged-{k}")
        left = pairs.join(best, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            to = joined.select(F.col("id").alias(f"{end}_component"), F.col("component").alias("to"))
            left = left.join(to, f"{end}_component", "left").withColumn(f"{end}_component", F.coalesce("to", f"{end}_component")).drop("to")
        pairs = ws.store(left.where("a_component <> b_component").select("a", "b", "a_component", "b_component", "apart"), f"unsettled-{k}")
        ws.drop(f"nearest-{k}", f"unsettled-{k - 1}")
        if links.isEmpty():
            break
    done.append(check(pairs.select("a", "b"), "more"))
    return reduce(DataFrame.unionByName, done)


def _link_by_sketches(
    buckets: list[DataFrame], fetch: Callable, verify: Callable, ws: Workspace, num: int, den: int, sets: Callable[[Column], Column],
) -> DataFrame:
    """``link`` with ``sets``: nothing but ids and leaders is kept of the buckets, and sketches come before bodies."""
    parts = []
    for g, part in enumerate(buckets):
        multi = part.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last")
        multi = ws.store(multi.select("key", "leader"), f"multi-{g}")
        parts.append(ws.store(part.join(multi, "key").select("id", "leader").distinct(), f"hits-{g}"))
        ws.drop(f"multi-{g}")
    hits = ws.store(reduce(DataFrame.unionByName, parts).distinct(), "hits")
    ws.drop(*(f"hits-{g}" for g in range(len(parts))))
    # an id that comes twice would cancel itself in its sketch
    bodies = ws.store(fetch(hits.select("id").distinct()).select("id", "body").dropDuplicates(["id"]), "bodies")
    shapes = ws.store(sketches(bodies.select("id", sets(F.col("body")).alias("set"))), "sketches")
    linked = F.expr(f"({den}L + {num}L) * common >= {num}L * both")

    def check(pairs: DataFrame, name: str) -> DataFrame:
        return ws.store(verify(_ends(pairs, bodies).select("a", "b", "a_body", "b_body")).where(linked).select("a", "b"), name)

    held = _ends(hits.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")), shapes)
    star = check(held.where(_may_link(_apart("a_", "b_"), F.col("a_n") + F.col("b_n"), num, den)).select("a", "b"), "star")
    found = ws.store(components(star, ws), "found")
    member = hits.where("id <> leader").join(found, "id", "left").select("leader", "id", F.coalesce("component", "id").alias("component"))
    split = member.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = ws.store(member.join(split.select("leader"), "leader"), "open")
    ws.drop("star", "hits")
    if rest.isEmpty():
        ws.drop("bodies", "sketches", "open")
        return found
    pairs = ws.store(open_pairs(rest, shapes, num, den, BLOCK), "unsettled--1")
    more = settle(pairs, check, ws, max(FEW, shapes.count()))
    known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    out = ws.store(components(known.unionByName(more), ws, "joined"), "linked")
    ws.drop("bodies", "sketches", "open", "found")
    return out


def link(
    buckets: DataFrame | list[DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    ws: Workspace,
    num: int = 80,
    den: int = 100,
    block: int = 256,
    dense: Callable[[DataFrame], DataFrame] | None = None,
    elements: Callable[[Column], Column] | None = None,
    sets: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Components (id, component) of the links between ids that share a bucket.

    ``buckets``: (key, id), or several such tables without common keys, which are
    shuffled one after the other. Where they also have ``n``, the size of the id's set, pairs whose sizes alone rule a
    link out (den * smaller < num * larger) are not compared. ``fetch`` maps a table of ids to (id, body), or to (id, body, n) with the
    same use of n. ``verify`` maps
    (a, b, a_body, b_body) to (a, b, common, both): the size of the intersection of the
    two sets, and the sum of their sizes. Two ids are linked if den * |A & B| >= num * |A | B|.

    1. Every member of a bucket is compared with the bucket's smallest id, its
       leader: linear in the members. That settles nearly every bucket.
    2. Of buckets whose other members still lie in different components, these are compared with
       each other, once for each pair, but for pairs in one component and pairs that the
       leader's distances rule out: Jaccard distance is a metric, so two members
       whose distances to the leader differ by more than 1 - num/den aren't linked.
       Large buckets are dealt out in blocks. Where ``dense`` is given, it gets pairs of
       blocks as sorted rows (key, i, j, block, id, body) and returns links (a, b) that connect
       whatever the links between block i and block j connect; no pair leaves it else.
       Where ``elements`` is given, which maps a body to its set, only members that share a
       rare element are compared (see ``rare_pairs``), whatever buckets they share.
       Where ``sets`` is given, which maps a body to its set, buckets with the same leader are one group, and
       only pairs that the sketches of their sets don't rule out are verified (see ``open_pairs``, ``settle``).

    No bucket, member or pair is dropped, so the components are those of all
    links between ids with a common bucket (with ``elements``: between members of
    buckets left open, too; with ``sets``: between ids whose buckets have one leader, too).
    """
    if sets is not None:
        return _link_by_sketches(buckets if isinstance(buckets, list) else [buckets], fetch, verify, ws, num, den, sets)
    hits, sized = None, False
    for g, part in enumerate(buckets if isinstance(buckets, list) else [buckets]):
        sized = "n" in part.columns
        first = F.struct("id", "n") if sized else F.struct("id")
        multi = part.groupBy("key").agg(F.min(first).alias("leader"), F.max("id").alias("last")).where("leader.id <> last")
        multi = ws.store(multi.select("key", F.col("leader.id").alias("leader"), *([F.col("leader.n").alias("leader_n")] if sized else [])), f"multi-{g}")
        part = ws.store(part.join(multi, "key").select("key", "id", "leader", *(["n", "leader_n"] if sized else [])).distinct(), f"hits-{g}")
        ws.drop(f"multi-{g}")
        hits = part if hits is None else hits.unionByName(part)
    parts = g + 1

    def fits(a: str, b: str) -> Column:
        return F.col(a) * den >= F.col(b) * num if sized else F.lit(True)

    bodies = ws.store(fetch(hits.select("id").distinct()), "bodies")
    measured = "n" in bodies.columns

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        if measured:
            for end in ("a", "b"):
                pairs = pairs.join(bodies.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n")), end)
            pairs = pairs.where(F.col("a_n") * den >= F.col("b_n") * num).where(F.col("b_n") * den >= F.col("a_n") * num)
        both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("a_body")), "a")
        both = both.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("b_body")), "b")
        return ws.store(verify(both.select("a", "b", "a_body", "b_body")), name)

    linked = F.expr(f"({den}L + {num}L) * common >= {num}L * both")
    star = compare(hits.where("id <> leader").where(fits("n", "leader_n") & fits("leader_n", "n")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "star")
    found = ws.store(components(star.where(linked), ws), "found")

    far = (1 - F.col("common") / (F.col("both") - F.col("common"))).alias("far")
    member = hits.where("id <> leader").join(star.select(F.col("a").alias("id"), F.col("b").alias("leader"), far), ["id", "leader"], "left" if sized or measured else "inner").join(found, "id", "left")
    member = member.select("key", "id", "far", *(["n"] if sized else []), F.coalesce("component", "id").alias("component"))
    split = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    split = split.where("low <> high").select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    rest = ws.store(member.join(split, "key"), "open")
    ws.drop("star", *(f"hits-{g}" for g in range(parts)))
    if rest.isEmpty():
        return found
    if dense is not None:
        spread = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        spread = spread.select("key", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id").join(bodies, "id")
        spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "id", "body")
        more = dense(spread)
        known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        out = ws.store(components(known.unionByName(more), ws, "joined"), "linked")
        ws.drop("bodies", "open", "found")
        return out
    known = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if elements is not None:
        members = ws.store(bodies.join(rest.select("id", "component").distinct(), "id").select("id", "component", "body"), "members")
        ws.drop("open")
        sets = members.select("id", "component", elements(F.col("body")).alias("set"))
        pairs = ws.store(rare_pairs(sets, ws, num, den, block), "pairs")
        ws.drop("members", *(f"prefixes-{g}" for g in range(SLICES)))
        more = compare(pairs, "more").where(linked).select("a", "b")
        ws.drop("pairs", "bodies")
        return ws.store(components(known.unionByName(more), ws, "joined"), "linked")
    rest = rest.join(rest.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")  # an id has a key for each band
    left = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    carried = ("id", "far", "component", "keys", *(["n"] if sized else []))
    left = left.select("key", "part", *(F.col(c).alias(f"a_{c}") for c in carried))
    right = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("key", "part", *(F.col(c).alias(f"b_{c}") for c in carried))
    same = (left["key"] == right["key"]) & (left["part"] == right["part"]) & (F.col("a_id") < F.col("b_id"))
    near = (F.col("a_component") != F.col("b_component")) & F.coalesce(F.abs(F.col("a_far") - F.col("b_far")) <= 1 - num / den + 1e-9, F.lit(True))
    near &= fits("a_n", "b_n") & fits("b_n", "a_n")
    here = F.array_min(F.array_intersect("a_keys", "b_keys")) == left["key"]
    pairs = ws.store(left.join(right, same & near & here).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "pairs")
    ws.drop("open")
    more = compare(pairs, "more").where(linked).select("a", "b")
    ws.drop("pairs", "bodies")
    return ws.store(components(known.unionByName(more), ws, "joined"), "linked")
