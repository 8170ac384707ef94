"""Graph operators over edge DataFrames ``(model_id, src, dst)``: reachability and cycles.

A graph of up to WHOLE_EDGES edges goes into one task as numbers (``whole``).  Larger ones are loops of joins.  Each round's result is checkpointed, so
the plan stays short and a lost executor costs one round; a frontier is broadcast only after its size was measured, otherwise the join shuffles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from estatelens.operators import whole
from estatelens.session import broadcast_if_small, dealt, discard, row_bytes
from estatelens.session import checkpoint as cut
from estatelens.session import written as checkpoint

HOPS = 4
#: Edges that a round of plain reachability follows; a round's time hardly grows with them.
REACH_HOPS = 8
LAYERS = 2
#: Edges of all models that one task takes as numbers.
WHOLE_EDGES = 8_000_000
COMPACT_EVERY = 8
#: Edges on or between cycles of one model that a single task takes.
SMALL_CORE = 200_000
#: Peeling ends with a round that takes off less than this share of the edges.
LEAST_PEEL = 0.1


def _settle(df: DataFrame, write: Callable[[DataFrame], DataFrame] = cut) -> tuple[DataFrame, int, int]:
    """Checkpoint ``df`` and return it with its row count and estimated bytes, taken in the same job."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b"))
    out = write(counted)
    return out, seen.get["n"], seen.get["b"]


def _code(node: str) -> Column:
    return F.xxhash64("model_id", node)


def _coded(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame] | None:
    """Written ``edges`` as numbers ``(a, b)`` in one partition, and the name of each number: ``(h, model_id, node)``.

    None where they are more than one task takes, or where two nodes would share a number.
    """
    if n > WHOLE_EDGES:
        return None
    ends = edges.select("model_id", F.col("src").alias("node")).unionByName(edges.select("model_id", F.col("dst").alias("node")))
    named = checkpoint(ends.select(_code("node").alias("h"), "model_id", "node").distinct())
    if not named.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        discard(named)
        return None
    return edges.select(_code("src").alias("a"), _code("dst").alias("b")).repartition(1), named


def _plain(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges between two nodes, written."""
    apart = edges.where("model_id is not null and src != dst").select("model_id", "src", "dst")
    kept, n, _ = _settle(apart, checkpoint)
    return kept, n


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes ``(model_id, node)`` reachable from ``seeds (model_id, node)``, seeds included, along ``src -> dst``."""
    seeds = checkpoint(seeds.select("model_id", "node").distinct())
    kept, n = _plain(edges)
    coded = _coded(kept, n)
    if coded is None:
        return _reach_in_rounds(kept, seeds)
    pairs, named = coded
    started = named.join(seeds, ["model_id", "node"], "left_semi").select(F.col("h").alias("a"), F.col("h").alias("b"))
    found = checkpoint(pairs.unionByName(started).repartition(1).mapInArrow(whole.from_seeds, "h long"))
    return seeds.unionByName(named.join(found, "h", "left_semi").select("model_id", "node"))


def _reach_in_rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes ``(model_id, node)`` reachable from ``seeds (model_id, node)``, seeds included, along ``src -> dst``.

    One round follows REACH_HOPS edges and settles the nodes it met for the first time, so a graph of depth d costs about d / REACH_HOPS jobs; only those that
    its last hop met first are followed further.  Edges into seeds lead nowhere new and are left out; the others are written in columns once.
    """
    frontier, n, size = _settle(seeds.select("model_id", "node").distinct(), checkpoint)
    known = broadcast_if_small(frontier.withColumnRenamed("node", "dst"), size)
    edges = checkpoint(edges.select("model_id", "src", "dst").join(known, ["model_id", "dst"], "left_anti").select("model_id", "src", "dst"))
    seen, rounds, last = frontier, 0, F.col("_hop") == REACH_HOPS - 1
    while n:
        rounds += 1
        step, met = frontier, None
        for hop in range(REACH_HOPS):
            step = _follow(edges, broadcast_if_small(step, size) if hop == 0 else step)
            found = step.withColumn("_hop", F.lit(hop))
            met = found if met is None else met.unionByName(found)
        first = met.groupBy("model_id", "node").agg(F.min("_hop").alias("_hop")).join(seen, ["model_id", "node"], "left_anti")
        ends = Observation()
        bytes_ahead = F.coalesce(F.sum(F.when(last, row_bytes(first))), F.lit(0))
        new = checkpoint(first.observe(ends, F.count_if(last).alias("n"), bytes_ahead.alias("b")))
        n, size = ends.get["n"], ends.get["b"]
        frontier = new.where(last).select("model_id", "node")
        seen = seen.unionByName(new.select("model_id", "node"))
        if rounds % COMPACT_EVERY == 0:
            seen = checkpoint(seen)
    discard(edges)
    return seen


def _follow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes one edge further.  An inner join, so that a small frontier can be the broadcast side and the edges stay where they lie."""
    return edges.join(nodes.withColumnRenamed("node", "src"), ["model_id", "src"]).select("model_id", F.col("dst").alias("node")).distinct()


def peel(edges: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that cannot lie on a cycle: repeatedly those whose source has no way in or whose target no way out.

    Layers that take off little are left on, long paths above all: they cost a round each, and whatever looks for cycles afterwards finds none there.
    """
    edges, n, _ = _settle(edges.where(F.col("src") != F.col("dst")).select("model_id", "src", "dst").distinct())
    while n:
        kept = edges
        for _ in range(LAYERS):
            sources = kept.select("model_id", F.col("src").alias("dst")).distinct()
            targets = kept.select("model_id", F.col("dst").alias("src")).distinct()
            kept = kept.join(sources, ["model_id", "dst"], "left_semi").join(targets, ["model_id", "src"], "left_semi")
        edges, left, _ = _settle(kept.select("model_id", "src", "dst"))
        little, n = n - left < n * LEAST_PEEL, left
        if little:
            break
    return edges, n


def _rings_of_one(table: pa.Table) -> pa.Table:
    """Kosaraju's two walks over one model's core: nodes in the order they are left, then backwards from the last one."""
    model, follow, back = table.column("model_id")[0].as_py(), defaultdict(list), defaultdict(list)
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
        follow[a].append(b)
        back[b].append(a)
    left, met = [], set()
    for start in [*follow]:
        stack = [] if start in met else [(start, iter(follow[start]))]
        met.add(start)
        while stack:
            node, ahead = stack[-1]
            step = next((x for x in ahead if x not in met), None)
            if step is None:
                left.append(stack.pop()[0])
            else:
                met.add(step)
                stack.append((step, iter(follow.get(step, ()))))
    components, nodes = [], []
    for start in reversed(left):
        group, stack = [], [start] if start in met else []
        met.discard(start)
        while stack:
            node = stack.pop()
            group.append(node)
            new = [x for x in back.get(node, ()) if x in met]
            met.difference_update(new)
            stack.extend(dict.fromkeys(new))
        if len(group) > 1:
            components += [min(group)] * len(group)
            nodes += group
    columns = [pa.array([model] * len(nodes), pa.string()), pa.array(components, pa.string()), pa.array(nodes, pa.string())]
    return pa.Table.from_arrays(columns, ["model_id", "component", "node"])


def _weak(edges: DataFrame) -> DataFrame:
    """``(model_id, node, part)``: the smallest name of the weakly connected component, for every node that isn't itself the smallest.

    Large and small stars in turn: every node links its larger neighbours, then its smaller ones, to the smallest name around it, until each component
    is one star; the rounds grow with the logarithm of the longest path.
    """
    ends = F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    links, before = edges.select("model_id", *ends).distinct(), None
    held = []
    while True:
        both = links.unionByName(links.select("model_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("model_id", "a").agg(F.min(F.least("a", "b")).alias("_low"))
        large = both.where(F.col("b") > F.col("a")).join(low, ["model_id", "a"]).select("model_id", F.col("b").alias("a"), F.col("_low").alias("b"))
        least = large.groupBy("model_id", "a").agg(F.min("b").alias("_low"))
        moved = large.join(least, ["model_id", "a"]).where(F.col("b") > F.col("_low")).select("model_id", F.col("b").alias("a"), F.col("_low").alias("b"))
        seen = Observation()
        stars = moved.unionByName(least.withColumnRenamed("_low", "b")).distinct()
        links = checkpoint(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("model_id", "a", "b")).alias("h")))
        discard(*held)
        held, now = [links], (seen.get["n"], seen.get["h"])
        if now == before:
            return links.select("model_id", F.col("a").alias("node"), F.col("b").alias("part"))
        before = now


def _parts(core: DataFrame) -> DataFrame:
    """``core`` with the weakly connected component of each edge, ``part``, and the edges it has, ``edges``."""
    parts = _weak(core)
    named = core.join(parts.withColumnRenamed("node", "src").hint("merge"), ["model_id", "src"], "left").withColumn("part", F.coalesce("part", "src"))
    sizes = named.groupBy("model_id", "part").agg(F.count(F.lit(1)).alias("edges"))
    return checkpoint(named.join(sizes, ["model_id", "part"]).select("model_id", "src", "dst", "part", "edges"))


def _in_tasks(core: DataFrame, *by: str) -> DataFrame:
    return core.groupBy("model_id", *by).applyInArrow(_rings_of_one, "model_id string, component string, node string")


def cycles(edges: DataFrame, small: int = SMALL_CORE) -> DataFrame:
    """Members of every cycle: ``(model_id, component, node)``, ``component`` being its smallest member."""
    kept, n = _plain(edges)
    coded = _coded(kept, n)
    if coded is None:
        return _cycles_in_rounds(kept, small)
    pairs, named = coded
    found = checkpoint(pairs.mapInArrow(whole.in_cycles, "h long, c long"))
    members = checkpoint(found.join(named, "h").select("c", "model_id", "node"))
    discard(kept, named, found)
    least = members.groupBy("c").agg(F.min("node").alias("component"))
    return members.join(least, "c").select("model_id", "component", "node")


def _cycles_in_rounds(edges: DataFrame, small: int) -> DataFrame:
    """The same for any number of edges.

    After peeling little is left, as a rule: once no model has more than ``small`` edges left, a task takes a model.  Else no cycle leaves its weakly connected
    component, and tasks take those of up to ``small`` edges, several at once.  What is in larger ones, with the same result, goes through strongly connected
    components by colouring: every node takes the largest name that reaches it; a node that keeps its own name is a root, and whatever of its colour reaches
    it back is its component.  All others lie within a colour, so only edges inside one go on.  The work per round is linear in the edges, no pairs of nodes
    are ever formed.
    """
    model = edges.select("model_id", F.col("src").alias("component"), F.col("src").alias("node")).limit(0)
    found = model
    core, n = peel(edges)
    while n:
        most = core.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most <= small:
            return found.unionByName(_in_tasks(core))
        parts = _parts(core)
        bins = F.pmod(F.xxhash64("part"), F.lit(max(1, 4 * n // max(small, 1))))
        found = found.unionByName(_in_tasks(parts.where(F.col("edges") <= small).withColumn("_bin", bins), "_bin"))
        core, n, _ = _settle(parts.where(F.col("edges") > small).select("model_id", "src", "dst"))
        if not n:
            break
        colour = _largest_ancestor(core)
        inside = checkpoint(_within_colour(core, colour))
        roots = colour.where(F.col("node") == F.col("colour"))
        back = inside.select("model_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
        # A root is the largest name of its colour, so it is the largest ancestor, edges turned round, of just those that lead back to it.
        leading = _largest_ancestor(back).withColumnRenamed("colour", "_back").join(colour, ["model_id", "node"]).where(F.col("_back") == F.col("colour"))
        members = leading.select("model_id", "node", "colour").unionByName(roots).distinct()
        # A root alone is no cycle: self references are not edges.
        sized = members.groupBy("model_id", "colour").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("component"))
        group = members.join(sized.where(F.col("_n") > 1), ["model_id", "colour"]).select("model_id", "component", "node")
        found = found.unionByName(checkpoint(group))
        done = checkpoint(members.select("model_id", "node"))
        rest = inside.join(done.withColumnRenamed("node", "src"), ["model_id", "src"], "left_anti").join(
            done.withColumnRenamed("node", "dst"), ["model_id", "dst"], "left_anti"
        )
        core, n = peel(rest)
    return found


def _within_colour(core: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges whose two ends share a colour."""
    a = colour.withColumnsRenamed({"node": "src", "colour": "_from"})
    b = colour.withColumnsRenamed({"node": "dst", "colour": "_to"})
    both = core.join(a, ["model_id", "src"]).join(b, ["model_id", "dst"])
    return both.where(F.col("_from") == F.col("_to")).select("model_id", "src", "dst")


def _largest_ancestor(core: DataFrame) -> DataFrame:
    """``(model_id, node, colour)``: the largest name that leads to each node, its own included.

    Besides its predecessors' colours a node takes that of one ancestor, whose distance doubles each round, so a ring of n takes about log n rounds.
    """
    nodes = core.select("model_id", F.col("src").alias("node")).union(core.select("model_id", "dst")).distinct()
    before = core.groupBy("model_id", F.col("dst").alias("node")).agg(F.max("src").alias("jump"))
    state, _, _ = _settle(nodes.join(before, ["model_id", "node"], "left").select("model_id", "node", F.col("node").alias("colour"), "jump"), checkpoint)
    held = state
    while True:
        pushed = core.join(state.select("model_id", F.col("node").alias("src"), "colour").hint("merge"), ["model_id", "src"]).groupBy(
            "model_id", F.col("dst").alias("node")
        ).agg(F.max("colour").alias("_in"))
        far = state.select("model_id", F.col("node").alias("jump"), F.col("colour").alias("_far"), F.col("jump").alias("_next"))
        met = state.join(pushed, ["model_id", "node"], "left").join(far.hint("merge"), ["model_id", "jump"], "left")
        best = F.greatest("colour", "_in", "_far")
        seen = Observation()
        moved = met.select("model_id", "node", best.alias("colour"), F.col("_next").alias("jump"), (best > F.col("colour")).alias("_moved"))
        settled = checkpoint(moved.observe(seen, F.count_if("_moved").alias("n")))
        discard(held)
        held, state = settled, settled.drop("_moved")
        if seen.get["n"] == 0:
            return state.select("model_id", "node", "colour")


def dead_chains(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """Measures marked as used that no directly used measure reaches."""
    seeds = statuses.where(F.col("status") == "direct").select("model_id", F.col("name").alias("node"))
    alive = reach(edges, seeds).withColumnRenamed("node", "name")
    return statuses.where(F.col("status") != "unused").join(alive, ["model_id", "name"], "left_anti")


def rings(edges: DataFrame, members: DataFrame | None = None, small: int = SMALL_CORE) -> DataFrame:
    """One shortest ring through the smallest member of every cycle: ``(model_id, component, step_no, node, ring_length)``.

    Tasks take whole components of up to ``small`` edges, several at once; only larger ones are walked in rounds.
    """
    keys = ["model_id", "component"]
    members = checkpoint(cycles(edges) if members is None else members)
    ends = members.withColumnRenamed("node", "src"), members.withColumnsRenamed({"node": "dst", "component": "_c"})
    both = edges.where(F.col("src") != F.col("dst")).select("model_id", "src", "dst").distinct().join(ends[0], ["model_id", "src"]).join(ends[1], ["model_id", "dst"])
    inside = checkpoint(both.where(F.col("component") == F.col("_c")).select(*keys, "src", "dst"))
    sizes = checkpoint(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    n, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    bins = F.pmod(F.xxhash64(*keys), F.lit(max(1, 4 * n // max(small, 1))))
    few = inside if most <= small else inside.join(sizes.where(F.col("_n") <= small), keys, "left_semi")
    found = few.withColumn("_bin", bins).groupBy("_bin").applyInArrow(_walks, "model_id string, component string, step_no long, node string, ring_length long")
    if most <= small:
        return found
    large = sizes.where(F.col("_n") > small)
    return found.unionByName(_rings_in_rounds(checkpoint(inside.join(large, keys, "left_semi")), members.join(large, keys, "left_semi")))


def _walks(table: pa.Table) -> pa.Table:
    """The rings of whole components; of several ways to a node the smallest predecessor, as everywhere."""
    after: dict[tuple[str, str], dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for model, component, a, b in zip(*(table.column(c).to_pylist() for c in ("model_id", "component", "src", "dst")), strict=True):
        after[model, component][a].append(b)
    rows = []
    for (model, start), follow in after.items():
        front, parent, closed = [start], {}, False
        while front and not closed:
            found: dict[str, str] = {}
            for a in front:
                for b in follow.get(a, ()):
                    if b not in parent and (b not in found or a < found[b]):
                        found[b] = a
            parent.update(found)
            front, closed = list(found), start in found
        if closed:
            ring = [parent[start]]
            while ring[-1] != start:
                ring.append(parent[ring[-1]])
            rows += [(model, start, step, node, len(ring)) for step, node in enumerate(reversed(ring))]
    names, kinds = ["model_id", "component", "step_no", "node", "ring_length"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _rings_in_rounds(inside: DataFrame, members: DataFrame) -> DataFrame:
    """The rings of components of any size, from the edges inside them.

    A breadth-first walk leaves each component's smallest member and notes from which node every other one was first met, the smallest where several lead there.
    The walk of a component ends where it meets its start again; the notes are then read back with jumps whose length doubles.
    """
    keys = ["model_id", "component"]
    start = members.select(*keys, F.col("component").alias("node")).distinct()
    frontier, n, size = _settle(start.withColumns({"parent": F.lit(None).cast("string"), "depth": F.lit(0)}))
    seen, closed, depth = frontier, [], 0
    while n:
        step, met = frontier.select(*keys, F.col("node").alias("src")), None
        for hop in range(HOPS):
            depth += 1
            ahead = inside.join(broadcast_if_small(step, size) if hop == 0 else step, [*keys, "src"])
            found = ahead.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("parent")).withColumn("depth", F.lit(depth))
            met = found if met is None else met.unionByName(found)
            step = found.where(F.col("node") != F.col("component")).select(*keys, F.col("node").alias("src"))
        first = met.groupBy(*keys, "node").agg(F.min(F.struct("depth", "parent")).alias("_m")).select(*keys, "node", "_m.parent", "_m.depth")
        first = checkpoint(first)
        closed.append(first.where(F.col("node") == F.col("component")))
        new = first.where(F.col("node") != F.col("component")).join(seen, [*keys, "node"], "left_anti").join(closed[-1].select(*keys), keys, "left_anti")
        # What a closing walk met is needed for reading back, but leads no further.
        kept = first.where(F.col("node") != F.col("component")).join(seen, [*keys, "node"], "left_anti")
        seen = checkpoint(seen.unionByName(kept))
        frontier, n, size = _settle(new.where(F.col("depth") == depth))
    if not closed:
        return seen.select(*keys, F.col("depth").cast("long").alias("step_no"), "node", F.col("depth").cast("long").alias("ring_length"))
    last = closed[0]
    for more in closed[1:]:
        last = last.unionByName(more)
    on = last.select(*keys, F.col("parent").alias("node"))
    jump, longest = seen.select(*keys, "node", F.col("parent").alias("up")).where(F.col("up").isNotNull()), 1
    while longest < depth:
        on = checkpoint(on.unionByName(on.join(jump, [*keys, "node"]).select(*keys, F.col("up").alias("node"))))
        further = jump.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"))
        jump = checkpoint(jump.join(further, [*keys, "up"]).select(*keys, "node", F.col("_next").alias("up")))
        longest *= 2
    steps = on.distinct().join(seen, [*keys, "node"]).join(last.select(*keys, F.col("depth").cast("long").alias("ring_length")), keys)
    return steps.select(*keys, F.col("depth").cast("long").alias("step_no"), "node", "ring_length")


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Marks ``(model_id, node, word, bits)`` of ``seeds`` and of every node that leads to them along ``dst -> src``: 64 marks in a word.

    A graph that one task holds is condensed there and sent to all tasks, each of which spreads words of its own: words don't depend on each other.
    """
    kept, n = _plain(edges)
    coded = _coded(kept, n)
    if coded is None:
        return _spread_in_rounds(kept, seeds)
    pairs, named = coded
    made = checkpoint(pairs.mapInArrow(whole.condensed, "h long, at int, to int"))
    layers = edges.sparkSession.sparkContext.broadcast(whole.Layers(made.where("h is null").select("at", "to").toArrow()))
    numbers = checkpoint(made.where("h is not null").select("h", "at").join(named, "h").select("model_id", "node", "at"))
    discard(kept, named, made)
    placed = checkpoint(seeds.select("model_id", "node", "word", "bits").join(numbers.hint("merge"), ["model_id", "node"], "left"))
    words = dealt(placed.where("at is not null").select("at", "word", "bits"), "word")
    marks = checkpoint(words.mapInArrow(lambda batches: layers.value.run(batches), "at int, word long, bits long"))
    spelt = numbers.join(marks.hint("merge"), "at").select("model_id", "node", "word", "bits")
    alone = placed.where("at is null").groupBy("model_id", "node", "word").agg(F.bit_or("bits").alias("bits"))
    return checkpoint(spelt.unionByName(alone))


def _spread_in_rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same for any number of edges.

    All members of a cycle get the same marks, so each cycle is one node until the end; what is left has no cycles and few rounds.
    Only marks that are new to a node go on in the next round; a node holds one number per word, however many marks reach it.
    """
    keys = ["model_id", "node", "word"]
    edges = checkpoint(edges.select("model_id", "src", "dst"))
    members = checkpoint(cycles(edges))

    def whole(df: DataFrame, end: str) -> DataFrame:
        named = df.join(members.withColumnsRenamed({"node": end, "component": "_c"}).hint("merge"), ["model_id", end], "left")
        return named.withColumn(end, F.coalesce("_c", end)).drop("_c")

    between = whole(whole(edges, "src"), "dst").where(F.col("src") != F.col("dst"))
    back = checkpoint(between.select("model_id", F.col("dst").alias("node"), F.col("src").alias("_to")).distinct())
    either, none = F.bit_or("bits").alias("bits"), F.lit(0).cast("long")

    def settled(rows: DataFrame) -> tuple[DataFrame, int, int]:
        """All marks of each node, with those it had before; the new ones are counted in the same job."""
        new, seen = F.col("bits").bitwiseAND(F.bitwise_not("_had")) != 0, Observation()
        merged = rows.groupBy(*keys).agg(either, F.bit_or("_had").alias("_had"))
        size = F.coalesce(F.sum(F.when(new, row_bytes(merged))), F.lit(0))
        return checkpoint(merged.observe(seen, F.count_if(new).alias("n"), size.alias("b"))), seen.get["n"], seen.get["b"]

    state, n, size = settled(whole(seeds, "node").select(*keys, "bits", none.alias("_had")))
    while n:
        added = F.col("bits").bitwiseAND(F.bitwise_not("_had"))
        step, met = state.select(*keys, added.alias("bits")).where("bits != 0"), state.select(*keys, "bits", F.col("bits").alias("_had"))
        for hop in range(HOPS):
            ahead = back.join(broadcast_if_small(step, size) if hop == 0 else step.hint("merge"), ["model_id", "node"])
            step = ahead.groupBy("model_id", F.col("_to").alias("node"), "word").agg(either)
            met = met.unionByName(step.withColumn("_had", none))
        before, (state, n, size) = state, settled(met)
        discard(before)
    each = members.select("model_id", F.col("node").alias("_member"), F.col("component").alias("node"))
    spelt = state.join(each.hint("merge"), ["model_id", "node"], "left")
    return checkpoint(spelt.select("model_id", F.coalesce("_member", "node").alias("node"), "word", "bits"))


def marked(words: DataFrame, name: str) -> DataFrame:
    """How many rows of ``words (model_id, word, bits)`` hold each mark: ``(model_id, mark, name)``, marks from 0."""
    # Rows with the same bits first: the 64 sums then go over few rows.
    alike = words.groupBy("model_id", "word", "bits").agg(F.count(F.lit(1)).alias("_rows"))
    bits = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1).cast("long")) * F.col("_rows")) for k in range(64)]
    counted = alike.groupBy("model_id", "word").agg(F.array(*bits).alias("_n"))
    return counted.select("model_id", "word", F.posexplode("_n").alias("_at", name)).where(F.col(name) > 0).select(
        "model_id", (F.col("word") * 64 + F.col("_at")).alias("mark"), name
    )
