"""Communities: weighted undirected views of a dependency graph, quality measures, and Leiden detection.

The measures are DataFrame aggregates over weighted(u, v, w) with u <= v (u = v: a self-loop) and assignments(node,
community). Detection itself moves one node at a time and is one Python task for each graph.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlattice.functions.paths import order_key
from driftlattice.operators.graph import clean_edges, links_by_key, number_components, number_edges, numbered
from driftlattice.session import checkpointed

MIN_GAIN = 1e-10
REFINE_SWEEPS = 10
LINKS_AT_ONCE = 1 << 20
MOST_TASKS = 1024


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(u, v, w): weights of an unordered pair summed up; an edge without a weight counts 1."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    return edges.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum(w).alias("w"))


def weighted_edges(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """edges(source, target) with the weight of their unordered pair, 1 where none is given."""
    keyed = weights.select(F.least("source", "target").alias("__u"), F.greatest("source", "target").alias("__v"), "weight")
    on = (F.least("source", "target") == F.col("__u")) & (F.greatest("source", "target") == F.col("__v"))
    return edges.join(keyed, on, "left").select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def caller_weights(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """weights(ordinal, source, target, weight) over known nodes, one for each unordered pair: the last one given."""
    ids = nodes.select(F.col("id").alias("__id"))
    known = weights.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    return known.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max_by("weight", "ordinal").alias("weight"))


def weighted_degrees(weighted: DataFrame) -> DataFrame:
    """(node, degree): a self-loop counts twice."""
    both = weighted.select(F.explode(F.array("u", "v")).alias("node"), "w")
    return both.groupBy("node").agg(F.sum("w").alias("degree"))


def community_edges(weighted: DataFrame, assignments: DataFrame) -> DataFrame:
    """weighted with the communities of both ends: cu, cv."""
    a = assignments.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = assignments.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    return weighted.join(a, "u").join(b, "v")


def modularity(weighted: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row: the sum over communities of l / m - (s / 2m)^2; 0 without edges."""
    rows = community_edges(weighted, assignments)
    sides = rows.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0).alias("inner"), "w"), F.struct(F.col("cv").alias("c"), F.lit(0.0).alias("inner"), "w"))).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("inner").alias("l"), F.sum("w").alias("s"))
    m = weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m"))
    both = per.crossJoin(F.broadcast(m))  # one row
    return both.agg(F.coalesce(F.sum(F.when(F.col("m") > 0, F.col("l") / F.col("m") - F.pow(F.col("s") / (2 * F.col("m")), 2))), F.lit(0.0)).alias("modularity"))


def community_density(weighted: DataFrame, assignments: DataFrame) -> DataFrame:
    """(community, size, density): inner weight over possible pairs; 1 for a single node."""
    rows = community_edges(weighted.filter("u != v"), assignments).filter("cu = cv").groupBy(F.col("cu").alias("__c")).agg(F.sum("w").alias("inner"))
    sizes = community_sizes(assignments)
    n = F.col("size").cast("double")
    density = F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("inner", F.lit(0.0)) / (n * (n - 1) / 2))
    return sizes.join(rows, F.col("community") == F.col("__c"), "left").select("community", "size", density.alias("density"))


def community_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def community_members(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("community").agg(F.sort_array(F.collect_set("node")).alias("members"))


def partition_stats(assignments: DataFrame) -> DataFrame:
    """One row: node_count, community_count, largest_community_size; 0 without nodes."""
    sizes = community_sizes(assignments)
    return sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("node_count"), F.count(F.lit(1)).alias("community_count"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest_community_size"))


def edge_weights(weighted: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with the weight between a and b in either order, 0 where there is no edge."""
    known = weighted.select(F.col("u").alias("__u"), F.col("v").alias("__v"), "w")
    on = (F.least("a", "b") == F.col("__u")) & (F.greatest("a", "b") == F.col("__v"))
    return pairs.join(known, on, "left").select("a", "b", F.coalesce("w", F.lit(0.0)).alias("weight"))


def quotient(weighted: DataFrame, assignments: DataFrame) -> DataFrame:
    """The graph of communities: inner weights become self-loops, others are summed up."""
    rows = community_edges(weighted, assignments)
    return rows.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w"))


def induced(weighted: DataFrame, members: DataFrame) -> DataFrame:
    """The edges between nodes of members(node)."""
    ids = members.select(F.col("node").alias("__id"))
    return weighted.join(ids, F.col("u") == F.col("__id"), "left_semi").join(ids, F.col("v") == F.col("__id"), "left_semi")


def path_partition(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    return nodes.select("id", "path").join(assignments, F.col("id") == F.col("node")).select("path", "community")


class Network:
    """An undirected weighted graph over 0..n-1 for one task, as flat arrays: to[start[x]:start[x + 1]] are x's neighbours
    and weight the same of their links, each of which stands at both of its ends. Self-loops are apart."""

    def __init__(self, n: int, links: dict[tuple[int, int], float]):
        ends = np.array(list(links), np.int64).reshape(-1, 2)
        w = np.fromiter(links.values(), np.float64, len(links))
        inner = ends[:, 0] == ends[:, 1]
        loops = np.bincount(ends[inner, 0], w[inner], n)
        a, b, w = *ends[~inner].T, w[~inner]
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        order = np.lexsort((b, a))
        self.fill(np.bincount(a, minlength=n), b[order], w[order], loops)

    @classmethod
    def of_arrays(cls, counts: np.ndarray, to: np.ndarray, weight: np.ndarray, loops: np.ndarray | None = None, total: float | None = None) -> Network:
        net = cls.__new__(cls)
        net.fill(counts, to, weight, np.zeros(len(counts)) if loops is None else loops)
        if total is not None:
            net.total = total
        return net

    def fill(self, counts: np.ndarray, to: np.ndarray, weight: np.ndarray, loops: np.ndarray) -> None:
        self.n, self.counts = len(counts), counts.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.ends = to.astype(np.int32 if self.n < 1 << 31 else np.int64, copy=False)
        self.weights, self.loops = weight, loops.astype(np.float64)
        degree, some = 2 * self.loops, self.counts > 0
        if some.any():
            degree[some] += np.add.reduceat(weight, self.starts[:-1][some], dtype=np.float64)
        self.degree = degree.tolist()
        self.total = float(degree.sum()) / 2
        self.start, self.to, self.weight = memoryview(self.starts), memoryview(np.ascontiguousarray(self.ends)), memoryview(np.ascontiguousarray(weight))

    def links(self, v: int) -> tuple[list[int], list[float]]:
        a, b = self.start[v], self.start[v + 1]
        return self.to[a:b].tolist(), self.weight[a:b].tolist()

    @cached_property
    def near(self) -> list[dict[int, float]]:
        """Neighbours of each node with the weights of their links; for small graphs."""
        return [dict(zip(*self.links(v), strict=True)) for v in range(self.n)]

    def aggregate(self, of: list[int]) -> tuple[Network, list[int]]:
        """The network of groups, and the number of each node's group. Groups are summed up some at a time."""
        number: dict[int, int] = {}
        at = [number.setdefault(c, len(number)) for c in of]
        group, k = np.array(at, np.int64), len(number)
        order = np.argsort(group, kind="stable")
        behind = np.concatenate([[0], np.cumsum(self.counts[order])])
        first = np.searchsorted(group[order], np.arange(k + 1))
        loops, counts, to, weight = np.bincount(group, self.loops, k), np.zeros(k, np.int64), [], []
        a = 0
        while a < k:
            b = max(a + 1, int(np.searchsorted(behind[first], behind[first[a]] + LINKS_AT_ONCE, "right")) - 1)
            own = order[first[a] : first[b]]
            n = self.counts[own]
            places = np.arange(n.sum()) + np.repeat(self.starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            keys, w = np.repeat(group[own], n) * k + group[self.ends[places]], self.weights[places].astype(np.float64)
            keys, where = np.unique(keys, return_inverse=True)
            w, sides = np.bincount(where, w, len(keys)), np.divmod(keys, k)
            inner = sides[0] == sides[1]
            loops[sides[0][inner]] += w[inner] / 2
            counts += np.bincount(sides[0][~inner], minlength=k)
            to.append(sides[1][~inner].astype(np.int32 if k < 1 << 31 else np.int64))
            weight.append(w[~inner])
            a = b
        return Network.of_arrays(counts, np.concatenate(to), np.concatenate(weight), loops, self.total), at


class Leiden:
    """Leiden with modularity or the constant Potts model ("cpm", for which gamma counts in gains)."""

    def __init__(self, seed: int = 42, gamma: float = 1.0, iterations: int = 100, quality: str = "modularity", min_compression_ratio: float = 0.1, max_recursion_depth: int = 32):
        if not 0.0 <= min_compression_ratio < 1.0 or max_recursion_depth < 1:
            raise ValueError("min_compression_ratio must be in [0, 1) and max_recursion_depth at least 1")
        self.random, self.gamma, self.iterations, self.cpm = random.Random(seed), gamma, iterations, quality.lower() == "cpm"
        self.ratio, self.depth = min_compression_ratio, max_recursion_depth

    def shares(self, net: Network) -> tuple[list[float], float, float]:
        """What enters a community's sum for each node, degrees or (cpm) nodes; a factor and a divisor of what a gain loses by it."""
        if self.cpm:
            return [1.0] * net.n, self.gamma, 1.0
        return net.degree, 1.0, 2 * net.total

    def local_moves(self, net: Network, of: list[int]) -> bool:
        """Moves nodes to better communities until none moves; whether any node had a community to prefer."""
        if not self.cpm and not net.total:
            return False
        mass, factor, divisor = self.shares(net)
        sums = defaultdict(float)
        for v, c in enumerate(of):
            sums[c] += mass[v]
        preferred = False
        for _ in range(self.iterations):
            order = list(range(net.n))
            self.random.shuffle(order)
            moved = False
            for v in order:
                old, own = of[v], mass[v]
                sums[old] -= own
                into: dict[int, float] = {}
                for u, w in zip(*net.links(v), strict=True):
                    c = of[u]
                    into[c] = into.get(c, 0.0) + w
                share = factor * own
                best, most = old, MIN_GAIN
                for c, k in into.items():
                    g = k - share * sums[c] / divisor
                    if g > most or g == most and c < best and most > MIN_GAIN:
                        best, most = c, g
                preferred |= most > MIN_GAIN
                of[v] = best
                sums[best] += own
                moved |= best != old
            if not moved:
                break
        return preferred

    def refined(self, net: Network, of: list[int]) -> list[int]:
        """Each community cut into well-connected parts, grown from single nodes."""
        members = defaultdict(list)
        for v, c in enumerate(of):
            members[c].append(v)
        part, size, gamma = list(range(net.n)), [1] * net.n, self.gamma
        mass, factor, divisor = self.shares(net)
        sums = list(mass)
        for c in sorted(members):
            own_nodes, whole = members[c], len(members[c])
            for _ in range(REFINE_SWEEPS):
                order = own_nodes[:]
                self.random.shuffle(order)
                moved = False
                for v in order:
                    here, own = part[v], mass[v]
                    into: dict[int, float] = {}
                    for u, w in zip(*net.links(v), strict=True):
                        if of[u] == c:
                            to = part[u]
                            into[to] = into.get(to, 0.0) + w
                    share = factor * own
                    base = into.pop(here, 0.0) - share * (sums[here] - own) / divisor
                    best, most = here, MIN_GAIN
                    for to, k in into.items():
                        s = size[to]
                        if gamma and k < gamma * (s - s * s / whole):
                            continue
                        g = k - share * sums[to] / divisor - base
                        if g > most or g == most and to < best and most > MIN_GAIN:
                            best, most = to, g
                    if best != here:
                        sums[here] -= own
                        size[here] -= 1
                        part[v] = best
                        sums[best] += own
                        size[best] += 1
                        moved = True
                if not moved:
                    break
        return part

    def run(self, net: Network, initial: list[int] | None = None) -> list[int]:
        """The community of each node, numbered by first appearance."""
        of = list(initial) if initial is not None else list(range(net.n))
        nodes, level = np.arange(net.n), net  # nodes: the level's node that stands for each original one
        for _ in range(self.depth):
            if not self.local_moves(level, of):
                break
            part = self.refined(level, of)
            smaller, at = level.aggregate(part)
            if smaller.n == level.n or 1 - smaller.n / level.n < self.ratio:
                break
            coarse = [0] * smaller.n
            for v, group in enumerate(at):
                coarse[group] = of[v]
            nodes, of, level = np.array(at)[nodes], coarse, smaller
        number: dict[int, int] = {}
        return [number.setdefault(of[x], len(number)) for x in nodes.tolist()]


def warm_start(ids: Sequence, known: dict) -> list[int]:
    """Communities known from before, renumbered by first appearance; new nodes get the smallest numbers not in use."""
    number: dict[int, int] = {}
    out = [number.setdefault(known[i], len(number)) if i in known else -1 for i in ids]
    free = len(number)
    for k, c in enumerate(out):
        if c < 0:
            out[k], free = free, free + 1
    return out


def compact(weight: np.ndarray) -> np.ndarray:
    """Weights in four bytes each where that keeps them as they are."""
    small = weight.astype(np.float32)
    return small if np.array_equal(small, weight) else weight


def detected(options: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(number, leader) for the nodes of each component out of its sorted rows (component, s, t, w): first (-1, -1, total
    weight of the graph), then by node (s, -1, earlier community) if it has one, and its links in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in links_by_key(batches, weighted=True):
            ids, counts = np.frombuffer(rows.heads, np.int64)[1:], np.frombuffer(rows.counts, np.int64)[1:]
            tails, weights = np.frombuffer(rows.tails, rows.tails.typecode), np.frombuffer(rows.weights, np.float64)
            total, tails, weights = float(weights[0]), tails[1:], weights[1:]
            initial, given = None, tails < 0
            if given.any():
                at = np.searchsorted(np.cumsum(counts), np.flatnonzero(given), "right")
                initial = warm_start(range(len(ids)), dict(zip(at.tolist(), weights[given].tolist(), strict=True)))
                counts = counts - np.bincount(at, minlength=len(ids))
                tails, weights = tails[~given], weights[~given]
            to = np.empty(len(tails), np.int32 if len(ids) < 1 << 31 else np.int64)
            for k in range(0, len(to), LINKS_AT_ONCE):
                to[k : k + LINKS_AT_ONCE] = np.searchsorted(ids, tails[k : k + LINKS_AT_ONCE])
            net = Network.of_arrays(counts, to, compact(weights), total=total)
            del tails, weights, given
            rows.tails = rows.weights = None  # the network has them
            found = np.array(Leiden(**options).run(net, initial))
            leader = ids[np.unique(found, return_index=True)[1]][found]
            for k in range(0, len(ids), LINKS_AT_ONCE):
                yield pa.RecordBatch.from_pydict({"number": ids[k : k + LINKS_AT_ONCE], "leader": leader[k : k + LINKS_AT_ONCE]})

    return run


def leiden(nodes: DataFrame, edges: DataFrame, graph: str | None = None, prior: DataFrame | None = None, **options) -> DataFrame:
    """(graph, node, community). edges(source, target[, weight]); prior(node, community) starts from an earlier result.

    No community reaches beyond a connected component (one of `prior` that does begins as one in each), so a component
    of a graph is one task, as each move depends on those before; components run side by side and share their graph's
    total weight. A task holds about 12 bytes of a link at each of its ends. Communities are numbered by their first node.
    """
    own = graph is None
    if own:
        graph = "graph"
        nodes, edges = nodes.withColumn(graph, F.lit(0)), edges.withColumn(graph, F.lit(0))
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    Leiden(**options)  # bad options are errors here, not in tasks
    numbers = numbered(nodes.select(graph, "id"), F.col(graph), order_key(F.col("id")), F.col("id"))
    links = number_edges(edges.select(graph, "source", "target", F.col("weight").cast("double").alias("w")), numbers, graph)
    links = checkpointed(links.filter("s != t"))
    of = checkpointed(number_components(links.select("s", "t")))
    kind = links.schema["s"].dataType
    none = F.lit(-1).cast(kind)
    totals = links.groupBy(graph).agg(F.round(F.sum("w"), 6).alias("w"))  # rounded: the order of a sum in tasks varies
    heads = of.filter("node = component").select("component").join(numbers.select(F.col("number").alias("component"), graph), "component").join(totals, graph)
    both = links.select("s", "t", "w").union(links.select("t", "s", "w")).join(of.withColumnRenamed("node", "s"), "s")
    rows = both.select("component", "s", "t", "w").union(heads.select("component", none, none, "w"))
    if prior is not None:
        known = numbers.join(prior.select(F.col("node").alias("id"), "community"), "id").filter("community IS NOT NULL")
        first = known.groupBy(graph, "community").agg(F.min("number").cast("double").alias("w"))
        known = known.join(first, [graph, "community"]).select(F.col("number").alias("node"), "w").join(of, "node")
        rows = rows.union(known.select("component", F.col("node").cast(kind), none, "w"))
    tasks = min(max(1, 2 * heads.count()), MOST_TASKS)
    found = rows.repartition(tasks, "component").sortWithinPartitions("component", "s", "t", "w").mapInArrow(detected(options), "number long, leader long")
    found = checkpointed(numbers.join(found, "number", "left").select(graph, "id", "number", F.coalesce("leader", "number").alias("leader")))
    ranks = numbered(found.filter("leader = number").select(graph, "leader"), F.col("leader")).withColumnRenamed("number", "rank")
    least = ranks.groupBy(graph).agg(F.min("rank").alias("least"))
    ranks = ranks.join(least, graph).select("leader", (F.col("rank") - F.col("least")).cast("long").alias("community"))
    out = found.join(ranks, "leader").select(graph, F.col("id").alias("node"), "community")
    return out.drop(graph) if own else out


def detect_boundaries(nodes: DataFrame, edges: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """Assignments of validated nodes; weights(source, target, weight) apply to unordered pairs."""
    edges = clean_edges(nodes, edges)
    if weights is not None:
        edges = weighted_edges(edges, weights)
    return leiden(nodes, edges, **options)
