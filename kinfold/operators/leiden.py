"""Leiden communities with three quality functions, in blocks of whole communities."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinfold.plans.tables import discard, materialize, numbered

#: Fixed values: (quality, resolution) of the four uses.
PRESETS = {"cpm_benchmark": ("cpm", 0.005), "cpm_raw": ("cpm", 0.05), "modularity": ("modularity", 1.0), "rb_plots": ("rb", 0.5)}


class Graph:
    """A weighted graph in memory. ``size`` and ``degree`` may be those that vertices have in a larger graph."""

    def __init__(self, n: int, edges, size=None, degree=None, total=None):
        self.n, self.adj, self.loops = n, [defaultdict(float) for _ in range(n)], [0.0] * n
        for a, b, w in edges:
            if a == b:
                self.loops[a] += w
            else:
                self.adj[a][b] += w
                self.adj[b][a] += w
        self.size = size or [1] * n
        self.degree = degree or [sum(self.adj[i].values()) + 2 * self.loops[i] for i in range(n)]
        self.total = sum(self.degree) / 2 if total is None else total

    def weight(self, kind: str) -> list[float]:
        return self.size if kind == "cpm" else self.degree


def _penalty(g: Graph, kind: str, gamma: float) -> float:
    return gamma if kind == "cpm" else gamma / (2 * g.total) if g.total else 0.0


def _move(g: Graph, part: list[int], kind: str, gamma: float, rng: random.Random) -> bool:
    """Fast local moving with a queue; a node goes where the gain is greatest."""
    w, pen = g.weight(kind), _penalty(g, kind, gamma)
    mass: dict[int, float] = defaultdict(float)
    for i, c in enumerate(part):
        mass[c] += w[i]
    order = list(range(g.n))
    rng.shuffle(order)
    queue, waiting, moved, fresh = deque(order), [True] * g.n, False, max(part, default=0) + 1
    while queue:
        i = queue.popleft()
        waiting[i] = False
        links: dict[int, float] = defaultdict(float)
        for j, x in g.adj[i].items():
            links[part[j]] += x
        old = part[i]
        mass[old] -= w[i]
        best, gain = old, links.get(old, 0.0) - pen * w[i] * mass[old]
        for c in sorted(links):
            v = links[c] - pen * w[i] * mass[c]
            if v > gain + 1e-12:
                best, gain = c, v
        if gain < -1e-12:
            best, fresh = fresh, fresh + 1
        mass[best] += w[i]
        if best != old:
            part[i], moved = best, True
            for j in g.adj[i]:
                if part[j] != best and not waiting[j]:
                    waiting[j] = True
                    queue.append(j)
    return moved


def _refine(g: Graph, part: list[int], kind: str, gamma: float, rng: random.Random) -> list[int]:
    """Communities split into well-connected parts: singletons merge within their community."""
    w, pen = g.weight(kind), _penalty(g, kind, gamma)
    sub = list(range(g.n))
    mass = list(map(float, w))
    whole: dict[int, float] = defaultdict(float)
    for i, c in enumerate(part):
        whole[c] += w[i]
    cut = [sum(x for j, x in g.adj[i].items() if part[j] == part[i]) for i in range(g.n)]
    outside, count = cut[:], [1] * g.n
    order = list(range(g.n))
    rng.shuffle(order)
    for i in order:
        if count[sub[i]] != 1 or cut[i] < pen * w[i] * (whole[part[i]] - w[i]) - 1e-12:
            continue
        links: dict[int, float] = defaultdict(float)
        for j, x in g.adj[i].items():
            if part[j] == part[i]:
                links[sub[j]] += x
        best, gain = sub[i], 0.0
        for c in sorted(links):
            if c == sub[i] or outside[c] < pen * mass[c] * (whole[part[i]] - mass[c]) - 1e-12:
                continue
            v = links[c] - pen * w[i] * mass[c]
            if v > gain + 1e-12:
                best, gain = c, v
        if best != sub[i]:
            old = sub[i]
            mass[old] -= w[i]
            count[old] -= 1
            mass[best] += w[i]
            count[best] += 1
            outside[best] += cut[i] - 2 * links[best]
            sub[i] = best
    return sub


def _levels(g: Graph, part: list[int], kind: str, gamma: float, rng: random.Random, rounds: int = 20) -> list[int]:
    """Moving, refinement and contraction, from a given partition on, until nothing changes."""
    node = list(range(g.n))
    for _ in range(rounds):
        moved = _move(g, part, kind, gamma, rng)
        if len(set(part)) == g.n or not moved and node != list(range(g.n)):
            break
        sub = _refine(g, part, kind, gamma, rng)
        names = {c: k for k, c in enumerate(dict.fromkeys(sub))}
        if len(names) == g.n:
            break
        size, degree, up = [0] * len(names), [0.0] * len(names), [0] * len(names)
        for i in range(g.n):
            k = names[sub[i]]
            size[k] += g.size[i]
            degree[k] += g.degree[i]
            up[k] = part[i]
        joined: dict[tuple[int, int], float] = defaultdict(float)
        for i in range(g.n):
            a = names[sub[i]]
            for j, x in g.adj[i].items():
                b = names[sub[j]]
                if i < j and a != b:
                    joined[min(a, b), max(a, b)] += x
        node = [names[sub[x]] for x in node]
        g, part = Graph(len(names), ((a, b, x) for (a, b), x in joined.items()), size, degree, g.total), up
    return [part[x] for x in node]


def communities(n: int, edges, kind: str = "modularity", gamma: float = 1.0, seed: int = 42, rounds: int = 20) -> list[int]:
    """A community number for each of n nodes; edges are (i, j, weight)."""
    return _levels(Graph(n, edges), list(range(n)), kind, gamma, random.Random(seed), rounds)


#: Vertices of a block. It bounds what a task holds; with 14 neighbours a vertex, about 200 MB.
BLOCK = 1 << 16

#: Steps by which the leaders' cells spread over the graph of communities.
SPREAD = 3


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that meets it by a shuffle: a broadcast collects its side on the driver, and loops would do so every round."""
    return df.hint("merge")


def near_blocks(v: DataFrame, e: DataFrame, block: int, seed: int) -> DataFrame:
    """(id, size, degree, part, key, salt, frozen): vertices in blocks of whole communities that are near each other.

    Leaders are drawn from the communities by a seeded hash, one for a quarter of a block, and communities join the
    cell of the neighbour they have most edge weight with, ring by ring. A cell above ``block`` vertices is
    split by a hash of its communities; a community above ``block`` vertices is split by its vertices, and frozen.
    """
    parts = v.groupBy("part").agg(F.count("*").alias("n"))
    n, k = parts.agg(F.sum("n"), F.count("*")).first()
    every = max(2, int(k * (block / 4) / n))
    a, b = v.select(F.col("id").alias("src"), F.col("part").alias("p")), v.select(F.col("id").alias("dst"), F.col("part").alias("q"))
    across = e.join(unsent(a), "src").join(unsent(b), "dst").where("p <> q").select(F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("x"), "weight")
    across = materialize(across.groupBy("x.p", "x.q").agg(F.sum("weight").alias("w")), "leiden-across")
    cells = parts.select("part", "n", F.when(F.pmod(F.xxhash64("part", F.lit(seed)), F.lit(every)) == 0, F.col("part")).alias("cell"))
    for _ in range(SPREAD):
        known = cells.where("cell is not null").select(F.col("part").alias("q"), "cell")
        best = across.join(unsent(known), "q").groupBy("p", "cell").agg(F.sum("w").alias("w")).groupBy(F.col("p").alias("part")).agg(F.max_by("cell", F.struct("w", "cell")).alias("near"))
        cells = cells.join(unsent(best), "part", "left").select("part", "n", F.coalesce("cell", "near").alias("cell"))
    cells = materialize(cells, "leiden-cells")
    lost = -1 - F.pmod(F.xxhash64("part", F.lit(seed)), F.lit(max(1, 4 * n // block)))  # what no leader reached
    cells = cells.select("part", "n", F.coalesce("cell", lost).alias("key"))
    frozen = F.col("n") > block
    load = cells.where(~frozen).groupBy("key").agg(F.sum("n").alias("load"))
    cells = cells.join(unsent(load), "key", "left").withColumn("cuts", F.ceil(F.when(frozen, F.col("n")).otherwise(F.col("load")) / block))
    salt = F.pmod(F.xxhash64(F.when(F.col("frozen"), F.col("id")).otherwise(F.col("part")), F.lit(seed)), F.col("cuts")).cast("int")
    cells = cells.select("part", F.when(frozen, F.col("part")).otherwise(F.col("key")).alias("key"), "cuts", frozen.alias("frozen"))
    return materialize(v.join(unsent(cells), "part").withColumn("salt", salt).drop("cuts"), "leiden-dealt")


def _blockwise(dealt: DataFrame, e: DataFrame, kind: str, gamma: float, total: float, seed: int, whole: bool) -> DataFrame:
    """(id, part, sub, moved) after moving and refinement within each block, or after all levels of the ``whole`` graph in one block.

    A block has all members of its communities, so gains within it are exact, and gains of different blocks, whose communities are
    different, add up: the quality never falls.
    """

    def run(key, left, right):
        left = left.sort_by("id")
        ids, frozen = left.column("id").to_pylist(), left.column("frozen")[0].as_py() if len(left) else False
        at = {x: i for i, x in enumerate(ids)}
        right = right.sort_by([("src", "ascending"), ("dst", "ascending")])
        edges = zip(map(at.get, right.column("src").to_pylist()), map(at.get, right.column("dst").to_pylist()), right.column("weight").to_pylist())
        g = Graph(len(ids), edges, left.column("size").to_pylist(), left.column("degree").to_pylist(), total)
        names: dict[int, int] = {}
        start = left.column("part").to_pylist()
        part = [names.setdefault(p, len(names)) for p in start]
        rng, before = random.Random(f"{seed}:{key}"), part[:]
        if whole:
            part = sub = _levels(g, part, kind, gamma, rng)
        else:
            if not frozen:
                _move(g, part, kind, gamma, rng)
            sub = _refine(g, part, kind, gamma, rng)
        # a frozen community keeps its name; others go by their first member
        first: dict[int, int] = {}
        for i, c in enumerate(part):
            first.setdefault(c, ids[i])
        head: dict[int, int] = {}
        for i, c in enumerate(sub):
            head.setdefault(c, ids[i])
        named = start if frozen else [first[c] for c in part]
        cols = ids, named, [head[c] for c in sub], [x != y for x, y in zip(before, part)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "part", "sub", "moved"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))})

    where = dealt.select("id", "key", "salt", "frozen")
    a, b = where.toDF("src", "key", "salt", "frozen"), where.toDF("dst", "key_b", "salt_b", "frozen_b")
    inside = e.join(unsent(a), "src").join(unsent(b), "dst").where("key = key_b and salt = salt_b and frozen = frozen_b")
    inside = inside.select("key", "salt", "frozen", "src", "dst", "weight")
    by = "key", "salt", "frozen"
    out = dealt.groupBy(*by).cogroup(inside.groupBy(*by)).applyInArrow(run, "id bigint, part bigint, sub bigint, moved boolean")
    return materialize(out, "leiden-moved")


def _one_pass(e: DataFrame, start: DataFrame, kind: str, gamma: float, total: float, seed: int, block: int, rounds: int, levels: int) -> DataFrame:
    """(id, size, degree, part) of the vertices of ``start``, which has a part for each, after moving, refinement and contraction."""
    v, node = start, start.select("id", F.col("id").alias("at"))
    for level in range(levels):
        n = v.count()
        whole = n <= block
        for r in range(1 if whole else rounds):
            turn = seed + 1000 * level + r
            one = {"key": F.lit(0).cast("bigint"), "salt": F.lit(0), "frozen": F.lit(False)}
            dealt = v.withColumns(one) if whole else near_blocks(v, e, block, turn)
            out = _blockwise(dealt, e, kind, gamma, total, turn, whole)
            v = v.drop("part").join(out.select("id", "part"), "id")
            if not whole:
                v = materialize(v, "leiden-vertices")
                discard(dealt)
                if not out.where("moved").limit(1).count():
                    break
        node = node.join(out.select(F.col("id").alias("at"), "part", "sub"), "at")
        if whole:
            node = node.select("id", "part")
            break
        node = materialize(node.select("id", F.col("sub").alias("at"), "part"), "leiden-nodes")
        smaller = v.join(out.select("id", "sub"), "id").groupBy(F.col("sub").alias("id")).agg(F.sum("size").alias("size"), F.sum("degree").alias("degree"), F.min("part").alias("part"))
        v = materialize(smaller, "leiden-vertices")
        if v.count() == n:
            break
        s, t = out.select(F.col("id").alias("src"), F.col("sub").alias("a")), out.select(F.col("id").alias("dst"), F.col("sub").alias("b"))
        joined = e.join(s, "src").join(t, "dst").where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))
        e = materialize(joined, "leiden-edges")
        node = node.drop("part")
    return materialize(start.drop("part").join(node.select("id", "part"), "id"), "leiden-vertices")


def leiden(edges: DataFrame, vertices: DataFrame, kind: str = "modularity", gamma: float = 1.0, seed: int = 42, block: int = BLOCK, rounds: int = 4, levels: int = 20, passes: int = 2) -> DataFrame:
    """(id, label), labels by falling size, ties by the smallest member; vertices without an edge stand alone.

    Every level moves vertices between communities, splits communities into well-connected parts, and contracts the
    graph by joins; a further pass starts from the partition of the one before. Moving is in rounds over blocks of at most
    ``block`` vertices: a block holds whole communities near each other, and blocks are drawn anew each round, so that neighbours
    meet. Neither vertices nor edges come to the driver, and no task sees more than a block and the edges within; once the contracted
    graph fits one block, that block is the rest of the pass. Loops and repeated edges count; null endpoints
    are left out. The same input and seed give the same labels.
    """
    rows = edges.where("src is not null and dst is not null")
    rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = materialize(rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "leiden-edges")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "weight")  # a loop counts twice
    v = materialize(ends.groupBy("id").agg(F.lit(1).cast("bigint").alias("size"), F.sum("weight").alias("degree")).withColumn("part", F.col("id")), "leiden-vertices")
    total = float(e.agg(F.sum("weight")).first()[0] or 0.0)
    for p in range(passes):
        v = _one_pass(e.where("src <> dst"), v, kind, gamma, total, seed + 1_000_000 * p, block, rounds, levels)
    labels = vertices.select("id").distinct().join(v.select("id", "part"), "id", "left").select("id", F.coalesce("part", "id").alias("part"))
    labels = materialize(labels, "leiden-labels")
    groups = numbered(labels.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first")), F.desc("n"), F.col("first"))
    return labels.join(groups, "part").select("id", F.col("number").cast("int").alias("label"))
