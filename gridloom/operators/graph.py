"""Graphs as edge tables (src long, dst long, w) and vertex tables (id, cluster, features)."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, first_rows, forget, numbered, parts, running_sum


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def without_parallels(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def weighted(edges: DataFrame) -> DataFrame:
    """Parallel edges summed; zero weights go."""
    return edges.groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w")).where("w <> 0")


def cleaned(edges: DataFrame) -> DataFrame:
    """Multiplicity as weight where all weights are 1; else sums, with zero and negative sums as 1."""
    sums = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("s"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    return sums.select("src", "dst", F.when((F.col("hi") == 1) & (F.col("lo") == 1), F.col("n")).when(F.col("s") <= 0, 1).otherwise(F.col("s")).cast("long").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetrised(edges: DataFrame) -> DataFrame:
    """The upper triangle and its mirror image."""
    upper = edges.where("src <= dst")
    return upper.union(upper.where("src < dst").select("dst", "src", *[c for c in edges.columns if c not in ("src", "dst")]))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def renumbered(edges: DataFrame) -> DataFrame:
    """Ids 0..n-1 in the order of the old ones."""
    ids = numbered(nodes(edges), "new", F.col("id"))
    return edges.join(ids.select(F.col("id").alias("src"), F.col("new").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("new").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node: a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_histogram(degree: DataFrame, filled: bool = True) -> DataFrame:
    """(degree, n) from 1 to the largest, with zero counts if filled."""
    counts = degree.where("degree > 0").groupBy("degree").agg(F.count("*").alias("n"))
    if not filled:
        return counts
    axis = counts.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("degree"))
    return axis.join(counts, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def size(edges: DataFrame) -> DataFrame:
    """One row: nodes n, edges m."""
    return nodes(edges).agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))


def density(edges: DataFrame, directed: bool = True) -> DataFrame:
    factor = 1 if directed else 2
    return size(edges).select((F.lit(float(factor)) * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: whether each edge has its mirror with the same weight, and whether a triangle is empty."""
    mirror = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    pairs = edges.join(mirror, ["src", "dst"], "left")
    return pairs.agg(F.bool_and(F.coalesce(F.col("w") == F.col("w2"), F.lit(False))).alias("symmetric"), (F.bool_and(F.col("src") <= F.col("dst")) | F.bool_and(F.col("src") >= F.col("dst"))).alias("one_triangle"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, w) with i the target and j the source."""
    return edges.select(F.col("dst").alias("i"), F.col("src").alias("j"), "w")


def laplacian(edges: DataFrame) -> DataFrame:
    """Rows of D - A, D being the sum of a row's weights."""
    a = adjacency(edges)
    diagonal = a.groupBy("i").agg(F.sum("w").alias("w")).select("i", F.col("i").alias("j"), "w")
    return diagonal.union(a.select("i", "j", -F.col("w"))).groupBy("i", "j").agg(F.sum("w").alias("w")).where("w <> 0")


def neighbours(edges: DataFrame, outward: bool = True) -> DataFrame:
    """(id, list of (node, w)): as long as the node's own degree."""
    own, other = ("src", "dst") if outward else ("dst", "src")
    return edges.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("node"), "w"))).alias("neighbours"))


def lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weights of the pairs asked for, 0 where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0)))


def vertex_values(ids: DataFrame, vertices: DataFrame, column: str) -> DataFrame:
    """(id, column) of the nodes asked for: a label, a cluster; null where there is none."""
    return ids.join(vertices.select("id", column), "id", "left")


def weight_stats(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy("src").agg(F.sum("w").alias("s"))
    return rows.agg(F.avg("s").alias("mean_row"), F.var_pop("s").alias("var_row")).crossJoin(edges.agg(F.count("*").alias("nnz"), F.max("w").alias("max_w"), F.countDistinct("w").alias("distinct_w")))


def relation_types(edges: DataFrame) -> DataFrame:
    return edges.agg(F.greatest(F.max("w") + 1, F.lit(2)).alias("types"), F.bool_or(F.col("src") == F.col("dst")).alias("has_loops"))


def possible_pairs(edges: DataFrame, directed: bool = True, tested: int = 0) -> DataFrame:
    return size(edges).select((F.col("n") * (F.col("n") - 1) / (1 if directed else 2) - tested).cast("long").alias("pairs"))


#: Edges that a task of triangles holds, neighbours and pairs of neighbours that it looks up at a time, and colours of nodes at least.
CELL_EDGES, CELL_ENDS, CELL_PAIRS, CELL_COLOURS = 1 << 22, 1 << 17, 1 << 20, 4
#: Edges (kind 0) or lists of neighbours (kind 1) of a cell: nodes they start from, how many neighbours of each have the cell's first colour and how many its second, and these in turn.
CELLS = "cell int, kind int, heads binary, one binary, two binary, ends binary, n int, m int"


def _ranked(simple: DataFrame, degree: DataFrame) -> DataFrame:
    """Simple undirected edges from the end of smaller (degree, id) to the other: no node has many of them going out."""
    with_d = simple.join(degree.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(degree.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return with_d.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    kinds = (np.uint8, np.uint16, np.uint32) if len(x) and x.min() >= 0 else ()
    return x.astype(next((k for k in kinds if x.max() <= np.iinfo(k).max), np.int64)).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // n if n else 8]).astype(np.int64)


def _cells(colours: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(colours) for j in range(i, colours)]


def _dealt(colours: int):
    """Edges (a, b) in order of a to rows of ``CELLS``: each edge to the cell of its ends' colours, and the neighbours of each a to the cells in which two of them may be linked."""
    cells = _cells(colours)
    place = np.zeros((colours, colours), np.int64)
    for k, (i, j) in enumerate(cells):
        place[i, j] = place[j, i] = k
    colour = lambda x: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % colours

    def deal(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        rows, y = [], colour(b)
        at = place[colour(a), y]
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(cells) + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k] : bounds[k + 1]]
            rows.append((k, 0, _narrow(a[own]), b"", b"", _narrow(b[own]), len(own), len(own)))
        first = np.diff(a, prepend=a[0] - 1) != 0
        heads, number = a[first], np.cumsum(first) - 1
        counts = np.bincount(number * colours + y, minlength=len(heads) * colours).reshape(-1, colours)
        order = np.lexsort((y, number))
        b, y, number = b[order], y[order], number[order]
        for k, (i, j) in enumerate(cells):
            many = counts[:, i] > 1 if i == j else (counts[:, i] > 0) & (counts[:, j] > 0)
            if many.any():
                ends = b[many[number] & ((y == i) | (y == j))]
                two = np.zeros_like(counts[:, j]) if i == j else counts[:, j]
                rows.append((k, 1, _narrow(heads[many]), _narrow(counts[many, i]), _narrow(two[many]), _narrow(ends), int(many.sum()), len(ends)))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in CELLS.split(", ")])

    def run(batches):
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = (np.concatenate([x, batch[c].to_numpy()]) for x, c in ((a, "a"), (b, "b")))
            if len(a) and (whole := int(np.searchsorted(a, a[-1]))):  # the last list may go on
                yield deal(a[:whole], b[:whole])
                a, b = a[whole:], b[whole:]
        if len(a):
            yield deal(a, b)

    return run


class _Linked:
    """Which pairs of nodes are linked in a cell. Most pairs that are not are told by a table of hashes, without a search."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.nodes = np.unique(np.concatenate([x, y]))
        self.keys = np.sort(self._key(np.searchsorted(self.nodes, x), np.searchsorted(self.nodes, y)))
        self.bits = np.uint64(64 - min(26, max(10, 3 + len(x).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[self._hash(self.keys)] = True

    def _key(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.minimum(p, q) * len(self.nodes) + np.maximum(p, q)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def among(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places of the pairs that are linked."""
        keys = self._key(p, q)
        maybe = np.flatnonzero(self.seen[self._hash(keys)])
        keys = keys[maybe]
        return maybe[self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys]

    def closed(self, heads: np.ndarray, one: np.ndarray, two: np.ndarray, ends: np.ndarray):
        """Triangles of each head with two linked neighbours of its list: one of either colour, or where there is one colour any two."""
        lists = np.repeat(np.arange(len(heads)), one + two)
        first = np.arange(len(ends)) - np.repeat(np.cumsum(one + two) - one - two, one + two) < one[lists]
        at = np.minimum(np.searchsorted(self.nodes, ends), len(self.nodes) - 1)
        known = self.nodes[at] == ends
        same, lists, first, at = not two.any(), lists[known], first[known], at[known]
        one, two = (np.bincount(lists[f], minlength=len(heads)) for f in (first, ~first))
        begin = (np.cumsum(one + two) - two)[lists]  # of the list's second colour
        here = np.arange(len(at))
        begin, count = (here + 1, begin - here - 1) if same else (begin, np.where(first, two[lists], 0))
        total, k = np.concatenate([[0], np.cumsum(count)]), 0
        while k < len(at):
            last = max(k + 1, int(np.searchsorted(total, total[k] + CELL_PAIRS, "right")) - 1)
            n = count[k:last]
            x = np.repeat(here[k:last], n)
            y = np.arange(len(x)) + np.repeat(begin[k:last] - total[k:last] + total[k], n)
            hit = self.among(at[x], at[y])
            x, y, k = x[hit], y[hit], last
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(heads[lists[x]]), pa.array(self.nodes[at[x]]), pa.array(self.nodes[at[y]])], ["a", "b", "c"])


def _closed(batches):
    """Rows of ``CELLS``, in order of cell and kind, to triangles. A task holds its cell's edges and a bounded number of lists and pairs."""
    now, edges, linked, lists, size = None, [], None, [], 0
    joined = lambda rows: (np.concatenate(c) for c in zip(*rows, strict=True))
    for batch in batches:
        for cell, kind, heads, one, two, ends, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lists and (cell != now or size > CELL_ENDS):
                yield from linked.closed(*joined(lists))
                lists, size = [], 0
            if cell != now:
                now, edges, linked = cell, [], None
            if kind == 0:
                edges.append((_wide(heads, n), _wide(ends, n)))
            elif edges or linked:
                if linked is None:
                    linked, edges = _Linked(*joined(edges)), []
                lists.append((_wide(heads, n), _wide(one, n), _wide(two, n), _wide(ends, m)))
                size += m
    if lists:
        yield from linked.closed(*joined(lists))


def _triangles(simple: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes have colours, and a cell is a pair of them. It gets the edges between its colours and the neighbours of these colours of every node, as packed lists, and looks up which neighbours are linked.

    Pairs of neighbours, many times the edges, are made inside tasks only; shuffled are the edges and, for each neighbour, one number per colour. The colours grow with the root of the edges.
    """
    colours = max(CELL_COLOURS, math.ceil(math.sqrt(2 * simple.count() / CELL_EDGES)))
    lists = _ranked(simple, degree).repartition("a").sortWithinPartitions("a").mapInArrow(_dealt(colours), CELLS)
    return lists.repartitionById(len(_cells(colours)), "cell").sortWithinPartitions("cell", "kind").mapInArrow(_closed, "a long, b long, c long")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), each triangle once."""
    simple = cut(undirected(without_loops(edges)))
    return _triangles(simple, cut(degrees(simple)))


def clustering(edges: DataFrame) -> DataFrame:
    """One row: average local clustering (nodes of degree below two count as 0) and global transitivity."""
    up = F.col("src") <= F.col("dst")  # a null end stays one
    both = cut(edges.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct())
    ends = both.select(F.explode(F.array("src", "dst")).alias("id"), F.coalesce((F.col("src") != F.col("dst")).cast("long"), F.lit(0)).alias("linked"))
    d = cut(ends.groupBy("id").agg(F.sum("linked").alias("degree")))
    per_node = _triangles(without_loops(both), d).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    local = d.join(per_node, "id", "left").select(F.col("degree").alias("d"), F.coalesce("t", F.lit(0)).alias("t"))
    c = F.when(F.col("d") > 1, 2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return local.agg(F.avg(c).alias("average_clustering"), (F.sum("t").cast("double") / F.sum(F.col("d") * (F.col("d") - 1) / 2)).alias("transitivity"))


def modularity(edges: DataFrame, clusters: DataFrame, weighted: bool = False) -> DataFrame:
    """Sum over clusters of inside/m - (degree/2m)^2 for undirected edges; clusters(id, cluster)."""
    w = F.col("w") if weighted else F.lit(1)
    tagged = edges.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("k")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("l")), "dst").withColumn("x", w)
    inside = tagged.where("k = l").groupBy(F.col("k").alias("cluster")).agg(F.sum("x").alias("inside"))
    ends = tagged.select(F.explode(F.array("k", "l")).alias("cluster"), "x").groupBy("cluster").agg(F.sum("x").alias("ends"))
    m = tagged.agg(F.sum("x").alias("m"))
    term = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / (2.0 * F.col("m")), 2)
    return ends.join(inside, "cluster", "left").crossJoin(F.broadcast(m)).agg(F.sum(term).alias("modularity"))


def block_degrees(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(k, l, id, n): edges of node id in cluster k towards cluster l."""
    tagged = edges.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("k")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("l")), "dst")
    return tagged.groupBy("k", "l", F.col("src").alias("id")).agg(F.count("*").alias("n"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Sizes in falling order, equal ones by falling label."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("cluster"))


def by_cluster_size(clusters: DataFrame) -> DataFrame:
    """(id, cluster, rank): clusters relabelled by size, equal ones by falling label."""
    ranks = numbered(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "rank", F.desc("n"), F.desc("cluster"))
    return clusters.join(ranks.select("cluster", F.col("rank").cast("int").alias("rank")), "cluster")


def one_hot(clusters: DataFrame, labels: list) -> DataFrame:
    return clusters.groupBy("id").pivot("cluster", labels).agg(F.count("cluster")).na.fill(0)


def cluster_similar(clusters: DataFrame) -> DataFrame:
    """One row: ordered pairs of nodes with one cluster, the diagonal included, from sizes alone."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("similar"), F.sum("n").alias("nodes"))


def homophily(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the part of links whose ends are similar (loops are not among them), and the part expected of random pairs."""
    tagged = edges.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("k")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("l")), "dst")
    seen = tagged.agg((F.count_if((F.col("k") == F.col("l")) & (F.col("src") != F.col("dst"))) / F.count("*")).alias("observed"))
    return seen.crossJoin(cluster_similar(clusters).select((F.col("similar") / (F.col("nodes") * (F.col("nodes") - 1))).alias("expected")))


def assortativity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a + d - b - c) / (n (n - 1)) over linked or not, similar or not."""
    tagged = edges.where("src <> dst").join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("k")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("l")), "dst")
    counts = tagged.agg(F.count_if(F.col("k") == F.col("l")).alias("a"), F.count_if(F.col("k") != F.col("l")).alias("b"))
    pairs = cluster_similar(clusters).select((F.col("similar") - F.col("nodes")).alias("alike"), (F.col("nodes") * (F.col("nodes") - 1)).alias("all"))
    c, d = F.col("alike") - F.col("a"), F.col("all") - F.col("alike") - F.col("b")
    return counts.crossJoin(pairs).select(((F.col("a") + d - F.col("b") - c) / F.col("all")).alias("assortativity"))


def stub_matched(edges: DataFrame, seed: int = 0, directed: bool = True) -> DataFrame:
    """(src, dst) of a random graph in which every node has the ends of edges that it has in ``edges``: ends are put in a drawn order and matched by their place in it.

    Directed graphs keep out- and in-degrees (sources and targets have an order each). Loops and parallel edges may come, as they do in the configuration model.
    """
    draw = lambda end, *key: hash_rank(F.lit(end), *key, seed=seed)
    pair = [F.col("src"), F.col("dst")]
    if directed:
        one = numbered(edges.select("src", "dst", draw("out", *pair).alias("draw")), "k", F.col("draw"), *pair).select("k", "src")
        two = numbered(edges.select("src", "dst", draw("in", *pair).alias("draw")), "k", F.col("draw"), *pair).select("k", "dst")
        return one.join(two, "k").select("src", "dst")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("end")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("end")))).alias("x"), "src", "dst")
    keyed = ends.select("x.id", "x.end", "src", "dst", draw(F.col("x.end"), *pair).alias("draw"))
    placed = numbered(keyed, "k", F.col("draw"), *pair, F.col("end"))
    return placed.groupBy(F.floor(F.col("k") / 2).alias("k")).agg(F.min(F.struct("k", "id"))["id"].alias("src"), F.max(F.struct("k", "id"))["id"].alias("dst")).select("src", "dst")


def compared_cells(edges: DataFrame, clusters: DataFrame, other: DataFrame, other_clusters: DataFrame) -> DataFrame:
    """(a, b, n): the cells off the diagonal by what they are in two graphs over the same nodes: 0 linked and similar, 1 linked, 2 similar, 3 neither.

    Two nodes are similar if they have one cluster. Only linked pairs are rows; all others are counted from the sizes of clusters and of their intersections.
    """
    both = clusters.select("id", F.col("cluster").alias("k")).join(other_clusters.select("id", F.col("cluster").alias("l")), "id")
    sizes = both.groupBy("k", "l").agg(F.count("*").alias("n"))
    squares = lambda *by: sizes.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s")) if by else sizes.agg((F.sum("n") * F.sum("n")).alias("s"))
    similar = squares("k", "l").select(F.col("s").alias("kl")).crossJoin(squares("k").select(F.col("s").alias("k"))).crossJoin(squares("l").select(F.col("s").alias("l"))).crossJoin(squares().select(F.col("s").alias("every"))).crossJoin(both.agg(F.count("*").alias("n")))
    cell = lambda p, q, n: F.struct(F.lit(p).alias("sa"), F.lit(q).alias("sb"), n.alias("n"))
    kl, k, l, every = (F.col(c) for c in ("kl", "k", "l", "every"))
    all_cells = similar.select(F.explode(F.array(cell(True, True, kl - F.col("n")), cell(True, False, k - kl), cell(False, True, l - kl), cell(False, False, every - k - l + kl))).alias("x")).select("x.*")
    tagged = lambda e, name: e.where("src <> dst").select("src", "dst").distinct().withColumn(name, F.lit(True))
    linked = tagged(edges, "la").join(tagged(other, "lb"), ["src", "dst"], "full_outer")
    ends = [both.select(F.col("id").alias(e), F.col("k").alias(f"k_{e}"), F.col("l").alias(f"l_{e}")) for e in ("src", "dst")]
    seen = linked.join(ends[0], "src").join(ends[1], "dst").select(F.coalesce("la", F.lit(False)).alias("la"), F.coalesce("lb", F.lit(False)).alias("lb"), (F.col("k_src") == F.col("k_dst")).alias("sa"), (F.col("l_src") == F.col("l_dst")).alias("sb"))
    counted = cut(seen.groupBy("la", "lb", "sa", "sb").agg(F.count("*").alias("n")))
    taken = counted.groupBy("sa", "sb").agg(F.sum("n").alias("taken"))
    rest = all_cells.join(taken, ["sa", "sb"], "left").select(F.lit(False).alias("la"), F.lit(False).alias("lb"), "sa", "sb", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"))
    kind = lambda link, same: F.when(link, F.when(same, 0).otherwise(1)).otherwise(F.when(same, 2).otherwise(3))
    return counted.unionByName(rest).select(kind(F.col("la"), F.col("sa")).alias("a"), kind(F.col("lb"), F.col("sb")).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def assortativity_compared(edges: DataFrame, clusters: DataFrame, other: DataFrame, other_clusters: DataFrame | None = None) -> DataFrame:
    """One row: the assortativity of a graph and of another one over its nodes (source, learned), and the normalised mutual information of their cells (nmi)."""
    cells = cut(compared_cells(edges, clusters, other, clusters if other_clusters is None else other_clusters))
    index = lambda c: (F.sum(F.when(F.col(c).isin(0, 3), F.col("n")).otherwise(-F.col("n"))) / F.sum("n"))
    return cells.agg(index("a").alias("source"), index("b").alias("learned")).crossJoin(information(cells))


def mutual_information(labels: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean) of two labellings (a, b) from their contingency table."""
    return information(labels.groupBy("a", "b").agg(F.count("*").alias("n")))


def information(table: DataFrame) -> DataFrame:
    """One row ``nmi`` of a contingency table (a, b, n)."""
    joint = table.select("a", "b", F.col("n").cast("double").alias("n"))
    total = joint.agg(F.sum("n").alias("t"))
    rows, cols = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    mi = joint.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda df, c, name: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    return mi.crossJoin(h(rows, "na", "ha")).crossJoin(h(cols, "nb", "hb")).select((2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def similarity(pairs: DataFrame, how: str = "dot", threshold: float = 0.0) -> DataFrame:
    """Similarity of vector pairs (a, b): dot, cos, or a threshold on the Euclidean distance."""
    product = dot(F.col("a"), F.col("b"))
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    if how == "dot":
        value = product
    elif how == "cos":
        value = product / (norm("a") * norm("b"))
    elif how == "euclid":
        value = (F.sqrt(F.greatest(dot(F.col("a"), F.col("a")) + dot(F.col("b"), F.col("b")) - 2 * product, F.lit(0.0))) <= threshold).cast("double")
    else:
        raise ValueError(how)
    return pairs.withColumn("similarity", value)


#: Queries and vectors of a tile, vectors that a task compares at a time (rows that repeat soon are stored in few bytes), and pairs of these.
TILE_QUERIES, TILE_VECTORS, TILE_ROWS, TILE_PAIRS = 4096, 8192, 504, 1 << 18
#: Pairs of the commonest similarities that come first in a tile. A Parquet file keeps a dictionary of its values, 17 bits a pair where the values are rounded, only if that pays on its first page (20,000 rows).
TILE_FIRST = 1 << 15
#: Partitions that tiles are dealt to at most.
MOST_PARTS = 4096


def _matrices(a: pa.Array, b: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Arrays of numbers as rows of a matrix and their lengths; nulls are not a number, shorter rows end in zeros."""
    size = max((x for c in (a, b) for x in pc.list_value_length(c).to_pylist() if x is not None), default=0)

    def matrix(c: pa.Array) -> list[np.ndarray]:
        n = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
        out = np.zeros((len(c), size))
        out[np.arange(size)[None] < n[:, None]] = c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[pc.is_null(c).to_numpy(zero_copy_only=False)] = np.nan
        return [out, n]

    return matrix(a), matrix(b)


def _codes(a: pa.Array, b: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal values as equal numbers; a null equals nothing."""
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices
    null, codes = codes.is_null().to_numpy(zero_copy_only=False), pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
    return [codes[: len(a)], null[: len(a)]], [codes[len(a) :], null[len(a) :]]


def _within(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which rows are at most so far apart. Sums that the product of matrices cannot tell from the bound are made anew, entry by entry."""
    with np.errstate(invalid="ignore", over="ignore"):
        sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
        square = sizes - 2 * (a @ b.T)
        near = square <= most * most
        known = ~np.isnan(a).any(1)[:, None] & ~np.isnan(b).any(1)[None]
        x, y = np.nonzero(~(np.abs(square - most * most) > 1e-9 * (sizes + most * most)) & known)
        for k in range(0, len(x), 4096):
            apart = (a[x[k : k + 4096]] - b[y[k : k + 4096]]) ** 2
            near[x[k : k + 4096], y[k : k + 4096]] = np.sqrt(apart.cumsum(1)[:, -1:].sum(1)) <= most
    return near


def _tiled(prepare: Callable, compare: Callable):
    """Rows (tile, kind, id, x), in order of tile and kind, to the pairs of a tile's queries (kind 0) and vectors (kind 1)."""

    def common_first(value: np.ndarray) -> np.ndarray:
        """Places of the values next to the median, then of the others as they stand."""
        with np.errstate(invalid="ignore"):
            apart = np.abs(value - np.partition(value, len(value) // 2)[len(value) // 2])
        first = np.zeros(len(value), bool)
        first[np.argpartition(apart, TILE_FIRST)[:TILE_FIRST]] = True
        return np.argsort(~first, kind="stable")

    def pairs(held: list[pa.RecordBatch], part: pa.RecordBatch, new: bool):
        ids, own = (pa.concat_arrays([h[c] for h in held]) for c in ("id", "x"))
        i, j = ids.to_numpy(), part["id"].to_numpy()
        a, b = prepare(own, part["x"])
        step = max(1, TILE_PAIRS // len(j))
        for k in range(0, len(i), step):
            value = compare(*[x[k : k + step] for x in a], *b).astype(np.float64).ravel()
            x, y = np.repeat(i[k : k + step], len(j)), np.tile(j, len(i[k : k + step]))
            if not (other := x != y).all():
                x, y, value = x[other], y[other], value[other]
            if new and k == 0 and len(value) > TILE_FIRST:
                x, y, value = (c[order] for order in [common_first(value)] for c in (x, y, value))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(value)], ["i", "j", "similarity"])

    def run(batches):
        now, held, new = None, [], True
        for batch in batches:
            tiles, kinds = batch["tile"].to_numpy(), batch["kind"].to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(2 * tiles + kinds)) + 1).tolist(), len(tiles)]
            for k, end in zip(ends[:-1], ends[1:], strict=True):
                if k == end:
                    continue
                if tiles[k] != now:
                    now, held, new = tiles[k], [], True
                part = batch.slice(k, end - k)
                if kinds[k] == 0:
                    held.append(part)
                elif held:
                    for at in range(0, len(part), TILE_ROWS):
                        yield from pairs(held, part.slice(at, TILE_ROWS), new)
                        new = False

    return run


def tiled_pairs(queries: DataFrame, rows: DataFrame, prepare: Callable, compare: Callable) -> DataFrame:
    """(i, j, similarity) of each query (id, x) with all rows (id, x) of other id.

    Both are dealt into parts of a bounded size, and each part of the queries meets each part of the rows in a tile: a task holds one tile's queries and a bounded number of its pairs. The pairs are as many
    as queries times rows by nature; what is shuffled is a row for each tile that it is in, one in three thousand of that.
    """
    few, many = (df.where("id is not null").select(F.col("id").cast("long").alias("id"), "x") for df in (queries, rows))
    p, v = (max(1, -(-df.count() // most)) for df, most in ((few, TILE_QUERIES), (many, TILE_VECTORS)))
    own = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = few.withColumn("own", own(p)).withColumn("met", every(v)).select((F.col("own") * v + F.col("met")).alias("tile"), F.lit(0).alias("kind"), "id", "x")
    right = many.withColumn("own", own(v)).withColumn("met", every(p)).select((F.col("met") * v + F.col("own")).alias("tile"), F.lit(1).alias("kind"), "id", "x")
    dealt = left.unionByName(right).repartitionById(min(p * v, MOST_PARTS), F.pmod("tile", F.lit(MOST_PARTS)).cast("int"))
    return dealt.sortWithinPartitions("tile", "kind").mapInArrow(_tiled(prepare, compare), "i long, j long, similarity double")


def rounded(value: np.ndarray, digits: int) -> np.ndarray:
    """What ``bround`` gives, without a decimal for each value: only those that may be ties, or have no digits to spare, are rounded as decimals."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = value * 10.0**digits
        out = np.rint(scaled) / 10.0**digits + 0.0  # no -0.0
        unsure = ~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-9 + np.abs(scaled) * 1e-15) | (np.abs(scaled) > 2.0**49)
    for at in zip(*np.nonzero(unsure), strict=True):
        x = float(value[at])
        out[at] = float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN, Context(prec=400))) + 0.0 if math.isfinite(x) else x
    return out


def _compared(how: str, threshold: float, digits: int | None = None):
    def compare(a, n, b, m):
        if (n[:, None] != m[None]).any():
            raise ValueError("vectors of different lengths")
        if how == "euclid":
            return _within(a, b, threshold)
        value = a @ b.T
        if how == "cos":
            with np.errstate(divide="ignore", invalid="ignore"):
                value = value / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        return value if digits is None else rounded(value, digits)

    return compare


def similarity_matrix(queries: DataFrame, vectors: DataFrame, how: str = "dot", threshold: float = 0.0, digits: int | None = None) -> DataFrame:
    """(i, j, similarity) of each query (id, v) with all vectors (id, v) of other id, as products of blocks, rounded half to even if digits are given; null vectors have none."""
    if how not in ("dot", "cos", "euclid"):
        raise ValueError(how)
    few, many = (df.where("v is not null").select("id", F.col("v").alias("x")) for df in (queries, vectors))
    return tiled_pairs(few, many, _matrices, _compared(how, threshold, digits))


def bilinear(edges: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """(src, dst, likelihood): theta(id, k, p) and phi(k, l, p) of each edge's ends."""
    left = edges.join(theta.select(F.col("id").alias("src"), "k", F.col("p").alias("ps")), "src")
    both = left.join(theta.select(F.col("id").alias("dst"), F.col("k").alias("l"), F.col("p").alias("pd")), "dst")
    return both.join(phi.select("k", "l", F.col("p").alias("f")), ["k", "l"]).groupBy("src", "dst").agg(F.sum(F.col("ps") * F.col("pd") * F.col("f")).alias("likelihood"))


def hash_rank(*key: Column, seed: int = 0) -> Column:
    """The order of a draw: an md5 of seed and key, the same on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def drawn_int(*key: Column | str | int, seed: int = 0) -> Column:
    """A whole number of 60 bits drawn by md5 from seed and key, the same on any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def test_split(edges: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Edges with ``is_test``: the int(m * ratio) of smallest draw."""
    keyed = numbered(edges.withColumn("draw", hash_rank(F.col("src"), F.col("dst"), seed=seed)), "rank", F.col("draw"), F.col("src"), F.col("dst"))
    return keyed.withColumn("is_test", F.col("rank") < int(edges.count() * ratio)).drop("draw", "rank")


def test_ratio(test_percent: float, valid_percent: float = 0.0) -> float:
    """The part of edges that is held out: validation is a share of the test set on top of it."""
    return test_percent / 100 * (1 + valid_percent / 100)


def full_split(edges: DataFrame, test_percent: float, valid_percent: float = 0.0, zeros_ratio: float = 1.0, train_percent: float = 0.0, directed: bool = True, seed: int = 0) -> DataFrame:
    """(src, dst, w, part): part is train, test (held-out edges, and zeros_ratio times as many non-edges of weight 0) or gone.

    Undirected test pairs come in both directions. With a train_percent under 100 the other edges outside the test set are gone (thinned).
    """
    ratio = test_ratio(test_percent, valid_percent)
    if not 0 < ratio <= 1:
        raise ValueError(f"no test set of {ratio} of the edges")
    edges = cut(edges)  # read for the ranks, the nodes and the missing pairs
    split = cut(test_split(edges, ratio, seed))
    held, rest = split.where("is_test").select("src", "dst", "w"), split.where("not is_test").select("src", "dst", "w")
    zeros = non_edges(edges, int(held.count() * zeros_ratio), seed + 1, directed).withColumn("w", F.lit(0).cast("long"))
    test = held.unionByName(zeros)
    if not directed:
        test = test.union(test.where("src <> dst").select("dst", "src", "w"))
    kept = rest.withColumn("part", F.lit("train"))
    if 0 < train_percent < 100:
        order = [hash_rank(F.col("src"), F.col("dst"), seed=seed + 2), F.col("src"), F.col("dst")]
        n = rest.count()
        extra = int(n - train_percent / 100 * n)
        kept = numbered(rest.withColumn("draw", order[0]), "rank", F.col("draw"), *order[1:]).select("src", "dst", "w", F.when(F.col("rank") < extra, "gone").otherwise("train").alias("part"))
    return kept.unionByName(test.withColumn("part", F.lit("test")))


def inverted(split: DataFrame) -> DataFrame:
    """The split's other side: what was filtered out is what is seen."""
    return split.withColumn("is_test", ~F.col("is_test"))


def non_edges(edges: DataFrame, n: int, seed: int = 0, directed: bool = True) -> DataFrame:
    """n distinct pairs without an edge and off the diagonal, one drawn from each n-th part of all such pairs in order of ids. More than there are is an error.

    Pairs are found by their rank: the running sum of the nodes' missing links tells the source, and the gaps of its sorted links the target. So the cost is that of the edges, the nodes and
    the result, however dense the graph is. Undirected pairs have the smaller id first.
    """
    ids = cut(numbered(nodes(edges), "place", F.col("id")).select("id", "place"))
    count, spark = ids.count(), edges.sparkSession
    taken = (edges if directed else undirected(edges)).where("src <> dst").select("src", "dst").distinct()
    p, q = F.col("p"), F.col("q")
    # Places of targets without those that no pair has: the source itself, or all up to it.
    target = F.when(q > p, q - 1).otherwise(q) if directed else q - p - 1
    linked = taken.join(ids.select(F.col("id").alias("src"), F.col("place").alias("p")), "src").join(ids.select(F.col("id").alias("dst"), F.col("place").alias("q")), "dst")
    present = cut(linked.select(p.alias("key"), target.alias("place")))
    degree = present.groupBy(F.col("key").alias("place")).agg(F.count("*").alias("linked"))
    room = F.lit(count - 1) if directed else count - 1 - F.col("place")
    free = ids.join(degree, "place", "left").select("id", "place", (room - F.coalesce("linked", F.lit(0))).alias("free"))
    starts = cut(running_sum(free, "end", F.col("free"), F.col("place")).select("id", "place", (F.col("end") - F.col("free")).alias("start"), "free"))
    every = starts.agg(F.sum("free")).first()[0] or 0
    if n > every:
        raise ValueError(f"{n} pairs without an edge are asked for; there are {every}")
    if n <= 0:
        return edges.select("src", "dst").limit(0)
    border = lambda t: F.expr(f"cast(cast({t} as decimal(19, 0)) * cast({every} as decimal(19, 0)) div {n} as long)")
    drawn = spark.range(n).select(F.col("id").alias("t"), border("id").alias("lo"), border("id + 1").alias("hi")).select("t", (F.col("lo") + drawn_int(F.col("t"), "pair", seed=seed) % (F.col("hi") - F.col("lo"))).alias("r"))
    rows = starts.select(F.col("start").alias("r"), F.lit(0).alias("kind"), F.col("place").alias("t")).unionByName(drawn.select("r", F.lit(1).alias("kind"), "t"))
    seen = running_sum(rows, "seen", F.when(F.col("kind") == 0, 1).otherwise(0), F.col("r"), F.col("kind"), F.col("t")).where("kind = 1")
    source = seen.select("r", "t", (F.col("seen") - 1).alias("place")).join(starts, "place")
    asked = source.select(F.col("place").alias("key"), (F.col("r") - F.col("start")).alias("k"), "t", F.col("id").alias("src"))
    found = kth_absent(present, asked).withColumn("p", F.col("key")).withColumn("q", F.col("place"))
    whole = F.when(q >= p, q + 1).otherwise(q) if directed else q + p + 1
    return found.select("src", whole.alias("place")).join(ids.select("place", F.col("id").alias("dst")), "place").select("src", "dst")


def random_mask(cells: DataFrame, ratio: float, seed: int = 0, symmetric: bool = False) -> DataFrame:
    """``masked`` for the diagonal and the int(cells * ratio) off-diagonal cells of smallest draw; a symmetric mask draws pairs and covers both of their cells."""
    a, b = (F.least("src", "dst"), F.greatest("src", "dst")) if symmetric else (F.col("src"), F.col("dst"))
    pairs = cells.where("src <> dst").select(a.alias("a"), b.alias("b")).distinct().withColumn("draw", hash_rank(F.col("a"), F.col("b"), seed=seed))
    hit = first_rows(pairs, int(cells.count() * ratio) // (2 if symmetric else 1), F.col("draw"), F.col("a"), F.col("b")).select("a", "b", F.lit(True).alias("hit"))
    return cells.withColumns({"a": a, "b": b}).join(hit, ["a", "b"], "left").withColumn("masked", F.coalesce("hit", F.col("src") == F.col("dst"))).drop("hit", "a", "b")


def balanced_mask(cells: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Equal numbers of ones and zeros, int(ratio * ones) of each, by smallest draw."""
    n = int(cells.where("w > 0").count() * ratio)
    drawn = cut(cells.where("src <> dst").select("src", "dst", "w", hash_rank(F.col("src"), F.col("dst"), seed=seed).alias("draw")))
    first = [first_rows(drawn.where(part), n, F.col("draw"), F.col("src"), F.col("dst")) for part in ("w > 0", "w = 0")]
    chosen = first[0].union(first[1]).select("src", "dst", F.lit(True).alias("masked"))
    return cells.join(chosen, ["src", "dst"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def add_noise(edges: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """ratio of the edges lose one unit of weight (and go at zero); twice as many new pairs come."""
    n = int(edges.count() * ratio)
    hit = numbered(edges.withColumn("draw", hash_rank(F.col("src"), F.col("dst"), seed=seed)), "rank", F.col("draw"), F.col("src"), F.col("dst"))
    kept = hit.select("src", "dst", (F.col("w") - F.when(F.col("rank") < n, 1).otherwise(0)).cast("long").alias("w")).where("w > 0")
    return kept.union(non_edges(edges, 2 * n, seed + 1).select("src", "dst", F.lit(1).cast("long")))


#: Ranks that one row spreads at a time: a node's share of non-links may be large.
SPREAD = 4096


def kth_absent(present: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, k, and other columns that make its rows unique) with ``place``: the k-th (from 0) whole number from 0 on that ``present`` (key, place) lacks for the key.

    Before the i-th present number of a key there are place - i absent ones, so the numbers present up to the k-th absent one are those with place - i <= k. They are counted by one running
    sum over both tables in order, whatever the number of rows of a key. Of a key that ``present`` lacks every number is absent.
    """
    ordered = numbered(present.select("key", "place").distinct(), "n", F.col("key"), F.col("place"))
    firsts = ordered.groupBy("key").agg(F.min("n").alias("first"))
    gaps = ordered.join(firsts, "key").select("key", (F.col("place") - (F.col("n") - F.col("first"))).alias("k"), F.col("place").alias("tie"))
    rest = [c for c in asked.columns if c not in ("key", "k")]
    rows = gaps.select("key", "k", F.lit(0).alias("kind"), "tie", F.lit(None).cast(asked.select(F.struct(*rest)).dtypes[0][1]).alias("own")).unionByName(asked.select("key", "k", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.struct(*rest).alias("own")))
    counted = running_sum(rows, "seen", F.when(F.col("kind") == 0, 1).otherwise(0), F.col("key"), F.col("k"), F.col("kind"), F.col("tie"), F.col("own"))
    found = counted.where("kind = 1").join(firsts, "key", "left")
    return found.select("key", "k", "own.*", (F.col("k") + F.coalesce(F.col("seen") - F.col("first"), F.lit(0))).alias("place"))


def minibatches(edges: DataFrame, batches: int | DataFrame, zeros: int = 10, zero_prior: float = 0.5, directed: bool = True, sparse: bool = False, seed: int = 0) -> DataFrame:
    """(batch, part, kind, src, dst, w) of stratified minibatches, numbered 0.. or by a table's column ``batch``: each draws a node and one of its sets: non-links (with zero_prior), out-links, in-links (directed only).

    ``kind`` is "scale" for a minibatch's header (src is the node, w the factor that its observations stand for) or "edge". Of a node's f non-links in one direction, which are "zeros out" if the
    node is their source and "zeros in" if it is their target, ceil(f / zeros) distinct ones are drawn: one of each ``zeros`` that follow in order of id. A node without links in a direction gives no
    minibatch of it. Node and set are drawn with repeats. ``sparse`` has the factors of the sparse variant: numbers of links and non-links instead of numbers of nodes.

    Non-links are found by rank in the gaps of the drawn nodes' sorted links, so a minibatch costs its own rows and those links.
    """
    ids = cut(numbered(nodes(edges), "place", F.col("id")).select("id", "place"))
    n, spark, sets, half = ids.count(), edges.sparkSession, 3 if directed else 2, 1 if directed else 2
    number = F.col("batch")
    ticks = spark.range(batches).toDF("batch") if isinstance(batches, int) else batches.select("batch")
    u = (drawn_int(number, "set", seed=seed) % 1_000_000) / 1e6
    part = F.when(u < zero_prior, F.array(F.lit("zeros out"), F.lit("zeros in"))).when((u < zero_prior + (1 - zero_prior) / (sets - 1)) | F.lit(not directed), F.array(F.lit("out"))).otherwise(F.array(F.lit("in")))
    drawn = ticks.select("batch", (drawn_int(number, "node", seed=seed) % n).alias("place"), F.explode(part).alias("part")).join(ids, "place").select("batch", "part", F.col("id").alias("node"), F.col("place").alias("own"))
    drawn = cut(drawn.withColumn("way", F.element_at(F.split("part", " "), -1)))
    ends = edges.select(F.col("src").alias("node"), F.lit("out").alias("way"), F.col("dst").alias("other"), "w").union(edges.select("dst", F.lit("in"), "src", "w"))
    wanted = drawn.select("node", "way", "own").distinct()
    near = cut(ends.join(wanted, ["node", "way"]))  # the links of each drawn node, once
    sizes = near.groupBy("node", "way").agg(F.count("*").alias("degree"), F.count_distinct(F.when(F.col("other") != F.col("node"), F.col("other"))).alias("linked"))
    met = cut(drawn.join(sizes, ["node", "way"]))
    is_zero = F.col("part").startswith("zeros")
    if sparse:
        factor = F.when(is_zero, (n - F.col("degree") - 1) * zeros * half).otherwise(half * n * F.col("degree"))
    else:
        factor = F.when(is_zero, F.lit(sets * zeros / half)).otherwise(F.lit(n * sets / half))
    header = met.select("batch", "part", F.lit("scale").alias("kind"), F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), factor.cast("double").alias("w"))
    key = F.struct("node", "way").alias("key")
    present = near.join(ids.select(F.col("id").alias("other"), "place"), "other").select(key, "place").unionByName(near.select(key, F.col("own").alias("place")))
    free = n - 1 - F.col("linked")
    strata = met.where(is_zero & (free > 0)).select("batch", "part", "node", "way", free.alias("free"), F.ceil(free / zeros).alias("most"))
    for step in (SPREAD, 1):  # in two steps, so that no row holds a list as long as the table of nodes
        first = F.col("at") if "at" in strata.columns else F.lit(0).cast("long")
        last = (F.col("most") if step > 1 else F.least(F.col("most"), F.col("at") + SPREAD)) - 1
        strata = strata.select("batch", "part", "node", "way", "free", "most", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("at"))
    width = F.least(F.lit(zeros), F.col("free") - F.col("at") * zeros)
    asked = strata.select(key, (F.col("at") * zeros + drawn_int(number, F.col("part"), F.col("at"), seed=seed) % width).alias("k"), "batch", "part")
    found = kth_absent(present, asked).join(ids.select("place", F.col("id").alias("other")), "place").select("batch", "part", "key.way", "key.node", "other", F.lit(0).cast("long").alias("w"))
    links = met.where(~is_zero).select("batch", "part", "way", "node").join(near.select("node", "way", "other", F.col("w").cast("long").alias("w")), ["node", "way"])
    seen = links.select("batch", "part", "way", "node", "other", "w").unionByName(found)
    out = F.col("way") == "out"
    return header.union(seen.select("batch", "part", F.lit("edge"), F.when(out, F.col("node")).otherwise(F.col("other")), F.when(out, F.col("other")).otherwise(F.col("node")), F.col("w").cast("double")))


def minibatch_count(n_nodes: int, zeros: int, coverage: float) -> int:
    return int(n_nodes * zeros * coverage)


#: Neighbours of a node from which it is broadcast to them: at most one node in so many pairs.
HOT_NODE = 100_000


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """A round of star contraction on pairs (a, b), a > b: a node's neighbours meet the smallest of them, in a large round its larger neighbours, in a small one its smaller neighbours and itself.

    Stars grow until a component is one, so nodes of many neighbours are told to them by a broadcast: no task gathers a star.
    """
    ends = pairs.union(pairs.select("b", "a")) if large else pairs
    least = ends.groupBy("a").agg((F.least("a", F.min("b")) if large else F.min("b")).alias("m"), F.count("*").alias("n"))
    hot = least.where(F.col("n") > HOT_NODE).select("a", F.col("m").alias("hot"))
    marked = (pairs.select(F.col("b").alias("a"), F.col("a").alias("b")) if large else pairs).join(F.broadcast(hot), "a", "left")
    few = marked.where("hot is null").select("a", "b").join(least.select("a", "m"), "a")
    met = few.unionByName(marked.where("hot is not null").select("a", "b", F.col("hot").alias("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (met if large else met.union(least.select("a", "m"))).where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): smallest reachable id of undirected edges, by alternating large and small stars: about as many rounds as the logarithm of the nodes, each written."""
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(pairs)
    for _ in range(most):
        half = cut(_star(pairs, True))
        after = cut(_star(half, False))
        forget(pairs, half)
        pairs, now = after, state(after)
        if now == before:
            return nodes(edges).join(pairs.select(F.col("a").alias("id"), F.col("b").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def distances(edges: DataFrame, source: int, most: int = 1000) -> DataFrame:
    """(id, d): steps from a node along undirected edges; a join per step with the frontier only."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(source, 0)], "id long, d int")
    for d in range(1, most):
        reached = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("d", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))
    raise RuntimeError(f"nodes are more than {most - 1} steps away")


def pseudo_diameter(edges: DataFrame, start: int) -> int:
    """A double sweep: the farthest node from the farthest node."""
    far = distances(edges, start).orderBy(F.desc("d"), "id").first()
    return distances(edges, far["id"]).agg(F.max("d")).first()[0]


def diameter(edges: DataFrame, most_sweeps: int = 1_000) -> int | None:
    """The largest distance, None if the graph is not connected.

    A breadth-first sweep from a node bounds every other node's eccentricity: not less than its distance and than the sweep's depth less it, not more than their sum.
    Sweeps start at nodes with the largest upper and the smallest lower bounds, 1, 2, 4, up to 64 of them at a time, until no upper bound exceeds the largest distance seen. So there are as many rows as nodes
    and sweeps at a time; graphs in which most nodes' bounds stay apart need a sweep for each of these, and more than ``most_sweeps`` are an error.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct())
    bounds = cut(nodes(edges).select("id", F.lit(0).alias("low"), F.lit(1 << 30).alias("high")))
    n = bounds.count()
    if n == 0:
        return None
    best, sweeps, at_once = 0, 0, 1
    while True:
        open_nodes = bounds.where(F.col("high") > best)
        picked = {r["id"] for order in ([F.desc("high"), F.desc("low"), F.col("id")], [F.col("low"), F.desc("high"), F.col("id")]) for r in open_nodes.orderBy(*order).limit(max(1, at_once // 2)).collect()}
        if not picked:
            return best
        sweeps += len(picked)
        if sweeps > most_sweeps:
            raise RuntimeError(f"the diameter is not settled after {most_sweeps} sweeps")
        reached = _sweeps(both, sorted(picked))
        if reached.count() < n * len(picked):
            return None
        depth = reached.groupBy("s").agg(F.max("d").alias("depth"))
        best = max(best, depth.agg(F.max("depth")).first()[0])
        seen = reached.join(F.broadcast(depth), "s").groupBy("id").agg(F.max(F.greatest(F.col("d"), F.col("depth") - F.col("d"))).alias("l"), F.min(F.col("d") + F.col("depth")).alias("h"))
        bounds = cut(bounds.join(seen, "id").select("id", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high")))
        at_once = min(64, 2 * at_once)


def _sweeps(both: DataFrame, sources: list[int], most: int = 10_000) -> DataFrame:
    """(s, id, d): steps from each of a few sources to all nodes they reach."""
    seen = frontier = both.sparkSession.createDataFrame([(x, x, 0) for x in sources], "s long, id long, d int")
    for d in range(1, most):
        frontier = cut(frontier.join(both, F.col("id") == F.col("a")).select("s", F.col("b").alias("id")).distinct().join(seen, ["s", "id"], "left_anti").select("s", "id", F.lit(d).alias("d")))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))
    raise RuntimeError(f"nodes are more than {most - 1} steps away")


def to_dot(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Lines of a dot file's body."""
    arrow = " -> " if directed else " -- "
    return edges.select(F.concat(F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), F.lit(" [weight="), F.col("w").cast("string"), F.lit("];")).alias("line"))


def observations(masked: DataFrame, symmetric: bool = False) -> DataFrame:
    """Cells that a model sees: those not masked, of a symmetric matrix the upper triangle."""
    seen = masked.where(~F.col("masked"))
    return seen.where("src <= dst") if symmetric else seen


def masked_sizes(masked: DataFrame) -> DataFrame:
    """(id, seen): unmasked cells of each node's row and column; the diagonal counts once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return masked.where(~F.col("masked")).select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("seen"))


def signed(masked: DataFrame) -> DataFrame:
    """Weights as 1 and -1 with 0 outside the part: (src, dst, train, test)."""
    value = F.when(F.col("w") == 0, -1).otherwise(1)
    return masked.select("src", "dst", F.when(F.col("masked"), 0).otherwise(value).alias("train"), F.when(F.col("masked"), value).otherwise(0).alias("test"))


def predict_masked(masked: DataFrame, probability: Column, seed: int = 0) -> DataFrame:
    """Masked cells with a drawn prediction: one where the cell's draw is below its probability."""
    from ..functions.scalars import draw_bernoulli, uniform

    return masked.where("masked").withColumn("predicted", draw_bernoulli(probability, uniform(F.col("src"), F.col("dst"), seed=seed)))


def without_vertices(edges: DataFrame, least: int) -> DataFrame:
    """Edges between nodes of at least ``least`` ends of edges."""
    kept = degrees(edges).where(F.col("degree") >= least).select("id")
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def sampled_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The subgraph of the n smallest ids."""
    kept = first_rows(nodes(edges), n, F.col("id"))
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def updated(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices (id, ...) with ids 0..n-1 in the order of the old ones; vertices that no edge names go."""
    ids = numbered(nodes(edges), "new", F.col("id")).select("id", "new")
    return renumbered(edges), vertices.join(ids, "id").drop("id").withColumnRenamed("new", "id")


def dense_setup(cells: DataFrame, form: str = "b") -> DataFrame:
    """Cells (src, dst, w) of a dense network: "b" holds links only (w 0 or 1), "w" whole weights."""
    if form not in ("b", "w"):
        raise ValueError(f"unknown network form {form}")
    return cells.select("src", "dst", (F.when(F.col("w") != 0, 1).otherwise(0) if form == "b" else F.col("w")).cast("long").alias("w"))


def from_matrix(cells: DataFrame) -> tuple[DataFrame, bool]:
    """Edges of the non-zero cells of a matrix, and whether they are directed: a symmetric matrix makes an undirected graph, with each pair once."""
    edges = cells.where("w <> 0")
    directed = not bool(edges.isEmpty() or is_symmetric(edges).first()["symmetric"])
    return (edges if directed else edges.where("src <= dst")), directed


def sparse_setup(edges: DataFrame, directed: bool | None = None, loops: bool = False, value: str | None = None, shift: str | int | None = None) -> tuple[DataFrame, bool]:
    """A sparse network made ready, in this order: self-loops go, the direction is set or guessed, weights are there (1, or ceil(10 value)), weights are shifted.

    A graph is undirected if its matrix is symmetric or one triangle of it is empty. ``shift`` is a number to add, or "linear_k" for k w + k.
    """
    df = edges if loops else without_loops(edges)
    if directed is None:
        guess = is_symmetric(df.select("src", "dst", F.lit(1).alias("w")).distinct()).first()
        directed = not (guess["symmetric"] or guess["one_triangle"])
    if not directed:
        keep = [c for c in df.columns if c not in ("src", "dst")]
        df = df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *keep).dropDuplicates(["src", "dst"])
    if "w" not in df.columns:
        df = df.withColumn("w", F.ceil(F.col(value) * 10) if value else F.lit(1))
    if shift:
        head, _, k = str(shift).rpartition("_")
        df = df.withColumn("w", F.col("w") * int(k) + int(k) if head == "linear" else F.col("w") + int(k))
    return df.withColumn("w", F.col("w").cast("long")), directed


#: Largest weight after exponentiation: a fixed value.
MOST_WEIGHT = 300


def configured(edges: DataFrame, exponentiate: bool = False, n: int | str | None = None, test_percent: float | None = None, noise: float | None = None, seed: int = 0) -> DataFrame:
    """Set-up of a corpus in its order: weights to powers of two (at most MOST_WEIGHT), the first n nodes ("all" for every one), a test split (``is_test``), noise on what is not tested."""
    df = edges
    if exponentiate:
        df = df.withColumn("w", F.when(F.col("w") > 8, MOST_WEIGHT).otherwise(F.least(F.pow(F.lit(2.0), F.col("w")), F.lit(float(MOST_WEIGHT)))).cast("long"))
    if n is not None and n != "all":
        df = sampled_nodes(df, int(n))
    if test_percent is not None:
        df = test_split(df, test_ratio(test_percent), seed)
    if noise:
        if test_percent is None:
            return add_noise(df, noise, seed)
        df = cut(df)
        noisy = add_noise(df.where("not is_test").drop("is_test"), noise, seed).withColumn("is_test", F.lit(False))
        return noisy.unionByName(df.where("is_test"))
    return df


def edge_similarity(edges: DataFrame, vectors: DataFrame, how: str = "cos", threshold: float = 0.0) -> DataFrame:
    """Edges with the similarity of their ends' vectors (id, v): only pairs that are edges are compared."""
    both = edges.join(vectors.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(vectors.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    return similarity(both, how, threshold).drop("a", "b")


def _signs(near: np.ndarray) -> np.ndarray:
    return np.where(near, 1.0, -1.0)


def cluster_similarity(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(i, j, similarity) of each query (id, cluster) with all others (id, cluster): 1 where both have one cluster, else -1: the k-means sign and the community similarity, by the clusters given."""
    few, many = (df.select("id", F.col("cluster").alias("x")) for df in (queries, clusters))
    return tiled_pairs(few, many, _codes, lambda a, none, b, no: _signs((a[:, None] == b[None]) & ~none[:, None] & ~no[None]))


def near_similarity(queries: DataFrame, vectors: DataFrame, spread: float, k: int, how: str = "old") -> DataFrame:
    """(i, j, similarity) of each query (id, v) with all others (id, v): 1 or -1 by a distance of at most 2 spread / k: "old" the whole Euclidean one; "abs" on each of the first two
    coordinates (1 unless both are far); "dist" on the first coordinate, taken for both of them. Where a null or another length leaves no distance it is -1."""
    most = 2.0 * spread / k
    at = lambda a, n, d: np.where(n > d, a[:, d], np.nan) if a.shape[1] > d else np.full(len(a), np.nan)
    apart = lambda a, n, b, m, d: np.abs(at(a, n, d)[:, None] - at(b, m, d)[None])
    if how not in ("old", "abs", "dist"):
        raise ValueError(how)

    def compare(a, n, b, m):
        with np.errstate(invalid="ignore"):
            if how == "old":
                return _signs(_within(a, b, most) & (n[:, None] == m[None]))
            if how == "abs":
                return _signs((apart(a, n, b, m, 0) <= most) | (apart(a, n, b, m, 1) <= most))
            return _signs(np.sqrt(2.0) * apart(a, n, b, m, 0) <= most)

    few, many = (df.select("id", F.col("v").alias("x")) for df in (queries, vectors))
    return tiled_pairs(few, many, _matrices, compare)


def log_factorial(n: Column) -> Column:
    """ln n!, to double precision: factorials up to 20, Stirling's series beyond."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def expected_mutual_information(rows: DataFrame, cols: DataFrame, total: int) -> DataFrame:
    """One row ``expected``: the mutual information that two labellings with classes of these sizes (column n) have on average over all arrangements.

    Classes of one size share their terms, so there is a row for each pair of distinct sizes (at most 2 sqrt(total) pairs' sides each) and possible overlap.
    """
    x = rows.groupBy(F.col("n").alias("x")).agg(F.count("*").alias("fx"))
    y = cols.groupBy(F.col("n").alias("y")).agg(F.count("*").alias("fy"))
    least, most = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - total), F.least("x", "y")
    pairs = x.crossJoin(F.broadcast(y))  # distinct sizes: less than sqrt(2 total) on each side
    blocks = pairs.select("*", F.explode(F.sequence(least, most, F.lit(SPREAD).cast("long"))).alias("at"), most.alias("most")).repartition(parts(rows.sparkSession))
    terms = blocks.select("x", "y", "fx", "fy", F.explode(F.sequence(F.col("at"), F.least(F.col("most"), F.col("at") + SPREAD - 1))).alias("n"))
    f, t, a, b, n = log_factorial, F.lit(total).cast("long"), F.col("x"), F.col("y"), F.col("n")
    chance = F.exp(f(a) + f(b) + f(t - a) + f(t - b) - f(t) - f(n) - f(a - n) - f(b - n) - f(t - a - b + n))
    return terms.agg(F.coalesce(F.sum(F.col("fx") * F.col("fy") * n / total * F.log(t * n / (a * b)) * chance), F.lit(0.0)).alias("expected"))


def adjusted_mutual_information(labels: DataFrame) -> DataFrame:
    """One row ``ami``: adjusted mutual information (arithmetic mean) of two labellings (a, b); the expected value comes from the class sizes. Null without rows."""
    joint = cut(labels.groupBy("a", "b").agg(F.count("*").alias("n")))
    total = joint.agg(F.sum("n")).first()[0]
    if not total:
        return labels.sparkSession.range(1).select(F.lit(None).cast("double").alias("ami"))
    rows, cols = (cut(joint.groupBy(c).agg(F.sum("n").alias("n"))) for c in ("a", "b"))
    one = joint.join(rows.withColumnRenamed("n", "na"), "a").join(cols.withColumnRenamed("n", "nb"), "b").agg(F.sum(F.col("n") / total * F.log(F.col("n") * F.lit(float(total)) / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda df, name: df.agg((-F.sum(F.col("n") / total * F.log(F.col("n") / total))).alias(name))
    every = one.crossJoin(entropy(rows, "ha")).crossJoin(entropy(cols, "hb")).crossJoin(expected_mutual_information(rows, cols, total))
    room = (F.col("ha") + F.col("hb")) / 2 - F.col("expected")
    return every.select(F.when(F.abs(room) < 1e-15, 1.0).otherwise((F.col("mi") - F.col("expected")) / room).alias("ami"))
