"""Similarity join of documents on word shingles: a forest of count-vector R-trees, then exact verification.

A document's set is its distinct shingles of five lower-cased words. Equal sets form one class. Two classes link when
100 * |intersection| >= 75 * |union|.

Places. One tree over all points prunes little, for unrelated texts are about equally far apart in many dimensions (README has figures). The classes are therefore
first divided into places that no link crosses. Order all shingles, those found often in a sample of documents last. Two neighbours of a set in that order are a couple of it.
Linking sets of sizes a and b hold i >= 3(a+b)/7 shingles in common; each of the other a+b-2i breaks at most one couple of the
common ones, so the sets have 3i-a-b-1 couples in common at least, and meet in the first floor(n/2)+1 couples of each. Places are the components of the classes that meet
so. The sample only steers the order: any order gives the same links, and a passage that many documents share rarely makes them meet.

Trees. Shingles are hashed into ``GROUPS`` groups; a class is the point of its group counts. The sum over groups of the smaller
of two counts bounds an intersection from above, and so does the sum of the smaller of two tree nodes' largest counts for all pairs of points below them. An R-tree over
each place's points is joined with itself from the root down: pairs of nodes whose bound stays under the least overlap that their sizes ask for are skipped with all below them.
The surviving pairs are verified on the shingles themselves, as bit sets.
Documents that share short passages chain together into large places though few of them link, so a tree of many points also keeps, for each pair of its nodes, whether
points below share an early couple when shingles are ordered by their number in the place, rarest first; other pairs of nodes are skipped. What a place costs then follows such pairs of classes, not all pairs.

Hot places. A set travels to its place once. Places too large for a task are first split again, up to ``SPLITS`` times, each time in another order of all shingles, by three neighbours instead
of two: with D = a+b-2i shingles in one set only, at most D of the i-1 gaps between common ones are broken, and each spoils two triples at most, so linking sets have i-2-2D >= (a+b)/7 - 2 triples in common and meet in the first
n+1-ceil(n/4) of each; sets of fewer than nine shingles, where that may be none, use couples too. What is still too large then is dealt out whole: a place of more than ``PLACE_ROWS`` classes or ``PLACE_SHINGLES`` shingles is dealt out as pairs of blocks, each a task's work. A task
returns one row for each class, with its links and the first class that links connect it with: pairs never leave it. A shingle couple that many
classes hold is joined within each block of the input first, so it sends one row per block.

Cases: null and empty texts have empty sets and link with nothing; fewer than five words make one shingle of the whole sequence. Rows with equal doc_id
are documents of their own with one identity; a null doc_id is never a component's name unless all its ids are null. Texts may be of any length.
Other columns are ignored. Hashes have 64 bits; sets are equal when their sizes and 64-bit sums of mixed shingle hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import chunks, lower, materialise, mix, partitions, plain_name, shingles, text_arrays, tidy, word_hashes, words

#: Words of a shingle, coordinates of a point, children of a tree node.
WORDS, GROUPS, LEAF = 5, 64, 16
#: Classes and shingles of a place, or of a block of it, that one task compares. These decide who does the work, not what is compared.
PLACE_ROWS, PLACE_SHINGLES = 4096, 2_000_000
#: Couples that a task joins before sending them on, pairs and shingles that it verifies at a time.
BLOCK_COUPLES, PAIRS, COLUMNS = 1 << 18, 1 << 16, 1 << 14
#: Times that places too large for a task are split again. A tree of more points than ``PLAIN`` keeps which nodes share an early couple; entries and couples that are marked at a time.
SPLITS, PLAIN, MARKS, MARKED = 2, 64, 1 << 15, 1 << 11
#: Documents sampled (a share, and at least so many) to learn which shingles are frequent, sampled documents that make one frequent, and the most of these kept (32 MB).
SAMPLE_SHARE, SAMPLED, OFTEN, MOST_OFTEN = 1 / 16, 20_000, 16, 4_000_000
_U = np.uint64


def need(a, b):
    """Least intersection of linking sets of sizes a and b: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_arrays(column)
    for a, b in chunks(offsets):
        part, at = lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at)
        hashes = word_hashes(part, starts, ends)
        grams = shingles(hashes, WORDS)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= WORDS:
                yield np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                yield shingles(hashes[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def name_of(items: np.ndarray) -> int:
    """A class's 64-bit name, as a signed long."""
    total = mix(items ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64) + _U(len(items))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


@tidy
def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])

    for batch in batches:
        for items in sets_of(batch["text"]):
            held.append(items)
            n += len(items)
            if n >= BLOCK_COUPLES:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that ``OFTEN`` sampled documents hold (the most frequent ``MOST_OFTEN``)."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1 << 30))
    sample = docs.where(draw < int(min(1.0, max(SAMPLE_SHARE, SAMPLED / max(docs.count(), 1))) * (1 << 30)))
    found = sample.select("text").mapInArrow(_shingle_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(found.orderBy(F.desc("n"), "h").limit(MOST_OFTEN).select("h").toArrow()["h"].to_numpy().view(np.uint64))


def couples(items: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Hashes of the first floor(n/2) + 1 couples of neighbours, shingles of ``often`` last."""
    if len(often):
        hot = often[np.minimum(np.searchsorted(often, items), len(often) - 1)] == items
        items = np.concatenate([items[~hot], items[hot]])
    n = min(len(items) - 1, len(items) // 2 + 1)
    return mix(items[:n] * _U(0x9E3779B97F4A7C15) + items[1 : n + 1])


def triples(items: np.ndarray, often: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the first n+1-ceil(n/4) triples of neighbours in the order of ``seed``, shingles of ``often`` last; of sets below nine also of their couples."""
    key = mix(items ^ _U(seed + 1))
    if len(often):
        late = often[np.minimum(np.searchsorted(often, items), len(often) - 1)] == items
        order = np.lexsort((key, late))
    else:
        order = np.argsort(key)
    x, n = key[order], len(items)
    m = max(0, min(n - 2, n + 1 + -n // 4))
    found = mix(mix(x[:m] * _U(0x9E3779B97F4A7C15) + x[1 : m + 1]) * _U(0x9E3779B97F4A7C15) + x[2 : m + 2])
    if n >= 9:
        return found
    m = min(n - 1, n // 2 + 1)
    return np.concatenate([found, mix(x[:m] * _U(0xD6E8FEB86659FD93) + x[1 : m + 1])])


#: kind 0: a couple and a class that holds it. kind 1: two classes that meet. kind 2: a document (doc_id, tag, n) and its class.
ENTRY = "kind int, h long, name long, doc binary"
MET = "kind int, name long, hub long, doc binary"


def _entry(kind: int, h: np.ndarray, name: np.ndarray, doc: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(name), pa.array(doc, pa.binary()) if doc else pa.nulls(len(h), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "h", "name", "doc"])


def _runs(h: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by h: whether a row begins a run, and the first name of its run."""
    begins = np.ones(len(h), bool)
    begins[1:] = h[1:] != h[:-1]
    return begins, name[np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different numbers."""
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def _entries(shared):
    @tidy
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held, seen, n = shared.value, [], set(), 0

        def flush():
            h, name = np.concatenate([x for x, _ in held]).view(np.int64), np.repeat(np.array([k for _, k in held], np.int64), [len(x) for x, _ in held])
            order = np.argsort(h, kind="stable")
            h, name = h[order], name[order]
            begins, hub = _runs(h, name)
            yield _entry(0, h[begins], name[begins])
            one, two = _distinct(name[~begins], hub[~begins])
            if len(one):
                yield _entry(1, one, two)

        for batch in batches:
            names, docs = [], []
            for items, doc, tag in zip(sets_of(batch["text"]), batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), strict=True):
                name = name_of(items) if len(items) else None
                names.append(name)
                docs.append(np.array([doc is None, doc or 0, tag, len(items)], np.int64).tobytes())
                if len(items) > 1 and name not in seen:
                    seen.add(name)
                    held.append((couples(items, often), name))
                    n += len(held[-1][0])
                    if n >= BLOCK_COUPLES:
                        yield from flush()
                        held, seen, n = [], set(), 0
            # Documents travel with the couples so that the texts are read once; any key does for them.
            row = np.frombuffer(b"".join(docs), np.int64).reshape(-1, 4)
            yield _entry(2, row[:, 1] ^ row[:, 2], pa.array(names, pa.int64()), docs)
        if held:
            yield from flush()

    return entries


def _split_entries(shared, seed: int):
    """Triples of the sets of crowded places; those of different places stay apart."""

    @tidy
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, held, n = shared.value, [], 0

        def flush():
            h, name = np.concatenate([x for x, _ in held]).view(np.int64), np.repeat(np.array([k for _, k in held], np.int64), [len(x) for x, _ in held])
            order = np.argsort(h, kind="stable")
            h, name = h[order], name[order]
            begins, hub = _runs(h, name)
            yield _entry(0, h[begins], name[begins])
            one, two = _distinct(name[~begins], hub[~begins])
            if len(one):
                yield _entry(1, one, two)

        for batch in batches:
            for root, name, items in zip(batch["root"].to_numpy(), batch["name"].to_pylist(), batch["items"], strict=True):
                found = triples(np.frombuffer(items.as_buffer(), np.uint64), often, seed)
                held.append((mix(found ^ root.view(np.uint64)), name))
                n += len(found)
                if n >= BLOCK_COUPLES:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return entries


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, h): the classes of a couple meet its first one; other rows pass."""
    last: tuple | None = None  # couple and first class of the run that may go on
    for batch in batches:
        kind = batch["kind"].to_numpy()
        for k in (1, 2):
            if (kind == k).any():
                rest = batch.filter(pa.array(kind == k))
                yield pa.RecordBatch.from_arrays([rest["kind"], rest["name"], rest["h"], rest["doc"]], ["kind", "name", "hub", "doc"])
        h, name = (batch[c].filter(pa.array(kind == 0)).to_numpy() for c in ("h", "name"))
        if len(h):
            _, hub = _runs(h, name)
            if last is not None and h[0] == last[0]:
                hub[h == h[0]] = last[1]
            last = h[-1], hub[-1]
            one, two = _distinct(name, hub)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(one), np.int32)), pa.array(one), pa.array(two), pa.nulls(len(one), pa.binary())], ["kind", "name", "hub", "doc"])


@tidy
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        none, doc, tag, n = np.frombuffer(b"".join(batch["doc"].to_pylist()), np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(doc.copy(), mask=none.astype(bool)), pa.array(tag.copy()), pa.array(n.copy()), batch["name"]], ["doc_id", "tag", "n", "name"])


@tidy
def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            yield batch.drop_columns(["text"]).append_column("items", pa.array([x.tobytes() for x in sets_of(batch["text"])], pa.binary()))


def point_of(items: np.ndarray) -> np.ndarray:
    return np.bincount((items >> _U(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


class Tree:
    """A packed R-tree: nodes of LEAF children with largest counts and size ranges. ``near`` orders the points: those close in it share nodes."""

    def __init__(self, points: np.ndarray, near: np.ndarray):
        sizes = points.sum(1).astype(np.int64)
        self.order, self.meets = np.lexsort((sizes, near)), None
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def keep(self, items: np.ndarray, row: np.ndarray) -> None:
        """Only pairs that share an early couple are wanted: marks for each level which of its pairs of nodes have such a pair below."""
        n = len(self.order)
        at = np.empty(n, np.int64)
        at[self.order] = np.arange(n)
        self.meets = [early_couples(items, at[row], n)]
        some = self.meets[0].reshape(n, -1, LEAF // 8).any(2)
        while len(self.meets) < len(self.levels):
            some = np.logical_or.reduceat(some, np.arange(0, some.shape[0], LEAF), axis=0)
            self.meets.append(some)
            some = np.logical_or.reduceat(some, np.arange(0, some.shape[1], LEAF), axis=1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of points (each once) that their bounds allow to link, in portions; after ``keep`` those that also share an early couple."""
        self.bounded = 0
        yield from self._below(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def _below(self, k: int, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From pairs of nodes of level k down."""
        top, low, high = self.levels[k]
        if k == 0:
            p, q = p[p < q], q[p < q]
        if self.meets is not None:
            marked = (self.meets[0][p, q >> 3] >> (q & 7).astype(np.uint8)) & 1 if k == 0 else self.meets[k][p, q]
            p, q = p[marked.astype(bool)], q[marked.astype(bool)]
        self.bounded += len(p)
        # The smallest sizes that points below may have to link ask for the least overlap.
        a, b = np.maximum(low[p], -(-3 * low[q] // 4)), np.maximum(low[q], -(-3 * low[p] // 4))
        fits = np.flatnonzero((a <= high[p]) & (b <= high[q]))
        fits = fits[np.minimum(top[p[fits]], top[q[fits]]).sum(1) >= need(a[fits], b[fits])]
        p, q = p[fits], q[fits]
        if k == 0:
            if len(p):
                yield self.order[p], self.order[q]
            return
        n, step = len(self.levels[k - 1][0]), np.arange(LEAF)
        for c in range(0, len(p), 256):
            x, y = (p[c : c + 256, None, None] * LEAF + step[:, None]), (q[c : c + 256, None, None] * LEAF + step)
            x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
            some = (x <= y) & (y < n) & (x < n)
            yield from self._below(k - 1, x[some], y[some])


def early_couples(items: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Bit q of row p: sets p and q share one of their first floor(n/2) + 1 couples, the shingles that fewest sets hold first. Rows are padded to whole leaves."""
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    order = np.lexsort((column, times[column], row))
    column, row = column[order], row[order]
    size = np.bincount(row, minlength=n_rows)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    early = np.flatnonzero((row[:-1] == row[1:]) & (place[:-1] <= size[row[:-1]] // 2) & (times[column[:-1]] > 1))
    couple, who = column[early] * len(times) + column[early + 1], row[early]
    order = np.argsort(couple, kind="stable")
    _, group, n = np.unique(couple[order], return_inverse=True, return_counts=True)
    who = who[order][n[group] > 1]
    group = np.cumsum(n > 1)[group[n[group] > 1]] - 1  # couples of one set alone are gone
    wide = -(-n_rows // LEAF) * LEAF
    meets = np.zeros((n_rows, wide // 8), np.uint8)
    a = 0
    while a < len(who):
        last = min(group[min(a + MARKS, len(who)) - 1], group[a] + MARKED - 1)
        b = int(np.searchsorted(group, last, "right"))  # whole couples; one may have as many entries as there are rows
        held = np.zeros((last + 1 - group[a], wide), bool)
        held[group[a:b] - group[a], who[a:b]] = True
        bits = np.packbits(held, axis=1, bitorder="little")
        order = np.argsort(who[a:b], kind="stable")
        rows, starts = np.unique(who[a:b][order], return_index=True)
        meets[rows] |= np.bitwise_or.reduceat(bits[group[a:b][order] - group[a]], starts, axis=0)
        a = b
    return meets


def overlaps(items: np.ndarray, row: np.ndarray, n_rows: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """|intersection| of the sets of rows p and q; ``items`` and ``row`` list all shingles of all sets."""
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    begins = np.ones(len(items), bool)
    begins[1:] = items[1:] != items[:-1]
    column = np.cumsum(begins) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection
    row, column = row[shared], np.cumsum(begins[shared]) - 1
    total = np.zeros(len(p), np.int64)
    ends = np.searchsorted(column, np.arange(COLUMNS, (column[-1] if len(column) else 0) + COLUMNS + 1, COLUMNS))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if a == b:
            continue
        c = column[a:b] - column[a] // COLUMNS * COLUMNS
        wide = (int(c[-1]) >> 6) + 1
        bits = np.zeros((n_rows, wide), np.uint64)
        np.bitwise_or.at(bits, (row[a:b], c >> 6), _U(1) << (c & 63).astype(np.uint64))
        step = max(1, (1 << 21) // wide)
        for k in range(0, len(p), step):
            total[k : k + step] += np.bitwise_count(bits[p[k : k + step]] & bits[q[k : k + step]]).sum(1, dtype=np.int64)
    return total


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest number connected with each of 0..n-1 by pairs (p, q)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        for x in (p, q):
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _linked(name: np.ndarray, copies: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a place (or of a pair of its blocks, by side): the class that stands for its component here, and how many documents of other classes it links with."""
    n = np.array([len(x) for x in sets], np.int64)
    items, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    portion: list[tuple] = []

    def verify():
        p, q = (np.concatenate(x) for x in zip(*portion, strict=True))
        good = overlaps(items, row, len(sets), p, q) >= need(n[p], n[q])
        return p[good], q[good]

    def take(p, q):
        nonlocal root
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        root = roots(len(sets), np.concatenate([np.arange(len(sets)), p]), np.concatenate([root, q]))

    tree = Tree(np.stack([point_of(x) for x in sets]), np.array([x[0] for x in sets]))
    if len(sets) > PLAIN:
        tree.keep(items, row)
    for p, q in tree.pairs():
        if side is not None:
            across = side[p] != side[q]
            p, q = p[across], q[across]
        portion.append((p, q))
        if sum(len(x) for x, _ in portion) >= 16 * PAIRS:
            take(*verify())
            portion.clear()
    if portion:
        take(*verify())
    return name[root], links


@tidy
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j, side, name): one row for each class of each pair of blocks."""
    held: list[tuple] = []
    now, out, n_out = None, [], 0

    def solve():
        name, copies, side, sets = (list(x) for x in zip(*held, strict=True))
        name = np.array(name, np.int64)
        first, links = _linked(name, np.array(copies, np.int64), np.array(side) if now[1] < now[2] else None, sets)
        return name, first, links

    def write():
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["name", "first", "links"])

    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("root", "i", "j")), strict=True)
        for key, name, copies, side, items in zip(keys, *(batch[c].to_pylist() for c in ("name", "copies", "side")), batch["items"], strict=True):
            if key != now and held:
                out.append(solve())
                held, n_out = [], n_out + len(out[-1][0])
                if n_out >= 10_000:
                    yield write()
                    out, n_out = [], 0
            now = key
            if not held or held[-1][0] != name:  # one class may come from rows that are there twice
                held.append((name, copies, side, np.frombuffer(items.as_buffer(), np.uint64).copy()))
    if held:
        out.append(solve())
    if out:
        yield write()


def _tag():
    """With the id it tells a row: a row's text as a number."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


#: A class's set: its place, name, documents, size and shingles.
SET = ("root", "name", "copies", "n", "items")


def crowded(classes: DataFrame) -> DataFrame:
    """(root, blocks) of places that one task should not compare."""
    blocks = classes.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / PLACE_ROWS), F.ceil(F.sum("n") / PLACE_SHINGLES)).cast("int").alias("blocks"))
    return materialise(blocks.where("blocks > 1"))


def _read_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    read = docs.join(placed, docs["doc_id"].eqNullSafe(placed["reader"]) & (docs["tag"] == placed["reader_tag"])).select("root", "name", "copies", "n", "text")
    return read.mapInArrow(_whole_sets, "root long, name long, copies long, n long, items binary")


def split(sets: DataFrame, often, seed: int) -> DataFrame:
    """The sets of ``SET`` with smaller places in ``root``: those that triples of neighbours in the order of ``seed`` connect inside each. Sets that meet no other are left out."""
    entries = sets.select("root", "name", "items").mapInArrow(_split_entries(often, seed), ENTRY)
    met = entries.repartition(partitions(sets.sparkSession), "h").sortWithinPartitions("kind", "h").mapInArrow(_meet, MET)
    places = components(met.where("kind = 1").select(F.col("name").alias("a"), F.col("hub").alias("b"))).toDF("name", "root")
    return materialise(sets.drop("root").join(places, "name").select(*SET))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, n, name) of the documents, and (name, copies, links, root) of the classes that meet another: documents of the class,
    documents of other classes it links with, and the class that stands for its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", _tag())
    often = spark.sparkContext.broadcast(frequent(docs))
    entries = docs.mapInArrow(_entries(often), ENTRY)
    met = materialise(entries.repartition(partitions(spark), "h").sortWithinPartitions("kind", "h").mapInArrow(_meet, MET))
    members = met.where("kind = 2").select("doc", "name").mapInArrow(_documents, "doc_id long, tag long, n long, name long")
    places = components(met.where("kind = 1").select(F.col("name").alias("a"), F.col("hub").alias("b")))
    text = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    classes = members.where("name is not null").groupBy("name").agg(F.min(text).alias("reader"), F.count("*").alias("copies"), F.first("n").alias("n"))
    placed = materialise(classes.join(places.withColumnRenamed("id", "name"), "name").select("name", "copies", "n", "root", F.col("reader.doc_id").alias("reader"), F.col("reader.tag").alias("reader_tag")))
    blocks = crowded(placed)
    dealt = not blocks.isEmpty()
    sets = _read_sets(docs, placed.join(blocks, "root", "left_anti") if dealt else placed).withColumn("blocks", F.lit(1))
    if dealt:
        hot = materialise(_read_sets(docs, placed.join(blocks, "root", "left_semi")))
        for seed in range(SPLITS):
            hot = split(hot, often, seed)
            blocks = crowded(hot)
            if blocks.isEmpty():
                break
        dealt = not blocks.isEmpty()
        sets = sets.union(hot.join(blocks, "root", "left").select(*SET, F.coalesce("blocks", F.lit(1)).alias("blocks")))
    sets = sets.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("root", "name", "copies", "items", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    found = sets.repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "name").mapInArrow(_places, "name long, first long, links long")
    found = materialise(found)
    whole = found.groupBy("name").agg(F.sum("links").alias("links"), F.min("first").alias("root"))
    if dealt:  # a class of a place in blocks has a row for each pair of them
        joined = components(found.select(F.col("name").alias("a"), F.col("first").alias("b")))
        whole = whole.drop("root").join(joined.withColumnRenamed("id", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    return members, whole.join(placed.select("name", "copies"), "name")


def _rooted(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Documents with the class that stands for their component; null for those without words."""
    alone = members.where("name is not null").groupBy("name").agg(F.count("*").alias("copies"))
    known = alone.join(classes.drop("copies"), "name", "left").select("name", F.coalesce("root", "name").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return members.join(known, "name", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents that it links with, copies included) of each document."""
    rooted = _rooted(*_joined(docs))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id (null is the largest; then by text); all columns of docs are kept.

    Rows are lost by id and text, so other texts of a lost row's id stay; rows equal in both stay or go together.
    """
    members, classes = _joined(docs)
    rooted = _rooted(members, classes).where("root is not null").select("doc_id", "tag", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"))
    lost = rooted.join(first, "root").where(~order.eqNullSafe(F.col("first"))).select("doc_id", "tag").distinct()
    lost_id, lost_tag = plain_name(docs, "lost_id"), plain_name(docs, "lost_tag")
    return docs.join(lost.toDF(lost_id, lost_tag), F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & (_tag() == F.col(lost_tag)), "left_anti")
