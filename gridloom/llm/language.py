"""Language identification by partial matching over bytes.

Each language has a variable-order context tree: counts of the byte that follows each context of up to three bytes.
A byte seen in its context costs -log2(count / (n + d)), n being the context's count and d its number of distinct
followers; an unseen one costs the escape -log2(d / (n + d)) plus its cost in the next shorter context, down to a uniform
code of eight bits. The trees are frozen after training, so a text's code length is a sum over its bytes, and the language that codes it shortest wins.

All 256 byte values are coded, and a text begins after three marks that are no byte. Contexts are sparse: only strings seen in training have entries.
Training reads about ``PER_LANGUAGE`` documents of each language, chosen by a hash of doc_id, never those held out. The model has
every string of up to four bytes of those documents: 24 bytes for each string of four and language that saw it are collected and broadcast. More than ``most_costs`` of strings times languages are an error that asks for a smaller sample,
for an executor's tables have four bytes for each of these per order; nothing is left out of a model.

Cases: a null text, or one without a letter, is ``und`` with score 0. Null lang rows are scored but not learned from; a null
doc_id is not held out and not learned from. With nothing to learn from, every text is ``und``. Ties between languages go to the smaller name.
A text of any length is coded in pieces. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, materialise, text_arrays, tidy

#: Training documents of each language (a bound on average), the most strings times languages of a model, and the fold that is never learned from.
PER_LANGUAGE, MOST_COSTS, HELD_OUT_FOLD = 3000, 1 << 23, 2
#: Bits of a symbol (a byte, or START), and bytes that are coded at a time.
BITS, START, PIECE = 9, 256, 1 << 19
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def grams(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; ``first`` counts the bytes before it in its text, as far as three."""
    s = data.astype(np.int64)
    key = s.copy()
    for back in (1, 2, 3):
        shifted = np.full(len(s), START, np.int64)
        shifted[back:] = s[:-back]
        key |= np.where(first >= back, shifted, START) << (BITS * back)
    return key


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of each byte, for PIECE bytes at a time."""
    for a in range(0, len(data), PIECE):
        b, back = min(a + PIECE, len(data)), min(a, 3)
        at = np.arange(a - back, b)
        row = np.searchsorted(offsets, at, "right") - 1
        yield row[back:], grams(data[a - back : b], np.minimum(at - offsets[row], 3))[back:]


def _count_grams(names: list[str]):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            langs = np.array([names.index(x) for x in batch["lang"].to_pylist()], np.int64)
            for row, key in pieces(data, offsets):
                both, n = np.unique(langs[row] << 4 * BITS | key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both & MASK[4]), pa.array(both >> 4 * BITS), pa.array(n.astype(np.int64))], ["gram", "lang", "n"])

    return count


MASK = [(1 << BITS * k) - 1 for k in range(5)]


class Rows:
    """Row numbers of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, size = keys, 4
        while 1 << size < 2 * len(keys):
            size += 1
        self.shift, self.slots = np.uint64(64 - size), np.full(1 << size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._slot(keys)
        out = self.slots[at].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at]
            more = (out[left] >= 0) & (self.keys[out[left]] != keys[left])
            left, at = left[more], at[more]
        return out


class Trees:
    """Frozen code lengths by language: of single bytes and pairs densely, of seen strings of three and four bytes by row."""

    def __init__(self, names: list[str], gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        size = len(names)
        self.names = names
        seen = np.unique(gram)
        count = np.zeros((len(seen), size))
        np.add.at(count, (np.searchsorted(seen, gram), lang), n)

        def shorter(keys, count, order):
            """Counts of the last ``order`` symbols."""
            short, at = np.unique(keys & MASK[order], return_inverse=True)
            out = np.zeros((len(short), size))
            np.add.at(out, at, count)
            return short, out

        def contexts(keys, count):
            """Context of each string, and by context the escape and the whole count with the number of followers."""
            context, at = np.unique(keys >> BITS, return_inverse=True)
            total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
            np.add.at(total, at, count)
            np.add.at(kinds, at, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                return context, at, np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0), total + kinds

        def costs(count, at, escape, whole, below):
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(count > 0, -np.log2(count / whole[at]), escape[at] + below)

        levels = {4: (seen, count)}
        for order in (3, 2, 1):
            levels[order] = shorter(*levels[order + 1], order)
        # Bytes and pairs: every one has a cost, seen or not.
        keys, count = levels[1]
        _, at, escape, whole = contexts(keys, count)
        one = np.tile(8.0 + (escape[0] if len(escape) else np.zeros(size)), (START + 1, 1))
        one[keys] = costs(count, at, escape, whole, 8.0)
        keys, count = levels[2]
        context, at, escape, whole = contexts(keys, count)
        two = np.tile(one, (START + 1, 1, 1))
        two[context] += escape[:, None, :]
        two = np.concatenate([two, np.zeros((START + 1, (1 << BITS) - START - 1, size))], 1).reshape(-1, size)
        two[keys] = costs(count, at, escape, whole, one[keys & MASK[1]])
        keys, count = levels[3]
        context, at, escape, whole = contexts(keys, count)
        self.pair_escape = np.zeros(((START + 1) << BITS, size), np.float32)
        self.pair_escape[context] = escape
        three = costs(count, at, escape, whole, two[keys & MASK[2]])
        self.three, self.three_cost, self.two_cost = Rows(keys), three.astype(np.float32), two.astype(np.float32)
        short = keys
        keys, count = levels[4]
        context, at, escape, whole = contexts(keys, count)
        self.context, self.escape = Rows(context), escape.astype(np.float32)
        self.four, self.four_cost = Rows(keys), costs(count, at, escape, whole, three[np.searchsorted(short, keys & MASK[3])]).astype(np.float32)

    def _rare(self, key: np.ndarray) -> np.ndarray:
        """Costs of strings of four bytes that no language has seen."""
        short = key & MASK[3]
        row, context = self.three.find(short), self.context.find(key >> BITS)
        out = self.pair_escape[short >> BITS] + self.two_cost[short & MASK[2]]
        out[row >= 0] = self.three_cost[row[row >= 0]]
        out[context >= 0] += self.escape[context[context >= 0]]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        sums = np.zeros((len(offsets) - 1, len(self.names)))
        for row, key in pieces(data, offsets):
            at = self.four.find(key)
            new = np.flatnonzero(at < 0)
            each = self.four_cost[at] if len(self.four_cost) else np.zeros((len(key), len(self.names)), np.float32)
            each[new] = self._rare(key[new])
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sums[row[begins]] += np.add.reduceat(each, begins, axis=0, dtype=np.float64)
        return sums


_built: dict[int, Trees] = {}


def _predict(shared):
    @tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _built:
            _built.clear()
            _built[shared.id] = Trees(*shared.value) if shared.value[0] else None
        trees = _built[shared.id]
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            n = len(offsets) - 1
            best, score = np.full(n, -1), np.zeros(n)
            for a, b in chunks(offsets) if trees else ():
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                bits = trees.bits(part, at)
                raw = part.tobytes()
                letters = np.array([has_letter(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
                best[a:b] = np.where(letters, bits.argmin(1), -1)
                worse = np.minimum(bits - bits.min(1, keepdims=True), 1000)
                score[a:b] = np.where(letters, 1 / np.exp2(-worse).sum(1), 0.0)
            names = [*(trees.names if trees else []), "und"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([names[i] for i in best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_costs: int = MOST_COSTS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, and counted strings of the sampled training documents: the string, its language, and how often."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    none = np.zeros(0, np.int64)
    if not names:
        return [], none, none, none
    share = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(min(1.0, per_language / counts[s])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    found = sample.mapInArrow(_count_grams(names), "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    found = materialise(found)
    kinds = found.select("gram").distinct().count()
    if kinds * len(names) > most_costs:
        raise ValueError(f"{kinds} strings of four bytes in {len(names)} languages: lower per_language, or raise most_costs with the executors' memory")
    table = found.toArrow()
    gram, lang, n = (table[c].to_numpy() for c in ("gram", "lang", "n"))
    order = np.lexsort((lang, gram))
    return names, gram[order], lang[order], n[order]


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, most_costs: int = MOST_COSTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_language, most_costs))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(_predict(_Shared(shared)), "doc_id long, held_out boolean, lang_pred string, score double")


class _Shared:
    """A broadcast with a stable number, by which a worker keeps what it built from it."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value
