"""Byte-level BPE by a monoid tree.

Encodings are joined, not only made: an element of the monoid is the encoding of a stretch, and the product of two
neighbours re-encodes a window around their border, which grows until what lies outside it can no longer change.
There are two such trees, and a third for decoding.

* *Tokens of a match* (``TokenTree``). A match longer than ``leaf`` bytes is cut into leaves, which are encoded and joined pair by pair up the tree.
  A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs: the first merge that
  crossed a border would be the smallest among those two tokens' pairs as well, and would happen there. So a window is wide enough once its first and last
  token are those of the halves, and a megabyte without a space costs its windows, not its square.
* *Matches of a text* (``MatchTree``). A text longer than ``leaf`` characters is cut anywhere and joined in the same way. A match is settled when ``reach`` characters
  follow it in its stretch, for the pattern looks no further; the last ones of the left stretch are matched anew with the first ones of the right stretch
  until a match ends where one of the right stretch's begins.
* *Bytes of ids* (``decode``). Blocks of ids are looked up and concatenated up the tree.

A whole match that is in the vocabulary is its own token, as in the library whose ids these are. Each distinct match is encoded once per
worker; the table is keyed by its text and starts anew at ``MOST_MATCHES`` entries.

Rows stay in their partition: there is no shuffle, and a task that is run again gives the same ids.

Cases: a null text is empty and has no ids; repeated rows are encoded one by one; a null doc_id passes through; a text of any length is read whole.
Other columns are ignored. An empty table gives an empty table. Ids that the vocabulary lacks are an error; a null list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Bytes of a match, characters of a text and ids of a list of a leaf.
LEAF_BYTES, LEAF_CHARS, LEAF_IDS = 16, 4096, 65_536
#: Bytes up to which merges look through all pairs instead of keeping a queue.
SHORT = 64
#: Characters behind a match that the pattern may look at: "'l" is one match before "l" and none before another letter.
REACH = 2
#: Entries of a worker's table of matches, after which it starts anew.
MOST_MATCHES = 1_000_000
#: Texts of about so many bytes are encoded before their rows are given out.
OUT_BYTES = 1 << 23


def folded(items: list, join: Callable):
    """The product of items in order, neighbours first: a balanced tree."""
    while len(items) > 1:
        items = [join(*items[i : i + 2]) if i + 1 < len(items) else items[i] for i in range(0, len(items), 2)]
    return items[0]


class TokenTree:
    """Encoder of single matches by the ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, max(1, leaf)
        self.none = max(ranks.values(), default=0) + 1  # stands for the rank of no token
        self.packed = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.merged = 0  # bytes that merges have read so far

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of data: the pair of smallest rank merges first, the leftmost of equals."""
        self.merged += len(data)
        return self._merge_short(data) if len(data) <= SHORT else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[bytes]:
        rank, none = self.ranks.get, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same with a queue of pairs."""
        n, ranks = len(data), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, end = heapq.heappop(queue)
            middle = ends[i]
            if not i < middle < end or ends[middle] != end:  # one of the two has merged already
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(queue, (r, i, ends[end]))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left:end])) is not None:
                heapq.heappush(queue, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(data[at : ends[at]])
            at = ends[at]
        return out

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two encodings' bytes together."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(left[-i:] + right[:j]))
            ready_left, ready_right = i == len(left) or window[0] == left[-i], j == len(right) or window[-1] == right[j - 1]
            if ready_left and ready_right:
                return left[:-i] + window + right[j:]
            i, j = i if ready_left else 2 * i, j if ready_right else 2 * j

    def tokens(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf:
            return self.merge(data)
        return folded([self.merge(data[a : a + self.leaf]) for a in range(0, len(data), self.leaf)], self.join)

    def ids(self, match: str) -> bytes:
        data = match.encode()
        return self.packed.get(data) or b"".join([self.packed[t] for t in self.tokens(data)])


class MatchTree:
    """All matches of a pattern that leaves no character out, over texts of any length."""

    def __init__(self, pattern: str, reach: int = REACH, leaf: int = LEAF_CHARS):
        import regex

        self.find, self.reach, self.leaf = regex.compile(pattern).findall, reach, max(1, leaf)

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two stretches' text together."""
        keep, open_chars = len(left), 0
        while keep and open_chars < self.reach:
            keep -= 1
            open_chars += len(left[keep])
        tail, k = "".join(left[keep:]), 1
        while True:
            k = min(k, len(right))
            window = tail + "".join(right[:k])
            begins = dict(zip(accumulate(map(len, right[:k]), initial=len(tail)), range(k + 1), strict=True))  # how many of right's matches are before each border
            found, end = [], 0
            for m in self.find(window):
                found.append(m)
                end += len(m)
                if end in begins and (end + self.reach <= len(window) or k == len(right)):
                    return left[:keep] + found + right[begins[end] :]
            k *= 2

    def matches(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.find(text)
        return folded([self.find(text[a : a + self.leaf]) for a in range(0, len(text), self.leaf)], self.join)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _trees(path: str, pattern: str, reach: int) -> tuple[TokenTree, MatchTree, dict]:
    return TokenTree(_ranks(path)), MatchTree(pattern, reach), {}


def _ids(text: str, trees) -> bytes:
    tokens, matches, known = trees
    if len(known) > MOST_MATCHES:
        known.clear()
    found = matches.matches(text)
    for m in set(found):
        if m not in known:
            known[m] = tokens.ids(m)
    return b"".join(map(known.__getitem__, found))


def _flushed(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, bytes) rows, of about OUT_BYTES."""
    out, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names)

    for row in rows:
        out.append(row)
        size += len(row[1])
        if size > OUT_BYTES:
            yield batch()
            out, size = [], 0
    yield batch()


def encoded(docs: DataFrame, path: str, pattern: str, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: ids are little-endian unsigned 32-bit integers, end to end.

    path is that of a rank file (base64 of a byte string, rank), pattern finds the matches that are encoded one by one, reach is what it may look at behind a match.
    """

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(path, pattern, reach)
        yield from _flushed(((i.as_py(), _ids(t.as_py(), trees)) for b in batches for i, t in zip(b["doc_id"], b["text"], strict=True)), ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


@functools.cache
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and the border of each id's; an id without a token has the length -1."""
    ranks = _ranks(path)
    by_id = {i: t for t, i in ranks.items()}
    size = np.array([len(by_id[i]) if i in by_id else -1 for i in range(max(by_id, default=-1) + 1)], np.int64)
    return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), size


def _block(ids: np.ndarray, data: np.ndarray, size: np.ndarray, start: np.ndarray) -> bytes:
    if len(ids) and (ids.max() >= len(size) or size[ids].min() < 0):
        raise ValueError("an id is not in the vocabulary")
    n = size[ids]
    end = np.cumsum(n)
    return data[np.arange(end[-1] if len(end) else 0) + np.repeat(start[ids] - end + n, n)].tobytes()


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data, ids): the bytes of each row's ids; they are UTF-8 if the ids are those of a whole text."""

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, size = _bytes_of(path)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        for batch in batches:
            out = []
            for x in batch["ids"]:
                ids = np.frombuffer(x.as_py() or b"", "<u4")
                out.append(folded([_block(ids[a : a + LEAF_IDS], data, size, start) for a in range(0, max(1, len(ids)), LEAF_IDS)], bytes.__add__))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary()), batch["ids"]], ["doc_id", "data", "ids"])

    return tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(decode, "doc_id long, data binary, ids binary")


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids."""
    both = decoded(encoded(docs, path, pattern), path)
    return both.select("doc_id", F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
