"""Token ids of whole text columns for byte-level BPE vocabularies.

Texts are cut into pieces as the vocabulary's pattern asks, by array operations over code-point
classes; each distinct piece is encoded once per worker and looked up by its hash afterwards. Pieces of texts
with an apostrophe (contractions) and of texts of unusual form take the encoder's own path, so ids are always those of the encoder.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import Prefix, chunks, text_arrays

#: Entries of a worker's piece table, after which it starts anew.
MOST_PIECES = 1_200_000
#: Bytes that are cut and looked up together.
LOOK_UP_BYTES = 1 << 20


@functools.cache
def _encoding(path: str):
    """A tiktoken encoding of the rank file beside the JSON vocabulary, which holds the same ids."""
    import public_tokenizers
    import tiktoken

    with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    letter, number, space = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        if point < 128 or unicodedata.category(c)[0] in "LNZC":
            table[point] = 1 if letter.match(c) else 2 if number.match(c) else 3 if space.match(c) else 0
    return table


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces start, texts' starts included. The texts have no apostrophe."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return lead
    if len(lead) == len(data):
        points = data
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = _classes()[points]
    n = len(kind)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(lead, offsets[:-1][offsets[:-1] < len(data)])] = True
    begins[n] = True
    text_start = begins[:n]
    text_end = begins[1:]
    space = kind == 3
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[text_start] = 9
    new_run = kind != before  # a run of one class begins
    # A space joins the run after it when it is the last of its white space and a plain space.
    last_space = space & ~text_end & np.append(kind[1:] != 3, True)
    joins = last_space & (points == 32)
    start = new_run.copy()
    start[1:] &= ~joins[:-1] | text_start[1:]
    # The last white space before a word is a piece of its own, or begins the word's piece.
    start |= last_space
    return lead[start]


class PieceTable:
    """Ids of known pieces by hash; unknown pieces are encoded when met."""

    def __init__(self, encoding):
        self.encoding = encoding
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        hashes = Prefix(data).hash(starts, ends)
        found = np.searchsorted(self.keys, hashes)
        known = (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] == hashes) if len(self.keys) else np.zeros(len(hashes), bool)
        if not known.all():
            if len(self.keys) > MOST_PIECES:
                self.clear()
                known[:] = False
            fresh, first = np.unique(hashes[~known], return_index=True)
            where = np.flatnonzero(~known)[first]
            raw, one = data.tobytes(), self.encoding._encode_single_piece
            new = [one(raw[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            slots = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), np.uint32, int(sizes.sum()))])
            place = np.searchsorted(self.keys, fresh)
            self.keys, self.slot = np.insert(self.keys, place, fresh), np.insert(self.slot, place, slots)
            found = np.searchsorted(self.keys, hashes)
        slot = self.slot[found]
        size = self.at[slot + 1] - self.at[slot]
        end = np.cumsum(size)
        index = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(self.at[slot], size)
        return self.ids[index], size


_tables: dict[str, PieceTable] = {}


def _encode(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    encoding = _encoding(path)
    table = _tables.setdefault(path, PieceTable(encoding))
    data, offsets = text_arrays(column)
    marks = np.concatenate([[0], np.cumsum(data == 39)])
    for a, b in chunks(offsets, LOOK_UP_BYTES):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts = pieces(part, at)
        ids, size = table.encode(part, starts, np.append(starts[1:], len(part))) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        total = np.concatenate([[0], np.cumsum(size)])
        border = total[np.searchsorted(starts, at)]
        for i in range(b - a):
            if marks[offsets[a + i + 1]] > marks[offsets[a + i]]:
                yield np.array(encoding.encode_ordinary(part[at[i] : at[i + 1]].tobytes().decode()), np.uint32)
            else:
                yield ids[border[i] : border[i + 1]]


def byte_bpe(path: str):
    """An encoder for ``packed``: path is that of a byte-level BPE vocabulary, a parameter of the caller."""
    return lambda: functools.partial(_encode, path=path)
