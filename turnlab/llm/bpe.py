"""Byte-level BPE encoding and decoding from a rank file.

Each match of the splitting pattern is merged on its own. A segment tree over its byte positions keeps, for every
range, the leftmost position whose pair has the least rank; a merge changes the pairs at two live neighbours, which
are two logarithmic point updates. A match of n bytes thus costs O(n log n), also where a text is one long match.
"""

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from turnlab.llm.common import with_columns

# White_Space as Unicode has it (Python's own \s also takes the separators U+001C to U+001F)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NONE = 1 << 62


class SegmentTree:
    """Leftmost minimum of the pair ranks over positions: a node holds rank and position in one number."""

    def __init__(self, ranks, shift):
        n = len(ranks)
        self.size = size = 1 << (n - 1).bit_length()
        self.nodes = nodes = [_NONE] * size + [r << shift | i for i, r in enumerate(ranks)] + [_NONE] * (size - n)
        for i in range(size - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right

    def put(self, position, value):
        """Point update: the nodes above it, as far as they change."""
        nodes, i = self.nodes, position + self.size
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if nodes[i] == value:
                return
            nodes[i] = value


def merge_bytes(piece, ranks, pairs):
    """Ids of the bytes ``piece`` after all merges, lowest rank first and leftmost among equals.

    ``pairs`` holds the ranks of pairs of bytes, a << 8 | b.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    shift, get = n.bit_length(), ranks.get
    mask = (1 << shift) - 1
    end = list(range(1, n + 1))     # where the live part that begins at i ends
    before = list(range(-1, n - 1))  # where the live part before it begins
    tree = SegmentTree([pairs[a << 8 | b] for a, b in zip(piece, piece[1:])], shift)
    nodes, put = tree.nodes, tree.put
    while nodes[1] < _NONE:
        i = nodes[1] & mask
        gone = end[i]
        end[i] = stop = end[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if stop < n:
            before[stop] = i
            rank = get(piece[i:end[stop]])
            put(i, _NONE if rank is None else rank << shift | i)
        else:
            put(i, _NONE)
        j = before[i]
        if j >= 0:
            rank = get(piece[j:stop])
            put(j, _NONE if rank is None else rank << shift | j)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return tuple(ids)


class Codec:
    """Encoder and decoder of one rank file.

    Text is first cut where white space follows other characters; no match crosses such a place. Encoded pieces
    are kept in two tables of bounded size (the older one is dropped when the newer is full), so a frequent word is
    merged once per worker.
    """

    KEPT, LONGEST, GROUP = 400_000, 48, 1 << 20

    def __init__(self, path, pattern, kept=KEPT):
        self.kept = kept
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for part, i in self.ranks.items():
            self.parts[i] = part
        self.pairs = [self.ranks.get(bytes(divmod(i, 256)), _NONE) for i in range(1 << 16)]
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
                                   .replace(r"\s", f"[{SPACE}]"))
        self.pieces = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.known, self.older = {}, {}

    def match(self, text):
        """Ids of one match of the pattern, as little-endian 32-bit numbers."""
        found = self.known.get(text) or self.older.get(text)
        if not found:
            ids = merge_bytes(text.encode(), self.ranks, self.pairs)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(text) <= self.LONGEST:
            self.known[text] = found
        return found

    def packed_many(self, texts):
        """Ids of some texts, each as little-endian 32-bit numbers."""
        if len(self.known) >= self.kept:
            self.known, self.older = {}, self.known
        known, older, split, match = self.known, self.older, self.split.findall, self.match
        pieces = [self.pieces.findall(t) for t in texts]
        new = set().union(*pieces).difference(known)
        for piece in new:
            known[piece] = older.get(piece) or b"".join(map(match, split(piece)))
        find = known.__getitem__
        out = [b"".join(map(find, p)) for p in pieces]
        for piece in new:
            if len(piece) > self.LONGEST:
                del known[piece]
        return out

    def packed(self, text):
        return self.packed_many([text])[0]

    def encode(self, text):
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids):
        """Bytes of a list of ids; an id outside the vocabulary raises IndexError."""
        return b"".join(map(self.parts.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path, pattern, kept=Codec.KEPT):
    return Codec(path, pattern, kept)


def encode(docs, path, pattern, text="text", ids="ids"):
    """``docs`` with the column ``ids`` (array of int): the ids of each whole text.

    A null or empty text has no ids. Repeated rows each get theirs, an empty table stays empty and a column
    named as ``ids`` is replaced. ``path`` must be readable on every machine; only names travel with a task.
    """
    def run(texts):
        return [_as_lists(_packed(codec(path, pattern), texts))]
    return with_columns(docs, [text], run, f"`{ids}` array<int>")


def _packed(coder, texts):
    """Ids of texts as bytes, a bounded group of texts at a time."""
    packed, part, size = [], [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size > coder.GROUP or i == len(texts) - 1:
            packed += coder.packed_many(part)
            part, size = [], 0
    return packed


def _as_lists(packed):
    ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _decoded(coder, lists):
    offsets, values = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
    return [b"" if x else coder.decode(values[a:b].tolist())
            for x, a, b in zip(lists.is_null().to_pylist(), offsets, offsets[1:])]


def decode(rows, path, pattern, ids="ids", decoded="decoded"):
    """``rows`` with the column ``decoded`` (binary): the bytes of their ids. Null or no ids give no bytes."""
    return with_columns(rows, [ids], lambda lists: [_decoded(codec(path, pattern), lists)], f"`{decoded}` binary", raw=True)


def round_trip(docs, path, pattern, text="text", ids="ids", decoded="decoded", kept=Codec.KEPT):
    """``docs`` with both columns of ``encode`` and ``decode``, in one pass over the texts.

    ``kept`` bounds the pieces that a worker remembers: fewer take less memory and more time.
    """
    def run(texts):
        coder = codec(path, pattern, kept)
        lists = _as_lists(_packed(coder, texts))
        return [lists, _decoded(coder, lists)]
    return with_columns(docs, [text], run, f"`{ids}` array<int>, `{decoded}` binary")


def digest(rows):
    """The contract's columns of rows with ids and decoded bytes."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
