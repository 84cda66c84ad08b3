"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Method: two-tier lookup.  A text is split by the vocabulary's pattern.  Most pieces are in the vocabulary as a whole;
a minimal perfect hash finds them, checked against the vocabulary's own bytes.  The others are merged pair by pair,
lowest rank first, with a heap over a linked list of their bytes, in n log n steps even for one endless piece.

The perfect hash (about 1 MB) is built once on the driver and broadcast; its size is that of the vocabulary,
whatever the corpus.  Each row is encoded where it lies: there is no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from partweave.session import spread

#: Where the vocabulary files are; a parameter of encode_documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; when there are more it starts anew.  Bounds memory, changes no result.
REMEMBERED = 200_000


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Rank of each token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _digests(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash of a set of byte strings: n keys take the slots 0..n-1, each one slot.

    Hash and displace: keys fall into buckets; for each bucket, largest first, a displacement is sought that sends
    its keys to free slots; a bucket of one key names its slot outright.  Strings that are not keys get some slot,
    so a lookup compares the key stored there."""

    def __init__(self, values: dict[bytes, int]):
        keys = list(values)
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        h = _digests(keys)
        first = (h[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        by_bucket: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(first.tolist()):
            by_bucket[b].append(i)
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        slot_of = np.zeros(n, dtype=np.int64)
        order = sorted(range(self.buckets), key=lambda b: -len(by_bucket[b]))
        free: list[int] | None = None
        for b in order:
            members = by_bucket[b]
            if not members:
                break
            if len(members) == 1:
                if free is None:
                    free = np.flatnonzero(~taken).tolist()
                slot = free.pop()
                taken[slot] = True
                self.displace[b] = -slot - 1
                slot_of[members[0]] = slot
                continue
            own, k, d = h[members], len(members), 1
            while True:  # a block of displacements at a time
                block = np.arange(d, d + 32)
                tried = self._slots(own[None, :, :], block[:, None])
                ok = ~taken[tried].any(axis=1)
                for i in np.flatnonzero(ok).tolist():
                    if len(set(tried[i].tolist())) == k:
                        break
                else:
                    d += 32
                    continue
                d, slots = d + i, tried[i]
                break
            taken[slots] = True
            self.displace[b] = d
            slot_of[members] = slots
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, dtype=np.int64)
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s], self.values[s] = keys[i], values[keys[i]]

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        a, b = h[..., 0], h[..., 1]
        mixed = (b ^ (a >> np.uint64(7))) + np.asarray(d).astype(np.uint64) * (b | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each string, whether or not it is a key."""
        h = _digests(keys)
        d = self.displace[(h[:, 0] % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._slots(h, np.maximum(d, 0)))

    def find(self, keys: list[bytes]) -> list[int]:
        """The value of each string, -1 for strings that are not keys."""
        if not keys or not self.n:
            return [-1] * len(keys)
        own, values = self.keys, self.values
        return [int(values[s]) if own[s] == k else -1 for k, s in zip(keys, self.slots(keys).tolist())]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: adjacent parts are joined while the vocabulary has the join, lowest rank first, leftmost
    of equals; parts are linked by their neighbours and joins wait in a heap."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is joined to an earlier one
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts is no longer what it was
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes lists of texts; made once in each worker from the broadcast hash."""

    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.table = table
        self.split = regex.compile(pattern).findall
        self.ranks = dict(zip(table.keys, table.values.tolist()))
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        fresh = list({p for own in pieces for p in own if p not in known})
        spelled = [p.encode("utf-8", "surrogatepass") for p in fresh]
        for p, spelling, value in zip(fresh, spelled, self.table.find(spelled)):
            known[p] = [value] if value >= 0 else merge_bytes(spelling, self.ranks)
        return [[i for p in own for i in known[p]] for own in pieces]


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids): the token ids of each row's text, without special tokens.

    An empty or null text has an empty list.  Spellings of special tokens are ordinary text.  Every row gives one
    row, in any order; whole texts are encoded, however long.  ``path`` is the vocabulary file, read on the driver.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(PerfectHash(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = dict(documents.dtypes)[id_col]
    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
