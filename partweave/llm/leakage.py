"""Evaluation passages that stand in training documents (problem 8).

Method: winnowing.  Documents and test items are cut into words; every run of K words is hashed and in every window
of W consecutive hashes the least one is kept as a fingerprint.  Any run of K + W - 1 words that two texts share
gives them a common fingerprint, so joining the fingerprints misses none.  A passage of 20 words with two edits still
holds a run of 6 = K + W - 1 unedited words (18 words in at most three runs), and longer passages with one edit in
ten hold longer ones.  Each joined pair is then extended: an alignment around the shared fingerprints tells exactly
whether a passage within the allowed edits exists.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.skew import split_join
from partweave.session import Workspace, spread

K, W = 5, 2
#: A passage: at least so many consecutive words of the item, and one edit for so many of its words.
LEAST_WORDS, WORDS_PER_EDIT = 20, 10
#: Fingerprints of the items are broadcast up to this many rows (16 bytes each and the item's id); beyond, both
#: sides are shuffled by fingerprint.
BROADCAST_ROWS = 1_000_000
#: An opening sentence is an instruction if so many items with different remainders begin with it.
SHARED_BY = 2

_DROPPED = re.compile("['’‘ʼ`´­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text, without case, punctuation, spacing and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_DROPPED.sub("", text).casefold())


class _Hasher:
    """64-bit hashes of words, remembered within a worker up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, own: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known = {}
        known = self.known
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in own], dtype=np.uint64)


def fingerprints(hashes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the winnowed k-gram hashes of a text given by its word hashes.  A text with fewer than
    k words has none; with fewer than w k-grams it has its least."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(27)
    w = min(w, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)
    last_least = w - 1 - np.argmin(windows[:, ::-1], axis=1)
    places = np.unique(np.arange(len(windows)) + last_least)
    return places, grams[places]


def fingerprint_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, place, print): the fingerprints of each row's whole text."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            rows, places, prints = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    p, v = fingerprints(hasher(words(text)))
                    rows.append(np.full(len(p), i, dtype=np.int64))
                    places.append(p)
                    prints.append(v)
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(prints).view(np.int64))],
                    names=[id_col, "place", "print"],
                )

    return spread(texts.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"`{id_col}` {kind}, place int, print bigint")


def without_instructions(items: DataFrame, ws: Workspace) -> DataFrame:
    """(item_id, body): the items' texts without the opening sentences that several items share.  Sentences are
    compared without case, punctuation and spacing; items with one and the same text do not make theirs shared."""
    rest = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("body"))
    step = 0
    while True:
        cut = rest.select(
            "item_id",
            "body",
            F.trim(F.regexp_extract("body", r"(?s)^\s*[^.!?]*[.!?]+[\"')\]]*(.*)$", 1)).alias("after"),
            F.lower(F.regexp_replace(F.regexp_extract("body", r"(?s)^\s*([^.!?]*)[.!?]", 1), r"[^\p{L}\p{N}]+", " ")).alias("opening"),
        )
        shared = (
            cut.filter("opening <> '' and after <> ''").groupBy("opening").agg(F.countDistinct("after").alias("n")).filter(F.col("n") >= SHARED_BY)
        )
        marked = ws.save(cut.join(shared, "opening", "left").select("item_id", "body", "after", F.col("n").isNotNull().alias("cut")), f"items{step}")
        rest = marked.select("item_id", F.when(F.col("cut") & (F.col("after") != ""), F.col("after")).otherwise(F.col("body")).alias("body"))
        if marked.filter("cut and after <> ''").isEmpty():
            return rest
        step += 1


def has_passage(doc: np.ndarray, item: np.ndarray, least: int = LEAST_WORDS, per_edit: int = WORDS_PER_EDIT) -> bool:
    """Whether ``doc`` holds a passage of at least ``least`` consecutive words of ``item`` of which at most one in
    ``per_edit`` is changed, dropped or added.  Texts are arrays of word hashes.

    Each item word of a passage earns 1, each edit costs ``per_edit``; a passage within the limit has a sum of 0 or
    more.  ``best[j, n]`` is the greatest sum of a passage that ends before document word j and has n item words
    (n = least stands for that many or more).  The row of each item word follows from that of the word before."""
    n, m = len(doc), len(item)
    if m < least or n == 0:
        return False
    # necessary: a stretch of the item's words of which at most one in per_edit stands nowhere in the document
    total = np.concatenate([[0], np.cumsum(np.where(np.isin(item, doc), 1, 1 - per_edit))])
    if (total[least:] - np.minimum.accumulate(total)[: m - least + 1]).max() < 0:
        return False
    low = -(10**6)
    best = np.full((n + 1, least + 1), low, dtype=np.int32)
    best[:, 0] = 0
    ramp = (np.arange(n + 1, dtype=np.int32) * per_edit)[:, None]
    for w in item:
        step = best + np.int32(1 - per_edit)  # dropped
        met = np.where(doc == w, 1, 1 - per_edit).astype(np.int32)[:, None]
        np.maximum(step[1:], best[:-1] + met, out=step[1:])  # kept or changed
        new = np.full_like(best, low)
        new[:, 1:] = step[:, :-1]
        np.maximum(new[:, least], step[:, least], out=new[:, least])
        new = np.maximum.accumulate(new + ramp, axis=0) - ramp  # added words
        new[:, 0] = 0
        if (new[:, least] >= 0).any():
            return True
        best = new
    return False


#: Hits that every passage has at least.  Its unedited words (9 in 10, so 18 of the first 20) lie in runs parted by the
#: edits, and a run of r words has a fingerprint in each of its (r - K + 1) // W separate windows: for 18 words in
#: three runs that is 2 at the worst (5, 5 and 8 words), and more for longer or less edited passages.
LEAST_HITS = 2
#: Starts that hits tell are kept as the least and greatest of a stretch of so many words, no more than two starts may lie
#: apart and still tell of one passage; so a pair keeps no list of all its hits.
NEAR = LEAST_WORDS // WORDS_PER_EDIT + 2


def _windows(starts: list[int], n: int, m: int) -> list[tuple[int, int]]:
    """Stretches of a document of n words that hold every passage of an item of m words found through hits: a hit
    says that the item would begin at word ``start``.  Edits shift it by at most one in ten of the item's words, so
    the hits of one passage say nearly the same; where fewer than LEAST_HITS do, there is none.  Overlapping
    stretches are joined, and long ones cut with an overlap as long as the longest passage."""
    slack = m // WORDS_PER_EDIT + 2
    out: list[list[int]] = []
    ordered = sorted(starts)
    for i, s in enumerate(ordered):
        if not any(0 <= j < len(ordered) and abs(ordered[j] - s) <= slack for j in (i - 1, i + 1)):
            continue
        a, b = max(0, s - slack), min(n, s + m + slack)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    longest = m + 2 * slack
    cut = []
    for a, b in out:
        while b - a > 6 * longest:
            cut.append((a, a + 4 * longest))
            a += 3 * longest
        cut.append((a, b))
    return cut


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_id): each document and the items of which it holds a passage.

    ``items`` has item_id and text.  Null and empty texts leak nothing, and an item with fewer than LEAST_WORDS words
    after its instruction has no passage.  Documents that repeat one another each get their rows; a document given
    twice gets them once.  Other columns are ignored."""
    ws = Workspace(documents.sparkSession, "leakage")
    bodies = ws.save(without_instructions(items, ws), "bodies")
    item_prints = ws.save(fingerprint_rows(bodies, "item_id", "body").select("item_id", F.col("place").alias("at"), "print"), "item_prints")
    prints = fingerprint_rows(documents, id_col, text_col)
    if item_prints.count() <= BROADCAST_ROWS:
        hits = prints.join(F.broadcast(item_prints), "print")
    else:
        hits = split_join(ws.save(prints, "prints"), item_prints, ["print"], id_col, "item_id")
    start = F.col("place") - F.col("at")
    near = hits.groupBy(id_col, "item_id", F.floor(start / NEAR).alias("bucket")).agg(F.min(start).alias("lo"), F.max(start).alias("hi"), F.count("*").alias("n"))
    starts = F.flatten(F.collect_list(F.when(F.col("n") > 1, F.array("lo", "hi")).otherwise(F.array("lo"))))
    pairs = ws.save(near.groupBy(id_col, "item_id").agg(starts.alias("starts")).filter(F.size("starts") >= LEAST_HITS).join(bodies, "item_id").select(id_col, "item_id", "starts", "body"), "pairs")
    kind = dict(documents.dtypes)[id_col]
    texts = documents.select(id_col, F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    held = pairs.groupBy(id_col).agg(F.collect_list(F.struct("item_id", "starts", "body")).alias("_items"))
    stretch = f"`{id_col}` {kind}, item_id string, stretch array<bigint>, item array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of each document that may hold a passage, as word hashes; the text itself goes no further."""
        hasher = _Hasher()
        for batch in batches:
            rows, names, stretches, bodies = [], [], [], []
            for i, (own, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                doc = hasher(words(text)).view(np.int64)
                for one in own:
                    item = hasher(words(one["body"])).view(np.int64)
                    for a, b in _windows(one["starts"], len(doc), len(item)):
                        rows.append(i)
                        names.append(one["item_id"])
                        stretches.append(doc[a:b])
                        bodies.append(item)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(stretches, longs), pa.array(bodies, longs)], names=[id_col, "item_id", "stretch", "item"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, (doc, item) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)))) if has_passage(doc, item)]
            chosen = pa.array(kept, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=[id_col, "item_id"])

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = held.join(texts, id_col).select(id_col, "_items", "_text").mapInArrow(cut, stretch)
    return cuts.repartition(parts, F.xxhash64(id_col, "item_id", "stretch")).mapInArrow(extend, f"`{id_col}` {kind}, item_id string").distinct()


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column as arrays."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:]))
