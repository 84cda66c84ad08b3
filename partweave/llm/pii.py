"""Personal information in free text: found, told apart by kind, and replaced (problem 9).

Method: weak supervision.  Patterns, gazetteers and general context labelers vote on candidate places.  No place is
labelled by hand: expectation-maximisation over the counts of the vote patterns estimates for each labeler how often it
is right, and so a probability for each pattern.  With these as soft labels a span classifier (logistic regression over
hashed features of the span and its surroundings) is trained, surer labels weighing more; so it learns from the places
that the labelers are sure of in what company people and their numbers stand, and it decides every candidate of every
text.  Which words are ordinary, and so hardly names, is learned from how the corpus writes them.

Counts cover all documents.  Three bounded things come to the driver: the counts of the vote patterns (at most 3 to the
number of labelers a kind, in practice some hundreds), the table of word case (CASE_BUCKETS counts) and the training
sample (TRAIN_ROWS a kind).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.llm.makers import Makers
from partweave.llm.piispans import CASE_BUCKETS, DIMENSIONS, KINDS, Labelers, cased_words, word_bucket, words_after_articles
from partweave.session import Workspace, spread

#: Candidates of each kind on which the classifier is fitted: those first in a hash order of their places.
TRAIN_ROWS = 40_000
#: Passes over the sample, and the probability from which a candidate is taken.
EPOCHS, THRESHOLD, BATCH = 16, 0.5, 64
#: Least weight (log odds) of a vote.
WEAKEST = 0.4
_CANDIDATES = "array<struct<kind:int,start:int,stop:int,votes:string,features:array<int>>>"


def word_case(documents: DataFrame, text_col: str) -> tuple[bytes, bytes]:
    """For each bucket of words how often, of 255, the texts write them in lower case, and how often their capitalised
    uses follow an article, over all texts.  Words in capitals say nothing.  Tables of fixed size, added up before the
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            after: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(cased_words(text))
                after.update(words_after_articles(text))
            lower, title, thing = Counter(), Counter(), Counter()
            for w, n in after.items():
                thing[word_bucket(w.lower())] += n
            for w, n in seen.items():
                if w.islower():
                    lower[word_bucket(w)] += n
                elif w[0].isupper() and not w.isupper():
                    title[word_bucket(w.lower())] += n
            buckets = sorted(lower.keys() | title.keys() | thing.keys())
            counts = [pa.array([c[b] for b in buckets], pa.int64()) for c in (lower, title, thing)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *counts], names=["bucket", "low", "title", "thing"])

    parts = spread(documents.select(text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, "bucket int, low bigint, title bigint, thing bigint")
    of = lambda a, b: F.coalesce(F.least(F.round(F.try_divide(255.0 * F.sum(a), b)), F.lit(255)).cast("int"), F.lit(0))
    shares = parts.groupBy("bucket").agg(of("low", F.sum("low") + F.sum("title")).alias("low"), of("thing", F.sum("title")).alias("thing"))
    rows = shares.filter("low > 0 or thing > 0").toArrow()  # at most CASE_BUCKETS rows
    tables = []
    for name in ("low", "thing"):
        table = np.zeros(CASE_BUCKETS, dtype=np.uint8)
        table[rows.column("bucket").to_numpy()] = rows.column(name).to_numpy().astype(np.uint8)
        tables.append(table.tobytes())
    return tables[0], tables[1]


def find_candidates(documents: DataFrame, id_col: str, text_col: str, given: list[str], family: list[str], makers: Makers, case: tuple[bytes | None, bytes | None] = (None, None)) -> DataFrame:
    """(id_col, candidates): one row for each text that has any candidate."""
    kind = dict(documents.dtypes)[id_col]
    shape = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
    )

    shared = documents.sparkSession.sparkContext.broadcast((given, family, makers.names, *case))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelers = Labelers(*shared.value)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and (own := labelers.candidates(text)):
                    rows.append(i)
                    out.append([{"kind": c.kind, "start": c.start, "stop": c.end, "votes": c.votes, "features": c.features} for c in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out, shape)], names=[id_col, "candidates"])

    return spread(documents.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"`{id_col}` {kind}, candidates {_CANDIDATES}")


def label_model(counts: dict[str, int], rounds: int = 80) -> dict[str, float]:
    """Probability that a candidate with each vote pattern is real, by expectation-maximisation.

    A labeler votes for, against or not at all, with its own rates for real and other candidates; votes are taken as
    independent given the truth.  As usual in weak supervision a labeler that does not vote weighs nothing and one
    that votes is taken to be better than chance, which keeps the two classes from changing places or from splitting
    candidates that are all real.  Counts are smoothed."""
    if not counts:
        return {}
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    votes = np.array([["0-+".index(c) for c in p] for p in patterns])
    width = votes.shape[1]
    sums = (votes == 2).sum(axis=1) - 1.0 * (votes == 1).sum(axis=1)
    post = 1 / (1 + np.exp(-3.0 * (sums - 0.5)))
    for _ in range(rounds):
        share = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
        odds = np.full(len(patterns), np.log(share / (1 - share)))
        for k in range(width):
            real = np.bincount(votes[:, k], n * post, minlength=3) + [1.0, 0.2, 2.0]
            other = np.bincount(votes[:, k], n * (1 - post), minlength=3) + [1.0, 2.0, 0.2]
            weight = np.log(real / real.sum()) - np.log(other / other.sum())
            odds += np.array([0.0, np.clip(weight[1], -8.0, -WEAKEST), np.clip(weight[2], WEAKEST, 8.0)])[votes[:, k]]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, post.tolist()))


def train_classifier(features: list[list[int]], labels: np.ndarray, sure: np.ndarray | None = None, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression over hashed features (KINDS * DIMENSIONS of them), fitted to soft labels by
    Adagrad in small batches of a fixed order; ``sure`` is the weight of each row."""
    size = len(KINDS) * DIMENSIONS
    weights, squares = np.zeros(size + 1), np.full(size + 1, 1e-2)  # the last place stands for no feature
    if not len(labels):
        return weights[:size]
    rows = np.full((len(features), max(map(len, features))), size, dtype=np.int64)
    for i, f in enumerate(features):
        rows[i, : len(f)] = f
    sure = np.ones(len(labels)) if sure is None else sure
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            f = rows[pick]
            p = 1 / (1 + np.exp(-np.clip(weights[f].sum(axis=1), -30, 30)))
            used, where = np.unique(f, return_inverse=True)
            g = np.bincount(where.ravel(), np.repeat((p - labels[pick]) * sure[pick], f.shape[1]), len(used)) + 1e-4 * weights[used]
            squares[used] += g * g
            weights[used] -= 0.25 * g / np.sqrt(squares[used])
            weights[size] = 0.0
    return weights[:size]


def find_pii(documents: DataFrame, names: DataFrame, makers: Makers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pii_kind, start_char, end_char): every place of personal information, each once; characters are code
    points.  Null, empty and blank texts have none.  A document given twice has its places once."""
    listed = names.select(F.lower(F.trim("name_text")).alias("word"), "name_kind").filter("word <> ''").distinct().collect()
    given, family = ([r["word"] for r in listed if r["name_kind"] == kind] for kind in ("given", "family"))
    ws = Workspace(documents.sparkSession, "pii")
    spans = ws.save(find_candidates(documents, id_col, text_col, given, family, makers, word_case(documents, text_col)), "candidates")
    flat = spans.select(id_col, F.explode("candidates").alias("c")).select(id_col, "c.*")
    counted: dict[int, dict[str, int]] = {k: {} for k in range(len(KINDS))}
    for r in flat.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        counted[r["kind"]][r["votes"]] = r["n"]
    models = [label_model(counted[k]) for k in range(len(KINDS))]
    order = Window.partitionBy("kind").orderBy(F.xxhash64(id_col, "start", "stop"), id_col, "start", "stop")
    sample = flat.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= TRAIN_ROWS).select("kind", "votes", "features").collect()
    sample.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    labels = np.array([models[r["kind"]][r["votes"]] for r in sample])
    told = np.array([r["votes"].strip("0") != "" for r in sample], dtype=float)  # of which no labeler says anything teach nothing
    weights = train_classifier([r["features"] for r in sample], labels, told * np.abs(2 * labels - 1)).astype(np.float32)
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # fixed size: DIMENSIONS floats a kind
    kind = dict(documents.dtypes)[id_col]
    least = np.log(THRESHOLD / (1 - THRESHOLD))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            own = lists.flatten()
            features = own.field("features")
            ends = np.append(features.offsets.to_numpy(), 0)[: len(own) + 1] - features.offsets[0].as_py() if len(own) else np.zeros(1, np.int64)
            rows, kinds, starts, stops = [], [], [], []
            if len(own):
                z = np.add.reduceat(shared.value[features.flatten().to_numpy()], ends[:-1])  # every candidate has a feature
                where, start, stop = (own.field(c).to_numpy() for c in ("kind", "start", "stop"))
                of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                taken: dict[int, list[tuple[float, int, int, int]]] = {}
                for i in np.flatnonzero(z >= least).tolist():
                    taken.setdefault(int(of[i]), []).append((float(z[i]), int(where[i]), int(start[i]), int(stop[i])))
                for i, scored in taken.items():
                    for k, a, b in settle(scored):
                        rows.append(i)
                        kinds.append(KINDS[k])
                        starts.append(a)
                        stops.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())],
                names=[id_col, "pii_kind", "start_char", "end_char"],
            )

    found = spans.mapInArrow(decide, f"`{id_col}` {kind}, pii_kind string, start_char int, end_char int")
    return found.distinct()


def settle(scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places that overlap, the one that scores best; of equals the longer, then the earlier.  An address or an
    e-mail address outweighs a name inside it."""
    taken: list[tuple[int, int, int]] = []
    rank = {0: 0, 2: 1, 1: 2, 3: 3, 4: 4}
    for z, k, a, b in sorted(scored, key=lambda c: (rank[c[1]], -c[0], c[2] - c[3], c[2])):
        if all(b <= c or d <= a for _, c, d in taken):
            taken.append((k, a, b))
    return sorted(taken, key=lambda c: c[1])


def redact(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): each text with typed placeholders such as [EMAIL] in place of what was found; the rest is
    kept to the letter.  Null texts stay null."""
    places = found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "pii_kind"))).alias("_places"))
    joined = documents.select(id_col, F.col(text_col).alias("_text")).join(places, id_col, "left")
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and own:
                    pieces, at = [], 0
                    for p in own:
                        pieces += [text[at : p["start_char"]], f"[{p['pii_kind'].upper()}]"]
                        at = p["end_char"]
                    text = "".join([*pieces, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return joined.select(id_col, "_text", "_places").mapInArrow(run, f"`{id_col}` {kind}, text string")
