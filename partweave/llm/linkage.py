"""Store rows and supplier rows that are the same part, without a common key (problem 1).

Method: probabilistic record linkage.  Each row is read into part number keys, maker, kind, build, position and two
measures.  Candidate pairs come from several blocking passes within a project: equal number keys (also a number the
supplier says it replaces), equal characters of the number in another order with the same maker and kind, and equal
maker, kind and measures.  Every pair gets an agreement level for each attribute, where a silent side is a level that
weighs nothing and an equal number that parts of several makers or kinds bear is a level of its own.
Expectation-maximisation over the counts of the level patterns estimates how often matches and non-matches agree; a
pattern's posterior is the confidence of its pairs and decides.  One exact check follows: a pair in which the rows state
different things of an attribute is not the same part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.makers import Makers, read_makers
from partweave.llm.partspec import KINDS, POSITIONS, Reader, clean, kind_code, learned_noise
from partweave.operators.skew import HOT_LEAST, split_join
from partweave.session import Workspace, spread

#: Characters that look alike in keyed numbers.
ALIKE = str.maketrans("OISB", "0158")
_PREFIX = re.compile(r"^\s*(?:P/N|PN|#)[\s:]*", re.I)
_SUFFIX = re.compile(r"(?:/\d|[\s-]+(?:EA|RB|\d?PK|[AR])|(?<=\d)[AR])\s*$")
#: Confidence from which a pair is reported.
THRESHOLD = 0.5
ROUNDS = 60


def number_keys(number: str | None, code: str | None, makers: Makers) -> list[str]:
    """Spellings under which a part number may be found, the barest first: without punctuation and leading zeros,
    look-alike characters made equal, and with or without what looks like a packing suffix and like a line code before
    it.  Whether an ending or a beginning belongs to the number cannot be seen, so both readings are kept.  A spelling
    with fewer than four characters or no digit is none."""
    if not number:
        return []
    s = _PREFIX.sub("", number.upper()).strip()
    shorter = _SUFFIX.sub("", s)
    own = (code or "").strip().upper()
    found: list[str] = []
    for text in (shorter, s) if shorter != s and sum(map(str.isdigit, shorter)) >= 4 else (s,):
        key = clean(text)
        bare = key
        if own and key.startswith(own) and len(key) - len(own) >= 6:
            bare = key[len(own) :]
        elif (key[:3] in makers.store or key[:3] in makers.supplier) and len(key) >= 9:
            bare = key[3:]
        for k in (bare, key):
            k = k.translate(ALIKE).lstrip("0") if any(map(str.isdigit, k)) else ""
            if len(k) >= 4 and k not in found:
                found.append(k)
    return found


def number_key(number: str | None, code: str | None, makers: Makers) -> str | None:
    """The barest spelling of a part number, or None."""
    return next(iter(number_keys(number, code, makers)), None)


_BUILD_CODES = {(k, b): i for k, spec in KINDS.items() for i, b in enumerate(spec.builds)}
_POSITION_CODES = {p: i for i, p in enumerate(POSITIONS)}

#: Attributes that are compared, besides the number.
ATTRIBUTES = ["maker", "kind", "build", "position", "first", "second"]
_PARSED = "id string, project_id string, code string, number string, numbers array<string>, refs array<string>, " + ", ".join(f"{a} int" for a in ATTRIBUTES)
#: A line code that no mapping has is a maker's if at least so many rows name their maker, in so large a share the same.
LEARNED_ROWS, LEARNED_SHARE = 3, 0.9


def read_rows(rows: DataFrame, makers: Makers, supplier: bool, noise: list[str] = ()) -> DataFrame:
    """_PARSED of rows with id, project_id, part_number, line_code and description (and, if there, brand or
    manufacturer_name); attributes as small codes.  The maker is the one the description names, else the line code's by
    the mappings, else the brand.  A row without id or project can be in no pair and is left out."""
    codes = makers.supplier if supplier else makers.store
    maker_codes = {m: i for i, m in enumerate(makers.names)}
    brands = [F.nullif(F.lower(F.trim(c)), F.lit("")) for c in ("brand", "manufacturer_name") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(makers.names, noise)
        for batch in batches:
            lines, numbers, spellings, refs = [], [], [], []
            coded: list[list[int | None]] = [[] for _ in ATTRIBUTES]
            for number, code, text, brand in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5))):
                spec = reader.read(text)
                code = (code or "").strip().upper() or None
                keys = number_keys(number, code, makers)
                maker = spec.maker or codes.get(code) or brand
                lines.append(code)
                numbers.append(keys[0] if keys else None)
                spellings.append(keys)
                refs.append([r for x in spec.replaces if (r := x.translate(ALIKE).lstrip("0")) and r not in keys])
                coded[0].append(maker_codes.get(maker))
                coded[1].append(kind_code(spec.kind))
                coded[2].append(_BUILD_CODES.get((spec.kind, spec.build)))
                coded[3].append(_POSITION_CODES.get(spec.position))
                coded[4].append(spec.first)
                coded[5].append(spec.second)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lines, pa.string()), pa.array(numbers, pa.string()), pa.array(spellings, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.string()))]
                + [pa.array(c, pa.int32()) for c in coded],
                names=["id", "project_id", "code", "number", "numbers", "refs", *ATTRIBUTES],
            )

    told = rows.select("id", "project_id", "part_number", "line_code", "description", (F.coalesce(*brands) if brands else F.lit(None).cast("string")).alias("said"))
    return spread(told.filter("id is not null and project_id is not null")).mapInArrow(run, _PARSED)


def with_learned_makers(rows: DataFrame) -> DataFrame:
    """Rows without a maker take the one that the other rows of their line code name, if they name one nearly alone."""
    counts = rows.filter("code is not null and maker is not null").groupBy("code", "maker").agg(F.count("*").alias("n"))
    codes = counts.groupBy("code").agg(F.max(F.struct("n", "maker")).alias("top"), F.sum("n").alias("total"))
    learned = codes.filter((F.col("top.n") >= LEARNED_ROWS) & (F.col("top.n") >= LEARNED_SHARE * F.col("total"))).select("code", F.col("top.maker").alias("learned"))
    lacking = F.col("maker").isNull() & F.col("code").isNotNull()
    filled = rows.filter(lacking).join(learned, "code", "left").withColumn("maker", F.col("learned")).select(*rows.columns)
    return rows.filter(~lacking).unionByName(filled)


def with_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blocks``: 64-bit keys of the blocking passes.  Blocks that share a key by chance only add pairs
    to be compared."""
    key = lambda *parts: F.xxhash64("project_id", *parts)
    known = F.col("maker").isNotNull() & F.col("kind").isNotNull()
    letters = F.array_join(F.array_sort(F.split("number", "")), "")
    own = F.array(
        F.when(F.col("number").isNotNull() & known, key(F.lit("c"), letters, F.col("maker"), F.col("kind"))),
        F.when(known & F.col("first").isNotNull() & F.col("second").isNotNull(), key(F.lit("s"), *[F.col(x) for x in ("maker", "kind", "first", "second")])),
    )
    by_number = F.transform(F.concat("numbers", "refs"), lambda r: key(F.lit("n"), r))
    return rows.withColumn("blocks", F.array_distinct(F.array_compact(F.concat(by_number, own))))


def with_bearers(rows: DataFrame, both: DataFrame) -> DataFrame:
    """``rows`` with ``shared``, whether parts of several makers or kinds among ``both`` bear the row's number, and
    ``shared_kinds``, the kinds of which several makers' parts do.  Only distinct makers and kinds of a number are
    gathered, before the shuffle, so a number that very many rows bear is no matter."""
    told = both.filter("number is not null").groupBy("project_id", "number").agg(F.collect_set(F.struct(F.col("maker").alias("m"), F.col("kind").alias("k"))).alias("z"))
    several = lambda x: F.size(F.array_distinct(F.array_compact(x))) > 1
    kinds = F.array_distinct(F.array_compact(F.transform("z", lambda z: z["k"])))
    of = lambda k: F.transform(F.filter("z", lambda z: z["k"] == k), lambda z: z["m"])
    marked = told.select(
        "project_id", "number", (several(F.transform("z", lambda z: z["m"])) | several(F.transform("z", lambda z: z["k"]))).alias("shared"), F.filter(kinds, lambda k: several(of(k))).alias("shared_kinds")
    )
    return rows.join(marked.filter("shared"), ["project_id", "number"], "left")


#: Edits between numbers of which two neighbouring characters changed places.
SWAPPED_EDITS = 2
#: Levels: 0 silent, 1 agreement, 2 contradiction; for the number 1 equal, 2 said to be replaced, 3 two characters
#: changed places, 4 other, 5 equal but parts of other kinds or makers bear it too, 6 the same of parts of the very kind, or of any kind
#: where none is stated.
NUMBER_LEVELS = 7


def _level(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).otherwise(2)


def _swapped(a: Column, b: Column) -> Column:
    """Whether the two numbers have the same characters in nearly the same order, as keying errors leave them."""
    return (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))) & (F.levenshtein(a, b) <= SWAPPED_EDITS)


def candidate_pairs(store: DataFrame, supplier: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(store_item_id, supplier_item_id, pattern): each candidate pair once; ``pattern`` holds the level of each
    attribute as a digit, the number's first.  A pair counts only where it meets in the first block it shares, so it
    comes once without another shuffle; a block that very many rows share is cut into cells."""
    names = ["id", "number", "numbers", "refs", "blocks", *ATTRIBUTES]
    left = store.select(F.struct(*names, "shared", "shared_kinds").alias("a"), F.col("id").alias("a_id"), "project_id", F.explode("blocks").alias("block"))
    right = supplier.select(F.struct(*names).alias("b"), F.col("id").alias("b_id"), F.col("project_id").alias("project_b"), F.explode("blocks").alias("block"))
    met = split_join(left, right, ["block"], "a_id", "b_id", hot_least).filter("project_id = project_b")
    met = met.filter(F.get(F.array_intersect("a.blocks", "b.blocks"), F.lit(0)) == F.col("block"))
    kind = F.coalesce("a.kind", "b.kind")
    equal = F.when(F.col("a.shared").isNull(), 1).when(kind.isNotNull() & ~F.array_contains("a.shared_kinds", kind), 5).otherwise(6)
    number = (
        F.when(F.arrays_overlap("a.numbers", "b.numbers"), equal)
        .when(F.arrays_overlap("b.refs", "a.numbers") | F.arrays_overlap("a.refs", "b.numbers") | F.arrays_overlap("a.refs", "b.refs"), 2)
        .when(_swapped(F.col("a.number"), F.col("b.number")), 3)
        .when(F.col("a.number").isNull() | F.col("b.number").isNull(), 0)
        .otherwise(4)
    )
    spec = (F.col("a.first") == F.col("b.first")) & (F.col("a.second") == F.col("b.second"))
    met = met.withColumn("number", F.coalesce(number, F.lit(0))).filter((F.col("number") != 4) | F.coalesce(spec, F.lit(False)))  # else they met only in characters too far out of order
    levels = [F.col("number"), *[_level(F.col(f"a.{x}"), F.col(f"b.{x}")) for x in ATTRIBUTES]]
    return met.select(F.col("a_id").alias("store_item_id"), F.col("b_id").alias("supplier_item_id"), F.concat(*[x.cast("string") for x in levels]).alias("pattern"))


def fit(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of each pattern by expectation-maximisation over the counts of patterns.

    Two classes, attributes independent within each; silent attributes weigh nothing.  Starts from a guess in which
    matches agree and non-matches do not, so the classes cannot change places; counts are smoothed, so an attribute
    that never disagrees still has a finite weight.  No patterns give no posteriors."""
    names = list(patterns)
    if not names:
        return {}
    n = np.array([patterns[p] for p in names], dtype=float)
    levels = np.array([[int(c) for c in p] for p in names])
    width = [NUMBER_LEVELS, *[3] * len(ATTRIBUTES)]
    m = [np.array([1, 0.55, 0.1, 0.1, 0.1, 0.1, 0.05]), *[np.array([1, 0.95, 0.05])] * len(ATTRIBUTES)]
    u = [np.array([1, 0.1, 0.05, 0.05, 0.5, 0.1, 0.2]), *[np.array([1, 0.3, 0.7])] * len(ATTRIBUTES)]
    share = 0.5
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + sum(np.log(m[k][levels[:, k]] / u[k][levels[:, k]]) for k in range(len(width)))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = float(np.clip((n * post).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for k, size in enumerate(width):
            for table, weight in ((m, n * post), (u, n * (1 - post))):
                told = np.bincount(levels[:, k], weight, minlength=size)[1:] + 0.5
                table[k] = np.concatenate([[1.0], told / told.sum()])
    return dict(zip(names, post.tolist()))


def link(stores: DataFrame, suppliers: DataFrame, mappings: DataFrame, threshold: float = THRESHOLD, checked: bool = True) -> DataFrame:
    """(store_item_id, supplier_item_id, confidence): the pairs of one project that are the same part.

    With ``checked`` pairs in which the rows contradict one another are left out; without, and with a threshold of 0, it
    is the whole scored candidate set.  Nulls are silence; an empty table gives no pairs; a row delivered twice counts
    once; other columns are ignored.  Only the counts of the patterns come to the driver: at most 7 * 3^6 of them,
    whatever the data."""
    ws = Workspace(stores.sparkSession, "linkage")
    makers = read_makers(mappings)
    noise = learned_noise(stores.select("description").unionByName(suppliers.select("description")), makers.names)
    a = ws.save(with_learned_makers(ws.save(read_rows(stores, makers, False, noise), "store").dropDuplicates(["id"])), "store_known")
    b = ws.save(with_learned_makers(ws.save(read_rows(suppliers, makers, True, noise), "supplier").dropDuplicates(["id"])), "supplier_known")
    borne = ["project_id", "number", "maker", "kind"]
    a = ws.save(with_blocks(with_bearers(a, a.select(borne).unionByName(b.select(borne)))), "store_blocks")
    pairs = ws.save(candidate_pairs(a, with_blocks(b)), "pairs")
    counts = {r["pattern"]: r["n"] for r in pairs.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posteriors = fit(counts)
    table = pairs.sparkSession.createDataFrame([(p, float(c)) for p, c in posteriors.items()], "pattern string, confidence double")
    scored = pairs.join(F.broadcast(table), "pattern").filter(F.col("confidence") >= threshold)
    if checked:
        scored = scored.filter(~F.substring("pattern", 2, len(ATTRIBUTES)).contains("2"))
    return scored.select("store_item_id", "supplier_item_id", F.round("confidence", 6).alias("confidence"))
