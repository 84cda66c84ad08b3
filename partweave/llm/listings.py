"""Listings of the same product, worded differently (problem 4).

Method: what a listing says is extracted and normalised: standard identifiers (every GTIN whose check digit holds),
maker and part number, and the specification (maker, kind, build, position, both measures).  Listings are joined on keys
that are reliable: equal specifications, equal GTIN, equal maker and kind and part number.  Groups are the connected
components of the keys, guarded: where members of a component state different specifications, it is broken up into its
specifications; a member that states none in full goes to the one specification that it shares a key with and does not
contradict, and stands alone if there is not just one.  A component in which nobody states a specification but GTINs
differ is broken up by GTIN.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.components import connected_components
from partweave.llm.linkage import number_keys
from partweave.llm.makers import read_makers
from partweave.llm.partspec import Reader, learned_noise
from partweave.operators.skew import HOT_LEAST, heavy_keys, join_unique, split_join
from partweave.session import Workspace, spread

_DIGITS = re.compile(r"(?<!\d)\d{8}(?:\d{4,6})?(?!\d)")


def valid_gtin(digits: str) -> bool:
    """Whether the last of 8, 12, 13 or 14 digits is the check digit of the others."""
    if len(digits) not in (8, 12, 13, 14) or not digits.isascii() or not digits.isdigit():
        return False
    total = sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits[:-1])))
    return (10 - total % 10) % 10 == int(digits[-1])


def find_gtins(text: str | None) -> list[str]:
    """The GTINs of 12 to 14 digits in a text whose check digit holds, each once.  Eight digits are as often a part
    number, so they count only after the word GTIN, EAN or UPC."""
    found: list[str] = []
    for m in _DIGITS.finditer(text or ""):
        if valid_gtin(m[0]) and (len(m[0]) > 8 or re.search(r"(?:gtin|ean|upc)\W*$", text[: m.start()], re.I)):
            code = m[0].zfill(14)
            if code not in found:
                found.append(code)
    return found


_READ = "listing_id string, project_id string, spec string, parts array<string>, gtin string, keys array<string>"


def read_listings(stores: DataFrame, suppliers: DataFrame, mappings: DataFrame) -> DataFrame:
    """_READ of every listing once: the full specification or null, its parts (maker, kind, build, position, measures) as
    far as stated, the first GTIN, and the keys by which it may be joined, a full specification's first."""
    makers = read_makers(mappings)
    noise = learned_noise(stores.select("description").unionByName(suppliers.select("description")), makers.names)
    side = lambda df, codes: df.select("id", "project_id", "description", "part_number", F.upper(F.trim("line_code")).alias("code"), F.lit(codes).alias("side"))
    rows = side(stores, "store").unionByName(side(suppliers, "supplier")).filter("id is not null and project_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(makers.names, noise)
        codes = {"store": makers.store, "supplier": makers.supplier}
        for batch in batches:
            specs, parts, gtins, keys = [], [], [], []
            for project, text, number, code, where in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                spec = reader.read(text)
                full = spec.full_text()
                own = [f"s|{project}|{full}"] if full else []
                codes_found = find_gtins(text)
                own += [f"g|{project}|{g}" for g in codes_found]
                maker = spec.maker or codes[where].get(code or "")
                if maker and spec.kind:
                    own += [f"n|{project}|{maker}|{spec.kind}|{k}" for k in number_keys(number, code, makers)]
                specs.append(full)
                parts.append([maker, spec.kind, spec.build, spec.position, *(None if x is None else str(x) for x in (spec.first, spec.second))])
                gtins.append(codes_found[0] if codes_found else None)
                keys.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(specs, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(gtins, pa.string()), pa.array(keys, pa.list_(pa.string()))],
                names=["listing_id", "project_id", "spec", "parts", "gtin", "keys"],
            )

    return spread(rows).mapInArrow(run, _READ).dropDuplicates(["listing_id"])


def grouped_listings(stores: DataFrame, suppliers: DataFrame, mappings: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(listing_id, project_id, spec, group): every listing and the guarded component it is in; ``group`` is a name.

    Not the listings but their keys are contracted: a listing ties its keys together, and listings with the same keys
    tie them only once.  Keys that very many listings share are met by broadcast where the listings lie."""
    ws = Workspace(stores.sparkSession, "listings")
    read = read_listings(stores, suppliers, mappings).withColumn("keys", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("key", F.get("keys", F.lit(0)))
    read = ws.save(read, "read")
    ties = read.select("key", F.explode(F.slice("keys", 2, 1 << 20)).alias("other"))
    found = connected_components(ties, "key", "other")
    keyed, alone = read.filter("key is not null"), read.filter("key is null")

    def met(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
        hot, _ = heavy_keys(rows, F.col(key), hot_least)
        return join_unique(rows, side, key, None if hot is None else hot.select(F.col("_h").alias(key)), "left")

    joined = ws.save(met(keyed, found.select(F.col("node").alias("key"), "component"), "key").withColumn("component", F.coalesce("component", "key")), "joined")
    told = joined.groupBy("component").agg(F.min("spec").alias("lo"), F.max("spec").alias("hi"), F.min("gtin").alias("g1"), F.max("gtin").alias("g2"))
    broken = ws.save(told.filter("lo <> hi or (lo is null and g1 <> g2)").select("component", F.when(F.col("lo").isNull(), "gtin").otherwise("spec").alias("by")), "broken")
    marked = met(joined, broken, "component")
    torn = marked.filter("`by` = 'spec'")
    stated = torn.filter("spec is not null").select(F.explode("keys").alias("k"), "spec", F.col("parts").alias("full")).dropDuplicates(["k", "spec"])
    lost = torn.filter("spec is null").select("listing_id", "parts", F.explode("keys").alias("k"))
    agrees = F.forall(F.arrays_zip(F.col("parts").alias("x"), F.col("full").alias("y")), lambda z: z["x"].isNull() | z["y"].isNull() | (z["x"] == z["y"]))
    fits = lost.join(stated, "k").filter(agrees).groupBy("listing_id").agg(F.min("spec").alias("one"), F.max("spec").alias("another")).filter("one = another").select("listing_id", "one")
    settled = marked.join(fits, "listing_id", "left")
    by = F.col("by")
    split = F.when(by == "spec", F.coalesce("spec", "one")).when(by == "gtin", F.col("gtin"))
    name = F.when(by.isNull(), F.concat(F.lit("c"), "component")).when(split.isNotNull(), F.concat(F.lit("c"), "component", F.lit("|"), split)).otherwise(F.concat(F.lit("~"), "listing_id"))
    shown = settled.select("listing_id", "project_id", "spec", name.alias("group"))
    return shown.unionByName(alone.select("listing_id", "project_id", "spec", F.concat(F.lit("~"), "listing_id").alias("group")))


def same_products(stores: DataFrame, suppliers: DataFrame, mappings: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """(listing_a, listing_b): the pairs of listings in one guarded component whose descriptions both state the
    specification in full, listing_a first.  It is the guard that keeps different specifications apart.  A group that very many listings share is cut into cells."""
    ws = Workspace(stores.sparkSession, "products")
    stated = ws.save(grouped_listings(stores, suppliers, mappings, hot_least).filter("spec is not null").select("listing_id", "group"), "stated")
    a, b = stated.withColumnRenamed("listing_id", "listing_a"), stated.withColumnRenamed("listing_id", "listing_b")
    return split_join(a, b, ["group"], "listing_a", "listing_b", hot_least).filter("listing_a < listing_b").select("listing_a", "listing_b")


def product_groups(stores: DataFrame, suppliers: DataFrame, mappings: DataFrame) -> DataFrame:
    """(listing_id, project_id, group_id): one row for each listing; group_id is the least listing of its group.

    Listings that state too little stay alone unless a GTIN, or the number under which their maker lists that kind of
    part, ties them to others.  Null descriptions state nothing; a listing delivered twice counts once."""
    named = Workspace(stores.sparkSession, "groups").save(grouped_listings(stores, suppliers, mappings).drop("spec"), "named")
    least = named.groupBy("group").agg(F.min("listing_id").alias("group_id"))
    hot, _ = heavy_keys(named, F.col("group"))
    return join_unique(named, least, "group", None if hot is None else hot.select(F.col("_h").alias("group")), "left").select("listing_id", "project_id", "group_id")
