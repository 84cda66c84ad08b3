"""Schemas that drift between the files of a feed (problem 5).

Method: the schema of a file is a tree (a root with its columns; a column of JSON objects has their keys as children).
The edit script between two trees is the cheapest set of additions, removals, renames and moves: the children of two
matched nodes are paired by a minimum-cost assignment in which a rename costs less the likelier it is that the same
cells go on, and never more than a removal plus an addition.  Columns of one name take part too, so that two which
change places are seen.  What headers are known to mean is only a first guess that the cells may overrule.  Order costs
nothing.  The scripts are compiled into projections, which give every row of every file the same columns.

A feed may hold any share of the files: the file before is found within months of the feed and across the month's
edge, and each script is made from the columns of two files alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partweave.session import Workspace
from partweave.sources.headers import ROLE_OF, ROLES
from partweave.sources.rawrows import json_columns, strict_rows, with_columns_checked

#: Fixed patterns of cell types, in the order in which they are tried (trimmed cells).
TYPE_PATTERNS = {
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "boolean": r"^(?i)(true|false)$",
}
#: A type must fit more than this share of the cells that are not blank.
TYPE_SHARE = 0.75


# ---------------------------------------------------------------- trees and scripts


@dataclass
class Node:
    """A column: its name, its type (None if unknown), what its cells look like, and its children."""

    name: str
    kind: str | None = None
    profile: tuple[float, ...] = ()
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    kind: str  # added, removed, renamed, retyped or moved
    old: str | None
    new: str | None


def _grams(name: str) -> set[str]:
    padded = f"  {name.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


#: What a rename costs, in additions or removals: for names without common trigrams, for cells that are as unlike as can
#: be, and for headers known to mean different things.  Headers known to mean the same cost nothing for their names.
BY_NAME, BY_CELLS, BY_MEANING = 1.3, 6.0, 1.0
#: What keeping a name over other cells costs at most, and how unlike cells must be before it is asked at all.
KEPT_MOST, KEPT_FREE = 2.5, 0.25
#: What it costs more to remove or add a column whose name stands on the other side too.
KEPT_NAME = 1.5


def unlike(old: Node, new: Node) -> float:
    """How unlike the cells of two nodes are, 0 to 1; 0 where nothing is known of one."""
    return sum(abs(p - q) for p, q in zip(old.profile, new.profile)) / max(1, len(old.profile))


def rename_cost(old: Node, new: Node) -> float:
    """What it costs to call the two nodes one column; 2 or more is never cheaper than a removal and an addition.  Judged
    by their cells first, by what their headers are known to mean and by their names second."""
    if bool(old.children) != bool(new.children):
        return 4.0
    cells = BY_CELLS * unlike(old, new)
    if old.name == new.name:
        return min(cells, KEPT_MOST)
    a, b = ROLE_OF.get(old.name.upper()), ROLE_OF.get(new.name.upper())
    if a and a == b:
        return 0.2 + cells
    x, y = _grams(old.name), _grams(new.name)
    return BY_NAME * (1 - 2 * len(x & y) / (len(x) + len(y))) + cells + (BY_MEANING if a and b else 0.0)


def assign(cost: list[list[float]]) -> list[int]:
    """The column for each row of a square cost matrix that makes the least sum (shortest augmenting paths)."""
    n = len(cost)
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used, way = [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while row_of[j0]:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def _distance(old: Node, new: Node, path_old: str, path_new: str) -> tuple[float, list[Edit], list[tuple[Node, str]], list[tuple[Node, str]]]:
    """Cost and edits of turning the children of one node into those of the other; what was removed and added."""
    edits: list[Edit] = []
    same = {c.name: c for c in new.children}
    pairs = [(c, d) for c in old.children if (d := same.get(c.name)) is not None and bool(c.children) == bool(d.children) and (c.children or unlike(c, d) < KEPT_FREE)]
    kept = {c.name for c, _ in pairs}
    gone = [c for c in old.children if c.name not in kept]
    come = [c for c in new.children if c.name not in kept]
    total, removed, added = 0.0, [], []
    n = len(gone) + len(come)
    if n:
        inner = [[_distance(g, c, "", "")[0] + rename_cost(g, c) for c in come] for g in gone]
        both = {c.name for c in come} & {g.name for g in gone}
        alone = lambda node: node.size() + (KEPT_NAME if node.name in both else 0.0)
        cost = [
            [inner[i][j] if i < len(gone) and j < len(come) else alone(gone[i]) if i < len(gone) else alone(come[j]) if j < len(come) else 0.0 for j in range(n)]
            for i in range(n)
        ]
        picked = assign(cost)
        taken = set()
        for i, g in enumerate(gone):
            j = picked[i]
            if j < len(come) and inner[i][j] < alone(g) + alone(come[j]):
                pairs.append((g, come[j]))
                taken.add(j)
                total += inner[i][j]
            else:
                removed.append((g, path_old + g.name))
                total += g.size()
        for j, c in enumerate(come):
            if j not in taken:
                added.append((c, path_new + c.name))
                total += c.size()
    for a, b in pairs:
        if a.name != b.name:
            edits.append(Edit("renamed", path_old + a.name, path_new + b.name))
        if a.kind and b.kind and a.kind != b.kind:
            edits.append(Edit("retyped", path_old + a.name, path_new + b.name))
        _, more, gone_below, come_below = _distance(a, b, f"{path_old}{a.name}.", f"{path_new}{b.name}.")
        edits += more
        removed += gone_below
        added += come_below
    return total, edits, removed, added


def edit_script(old: Node, new: Node) -> list[Edit]:
    """The cheapest edits from one schema to the next.  A subtree that is removed under one parent and added, with
    the same name and type, under another is moved."""
    _, edits, removed, added = _distance(old, new, "", "")
    left = list(added)
    for node, path in removed:
        for k, (other, there) in enumerate(left):
            if other.name == node.name and other.kind == node.kind and path.rpartition(".")[0] != there.rpartition(".")[0]:
                edits.append(Edit("moved", path, there))
                del left[k]
                break
        else:
            edits.append(Edit("removed", path, None))
    return edits + [Edit("added", None, path) for _, path in left]


# ---------------------------------------------------------------- profiles of files


def _share(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


#: What parts the names of a path in a nested cell; in reports it is a dot.
NESTED = "\x1f"


def _leaves(name: str, cell: str | None, out: list[tuple[str, str | None]]) -> None:
    value = None
    if cell is not None and cell.lstrip().startswith("{"):
        try:
            value = json.loads(cell)
        except (ValueError, RecursionError):
            value = None
    if not isinstance(value, dict):
        out.append((name, cell))
        return
    out.append((name, None))
    for key, inner in value.items():
        text = json.dumps(inner, ensure_ascii=False) if isinstance(inner, (dict, list)) else inner if inner is None or isinstance(inner, str) else str(inner).lower()
        _leaves(f"{name}{NESTED}{key.strip().upper()}", text, out)


def _unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names, cells = [], []
        for own, values in zip(batch["names"], batch["cells"]):
            out: list[tuple[str, str | None]] = []
            for n, c in zip(own, values):
                _leaves(n, c, out)
            names.append([n for n, _ in out])
            cells.append([c for _, c in out])
        yield batch[["file_id"]].assign(names=names, cells=cells)


def unfolded(rows: DataFrame) -> DataFrame:
    """(file_id, names, cells) with the keys of nested cells as columns of their own; only rows that have such cells go
    through Python."""
    nested = F.exists("cells", lambda c: F.coalesce(F.ltrim(c).startswith("{"), F.lit(False)))
    plain = rows.select("file_id", "names", "cells")
    return plain.filter(~nested).unionByName(plain.filter(nested).mapInPandas(_unfold, "file_id string, names array<string>, cells array<string>"))


def profiles(rows: DataFrame) -> DataFrame:
    """(file_id, name, n, n_integer, ... , look): for each column of each file, over rows without a quoting or
    column_count fault, how many cells are not blank and how many fit each type; ``look`` describes the cells.
    One aggregation, combined before the shuffle."""
    cells = (
        unfolded(rows.filter("fits and names is not null and file_id is not null").dropDuplicates(["record"]))
        .select("file_id", F.explode(F.arrays_zip("names", "cells")).alias("z"))
        .select("file_id", F.col("z.names").alias("name"), F.trim(F.col("z.cells")).alias("cell"))
    )
    full = F.coalesce(F.col("cell") != "", F.lit(False))
    length = F.length("cell")
    share = lambda pattern: F.avg(F.when(full, F.length(F.regexp_replace("cell", pattern, "")) / length))
    return cells.groupBy("file_id", "name").agg(
        _share(full).alias("n"),
        *[_share(full & F.col("cell").rlike(p)).alias(f"n_{k}") for k, p in TYPE_PATTERNS.items()],
        F.array(
            F.coalesce(F.least(F.avg(F.when(full, length)) / 40, F.lit(1.0)), F.lit(0.0)),
            F.coalesce(share("[^0-9]"), F.lit(0.0)),
            F.coalesce(share("[^A-Za-z]"), F.lit(0.0)),
            F.coalesce(F.least(F.avg(F.log1p(F.abs(F.expr("try_cast(cell as double)")))) / 8, F.lit(1.0)), F.lit(0.0)),
        ).alias("look"),
    )


def column_type() -> Column:
    """The first type that fits; text if none does; null if every cell is blank."""
    kind = F.when(F.col("n") == 0, F.lit(None).cast("string"))
    for name in TYPE_PATTERNS:
        kind = kind.when(F.col(f"n_{name}") > TYPE_SHARE * F.col("n"), name)
    return kind.otherwise("text")


def file_schemas(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, columns array<struct<name, kind, look>>) of every file whose columns are known: the header of a
    delimited file that has rows, the common keys of a JSON file."""
    flat = rows.filter("header is not null").groupBy("file_id").agg(F.first("header").alias("header"))
    named = flat.select("file_id", F.explode(F.array_distinct("header")).alias("name")).unionByName(
        json_columns(rows).select("file_id", F.explode("columns").alias("key")).select("file_id", F.upper(F.trim("key")).alias("name"))
    )
    seen = profiles(rows).select("file_id", "name", column_type().alias("kind"), "look")
    full = named.unionByName(seen.filter(F.contains("name", F.lit(NESTED))).select("file_id", "name")).distinct().join(seen, ["file_id", "name"], "left")
    return full.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("name", "kind", "look"))).alias("columns"))


def file_pairs(files: DataFrame) -> DataFrame:
    """(feed_id, file_id, before): each file and the one before it in its feed by uploaded_at, then id.

    The window runs within a month of a feed; the first file of a month takes the last of the latest earlier month,
    found among one row a month.  So a feed with a large share of all files is spread over its months."""
    f = files.filter("feed_id is not null").select("feed_id", F.col("id").alias("file_id"), "uploaded_at", F.trunc("uploaded_at", "month").alias("month"))
    inside = Window.partitionBy("feed_id", "month").orderBy("uploaded_at", "file_id")
    f = f.withColumn("before", F.lag("file_id").over(inside))
    last = f.groupBy("feed_id", "month").agg(F.max(F.struct("uploaded_at", "file_id")).alias("last"))
    months = Window.partitionBy("feed_id").orderBy("month")
    edge = last.select("feed_id", "month", F.lag("last.file_id").over(months).alias("edge"))
    same = (F.col("f.feed_id") == F.col("e.feed_id")) & F.col("f.month").eqNullSafe(F.col("e.month"))
    return f.alias("f").join(edge.alias("e"), same, "left").select("f.feed_id", "f.file_id", F.coalesce("before", "edge").alias("before"))


def _tree(columns) -> Node:
    """The tree of a file's columns; a path of names stands below the column that begins it."""
    root = Node("")
    at = {(): root}
    for c in sorted(columns, key=lambda c: c["name"].count(NESTED)):
        path = tuple(c["name"].split(NESTED))
        node = Node(path[-1], c["kind"], tuple(c["look"]) if c["look"] is not None else ())
        at.get(path[:-1], root).children.append(node)
        at[path] = node
    return root


_SCRIPT_SCHEMA = "file_id string, before string, change_kind string, old_name string, new_name string"


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, before, old, new in zip(batch["file_id"], batch["before"], batch["old"], batch["new"]):
            rows += [(file_id, before, e.kind, e.old, e.new) for e in edit_script(_tree(old), _tree(new))]
        yield pd.DataFrame(rows, columns=["file_id", "before", "change_kind", "old_name", "new_name"])


@dataclass
class Drift:
    """Checked rows, the schema of each file, and the edit scripts."""

    rows: DataFrame
    schemas: DataFrame
    pairs: DataFrame
    scripts: DataFrame
    ws: Workspace


def schema_drift(items: DataFrame, files: DataFrame) -> Drift:
    """Everything about the drift of the feeds.  Files without a feed, and files of which no column is known (no
    header, or no valid row), take no part: the file after them is held against the one before them."""
    ws = Workspace(items.sparkSession, "drift")
    rows = ws.save(with_columns_checked(ws.save(strict_rows(items, files), "strict")), "checked")
    schemas = ws.save(file_schemas(rows, files), "schemas")
    known = files.dropDuplicates(["id"]).join(schemas.select(F.col("file_id").alias("id")), "id", "left_semi")
    pairs = ws.save(file_pairs(known), "pairs")
    both = (
        pairs.filter("before is not null")
        .join(schemas.withColumnRenamed("columns", "new"), "file_id")
        .join(schemas.select(F.col("file_id").alias("before"), F.col("columns").alias("old")), "before")
        .select("file_id", "before", "old", "new")
    )
    scripts = ws.save(both.mapInPandas(_scripts, _SCRIPT_SCHEMA), "scripts")
    return Drift(rows, schemas, pairs, scripts, ws)


def change_report(drift: Drift) -> DataFrame:
    """(file_id, column_name, change_kind): column_name is the later file's, for removed the earlier file's."""
    return drift.scripts.select("file_id", F.replace(F.coalesce("new_name", "old_name"), F.lit(NESTED), F.lit(".")).alias("column_name"), "change_kind").distinct()


def projections(drift: Drift) -> DataFrame:
    """(file_id, name, canonical): the compiled scripts.  A known header's canonical name is its role; another
    column keeps the name under which its feed first had it.  The first name is found by doubling pointers from
    each file's column to the same column of the file before, so a long feed takes log2 of its length in joins."""
    unknown = drift.schemas.select("file_id", F.explode("columns.name").alias("name"))
    roles = F.lit(None).cast("string")
    for role, names in ROLES.items():
        roles = F.when(F.col("name").isin(names), role).otherwise(roles)
    named = unknown.withColumn("role", roles)
    fresh = drift.scripts.filter("change_kind in ('renamed', 'added')").select("file_id", F.col("new_name").alias("name"), "old_name")
    at = named.filter("role is null").join(drift.pairs.select("file_id", "before"), "file_id", "left").join(fresh.withColumn("is_new", F.lit(True)), ["file_id", "name"], "left")
    up = F.when(F.col("is_new").isNull(), F.col("name")).otherwise(F.col("old_name"))
    jump = at.select("file_id", "name", F.when(up.isNotNull(), F.col("before")).alias("to_file"), F.when(F.col("before").isNotNull(), up).alias("to_name"))
    jump = drift.ws.save(jump, "jump0")
    step = 0
    while not (open_ends := jump.filter("to_file is not null and to_name is not null")).isEmpty():
        step += 1
        ends = jump.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("next_file"), F.col("to_name").alias("next_name"))
        moved = jump.join(ends, ["to_file", "to_name"], "left")
        arrived = F.col("next_file").isNull() | F.col("next_name").isNull()
        following = moved.select(
            "file_id",
            "name",
            F.when(arrived, F.col("to_file")).otherwise(F.col("next_file")).alias("to_file"),
            F.when(arrived, F.col("to_name")).otherwise(F.col("next_name")).alias("to_name"),
        )
        following = drift.ws.save(following, f"jump{step}")
        if following.join(jump, ["file_id", "name", "to_file", "to_name"], "left_anti").filter("to_file is not null").isEmpty():
            jump = following
            break
        jump = following
    firsts = jump.select("file_id", "name", F.coalesce("to_name", "name").alias("canonical"))
    return named.filter("role is not null").select("file_id", "name", F.col("role").alias("canonical")).unionByName(firsts)


#: Types of the roles in the consistent table; the others are text.
ROLE_TYPES = {"cost": "decimal(18,4)", "core": "decimal(18,4)", "weight": "decimal(18,4)", "quantity": "bigint", "usage": "bigint", "minimum": "bigint", "last_sale": "date"}


def _typed(cell: Column, role: str) -> Column:
    """A cell as its role's type; null if it is blank or cannot be read."""
    kind = ROLE_TYPES.get(role)
    if kind is None:
        return cell
    plain = F.nullif(F.trim(cell), F.lit(""))
    if kind == "date":
        return plain.try_cast("date")
    plain = F.regexp_replace(plain, "[$,]", "")
    return (F.regexp_replace(plain, r"\.0*$", "") if kind == "bigint" else plain).try_cast(kind)


def unified_rows(drift: Drift) -> DataFrame:
    """One consistent table of all readable rows: (record, id, file_id, one typed column a role, extra, unread).

    ``extra`` maps the canonical names of the columns that have no role to their cells; ``unread`` maps roles to cells
    that are not of the role's type, so that nothing is lost where a file retypes a column.  Either is null if there are
    none.  A cell is null where its file has no such column."""
    good = drift.rows.filter("fits and names is not null and file_id is not null").dropDuplicates(["record"])
    maps = projections(drift).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "canonical"))).alias("as"))
    named = good.join(maps, "file_id", "left")
    pairs = F.transform(F.arrays_zip("names", "cells"), lambda z: F.struct(F.coalesce(F.element_at("as", z["names"]), z["names"]).alias("k"), z["cells"].alias("v")))
    named = named.withColumn("pairs", pairs)
    of_role = lambda role: F.get(F.filter("pairs", lambda p: p["k"] == role), F.lit(0))["v"]
    rest = F.filter("pairs", lambda p: ~p["k"].isin(list(ROLES)))
    extra = F.to_json(F.map_from_arrays(F.array_distinct(F.transform(rest, lambda p: p["k"])), F.transform(F.array_distinct(F.transform(rest, lambda p: p["k"])), lambda k: F.get(F.filter(rest, lambda p: p["k"] == k), F.lit(0))["v"])))
    unlike_type = F.array_compact(F.array(*[F.when((F.trim(of_role(r)) != "") & _typed(of_role(r), r).isNull(), F.struct(F.lit(r).alias("k"), of_role(r).alias("v"))) for r in ROLE_TYPES]))
    unread = F.when(F.size(unlike_type) > 0, F.to_json(F.map_from_entries(unlike_type)))
    return named.select("record", "id", "file_id", *[_typed(of_role(r), r).alias(r) for r in ROLES], F.when(F.size(rest) > 0, extra).alias("extra"), unread.alias("unread"))
