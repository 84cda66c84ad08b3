"""Uploaded files into the engine's tables: headers resolved to roles, cells to types."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions.text import line_code_prefix, norm_canonical, norm_stored
from partweave.sources.headers import ROLES

#: Roles that a file of each kind must have, and may have.
REQUIRED = {"store": ["part_number"], "supplier": ["part_number"], "interchange": ["ours", "theirs"]}
#: Headers of interchange files.
INTERCHANGE_ROLES = {
    "ours": ["MERRILL PART #", "OUR PART NUMBER", "OUR PART #", "OURS"],
    "theirs": ["VENDOR PART #", "THEIR PART NUMBER", "COMPETITOR PART #", "THEIRS"],
    "vendor": ["VENDOR", "SUPPLIER", "BRAND"],
    "sub_category": ["SUB CATEGORY", "SUBCATEGORY"],
    "notes": ["NOTES", "NOTE", "REMARKS"],
}
#: Remarks that stand in place of a number.
NO_NUMBER = ["", "NO INTERCHANGE", "NONE", "N/A", "NA", "TBD", "-"]


#: Greatest size of an upload, extensions, and the bytes with which files of two of them begin.
MOST_BYTES = 50 * 1024 * 1024
EXTENSIONS = [".csv", ".xls", ".xlsx"]
MAGIC = {".xlsx": "504B0304", ".xls": "D0CF11E0"}


def checked_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, error) of the files at ``path``: too large, of another type, or not what the name says; null if a
    file may be read.  Of a file only its size and first bytes are looked at."""
    files = spark.read.format("binaryFile").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv]), extension)
    error = (
        F.when(F.col("length") > MOST_BYTES, F.format_string("File too large: %.1f MB (max 50 MB)", F.col("length") / (1024 * 1024)))
        .when(~extension.isin(EXTENSIONS), F.concat(F.lit("File type not allowed: "), F.coalesce(F.nullif(extension, F.lit("")), F.lit("(no extension)")), F.lit(f". Allowed: {', '.join(EXTENSIONS)}")))
        .when(wanted.isNotNull() & (F.hex(F.substring("content", 1, 4)) != wanted), F.concat(F.lit("File content does not match declared type ("), extension, F.lit("). Upload may be corrupted or misnamed.")))
    )
    return files.select("path", F.col("length").alias("size"), error.alias("error"))


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet, row by row, as text; a formula counts by its stored value."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_SHEET}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall(f"{_SHEET}c")):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = k if letters is None else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
                value = c.find(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook (.xlsx), or of several alike, with a header row; every cell is text.  Workbooks are
    read one a task; the header is that of the first."""
    books = spark.read.format("binaryFile").load(path)
    content = books.orderBy("path").limit(1).select("content").first()
    if content is None:
        raise ValueError(f"no workbook at {path}")
    header = [(h or "").strip() or f"__EMPTY_{i}" for i, h in enumerate(next(iter(sheet_rows(bytes(content["content"]))), []))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book in batch["content"]:
                rows = [r for r in sheet_rows(bytes(book))[1:] if any(c not in (None, "") for c in r)]
                yield pd.DataFrame([[*r, *[None] * len(header)][: len(header)] for r in rows], columns=range(len(header)), dtype=object).set_axis(header, axis=1)

    return books.select("content").mapInPandas(run, ", ".join(f"`{h.replace('`', '``')}` string" for h in header))


#: Column that holds a row which has not as many fields as the header.
BAD_ROW = "_bad_row"


def read_strict(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """A delimited file with a header of the given columns; a row of another shape is kept whole in BAD_ROW."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, BAD_ROW])
    return spark.read.schema(schema).csv(path, header=True, sep=delimiter, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited file with a header; every cell stays text, so leading zeros survive."""
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def resolve_roles(columns: list[str], kind: str, chosen: dict[str, str] | None = None) -> dict[str, str]:
    """Column of each role: what the user chose, else the first known header, without regard to case and outer
    spaces.  Raises if a required role has no column or a chosen column does not exist."""
    known = INTERCHANGE_ROLES if kind == "interchange" else ROLES
    by_name = {c.strip().upper(): c for c in reversed(columns)}
    found = {}
    for role, names in known.items():
        pick = (chosen or {}).get(role)
        if pick is not None:
            if pick not in columns:
                raise ValueError(f"column {pick!r} chosen for {role} is not in the file")
            found[role] = pick
        else:
            hit = next((by_name[n] for n in names if n in by_name), None)
            if hit is not None:
                found[role] = hit
    missing = [r for r in REQUIRED[kind] if r not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {columns}")
    return found


def _money(c: Column) -> Column:
    """An amount without dollar sign and commas; null if it cannot be read, and, as in the source system, if it is 0."""
    value = F.regexp_replace(F.trim(c), "[$,]", "").try_cast("decimal(10,2)")
    return F.when(value != 0, value)


def _whole(c: Column) -> Column:
    value = F.regexp_extract(F.trim(c), r"^-?\d+", 0).try_cast("int")
    return F.when(value != 0, value)


def project_items(rows: DataFrame, kind: str, project_id: str, chosen: dict[str, str] | None = None) -> DataFrame:
    """Rows of a store or supplier file as items; rows without a part number are left out."""
    roles = resolve_roles(rows.columns, kind, chosen)
    quoted = lambda role: F.col("`" + roles[role].replace("`", "``") + "`")
    text = lambda role: F.nullif(F.trim(quoted(role)), F.lit("")) if role in roles else F.lit(None).cast("string")
    number = F.coalesce(text("part_number"), text("part_full"))
    out = rows.select(
        F.lit(project_id).alias("project_id"), number.alias("part_number"), text("part_full").alias("part_full"), text("line_code").alias("line_code"), text("description").alias("description"),
        (_money(quoted("cost")) if "cost" in roles else F.lit(None).cast("decimal(10,2)")).alias("current_cost"), (_whole(quoted("quantity")) if "quantity" in roles else F.lit(None).cast("int")).alias("quantity"),
        (_whole(quoted("usage")) if "usage" in roles else F.lit(None).cast("int")).alias("usage"), F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])).alias("raw_data"),
    )
    return out.filter("part_number is not null").withColumn("part_number_norm", norm_stored(F.col("part_number"))).withColumn("canonical_part_number", norm_canonical(F.col("part_number")))


def project_interchanges(rows: DataFrame, project_id: str, chosen: dict[str, str] | None = None) -> DataFrame:
    """Rows of an interchange file as links; rows in which a remark stands for a number are left out."""
    roles = resolve_roles(rows.columns, "interchange", chosen)
    text = lambda role: F.trim(F.col("`" + roles[role].replace("`", "``") + "`")) if role in roles else F.lit(None).cast("string")
    out = rows.select(F.lit(project_id).alias("project_id"), text("ours").alias("merrill_part_number"), text("theirs").alias("vendor_part_number"), text("vendor").alias("vendor"), text("sub_category").alias("sub_category"), text("notes").alias("notes"))
    real = lambda c: ~F.upper(F.coalesce(F.col(c), F.lit(""))).isin(NO_NUMBER)
    kept = out.filter(real("merrill_part_number") & real("vendor_part_number"))
    return kept.withColumn("merrill_part_number_norm", norm_stored(F.col("merrill_part_number"))).withColumn("vendor_part_number_norm", norm_stored(F.col("vendor_part_number")))


def interchange_relations(rows: DataFrame, project_id: str, chosen: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The two relations of an interchange file: the project's links, and the map of whole numbers (with line code and
    bare number of each side) that holds in all projects; each pair of the map once."""
    links = project_interchanges(rows, project_id, chosen)
    theirs, ours = line_code_prefix(F.col("vendor_part_number")), line_code_prefix(F.col("merrill_part_number"))
    wide = links.select(
        F.col("vendor_part_number").alias("competitor_full"), theirs["line_code"].alias("competitor_line_code"), theirs["mfr_part"].alias("competitor_part_number"),
        F.col("merrill_part_number").alias("own_full"), ours["line_code"].alias("own_line_code"), ours["mfr_part"].alias("own_part_number"),
    )
    return links, wide.dropDuplicates(["competitor_full", "own_full"])


def replace_flagged(links: DataFrame, path: str) -> None:
    """Replace the interchanges that hold in all projects.  A link whose notes warn of anything carries a flag."""
    notes = F.trim("notes")
    flagged = links.withColumns({"flag_type": F.when(notes != "", "NOTE"), "flag_message": F.nullif(notes, F.lit(""))})
    flagged.write.mode("overwrite").parquet(path)


def store_mapping(spark: SparkSession, path: str, project_id: str, kind: str, roles: dict[str, str]) -> None:
    """Replace the column mapping of one project's files of one kind; others stay."""
    rows = spark.createDataFrame([(project_id, kind, role, column) for role, column in sorted(roles.items())], "project_id string, kind string, role string, column_name string")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "kind").parquet(path)


def stored_mapping(spark: SparkSession, path: str, project_id: str, kind: str) -> dict[str, str]:
    """The column of each role that was stored; a project and kind have as many rows as there are roles."""
    kept = spark.read.parquet(path).filter((F.col("project_id") == project_id) & (F.col("kind") == kind))
    return {r["role"]: r["column_name"] for r in kept.select("role", "column_name").collect()}


def write_delimited(rows: DataFrame, path: str) -> None:
    """An export: header, quotes where needed, quotes doubled inside; as many files as there are partitions."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False, emptyValue="")


def replace_project(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the projects that ``rows`` holds and leave other projects' alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
