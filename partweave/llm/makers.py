"""The makers of a project's parts, and the line codes by which stores and suppliers call them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Makers:
    """names: the makers, lower case; store and supplier: maker by line code (upper case)."""

    names: tuple[str, ...]
    store: dict[str, str]
    supplier: dict[str, str]


def read_makers(mappings: DataFrame) -> Makers:
    """Makers from line_code_mappings, a fixed list (69 rows) that does not grow with the catalogues.  A code that is
    mapped to two makers says nothing and is left out."""
    rows = mappings.select("client_line_code", "manufacturer_name", "arnold_line_code").distinct().collect()
    store: dict[str, set[str]] = {}
    supplier: dict[str, set[str]] = {}
    names = set()
    for client, name, arnold in rows:
        name = " ".join((name or "").lower().split())
        if not name:
            continue
        names.add(name)
        for code, into in ((client, store), (arnold, supplier)):
            if code and code.strip():
                into.setdefault(code.strip().upper(), set()).add(name)
    one = lambda d: {c: next(iter(own)) for c, own in d.items() if len(own) == 1}
    return Makers(tuple(sorted(names)), one(store), one(supplier))
