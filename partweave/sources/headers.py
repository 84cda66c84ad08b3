"""What the columns of an uploaded file mean.

ROLES names, for each role, the headers under which stores are known to send it (trimmed, upper case).  Reading
uses it; a header that is not listed has the role that its words tell (PATTERNS).  Drift detection takes the list only
as a first guess, which the cells may overrule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers of store files by role.
ROLES = {
    "part_full": ["PART"],
    "part_number": ["PART NUMBER", "PART NO", "PART #", "PART NUM", "MFR PART NO", "ITEM NUMBER", "ITEM NO", "MFG PART NUMBER"],
    "line_code": ["LINE", "LINE CODE", "MFR LINE"],
    "description": ["DESCRIPTION", "DESCR", "DESC", "ITEM DESC", "ITEM DESCRIPTION"],
    "cost": ["COST", "COST $", "CURR COST $", "CURR COST", "NET COST", "UNIT COST"],
    "quantity": ["QTY AVL", "QTY AVAIL", "QTY", "ON HAND", "QTY ON HAND", "QOH"],
    "usage": ["ROLLING 12", "USAGE", "USAGE 12M", "12M USAGE"],
    "vendor": ["VENDOR NAME", "VENDOR", "MANUFACTURER", "MFG", "MFR"],
    "last_sale": ["LAST SALE", "LAST SOLD", "DATE LAST SOLD"],
    "bin": ["BIN", "BIN LOC", "SHELF"],
    "core": ["CORE CHG", "CORE DEP", "CORE"],
    "superseded": ["SUPERSEDED", "SUPER FLAG", "REPLACED"],
    "weight": ["WEIGHT", "WT", "UNIT WT"],
    "minimum": ["MIN QTY", "MIN", "REORDER PT"],
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names}

#: Fixed patterns: words of headers that are not listed (trimmed, upper case) by which a checked role is told.
PATTERNS = {
    "part_number": r"^((MFR|MFG|VENDOR|STORE|OUR|MAKER) *)?(PART|ITEM|STOCK|P) *[/ ]? *(N|NUMBER|NUM|NBR|NO|#|CODE|ID)\.?$|^(PN|SKU)[ #.]*$",
    "cost": r"^((?!CORE|EXT|TOTAL|DATE|FREIGHT).)*\bCOST\b((?!CORE|EXT|TOTAL|DATE|FREIGHT|CODE).)*$",
    "quantity": r"^((?!MIN|MAX|ORDER|PACK|SOLD|DATE|REORD).)*\b(QTY|QUANTITY|ON HAND|ONHAND|QOH|OH|STOCK)\b((?!MIN|MAX|ORDER|PACK|SOLD|DATE|NUM|NO\b|#|CODE|ID).)*$",
    "usage": r"^((?!DATE).)*(\bUSAGE\b|\b12 *(MO|MON|MONTH|M)S?\b)((?!DATE).)*$",
}


def has_role(name: Column, role: str) -> Column:
    """Whether a column name (trimmed, upper case) has a role: it is listed for it, or is not listed at all and its words
    tell it."""
    return name.isin(ROLES[role]) | (~name.isin(list(ROLE_OF)) & name.rlike(PATTERNS[role]) if role in PATTERNS else F.lit(False))
