"""Mappings in Markdown tables: data stores, temporal schemes, schemas, tables and associations.

Strict: a line that the grammar doesn't know is an error that tells its number.
"""

from __future__ import annotations

import re

from .mapping import Association, EntityDef, Join, Model, PropertyDef, Source
from .milestoning import NONE, BiTemporal, BusinessDate, BusinessDateAndProcessing, Milestoning, Processing

#: Column types of the mapping files, and the property type of each.
COLUMN_TYPES = {"VARCHAR": "String", "STRING": "String", "TEXT": "String", "INT": "Integer", "INTEGER": "Integer", "BIGINT": "Integer", "DOUBLE": "Double", "FLOAT": "Float", "DECIMAL": "Decimal", "BOOLEAN": "Boolean", "DATE": "Date", "TIMESTAMP": "DateTime", "DATETIME": "DateTime", "DATE_TIME": "DateTime"}


def scheme(values: dict[str, str]) -> Milestoning:
    """The temporal kind that a scheme's filled cells tell."""
    v = {k: x for k, x in values.items() if x}
    infinite = v.pop("infinite_datetime", "") != ""
    start, end, date = v.get("processing_start"), v.get("processing_end"), v.get("business_date")
    first, last = v.get("business_date_from") or v.get("business_from"), v.get("business_date_to") or v.get("business_to")
    if first and last and start and end:
        return BiTemporal(first, last, start, end, infinite)
    if date and start and end:
        return BusinessDateAndProcessing(date, start, end, infinite)
    if date:
        return BusinessDate(date)
    if start and end:
        return Processing(start, end, infinite)
    raise ValueError(f"no temporal kind in {values}")


def loads(text: str) -> Model:
    name, store_kind, store, schema = "model", "", "", None
    schemes: dict[str, Milestoning] = {}
    tables: list[dict] = []
    links: list[dict] = []
    header: list[str] | None = None
    block: tuple[str, dict] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if not s:
            header = None
            continue
        if s.startswith("|"):
            cells = [c.strip() for c in s.strip("|").split("|")]
            if all(re.fullmatch(r":?-+:?", c) for c in cells):
                continue
            if header is None:
                header = [c.lower() for c in cells]
                continue
            row = dict(zip(header, cells, strict=False))
            if "scheme" in row:
                schemes[row.pop("scheme")] = scheme(row)
            elif block and block[0] == "table" and "column" in row:
                block[1]["columns"].append(row | {"line": number})
            elif block and block[0] == "association" and "source column" in row:
                links.append(block[1] | row | {"line": number})
            else:
                raise ValueError(f"line {number}: a row of no known table: {s}")
            continue
        header = None
        if m := re.fullmatch(r"#+ Model: (.+)", s):
            name = re.sub(r"\.md$", "", m[1])
        elif m := re.fullmatch(r"#+ DataStore: (\S+)(?: \((\w+)\))?", s):
            store, store_kind = m[1], (m[2] or "Database")
        elif m := re.fullmatch(r"#+ Schema: (\S+)", s):
            schema = m[1]
        elif m := re.fullmatch(r"#+ Table: (\S+) *(?:→|->) *(\w+)(?: \(milestoning: (\w+)\))?", s):
            if m[3] and m[3] not in schemes:
                raise ValueError(f"line {number}: unknown scheme {m[3]}")
            tables.append({"table": m[1], "entity": m[2], "milestoning": schemes.get(m[3], NONE), "columns": [], "source": Source(m[1], schema, store if store_kind == "DataCatalog" else None)})
            block = ("table", tables[-1])
        elif m := re.fullmatch(r"#+ Association: (\w+)", s):
            block = ("association", {"name": m[1], "of": tables[-1] if tables else None})
        else:
            raise ValueError(f"line {number}: not understood: {s}")

    by_table = {t["table"]: t for t in tables}
    joins: dict[str, list[Join]] = {t["entity"]: [] for t in tables}
    associations: list[Association] = []
    for link in links:
        column, target = link["source column"], by_table.get(link["target table"])
        owners = [t for t in tables if link["name"].startswith(t["entity"]) and any(c["column"] == column for c in t["columns"])]
        owner = max(owners, key=lambda t: len(t["entity"]), default=link["of"])
        if target is None or owner is None:
            raise ValueError(f"line {link['line']}: unknown table {link['target table']}")
        cell = next((c for c in owner["columns"] if c["column"] == column), None)
        if cell is None:
            raise ValueError(f"line {link['line']}: {owner['table']} has no column {column}")
        forward = cell.get("property") or target["entity"].lower()
        joins[owner["entity"]].append(Join(forward, target["entity"], column, link["target column"]))
        associations.append(Association(owner["entity"], forward, link.get("reverse") or owner["entity"][0].lower() + owner["entity"][1:] + "s"))
    entities = []
    for t in tables:
        taken = {j.left: j for j in joins[t["entity"]]}
        properties = []
        for c in t["columns"]:
            kind = c["type"].split("(")[0].upper()
            if kind not in COLUMN_TYPES:
                raise ValueError(f"line {c['line']}: unknown column type {c['type']}")
            if c.get("property") and c["column"] not in taken:
                properties.append(PropertyDef(c["property"].replace("_", " ").title(), c["column"], COLUMN_TYPES[kind], key="PK" in c.get("key", "")))
        entities.append(EntityDef(t["entity"], t["source"], tuple(properties), tuple(joins[t["entity"]]), t["milestoning"], extra_columns=tuple(c["column"] for c in t["columns"])))
    return Model(name, entities, associations)


def load(path: str) -> Model:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())
