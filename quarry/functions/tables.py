"""One tabular text (CSV, JSON document, NDJSON) → rows → markdown table.

Small per-file helpers used inside an Arrow map; whole tables of rows go
through ``quarry.operators.tabular`` instead."""

from __future__ import annotations

import csv
import io
import json
import re

from ..operators.tabular import MAX_LIST_LEN, WS_TAB

_BLANKS = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), WS_TAB) + "]+")
_NUMBER = re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
csv.field_size_limit(1 << 30)


def csv_rows(text: str, dialect: dict) -> tuple[list[str], list[list[str]]] | None:
    """(names, rows) of a delimited text; short rows are filled, long ones cut."""
    quote, escape = dialect["quote"], dialect["escape"]
    how = {"quotechar": quote, "escapechar": escape or None, "doublequote": not escape} if quote else {"quoting": csv.QUOTE_NONE}
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=dialect["delimiter"], **how) if any(x.strip() for x in r)]
    if not rows or len(rows[0]) < 2:
        return None
    width = len(rows[0])
    rows = [(r + [""] * width)[:width] for r in rows]
    head, rest = rows[0], rows[1:]
    columns = [[v for r in rest if (v := r[k].strip())] for k in range(width)]
    named = not any(_NUMBER.match(x.strip()) for x in head) and any(c and all(map(_NUMBER.match, c)) for c in columns)
    return (head, rest) if named else ([f"column_{k + 1}" for k in range(width)], rows)


def _flat(record: dict, prefix: str = "") -> dict:
    """Nested objects to dotted names, after the plain fields."""
    plain, nested = {}, {}
    for k, v in record.items():
        if isinstance(v, dict):
            nested.update(_flat(v, f"{prefix}{k}."))
        else:
            plain[prefix + k] = v
    return plain | nested


def json_rows(text: str, lines: bool) -> tuple[list[str], list[list]] | None:
    try:
        data = [json.loads(x) for x in text.split("\n") if x.strip()] if lines else json.loads(text)
    except ValueError:
        return None
    data = [data] if isinstance(data, dict) else data
    if not isinstance(data, list) or not data or not all(isinstance(x, dict) for x in data):
        return None
    flat = [_flat(x) for x in data]
    names = list(dict.fromkeys(k for x in flat for k in x))

    def wide(name):
        lists = [x[name] for x in flat if isinstance(x.get(name), list)]
        return any(len(v) > MAX_LIST_LEN for v in lists) and all(isinstance(i, int | float) or i is None for v in lists for i in v)
    names = [n for n in names if not wide(n)]
    return names, [[x.get(n) for n in names] for x in flat]


def cell(value) -> str:
    if isinstance(value, list):
        value = ", ".join("" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else str(v) for v in value)
    return _BLANKS.sub(" ", "" if value is None else str(value)).replace("|", "¦").strip()


def table_markdown(route: str, text: str, dialect: dict | None) -> dict | None:
    """Markdown table and profile of one tabular text."""
    got = csv_rows(text, dialect) if route == "csv" else json_rows(text, route == "ndjson")
    if got is None:
        return None
    names, rows = got
    names = ["RowID", *names]
    out = [" | ".join(names), " | ".join("-" for _ in names)]
    out += [" | ".join([str(i), *map(cell, r)]) for i, r in enumerate(rows, 1)]
    return {"markdown": "\n".join(out), "num_rows": len(rows), "num_cols": len(names), "columns": names}
