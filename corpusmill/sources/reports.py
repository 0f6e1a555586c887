"""Reports in Markdown, HTML and on the console, from small tables of results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def _rows(table: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    got = table.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report takes tables of up to {most} rows")
    show = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return table.columns, [[show(v) for v in r] for r in got]


def markdown(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    out = [f"# {title}", ""]
    for name, table in sections.items():
        cols, rows = _rows(table, most)
        cell = lambda v: v.replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]
    return "\n".join(out)


def _table(cols: list[str], rows: list[list[str]]) -> str:
    line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in r) + "</tr>"
    return "<table>" + line("th", cols) + "".join(line("td", r) for r in rows) + "</table>"


def page(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, table in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>" + _table(*_rows(table, most)))
    return "\n".join([*out, "</body></html>"])


def comparison_page(title: str, paired: DataFrame, shares: DataFrame, direction: DataFrame, goals: DataFrame, said: DataFrame) -> str:
    """The page that sets two runs side by side: tests, shares, directions, goals, and a box with what the run says."""
    import math

    cols, rows = _rows(paired, 1000)
    at = cols.index("z")
    shown = lambda z: "—" if z == "—" else f"{math.erfc(abs(float(z)) / math.sqrt(2)):.2e}"
    tests = _table([*cols, "p"], [[*r, shown(r[at])] for r in rows])
    parts = [("Paired results", tests), *[(n, _table(*_rows(t, 1000))) for n, t in (("Shares", shares), ("Directions", direction), ("Goals", goals))]]
    _, items = _rows(said.orderBy("place").select("label", "text"), 100)
    box = "".join(f"<li><b>{html.escape(a)}:</b> {html.escape(b)}</li>" for a, b in items)
    body = "".join(f"<h2>{k}. {html.escape(n)}</h2>{t}" for k, (n, t) in enumerate(parts, 1))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}<div class='conclusions'><h2>Conclusions</h2><ul>{box}</ul></div></body></html>"


def console(title: str, table: DataFrame, most: int = 100) -> str:
    cols, rows = _rows(table, most)
    wide = [max(len(x) for x in c) for c in zip(cols, *rows, strict=True)]
    return "\n".join([title, *["  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in [cols, *rows]]])
