"""Reports and the static page, from small result frames on the driver."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import money


def markdown_table(frame: DataFrame, digits: int = 2) -> str:
    """A Markdown table of a small frame."""
    names = frame.columns
    show = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in frame.toLocalIterator()]
    return "\n".join(lines) + "\n"


ARROWS = {"sube": "▲", "baja": "▼", "estable": "="}
NOT_COMPARABLE = "Los totales cubren distinta cantidad de productos: no se ordenan."


def hero(totals: DataFrame) -> str:
    """The baskets of a zone: cheapest first if all cover as many items, else by chain and with a notice.

    ``totals`` has chain, label, total, items_found: one row a chain.
    """
    rows = totals.withColumn("shown", money(F.col("total"))).collect()
    even = len({r["items_found"] for r in rows}) <= 1
    rows.sort(key=lambda r: (r["total"], r["chain"]) if even else r["chain"])
    notice = "" if even else f'<p class="notice">{NOT_COMPARABLE}</p>'
    lines = "".join(f"<li>{escape(r['label'])}: {r['shown']} ({r['items_found']})</li>" for r in rows)
    return notice + (f"<ol>{lines}</ol>" if even else f"<ul>{lines}</ul>")


def page(title: str, cells: DataFrame, chains: list[str], groups: list[str], totals: dict[str, DataFrame] | None = None) -> str:
    """The shopping page: baskets by zone, then items by group, one column a chain, best prices marked, missing ones dashed.

    ``cells`` has item_group, item, chain, shown price text, best flag and, if a
    forecast may stand beside the price, its direction in ``shown_dir``.
    ``totals`` has the baskets of every zone; a zone without any is left out.
    """
    table: dict[str, dict[str, dict[str, tuple[str, bool]]]] = {}
    arrows = "shown_dir" in cells.columns
    for r in cells.toLocalIterator():
        arrow = f" {ARROWS[r['shown_dir']]}" if arrows and r["shown_dir"] else ""
        table.setdefault(r["item_group"], {}).setdefault(r["item"], {})[r["chain"]] = (r["shown"] + arrow, r["best"])
    body = []
    for group in [*groups, *sorted(set(table) - set(groups))]:
        if group not in table:
            continue
        body.append(f'<tr class="group"><th colspan="{len(chains) + 1}">{escape(group)}</th></tr>')
        for item, prices in sorted(table[group].items()):
            row = "".join(f'<td class="{"best" if best else ""}">{escape(text)}</td>' for text, best in (prices.get(c, ("—", False)) for c in chains))
            body.append(f"<tr><th>{escape(item)}</th>{row}</tr>")
    head = "".join(f"<th>{escape(c)}</th>" for c in chains)
    zones = "".join(f"<section><h2>{escape(z)}</h2>{hero(t)}</section>" for z, t in (totals or {}).items() if not t.isEmpty())
    return f"<!DOCTYPE html><meta charset=utf-8><title>{escape(title)}</title>{zones}<table><tr><th></th>{head}</tr>{''.join(body)}</table>"
