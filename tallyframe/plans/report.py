"""A static report of a run, and of its comparison, from small aggregated tables."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICY = "default-src 'none'; style-src 'unsafe-inline'"
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #999;padding:3px 8px;text-align:left}pre{white-space:pre-wrap}"


def case_selection(failures: DataFrame, extremes: DataFrame | None, cases: DataFrame, limit: int = 200) -> DataFrame:
    """(case_key, why, rank): failures first, then the most regressed cases, then by key; each case once."""
    ranked = failures.select("case_key", F.lit("failed").alias("why"), F.lit(0).alias("rank"))
    if extremes is not None:
        ranked = ranked.unionByName(extremes.where("side = 'worst'").select("case_key", F.lit("regressed").alias("why"), F.col("rank")))
    ranked = ranked.unionByName(cases.orderBy("case_key").limit(limit).select("case_key", F.lit("listed").alias("why"), F.lit(1 << 30).alias("rank")))
    once = ranked.groupBy("case_key").agg(F.min(F.struct("rank", "why")).alias("m"))
    return once.select("case_key", "m.why", "m.rank").orderBy("rank", "case_key").limit(limit)


def _cell(v: object) -> str:
    if v is None:
        return "-"
    return html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))


def _table(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"<h2>{html.escape(title)}</h2><p>None.</p>"
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def render(title: str, sections: dict[str, DataFrame | list[dict]], cases: DataFrame | None = None, limit: int = 200) -> str:
    """One page without scripts or outside resources; every text is escaped. Sections hold a row per metric or evaluator."""
    parts = [f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>']
    for name, rows in sections.items():
        if isinstance(rows, DataFrame):
            rows = [r.asDict() for r in rows.orderBy(*rows.columns[:2]).limit(1000).collect()]
        parts.append(_table(name, rows))
    if cases is not None:
        parts.append("<h2>Cases</h2>")
        for r in cases.limit(limit).collect():
            parts.append(f"<h3>{html.escape(r['case_key'])}</h3>" + "".join(f"<p>{html.escape(c)}</p><pre>{_cell(r[c])}</pre>" for c in cases.columns if c != "case_key"))
    return "".join(parts) + "</body></html>"


def write(path: str, page: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(page)
    os.replace(path + ".tmp", path)
