"""Reports as text and as one HTML file.

What is listed is bounded (``listed``, ``max_items``) and fetched row by row; the
rest is counted.  The tables themselves are the report's DataFrames.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import VERDICT_LABELS
from .analysis import Report


def diagnosis() -> Column:
    """What an item's figures say and what to look at, as an expression on judged items."""
    r, p, verdict = F.format_number("point_biserial", 2), F.format_number("backwards_p", 4), F.col("verdict")
    chance = F.coalesce(F.concat(F.lit(" (p="), p, F.lit(")")), F.lit(""))
    said = (
        F.when((verdict == "dead") & (F.col("k") == F.col("n")), F.format_string("Every model passes (%d of %d): a constant. Replace it by a harder variant or drop it.", "k", "n"))
        .when(verdict == "dead", F.format_string("None of %d models passes: out of reach, or the grader never accepts. Read some answers.", "n"))
        .when(verdict == "backwards", F.concat(F.lit("The better a model does elsewhere, the more often it fails here"), chance, F.lit(": check grader and reference answer.")))
        .when((verdict == "weak") & (F.col("point_biserial") < 0), F.concat(F.lit("The sign is negative but within noise"), chance, F.lit(": conclude nothing from it.")))
    )
    rated = F.when(verdict == "weak", "Tells little about a model").when(verdict == "acceptable", "Agrees with the other items").otherwise("Agrees closely with the other items")
    return F.coalesce(said, F.concat(rated, F.lit(" (r="), r, F.lit(").")))


def _first(rows: DataFrame, most: int) -> Iterator[Row]:
    return rows.limit(most).toLocalIterator()


def _listed(head: str, lines: list[str], total: int) -> list[str]:
    more = [f"  ... {total - len(lines)} more"] if total > len(lines) else []
    return ["", head, *lines, *more]


def to_text(report: Report, max_items: int = 20, listed: int = 200) -> str:
    """A report for the terminal: models and which of their gaps are real, then items that need a hand, then the best ones."""
    f, gap = report.figures, report.min_real_gap()
    order = sorted(report.model_totals.items(), key=lambda x: -x[1])
    out = [
        f"SUITE REPORT: {report.n_items} items, {report.n_models} models",
        f"alpha {report.alpha:.3f}, {report.alpha_verdict}; error of a total {report.sem:.2f} items; at 95 % a gap is real from {gap:.2f} items on",
        f"{report.signal_ratio:.0%} of the items tell models apart, {report.wasted_fraction:.0%} do not",
    ]
    lines = []
    for place, ((name, total), below) in enumerate(zip(order, [*order[1:], None]), 1):
        lines.append(f"{place:>4}. {name}  {total}")
        if below:
            away = total - below[1]
            lines[-1] += f"  [{away} ahead of the next: {'real' if away > gap else 'NOT DISTINGUISHABLE'}]"
    out += ["", "MODELS", *lines]
    if f["backwards"]:
        rows = [f"  {s['item_id']}  p {s['backwards_p']:.5f}, r {s['point_biserial']:+.3f}, passed by {s['k']} of {s['n']}" for s in _first(report.backwards_items(), listed)]
        out += _listed(f"BACKWARDS ITEMS ({f['backwards']}), false discoveries held to {report.fdr:g}", rows, f["backwards"])
    elif not report.backwards_detectable():
        rows = [f"  {s['item_id']}  p {s['backwards_p']:.3f}, r {s['point_biserial']:+.3f}" for s in _first(report.suspicious_items(), 5)]
        out += _listed(f"BACKWARDS ITEMS: NOT TESTABLE, {report.n_models} models are too few for any p of {report.fdr:g}; the most suspicious:", rows, f["suspicious"])
    else:
        out += ["", f"BACKWARDS ITEMS: none at {report.fdr:g}; negative but explained by noise: {f['suspicious']}"]
    if f["dead"]:
        rows = [f"  {s['item_id']}  {'passed by all' if s['k'] else 'passed by none'}" for s in _first(report.dead_items(), listed)]
        out += _listed(f"DEAD ITEMS ({f['dead']}): {f['dead_all_pass']} passed by all, {f['dead_none_pass']} by none", rows, f["dead"])
    rows = [f"  {s['point_biserial']:+.3f} {s['discrimination']:+.3f} {s['difficulty']:.2f}  {VERDICT_LABELS[s['verdict']]:<9}  {s['item_id']}" for s in _first(report.ranked(), max_items)]
    return "\n".join([*out, *_listed("ITEMS by r, with D and pass rate", rows, report.n_items)])


STYLE = """
body{font:16px/1.5 system-ui,sans-serif;max-width:70rem;margin:2rem auto;padding:0 1rem;color:#1d2127;background:#fff}
dl{display:grid;grid-template-columns:max-content 1fr;gap:.2rem 1rem}
dd{margin:0;font-variant-numeric:tabular-nums}
table{border-collapse:collapse;width:100%;font-size:.9rem}
th,td{padding:.45rem .6rem;border-bottom:1px solid #e4e7eb;text-align:left;vertical-align:top}
td.num{font-variant-numeric:tabular-nums;white-space:nowrap}
.dead{color:#7a5c00}.backwards{color:#a3261b}.strong{color:#11633f}.acceptable{color:#2f6b57}.weak{color:#67717b}
"""


def to_html(report: Report, title: str = "Suite report", max_items: int = 10_000) -> str:
    """Items, best first, in one self-contained page; names are escaped, nothing is loaded."""
    e, f = html.escape, report.figures
    facts = (
        ("Items, models", f"{report.n_items}, {report.n_models}"),
        ("Alpha", f"{report.alpha:.3f} ({report.alpha_verdict})"),
        ("Gap that is real at 95 %", f"{report.min_real_gap():.2f} items"),
        ("Tell models apart", f"{report.signal_ratio:.0%}"),
        *((VERDICT_LABELS[v], str(f[v])) for v in ("dead", "backwards", "weak", "acceptable", "strong")),
    )
    rows = []
    for s in _first(report.ranked().withColumn("said", diagnosis()), max_items):
        figures = (VERDICT_LABELS[s["verdict"]], f"{s['k']} of {s['n']}", f"{s['point_biserial']:+.3f}", f"{s['discrimination']:+.3f}")
        cells = "".join(f'<td class="num {s["verdict"]}">{c}</td>' for c in figures)
        rows.append(f"<tr><td>{e(s['item_id'])}</td>{cells}<td>{e(s['said'])}</td></tr>")
    if report.n_items > len(rows):
        rows.append(f'<tr><td colspan="6">and {report.n_items - len(rows)} more</td></tr>')
    told = "".join(f"<dt>{e(a)}</dt><dd>{e(b)}</dd>" for a, b in facts)
    heads = "".join(f"<th>{x}</th>" for x in ("Item", "Verdict", "Passed by", "r", "D", "Reading"))
    return (
        f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title><style>{STYLE}</style></head>\n'
        f"<body><h1>{e(title)}</h1><dl>{told}</dl>\n<table><thead><tr>{heads}</tr></thead><tbody>\n" + "\n".join(rows) + "\n</tbody></table></body></html>"
    )
