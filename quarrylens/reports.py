"""Reports as JSON, Markdown and HTML."""

from __future__ import annotations

import html
import json
import os

from quarrylens.model import DatasetReport, ReportError, Severity, plain

ORDER = {Severity.ERROR: 0, Severity.WARNING: 1, Severity.INFO: 2}
STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}.score{font-size:2rem}"


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def sorted_findings(report: DatasetReport) -> list:
    return sorted((f for r in report.results for f in r.findings), key=lambda f: ORDER[f.severity])


def as_json(report: DatasetReport) -> str:
    return json.dumps(plain(report), indent=2, ensure_ascii=False, allow_nan=False, default=str)


def sections(report: DatasetReport) -> list[tuple[str, list[tuple[str, str]]]]:
    """(title, rows of two cells): what Markdown and HTML both show."""
    d, out = report.dataset, []
    overview = [("Path", report.dataset_path), ("Generated", report.generated_at), ("Files", str(len(report.scan.files))), ("Size", size_text(report.scan.total_size)), ("Seconds", str(report.duration_seconds))]
    if report.detection and report.detection.selected:
        overview.append(("Format", f"{report.detection.selected.dataset_type} ({report.detection.selected.confidence:.0%})"))
    if d:
        overview += [("Rows or images", str(d.num_samples)), ("Fields", str(len(d.fields))), ("Mode", d.analysis_mode.value)]
    out.append(("Overview", overview))
    if report.health:
        out.append(("Health", [("Score", f"{report.health.score} ({report.health.grade})"), *((p.category, f"{p.score:g} x {p.weight:g}: {p.details}") for p in report.health.parts)]))
    found = sorted_findings(report)
    for severity in Severity:
        rows = [(f.title, f.message) for f in found if f.severity == severity]
        if rows:
            out.append((f"{severity.value.title()} findings", rows))
    for r in report.results:
        scalars = [(k, str(v)) for k, v in r.metrics.items() if v is None or isinstance(v, (str, int, float, bool))]
        out.append((r.analyzer_name, scalars or [("Status", r.error_message or r.status)]))
    shown = report.examples[:5]
    if shown:
        out.append(("Examples", [(str(i), json.dumps(plain(e), ensure_ascii=False)) for i, e in enumerate(shown, 1)]))
    return out


def as_markdown(report: DatasetReport) -> str:
    cell = lambda s: s.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = ["# Dataset report", ""]
    for title, rows in sections(report):
        lines += [f"## {title}", "", "| | |", "|-|-|", *(f"| {cell(a)} | {cell(b)} |" for a, b in rows), ""]
    return "\n".join(lines)


def as_html(report: DatasetReport) -> str:
    """Every value is escaped."""
    body = "".join(f"<h2>{html.escape(t)}</h2><table>" + "".join(f"<tr><th>{html.escape(a)}</th><td>{html.escape(b)}</td></tr>" for a, b in rows) + "</table>" for t, rows in sections(report))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Dataset report</title><style>{STYLE}</style></head><body><h1>Dataset report</h1>{body}</body></html>'


WRITERS = {"json": as_json, "markdown": as_markdown, "html": as_html}
SUFFIXES = {".json": "json", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html"}


def write(report: DatasetReport, path: str, form: str | None = None) -> str:
    """Write a report; its form from the file's suffix, JSON if that tells none."""
    form = form or SUFFIXES.get(os.path.splitext(path)[1].lower(), "json")
    if form not in WRITERS:
        raise ReportError(f"unknown report format: {form}")
    with open(path, "w", encoding="utf-8") as out:
        out.write(WRITERS[form](report))
    return form
