"""Analyzers, and running those that a dataset has the capabilities for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from quarrylens.model import AnalyzerResult, Chart, Dataset, Finding, ProgressUpdate, Severity

_registry: list["Analyzer"] = []


class Analyzer:
    """A plan over the dataset's table, and a judge that turns its small result into findings.

    Own analyzers subclass this and are passed to ``register``.
    """

    id = ""
    name = ""
    requires: frozenset[str] = frozenset({"tabular"})

    def applies(self, dataset: Dataset) -> bool:
        return self.requires <= dataset.capabilities

    def run(self, dataset: Dataset) -> AnalyzerResult:
        raise NotImplementedError

    def result(self, metrics: dict | None = None, findings: list[Finding] | None = None, charts: list[Chart] | None = None) -> AnalyzerResult:
        return AnalyzerResult(self.id, self.name, metrics=metrics or {}, findings=findings or [], charts=charts or [])

    def skipped(self, why: str) -> AnalyzerResult:
        return AnalyzerResult(self.id, self.name, status="skipped", error_message=why)


def register(analyzer: Analyzer) -> Analyzer:
    _registry.append(analyzer)
    return analyzer


def registered() -> list[Analyzer]:
    from quarrylens.operators import images, relations, tables, texts  # noqa: F401  registers the built-in analyzers

    order = {name: k for k, name in enumerate(BUILT_IN)}
    return sorted(_registry, key=lambda a: order.get(a.id, len(order)))


BUILT_IN = (
    "missing_values", "duplicates", "class_balance", "column_stats", "correlation", "outliers", "feature_importance", "text_analysis",
    "time_series", "image_resolution", "image_quality", "image_duplicates", "corrupted_images", "image_channel_stats",
)


def run_analyzers(dataset: Dataset, progress: Callable[[ProgressUpdate], None] | None = None) -> list[AnalyzerResult]:
    """Every applicable analyzer in order; one that fails gives an error result and the others go on."""
    chosen = [a for a in registered() if a.applies(dataset)]
    out = []
    for k, analyzer in enumerate(chosen):
        if progress:
            progress(ProgressUpdate("analyzing", analyzer.id, 0.5 + 0.35 * k / len(chosen), k / len(chosen), analyzer.name))
        try:
            out.append(analyzer.run(dataset))
        except Exception as error:
            out.append(AnalyzerResult(analyzer.id, analyzer.name, status="error", error_message=f"{type(error).__name__}: {error}"[:2000]))
    return out


def error(code: str, title: str, message: str, **details) -> Finding:
    return Finding(Severity.ERROR, code, title, message, details)


def warning(code: str, title: str, message: str, **details) -> Finding:
    return Finding(Severity.WARNING, code, title, message, details)


def info(code: str, title: str, message: str, **details) -> Finding:
    return Finding(Severity.INFO, code, title, message, details)


def graded(value: float, steps: list[tuple[float, Callable[..., Finding], str]]) -> tuple[Callable[..., Finding], str] | None:
    """The first step that the value is strictly over."""
    return next(((make, code) for limit, make, code in steps if value > limit), None)


def rows_of(df) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in df.collect())
