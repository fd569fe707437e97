"""Plain data that the profiler hands around. Tables stay lazy DataFrames; everything here is small."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class ProfileError(Exception):
    """Base of every error raised by the profiler."""


class ScanError(ProfileError):
    """The path cannot be scanned."""


class PathNotFoundError(ScanError):
    """The path does not exist."""


class DetectionError(ProfileError):
    """No format can be told."""


class LoaderError(ProfileError):
    """A file cannot be read in its format."""


class UnsupportedFormatError(LoaderError):
    """The format is known but there is no reader for it here."""


class AnalyzerError(ProfileError):
    """An analyzer cannot run on this input."""


class ReportError(ProfileError):
    """A report cannot be written."""


class Modality(str, Enum):
    TABULAR = "tabular"
    IMAGE = "image"
    TEXT = "text"
    AUDIO = "audio"
    VIDEO = "video"
    MULTIMODAL = "multimodal"
    UNKNOWN = "unknown"


class FieldType(str, Enum):
    NUMERIC = "numeric"
    INTEGER = "integer"
    FLOAT = "float"
    CATEGORICAL = "categorical"
    TEXT = "text"
    BOOLEAN = "boolean"
    DATETIME = "datetime"
    IMAGE = "image"
    AUDIO = "audio"
    VIDEO = "video"
    UNKNOWN = "unknown"


class Severity(str, Enum):
    ERROR = "error"
    WARNING = "warning"
    INFO = "info"


class AnalysisMode(str, Enum):
    FULL = "full"
    SAMPLE = "sample"


NUMBERS = (FieldType.INTEGER, FieldType.FLOAT, FieldType.NUMERIC)


@dataclass
class FileInfo:
    path: str
    name: str
    extension: str
    size_bytes: int
    is_symlink: bool = False


@dataclass
class DirectoryNode:
    name: str
    path: str
    file_count: int = 0
    total_size: int = 0
    children: list[DirectoryNode] = field(default_factory=list)
    files: list[FileInfo] = field(default_factory=list)


@dataclass
class ExtensionCount:
    extension: str
    count: int
    total_size: int


@dataclass
class ScanResult:
    root: str
    files: list[FileInfo]
    extensions: list[ExtensionCount]
    directory_count: int
    total_size: int
    empty_directories: list[str]
    hidden_files: list[str]
    symlinks: list[str]
    tree: DirectoryNode | None = None

    def with_extensions(self, *wanted: str) -> list[FileInfo]:
        return [f for f in self.files if f.extension in wanted]


@dataclass
class Detection:
    dataset_type: str
    modality: Modality
    confidence: float
    reason: str
    loader_id: str


@dataclass
class DetectionReport:
    hypotheses: list[Detection]
    selected: Detection | None


@dataclass
class DatasetField:
    name: str
    dtype: FieldType
    nullable: bool = False
    sample_values: list[Any] = field(default_factory=list)


@dataclass
class Dataset:
    """What a loader gives: metadata, and the one table that schema and analyzers share."""

    modality: Modality
    source_format: str
    root_path: str
    num_samples: int
    total_size_bytes: int
    fields: list[DatasetField] = field(default_factory=list)
    splits: dict[str, int] = field(default_factory=dict)
    classes: dict[str, int] | None = None
    capabilities: set[str] = field(default_factory=set)
    analysis_mode: AnalysisMode = AnalysisMode.FULL
    sample_size: int | None = None
    data: Any = field(default=None, repr=False)
    images: Any = field(default=None, repr=False)

    def names(self, *kinds: FieldType) -> list[str]:
        return [f.name for f in self.fields if f.dtype in kinds]


@dataclass
class Finding:
    severity: Severity
    code: str
    title: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class Chart:
    kind: str
    title: str
    data: list[dict[str, Any]]


@dataclass
class AnalyzerResult:
    analyzer_id: str
    analyzer_name: str
    status: str = "success"
    error_message: str | None = None
    metrics: dict[str, Any] = field(default_factory=dict)
    findings: list[Finding] = field(default_factory=list)
    charts: list[Chart] = field(default_factory=list)


@dataclass
class HealthPart:
    category: str
    score: float
    weight: float
    details: str = ""


@dataclass
class HealthScore:
    score: float
    grade: str
    parts: list[HealthPart]
    n_errors: int = 0
    n_warnings: int = 0
    n_info: int = 0


@dataclass
class DatasetReport:
    version: str
    generated_at: str
    dataset_path: str
    scan: ScanResult
    detection: DetectionReport | None = None
    dataset: Dataset | None = None
    health: HealthScore | None = None
    results: list[AnalyzerResult] = field(default_factory=list)
    examples: list[dict[str, Any]] = field(default_factory=list)
    duration_seconds: float = 0.0


@dataclass
class ProgressUpdate:
    status: str
    stage: str
    progress: float
    stage_progress: float = 0.0
    message: str = ""
    detail: str = ""


def plain(value: Any) -> Any:
    """JSON-ready copy: enums by value, sets sorted, tables left out."""
    if isinstance(value, Enum):
        return value.value
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value) if f.repr}
    if isinstance(value, dict):
        return {str(plain(k)): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)
