"""Options and results of the four runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

FORMATS = ("jsonl", "csv", "json", "xlsx")
#: Statuses, and the exit codes that they give.
OK, WARNING, SKIPPED, FAILED, UNSUPPORTED = "OK", "WARNING", "SKIPPED", "FAILED", "UNSUPPORTED"


class RunFailed(RuntimeError):
    """Raised by raise_for_errors."""


@dataclass
class ExportOptions:
    formats: tuple[str, ...] = ("jsonl",)
    memo: str | None = None
    strip_spaces: bool = False
    encoding: str = "auto"
    decode_errors: str = "strict"
    deleted: str = "skip"
    missing_memo: str = "fail"
    overwrite: bool = True
    validate: bool = True
    xlsx_long_text: str = "overflow"
    incremental: bool = False

    def __post_init__(self) -> None:
        self.formats = normal_formats(self.formats)
        choices = {"memo": (None, "inline", "skip", "null"), "decode_errors": ("strict", "ignore", "replace"), "deleted": ("skip", "include", "separate"), "missing_memo": ("fail", "null-with-warning"), "xlsx_long_text": ("overflow", "error")}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} isn't one of {allowed}")

    def signature(self) -> dict:
        """What must be equal for outputs to be used again."""
        out = asdict(self)
        for name in ("overwrite", "incremental"):
            out.pop(name)
        return out | {"formats": sorted(self.formats), "output_version": 1}


@dataclass
class ReconstructionOptions:
    input_format: str = "jsonl"
    memo: str = "inline"
    overwrite: bool = False

    def __post_init__(self) -> None:
        if self.input_format not in FORMATS:
            raise ValueError(f"unknown input format: {self.input_format}")
        if self.memo not in ("inline", "skip", "null"):
            raise ValueError(f"unknown memo policy: {self.memo}")


@dataclass
class TableResult:
    table: str
    format: str
    status: str = OK
    output: str | None = None
    records: int = 0
    deleted_records: int = 0
    null_counts: dict[str, int] = field(default_factory=dict)
    empty_counts: dict[str, int] = field(default_factory=dict)
    memo_hashes: dict[str, str] = field(default_factory=dict)
    output_sha256: str | None = None
    output_bytes: int | None = None
    schema_output: str | None = None
    schema_sha256: str | None = None
    deleted_output: str | None = None
    deleted_sha256: str | None = None
    overflow_values: int = 0
    overflow_parts: int = 0
    overflow_sheets: int = 0
    sheets: int = 0
    encoding: str | None = None
    memo_fields: list[str] = field(default_factory=list)
    engine: str = "spark"
    seconds: float = 0.0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def fail(self, error: Exception | str, status: str = FAILED) -> TableResult:
        self.status = status
        self.errors.append(str(error).splitlines()[0][:300] if str(error) else type(error).__name__)
        return self

    def warn(self, text: str) -> None:
        self.warnings.append(text)
        if self.status == OK:
            self.status = WARNING


@dataclass
class Run:
    """Results of a run: counts by status, success and the exit code."""

    results: list
    warnings: list[str] = field(default_factory=list)
    exit_code: int = 0
    summary: dict = field(default_factory=dict)

    def count(self, status: str) -> int:
        return sum(r.status == status for r in self.results)

    @property
    def ok(self) -> int:
        return self.count(OK)

    @property
    def warning(self) -> int:
        return self.count(WARNING)

    @property
    def skipped(self) -> int:
        return self.count(SKIPPED)

    @property
    def failed(self) -> int:
        return self.count(FAILED) + self.count(UNSUPPORTED)

    @property
    def successful(self) -> bool:
        return self.exit_code == 0

    def raise_for_errors(self) -> None:
        if self.exit_code == 1:
            raise RunFailed("; ".join(f"{r.table}: {e}" for r in self.results for e in r.errors[:5]) or "the run failed")


def exit_code(results: list, strict: bool = True) -> int:
    """1 with a failure, else 2 with a warning (if strict), else 0."""
    if any(r.status in (FAILED, UNSUPPORTED) for r in results):
        return 1
    return 2 if strict and any(r.status == WARNING or r.warnings for r in results) else 0


def normal_formats(formats) -> tuple[str, ...]:
    """Formats in order, each once; raises on none or on an unknown one."""
    found = tuple(dict.fromkeys(f.strip().lower() for f in (formats.split(",") if isinstance(formats, str) else formats) if f.strip()))
    unknown = set(found) - set(FORMATS)
    if not found or unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}" if unknown else "no format")
    return found
