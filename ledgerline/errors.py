"""The errors a statement can end in; class and span are stable, wording is not."""

from __future__ import annotations

from dataclasses import dataclass

Span = tuple[int, int]


@dataclass(eq=True)
class EngineError(Exception):
    """Base of all errors of the engine."""

    message: str

    kind = "error"
    form = "{message}"

    def __str__(self) -> str:
        return self.form.format(**self.__dict__)


@dataclass(eq=True)
class _Located(EngineError):
    span: Span = (0, 0)

    def __str__(self) -> str:
        return f"{self.form} at bytes {self.span[0]}..{self.span[1]}: {self.message}"


class ParseError(_Located):
    kind, form = "parse", "SQL parse error"


class UnsupportedError(_Located):
    kind, form = "unsupported", "unsupported SQL feature"


class SchemaError(EngineError):
    kind, form = "schema", "schema error: {message}"


class TypeMismatch(EngineError):
    kind, form = "type", "type error: {message}"


class ConstraintError(EngineError):
    kind, form = "constraint", "constraint violation: {message}"


@dataclass(eq=True)
class CorruptStorage(EngineError):
    offset: int = 0

    kind, form = "corrupt_storage", "corrupt database at byte {offset}: {message}"


class RegexCompile(EngineError):
    kind, form = "regex_compile", "generated regex could not be compiled: {message}"


class RegexRuntime(EngineError):
    kind, form = "regex_runtime", "regex execution failed: {message}"


@dataclass(eq=True)
class ResourceLimit(EngineError):
    """`message` names the resource."""

    limit: int = 0

    kind, form = "resource_limit", "resource limit exceeded for {message} (limit: {limit})"


class AllocationError(EngineError):
    kind, form = "allocation", "allocation failed while {message}"


class CapacityError(EngineError):
    kind, form = "capacity", "capacity exceeded while {message}"


def quoted(text: str) -> str:
    """Text in double quotes, as messages show names."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
