"""Typed errors raised for requests that cannot be answered."""

from __future__ import annotations


class AnalysisError(Exception):
    """Base class; ``details`` carries machine-readable context."""

    def __init__(self, message: str, *, details: dict | None = None) -> None:
        super().__init__(message)
        self.message = message
        self.details = details or {}


class ValidationError(AnalysisError, ValueError):
    """The request does not fit the table."""


class UnsupportedFileError(AnalysisError):
    """The file kind is not one we read."""
