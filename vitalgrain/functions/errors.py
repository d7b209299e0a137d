"""Error classes with codes, and the envelope that callers get instead of a traceback."""

from __future__ import annotations

from functools import wraps


class EngineError(Exception):
    """Base: a message, a code and details that can be sent on."""

    code = "engine_error"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def as_dict(self, operation: str | None = None) -> dict:
        return {"error": self.code, "message": self.message, "details": self.details, "operation": operation}


class ValidationError(EngineError, ValueError):
    code = "validation_error"


class NotFoundError(EngineError):
    code = "not_found"


class AccessError(EngineError):
    code = "access_denied"


class RateLimitError(EngineError):
    code = "rate_limited"


class QueryError(EngineError):
    code = "query_error"


class SourceError(EngineError):
    code = "source_error"


def convert(error: Exception) -> EngineError:
    """An engine error for whatever Spark or Python raised."""
    from pyspark.errors import AnalysisException, PySparkException

    if isinstance(error, EngineError):
        return error
    if isinstance(error, AnalysisException):
        missing = "TABLE_OR_VIEW_NOT_FOUND" in str(error)
        return (NotFoundError if missing else QueryError)(str(error).split("\n")[0], kind=type(error).__name__)
    if isinstance(error, PySparkException):
        return QueryError(str(error).split("\n")[0], kind=type(error).__name__)
    if isinstance(error, (ConnectionError, TimeoutError)):
        return SourceError(str(error), kind=type(error).__name__)
    return EngineError(str(error), kind=type(error).__name__)


def enveloped(f):
    """Calls give {"success": True, "result": ...} or the error's envelope."""

    @wraps(f)
    def call(*args, **kwargs):
        try:
            return {"success": True, "result": f(*args, **kwargs)}
        except Exception as e:
            return {"success": False} | convert(e).as_dict(f.__name__)

    return call
