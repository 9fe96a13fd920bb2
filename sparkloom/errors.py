"""Errors with their SQLSTATE. Only a serialization conflict is worth another attempt."""

from __future__ import annotations


class GraphError(Exception):
    sqlstate = "XX000"
    retryable = False

    def __init__(self, message: str):
        super().__init__(f"{self.sqlstate}: {message}")
        self.message = message


class SerializationConflict(GraphError):
    sqlstate = "40001"
    retryable = True


class GqlSyntaxError(GraphError):
    sqlstate = "42000"

    def __init__(self, message: str, offset: int | None = None):
        super().__init__(message if offset is None else f"{message} at offset {offset}")
        self.offset = offset


class NotGql(GqlSyntaxError):
    pass


class UnsupportedFeature(GqlSyntaxError):
    def __init__(self, feature: str, offset: int):
        from .gql.features import describe

        super().__init__(f"unsupported feature {feature} ({describe(feature)})", offset)
        self.feature = feature


class AccessDenied(GraphError):
    sqlstate = "42501"


class DataError(GraphError):
    sqlstate = "23000"


class InvalidParameter(GraphError):
    sqlstate = "22023"


class Unavailable(GraphError):
    sqlstate = "08006"


class InternalError(GraphError):
    sqlstate = "XX000"


def translate(error: Exception) -> GraphError:
    """What Spark raised while a query ran, by its own SQLSTATE: arithmetic, casts and the like are data errors."""
    if isinstance(error, GraphError):
        return error
    state = getattr(error, "getSqlState", lambda: None)() or ""
    text = str(error).split("\n")[0][:500]
    if state[:2] in ("22", "23") or any(x in text for x in ("ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "CAST_INVALID_INPUT", "USER_RAISED_EXCEPTION", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE")):
        return DataError(text)
    return InternalError(text)
