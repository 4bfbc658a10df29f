"""Questions about schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def field_exists(schema: T.StructType, path: str) -> bool:
    """Whether a dotted path leads through structs to a field; arrays aren't entered."""
    now: T.DataType = schema
    for name in path.split("."):
        if not isinstance(now, T.StructType) or name not in now.names:
            return False
        now = now[name].dataType
    return True


def field_type(schema: T.StructType, name: str) -> T.DataType | None:
    """Type of a top-level field."""
    return schema[name].dataType if name in schema.names else None
