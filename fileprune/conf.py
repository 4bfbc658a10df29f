"""Settings, read from the session at each operation. A value that can't be used falls back to the default with a warning."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "spark.fileprune."
log = logging.getLogger(__name__)


def _bool(text: str) -> bool:
    return {"true": True, "false": False}[text.strip().lower()]


def _positive(kind: Callable[[str], Any]) -> Callable[[str], Any]:
    def read(text: str):
        value = kind(text)
        if value <= 0:
            raise ValueError(text)
        return value

    return read


def _fraction(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise ValueError(text)
    return value


SETTINGS: dict[str, tuple[Any, Callable[[str], Any]]] = {
    "largeIndexLimit": (500_000, _positive(int)),
    "indexRepartitionCount": (None, _positive(int)),
    "debug": (False, _bool),
    "repartitionDataFiles": (False, _bool),
    "lockTimeout": (1800, _positive(int)),
    "lockRetryInterval": (60, _positive(float)),
    "lockMaxWait": (3600, float),
    "lockRefreshInterval": (1, int),
    "autoCompactThreshold": (None, int),
    "autoBloomFpr": (0.01, _fraction),
    "batchedUpdate": (None, _bool),
}


def setting(spark: SparkSession, name: str):
    default, read = SETTINGS[name]
    text = spark.conf.get(PREFIX + name, None)
    if text is None:
        return default
    try:
        return read(text)
    except (ValueError, KeyError):
        log.warning("%s%s can't be %r; using %r", PREFIX, name, text, default)
        return default


def storage_path(spark: SparkSession) -> str:
    path = spark.conf.get(PREFIX + "storagePath", None)
    if not path:
        raise ValueError(f"{PREFIX}storagePath must be set")
    return path.rstrip("/")
