"""Locks between processes: a JSON file that only one can create. A lock that wasn't refreshed in time is stale and goes."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import socket
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from fileprune.conf import setting
from fileprune.errors import IndexLockException
from fileprune.sources.fs import Files

log = logging.getLogger(__name__)


class IndexLock:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)
        self.owner = f"{socket.gethostname()}:{os.getpid()}"
        self.correlation: str | None = None

    def _body(self, correlation: str, taken: float) -> str:
        return json.dumps({"owner": self.owner, "correlationId": correlation, "acquiredAt": taken, "lastRefreshed": time.time()})

    def _held(self) -> dict | None:
        """What the lock file says; None if there is none; {} if it can't be read."""
        try:
            if not self.files.exists(self.path):
                return None
            return dict(json.loads(self.files.read(self.path)))
        except (ValueError, TypeError):
            return {}
        except Py4JJavaError:
            if not self.files.exists(self.path):
                return None
            raise

    def _stale(self, held: dict) -> bool:
        last = held.get("lastRefreshed")
        return not isinstance(last, (int, float)) or time.time() - last > setting(self.spark, "lockTimeout")

    def _try(self) -> bool:
        held = self._held()
        if held is not None:
            if not self._stale(held):
                return False
            log.warning("lock %s of %s is stale and goes", self.path, held.get("owner", "an unknown owner"))
            self.files.delete(self.path)
        correlation = uuid.uuid4().hex
        try:
            self.files.create(self.path, self._body(correlation, time.time()))
        except Py4JJavaError:
            if self.files.exists(self.path):
                return False
            raise
        self.correlation = correlation
        return True

    def acquire(self) -> str:
        """Wait for the lock, longer each time, up to the longest wait."""
        began, tries = time.time(), 0
        while not self._try():
            pause = min(setting(self.spark, "lockRetryInterval") * 2 ** min(tries, 6), 60)
            if time.time() - began + pause > setting(self.spark, "lockMaxWait"):
                raise IndexLockException(f"{self.path} is held by {(self._held() or {}).get('owner')}")
            time.sleep(pause)
            tries += 1
        return self.correlation

    def _own(self) -> dict | None:
        held = self._held()
        return held if held and held.get("correlationId") == self.correlation else None

    def refresh(self, strict: bool = False) -> bool:
        held = self._own()
        if held is None:
            if strict:
                raise IndexLockException(f"{self.path} is no longer ours")
            log.warning("lock %s isn't ours and isn't refreshed", self.path)
            return False
        self.files.replace(self.path, self._body(self.correlation, held.get("acquiredAt", time.time())))
        return True

    def release(self) -> None:
        if self._own() is None:
            log.warning("lock %s isn't ours and isn't released", self.path)
        else:
            self.files.delete(self.path)
        self.correlation = None

    @contextlib.contextmanager
    def held(self, heartbeat: bool = False):
        """The lock for a block of work, refreshed from the side if asked for."""
        self.acquire()
        over = threading.Event()

        def beat() -> None:
            while not over.wait(max(1.0, setting(self.spark, "lockTimeout") / 3)):
                self.refresh()

        thread = threading.Thread(target=beat, daemon=True) if heartbeat else None
        try:
            if thread:
                thread.start()
            yield self
        finally:
            over.set()
            if thread:
                thread.join()
            self.release()
