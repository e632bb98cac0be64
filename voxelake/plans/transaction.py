"""Locks with generations, the gate between clean and dirty operations, and atomic commits on the driver."""

from __future__ import annotations

import functools
import json
import os
import time
import uuid
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class LockAcquisitionError(RuntimeError):
    """Another holds the lock."""


class LockVerificationError(RuntimeError):
    """The lock is gone or has changed hands."""


class CleanOperationUnlocked(RuntimeError):
    """A clean operation needs the lock."""


class ErrorLogExists(RuntimeError):
    """A series with an error log may not be opened."""


class Lock:
    """A file made only if it is not there; its generation says whose it is."""

    NAME = ".series.lock"

    def __init__(self, folder: str | Path, generation: str | None = None) -> None:
        self.path, self.generation = Path(folder) / self.NAME, generation

    def _held(self) -> str | None:
        """Whose the lock is: null if it is not there, empty if it is not whole (held by one that can't be told)."""
        try:
            return str(json.loads(self.path.read_text())["generation"])
        except FileNotFoundError:
            return None
        except (ValueError, KeyError, TypeError):
            return ""

    def acquire(self, snapshot: str | None = None) -> Lock:
        """Take the lock, or take it up again with the same generation."""
        held = self._held()
        if held is not None:
            if held != self.generation:
                raise LockAcquisitionError(str(self.path))
            return self
        self.path.parent.mkdir(parents=True, exist_ok=True)
        generation = uuid.uuid4().hex
        try:
            handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError as error:
            raise LockAcquisitionError(f"stolen: {self.path}") from error
        with os.fdopen(handle, "w") as f:
            json.dump({"generation": generation, "snapshot": snapshot, "acquired": time.time()}, f)
        self.generation = generation
        return self

    def verify(self) -> None:
        if self._held() is None or self._held() != self.generation:
            raise LockVerificationError(str(self.path))

    def release(self) -> None:
        self.verify()
        self.path.unlink()
        self.generation = None


def operation(method):
    """A method with ``dirty``: clean ones need the lock."""

    @functools.wraps(method)
    def gated(self, *args, dirty: bool = False, **kwargs):
        if not dirty and not self.locked:
            raise CleanOperationUnlocked(method.__name__)
        if dirty and self.locked:
            warnings.warn(f"{method.__name__} is called as dirty though the lock is held", stacklevel=2)
        return method(self, *args, **kwargs)

    return gated


class SeriesStore:
    """Instances of one series in versions; a pointer file names the one that counts.

    A commit writes a new version first and moves the pointer last, so a crash in between leaves the
    version before in force. Leaving the context after an exception keeps the lock.
    """

    def __init__(self, spark: SparkSession, folder: str | Path, *, lock: bool, override_errors: bool = False, generation: str | None = None) -> None:
        self.spark, self.folder = spark, Path(folder)
        log = self.folder / "error.log"
        if log.exists():
            if not override_errors:
                raise ErrorLogExists(log.read_text())
            log.unlink()
        self.lock = Lock(self.folder, generation)
        if lock:
            self.lock.acquire(self.version)

    def __enter__(self) -> SeriesStore:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and self.locked:
            self.lock.release()

    def __repr__(self) -> str:
        return f"SeriesStore({self.folder}, {'locked' if self.locked else 'unlocked'}, version {self.version})"

    @property
    def locked(self) -> bool:
        return self.lock.generation is not None

    @property
    def version(self) -> str | None:
        pointer = self.folder / "current"
        return pointer.read_text() if pointer.exists() else None

    def serialize(self) -> dict:
        return {"folder": str(self.folder), "generation": self.lock.generation}

    @classmethod
    def deserialize(cls, spark: SparkSession, state: dict) -> SeriesStore:
        return cls(spark, state["folder"], lock=state["generation"] is not None, generation=state["generation"])

    @operation
    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(str(self.folder / self.version)) if self.version else None

    @operation
    def commit(self, instances: DataFrame, _crash: bool = False) -> str:
        self.lock.verify()
        name = f"v-{uuid.uuid4().hex}"
        instances.write.parquet(str(self.folder / name))
        if _crash:
            raise RuntimeError("crashed before the pointer moved")
        fresh = self.folder / f"current-{name}"
        fresh.write_text(name)
        fresh.replace(self.folder / "current")
        return name

    @operation
    def upload_error_log(self, message: str) -> None:
        with (self.folder / "error.log").open("x") as f:
            f.write(message)
