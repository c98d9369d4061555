"""Checkpoints: key -> next ledger to process. Saves move forward; going back is a rewind."""

from __future__ import annotations

import json
import os
import tempfile
import threading
from pathlib import Path
from typing import Protocol, runtime_checkable
from urllib.parse import quote

from strandline.errors import CheckpointError
from strandline.functions.checks import whole

DEFAULT_KEY = "default"


@runtime_checkable
class CheckpointStore(Protocol):
    def load(self, key: str) -> int | None: ...
    def save(self, key: str, ledger: int) -> None: ...
    def rewind(self, key: str, ledger: int) -> None: ...
    def clear(self, key: str) -> None: ...


def is_checkpoint_store(x) -> bool:
    return isinstance(x, CheckpointStore)


def assert_checkpoint_store(x):
    if not is_checkpoint_store(x):
        raise TypeError("a checkpoint store has load, save, rewind and clear")
    return x


def _key(key) -> str:
    if not isinstance(key, str) or not key:
        raise TypeError("a checkpoint key is a non-empty text")
    return key


class MemoryCheckpointStore:
    def __init__(self):
        self._at: dict[str, int] = {}
        self._lock = threading.Lock()

    def load(self, key: str) -> int | None:
        return self._at.get(_key(key))

    def save(self, key: str, ledger: int) -> None:
        whole("ledger", ledger, 1, optional=False)
        with self._lock:
            if ledger < self._at.get(_key(key), 0):
                raise CheckpointError(f"checkpoint {key} would go back from {self._at[key]} to {ledger}")
            self._at[key] = ledger

    def rewind(self, key: str, ledger: int) -> None:
        with self._lock:
            self._at[_key(key)] = whole("ledger", ledger, 1, optional=False)

    def clear(self, key: str) -> None:
        self._at.pop(_key(key), None)


class FileCheckpointStore:
    """One small JSON file a key, replaced in one step and flushed to disk."""

    VERSION = 1

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self._lock = threading.Lock()

    def _file(self, key: str) -> Path:
        return self.folder / f"{quote(_key(key), safe='')}.json"

    def load(self, key: str) -> int | None:
        try:
            found = json.loads(self._file(key).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return None
        except ValueError as error:
            raise CheckpointError(f"checkpoint {key} is not JSON", cause=error) from error
        if not isinstance(found, dict) or found.get("version") != self.VERSION or found.get("key") != key or isinstance(found.get("ledger"), bool) or not isinstance(found.get("ledger"), int) or found["ledger"] < 1:
            raise CheckpointError(f"checkpoint {key} is corrupt")
        return found["ledger"]

    def _write(self, key: str, ledger: int) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        handle, temp = tempfile.mkstemp(dir=self.folder, suffix=".tmp")
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump({"version": self.VERSION, "key": key, "ledger": ledger}, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(temp, self._file(key))
        except BaseException:
            Path(temp).unlink(missing_ok=True)
            raise

    def save(self, key: str, ledger: int) -> None:
        whole("ledger", ledger, 1, optional=False)
        with self._lock:
            have = self.load(key)
            if have is not None and ledger < have:
                raise CheckpointError(f"checkpoint {key} would go back from {have} to {ledger}")
            self._write(key, ledger)

    def rewind(self, key: str, ledger: int) -> None:
        with self._lock:
            self._write(_key(key), whole("ledger", ledger, 1, optional=False))

    def clear(self, key: str) -> None:
        self._file(key).unlink(missing_ok=True)


class CheckpointManager:
    """The one checkpoint interface that all plans take."""

    def __init__(self, store=None, key: str = DEFAULT_KEY):
        self.store, self.key = assert_checkpoint_store(store if store is not None else MemoryCheckpointStore()), _key(key)

    def load(self, key: str | None = None) -> int | None:
        return self.store.load(key or self.key)

    def save(self, ledger: int, key: str | None = None) -> None:
        self.store.save(key or self.key, ledger)

    def rewind(self, ledger: int, key: str | None = None) -> None:
        self.store.rewind(key or self.key, ledger)

    def clear(self, key: str | None = None) -> None:
        self.store.clear(key or self.key)

    def resume_from(self, start: int, key: str | None = None) -> int:
        """The later of ``start`` and the stored position."""
        return max(start, self.load(key) or 0)
