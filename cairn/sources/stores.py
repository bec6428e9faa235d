"""Object stores: a flat space of keys with conditional creation.

The driver uses them for configuration, packs, manifests and listings; bulk reads go through
Spark's own readers.
"""

from __future__ import annotations

import os
import secrets
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from cairn.errors import CairnError, Kind, kind_of_os

HIDDEN = ".tmp-"


@dataclass(frozen=True)
class ObjectInfo:
    key: str
    size: int
    mod_time: float


def check_key(key: str) -> str:
    """The key itself, or an error: 1 to 1024 bytes, relative, plain segments."""
    bad = not key or len(key.encode()) > 1024 or "\0" in key or "\\" in key or any(s in ("", ".", "..") for s in key.split("/"))
    if bad:
        raise CairnError(Kind.INVALID, "key", repr(key))
    return key


def cut(data: bytes, offset: int, n: int) -> bytes:
    """A range: to the end for a negative ``n``, short past it, an error for a negative offset."""
    if offset < 0:
        raise CairnError(Kind.INVALID, "range", f"offset {offset}")
    return data[offset:] if n < 0 else data[offset : offset + n]


class Store:
    """What all stores offer; ``get``, ``put``, ``create``, ``stat``, ``list`` and ``delete`` differ."""

    def get(self, key: str) -> bytes:
        raise NotImplementedError

    def get_range(self, key: str, offset: int, n: int) -> bytes:
        return cut(self.get(key), offset, n)

    def put(self, key: str, data: bytes) -> None:
        raise NotImplementedError

    def create(self, key: str, data: bytes) -> bool:
        """Put unless there is such an object; whether it was put. Of many, one wins."""
        raise NotImplementedError

    def stat(self, key: str) -> ObjectInfo:
        raise NotImplementedError

    def list(self, prefix: str = "") -> Iterator[ObjectInfo]:
        raise NotImplementedError

    def delete(self, key: str) -> None:
        """Deleting what isn't there succeeds."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LocalStore(Store):
    """Objects as files below a folder. A write is a hidden file that gets its name when whole."""

    def __init__(self, root: str | Path, fsync: bool = True):
        self.root, self.fsync = Path(root), fsync
        try:
            self.root.mkdir(parents=True, exist_ok=True)
        except OSError as e:
            raise CairnError(kind_of_os(e), "open store", e) from e

    def _path(self, key: str) -> Path:
        return self.root / check_key(key)

    def _sync(self, folder: Path) -> None:
        if self.fsync:
            fd = os.open(folder, os.O_RDONLY)
            try:
                os.fsync(fd)
            finally:
                os.close(fd)

    def _hidden(self, path: Path, data: bytes) -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        tmp = path.parent / f"{HIDDEN}{secrets.token_hex(8)}"
        with open(tmp, "xb") as f:
            f.write(data)
            if self.fsync:
                f.flush()
                os.fsync(f.fileno())
        return tmp

    def get(self, key: str) -> bytes:
        try:
            return self._path(key).read_bytes()
        except IsADirectoryError as e:
            raise CairnError(Kind.NOT_FOUND, "get", key) from e
        except OSError as e:
            raise CairnError(kind_of_os(e), "get", e) from e

    def get_range(self, key: str, offset: int, n: int) -> bytes:
        if offset < 0:
            raise CairnError(Kind.INVALID, "range", f"offset {offset}")
        try:
            with open(self._path(key), "rb") as f:
                f.seek(offset)
                return f.read() if n < 0 else f.read(n)
        except IsADirectoryError as e:
            raise CairnError(Kind.NOT_FOUND, "get", key) from e
        except OSError as e:
            raise CairnError(kind_of_os(e), "get", e) from e

    def put(self, key: str, data: bytes) -> None:
        path = self._path(key)
        try:
            tmp = self._hidden(path, data)
            os.replace(tmp, path)
            self._sync(path.parent)
        except OSError as e:
            raise CairnError(kind_of_os(e), "put", e) from e

    def create(self, key: str, data: bytes) -> bool:
        path = self._path(key)
        try:
            tmp = self._hidden(path, data)
            try:
                os.link(tmp, path)  # fails if the name is taken, and never shows half a file
            except FileExistsError:
                return False
            finally:
                tmp.unlink(missing_ok=True)
            self._sync(path.parent)
            return True
        except OSError as e:
            raise CairnError(kind_of_os(e), "create", e) from e

    def fill(self, key: str, write: Callable[[str], None], anew: bool = False) -> bool:
        """``put``, or ``create`` if ``anew``, of what ``write`` puts into a file that it is told; for what memory can't hold."""
        path = self._path(key)
        try:
            tmp = self._hidden(path, b"")
            try:
                write(str(tmp))
                if self.fsync:
                    with open(tmp, "rb") as f:
                        os.fsync(f.fileno())
                if anew:
                    os.link(tmp, path)
                else:
                    os.replace(tmp, path)
            except FileExistsError:
                return False
            finally:
                tmp.unlink(missing_ok=True)
            self._sync(path.parent)
            return True
        except OSError as e:
            raise CairnError(kind_of_os(e), "fill", e) from e

    def stat(self, key: str) -> ObjectInfo:
        path = self._path(key)
        try:
            s = path.stat()
        except OSError as e:
            raise CairnError(kind_of_os(e), "stat", e) from e
        if not path.is_file():
            raise CairnError(Kind.NOT_FOUND, "stat", key)
        return ObjectInfo(key, s.st_size, s.st_mtime)

    def list(self, prefix: str = "") -> Iterator[ObjectInfo]:
        # Only the folder that the prefix names is walked.
        base = self.root / prefix.rpartition("/")[0]
        for folder, _, names in os.walk(base):
            for name in names:
                path = Path(folder) / name
                key = path.relative_to(self.root).as_posix()
                if key.startswith(prefix) and not name.startswith(HIDDEN):
                    try:
                        s = path.stat()
                    except FileNotFoundError:
                        continue
                    yield ObjectInfo(key, s.st_size, s.st_mtime)

    def delete(self, key: str) -> None:
        try:
            self._path(key).unlink(missing_ok=True)
        except OSError as e:
            raise CairnError(kind_of_os(e), "delete", e) from e


class MemoryStore(Store):
    """Objects in a dict, with faults on demand: ``faults`` are raised one by one by the next calls."""

    def __init__(self, page: int = 3):
        self.objects: dict[str, tuple[bytes, float]] = {}
        self.page, self.faults, self.calls = page, [], 0

    def _call(self) -> None:
        self.calls += 1
        if self.faults:
            raise self.faults.pop(0)

    def _find(self, key: str) -> tuple[bytes, float]:
        if check_key(key) not in self.objects:
            raise CairnError(Kind.NOT_FOUND, "get", key)
        return self.objects[key]

    def get(self, key: str) -> bytes:
        self._call()
        return self._find(key)[0]

    def put(self, key: str, data: bytes) -> None:
        self._call()
        self.objects[check_key(key)] = (bytes(data), time.time())

    def create(self, key: str, data: bytes) -> bool:
        self._call()
        made = (bytes(data), time.time())
        return self.objects.setdefault(check_key(key), made) is made

    def stat(self, key: str) -> ObjectInfo:
        self._call()
        data, at = self._find(key)
        return ObjectInfo(key, len(data), at)

    def list(self, prefix: str = "") -> Iterator[ObjectInfo]:
        found = sorted(k for k in self.objects if k.startswith(prefix))
        for i in range(0, max(1, len(found)), self.page):
            self._call()
            for k in found[i : i + self.page]:
                if k in self.objects:
                    yield ObjectInfo(k, len(self.objects[k][0]), self.objects[k][1])

    def delete(self, key: str) -> None:
        self._call()
        self.objects.pop(check_key(key), None)


class PrefixStore(Store):
    """Another store's objects below a prefix, seen without it."""

    def __init__(self, inner: Store, prefix: str):
        self.inner, self.prefix = inner, check_key(prefix.strip("/")) + "/"

    def _key(self, key: str) -> str:
        return self.prefix + check_key(key)

    def get(self, key):
        return self.inner.get(self._key(key))

    def get_range(self, key, offset, n):
        return self.inner.get_range(self._key(key), offset, n)

    def put(self, key, data):
        self.inner.put(self._key(key), data)

    def create(self, key, data):
        return self.inner.create(self._key(key), data)

    def stat(self, key):
        s = self.inner.stat(self._key(key))
        return ObjectInfo(key, s.size, s.mod_time)

    def list(self, prefix=""):
        for s in self.inner.list(self.prefix + prefix):
            yield ObjectInfo(s.key[len(self.prefix) :], s.size, s.mod_time)

    def delete(self, key):
        self.inner.delete(self._key(key))


class RetryingStore(Store):
    """Another store, each call repeated under a policy while its failures are passing."""

    def __init__(self, inner: Store, policy):
        self.inner, self.policy = inner, policy

    def get(self, key):
        return self.policy.run(lambda: self.inner.get(key))

    def get_range(self, key, offset, n):
        return self.policy.run(lambda: self.inner.get_range(key, offset, n))

    def put(self, key, data):
        self.policy.run(lambda: self.inner.put(key, data))

    def create(self, key, data):
        return self.policy.run(lambda: self.inner.create(key, data))

    def stat(self, key):
        return self.policy.run(lambda: self.inner.stat(key))

    def list(self, prefix=""):
        return iter(self.policy.run(lambda: list(self.inner.list(prefix))))

    def delete(self, key):
        self.policy.run(lambda: self.inner.delete(key))
