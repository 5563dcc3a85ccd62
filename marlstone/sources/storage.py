"""Reading and writing single files: local, over HTTP, in any store that Spark reads; routed and cached.

Scans don't go through here but through Spark's readers; this is for configurations,
indexes that are served as files, and for staging remote content.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import os
import shutil
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession

from marlstone.functions.paths import base_dir, glob_match, is_glob, path_of
from marlstone.plans.catalog import Source


class Storage(Protocol):
    def list(self, pattern: str) -> list[str]: ...
    def read(self, path: str) -> str: ...
    def write(self, path: str, content: str | bytes) -> None: ...
    def exists(self, path: str) -> bool: ...
    def remove(self, path: str) -> None: ...
    def remove_dir(self, path: str) -> None: ...


class LocalStorage:
    def __init__(self, root: str):
        self.root = Path(root)

    def list(self, pattern: str) -> list[str]:
        if not is_glob(pattern):
            return [pattern] if self.exists(pattern) else []
        top = self.root / base_dir(pattern)
        found = (str((Path(at) / n).relative_to(self.root)) for at, _, names in os.walk(top) for n in names)
        return sorted(p for p in found if glob_match(p, pattern))

    def read(self, path: str) -> str:
        return (self.root / path).read_text(encoding="utf-8")

    def write(self, path: str, content: str | bytes) -> None:
        target = self.root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode() if isinstance(content, str) else content)

    def exists(self, path: str) -> bool:
        return (self.root / path).exists()

    def remove(self, path: str) -> None:
        (self.root / path).unlink(missing_ok=True)

    def remove_dir(self, path: str) -> None:
        shutil.rmtree(self.root / path, ignore_errors=True)


class HttpStorage:
    """Read only. With compressed, a file's .gz sibling is tried first.

    A web server doesn't say what it has. The files of a catalog's source are those of the
    slugs that its exported index, served below `index` with its manifest, has lines for;
    other patterns are looked up in a manifest of all files.
    """

    def __init__(self, base: str, compressed: bool = False, manifest: str = "manifest.json", opener=urllib.request.urlopen, catalog: Mapping[str, Source] | None = None, index: str = "index"):
        self.base, self.compressed, self.manifest, self.opener = base.rstrip("/"), compressed, manifest, opener
        self.catalog, self.index = dict(catalog or {}), index.strip("/")

    def _get(self, path: str, method: str = "GET") -> bytes:
        with self.opener(urllib.request.Request(f"{self.base}/{path}", method=method), timeout=60) as got:
            return got.read()

    def read(self, path: str) -> str:
        if self.compressed:
            try:
                return gzip.decompress(self._get(f"{path}.gz")).decode()
            except (urllib.error.URLError, gzip.BadGzipFile):
                pass
        return self._get(path).decode()

    def list(self, pattern: str) -> list[str]:
        named = next((n for n, s in self.catalog.items() if s.pattern == pattern), None)
        if named is None:
            return sorted(p for p in json.loads(self._get(self.manifest)) if glob_match(p, pattern))
        return sorted({path_of(slug, pattern) for slug in self._slugs(named)}) if is_glob(pattern) else [pattern]

    def _slugs(self, source: str) -> Iterator[str]:
        """The values of a source's slug index, file by file."""
        own = f"source={source}/field=slug/"
        for file in json.loads(self._get(f"{self.index}/manifest.json")):
            if own in file:
                body = self._get(f"{self.index}/{urllib.parse.quote(file[file.index(own) :], safe='/=%')}")
                for line in (gzip.decompress(body) if file.endswith(".gz") else body).decode().splitlines():
                    if line.strip():
                        yield json.loads(line)["v"]

    def exists(self, path: str) -> bool:
        try:
            self._get(path, "HEAD")
            return True
        except urllib.error.URLError:
            return False

    def write(self, path: str, content: str | bytes) -> None:
        raise PermissionError("HTTP storage is read only")

    remove = remove_dir = lambda self, path: self.write(path, "")


class SparkStorage:
    """A folder in any file system that Spark has a client for (object stores too); a missing file is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark._jvm
        full = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return full, full.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list(self, pattern: str) -> list[str]:
        from marlstone.sources.files import text_files

        return sorted(r[0] for r in text_files(self.spark, self.root, pattern).select("path").collect())

    def read(self, path: str) -> str:
        if not self.exists(path):
            raise FileNotFoundError(f"{self.root}/{path}")
        return self.spark.read.text(f"{self.root}/{path}", wholetext=True).first()[0]

    def write(self, path: str, content: str | bytes) -> None:
        full, system = self._at(path)
        stream = system.create(full, True)
        try:
            stream.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        full, system = self._at(path)
        return bool(system.exists(full))

    def remove(self, path: str) -> None:
        full, system = self._at(path)
        system.delete(full, False)

    def remove_dir(self, path: str) -> None:
        full, system = self._at(path)
        system.delete(full, True)


class RoutedStorage:
    """Reads go to the storage of the first pattern that matches, else to the default; writes to one."""

    def __init__(self, routes: Mapping[str, Storage], default: Storage | None = None, writes: Storage | None = None):
        self.routes, self.default, self.writes = dict(routes), default, writes or default

    def _of(self, path: str) -> Storage:
        found = next((s for p, s in self.routes.items() if p == path or glob_match(path, p) or fnmatch.fnmatch(path, p)), self.default)
        if found is None:
            raise LookupError(f"No storage for {path}")
        return found

    def list(self, pattern: str) -> list[str]:
        return self._of(pattern).list(pattern)

    def read(self, path: str) -> str:
        return self._of(path).read(path)

    def exists(self, path: str) -> bool:
        return self._of(path).exists(path)

    def write(self, path: str, content: str | bytes) -> None:
        self._for_writing().write(path, content)

    def remove(self, path: str) -> None:
        self._for_writing().remove(path)

    def remove_dir(self, path: str) -> None:
        self._for_writing().remove_dir(path)

    def _for_writing(self) -> Storage:
        if self.writes is None:
            raise LookupError("No storage for writing")
        return self.writes


class CachedStorage:
    """Keeps what was read and listed; a write or removal forgets it. With a version and a folder, also between processes: another version starts empty."""

    def __init__(self, inner: Storage, version: str = "", folder: str | None = None):
        self.inner, self.files, self.lists = inner, {}, {}
        self.disk = LocalStorage(folder) if folder else None
        if self.disk and (not self.disk.exists("version") or self.disk.read("version") != version):
            self.disk.remove_dir("files")
            self.disk.write("version", version)

    def read(self, path: str) -> str:
        if path not in self.files:
            kept = f"files/{path}"
            if self.disk and self.disk.exists(kept):
                self.files[path] = self.disk.read(kept)
            else:
                self.files[path] = self.inner.read(path)
                if self.disk:
                    self.disk.write(kept, self.files[path])
        return self.files[path]

    def list(self, pattern: str) -> list[str]:
        if pattern not in self.lists:
            self.lists[pattern] = self.inner.list(pattern)
        return self.lists[pattern]

    def exists(self, path: str) -> bool:
        return path in self.files or self.inner.exists(path)

    def _forget(self, path: str) -> None:
        self.files = {p: c for p, c in self.files.items() if p != path and not p.startswith(f"{path}/")}
        self.lists.clear()
        if self.disk:
            target = self.disk.root / "files" / path
            self.disk.remove_dir(f"files/{path}") if target.is_dir() else self.disk.remove(f"files/{path}")

    def write(self, path: str, content: str | bytes) -> None:
        self.inner.write(path, content)
        self._forget(path)

    def remove(self, path: str) -> None:
        self.inner.remove(path)
        self._forget(path)

    def remove_dir(self, path: str) -> None:
        self.inner.remove_dir(path)
        self._forget(path)


def prefetch(storage: Storage, paths: Iterable[str], concurrency: int = 6) -> int:
    """Reads files ahead; how many could be read. Those that can't are left out."""

    def one(path: str) -> bool:
        try:
            storage.read(path)
            return True
        except (OSError, LookupError):
            return False

    with ThreadPoolExecutor(concurrency) as pool:
        return sum(pool.map(one, paths))
