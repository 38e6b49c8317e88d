"""A content-addressed store: each key's files are published whole or not at all.

A key's folder holds attempts, and versions: small files that name an attempt. A writer
fills an attempt of its own and then creates the next version's file, which only one writer
can; nothing is moved. The highest version whose file is whole is what readers see, so a writer
that dies leaves an attempt that nobody sees, and never takes away what was there before.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

from . import files

T = TypeVar("T")
#: The end of a version's file: without it, its writer has not come to the end.
_END = "\n"


def safe(name: str) -> str:
    """An identifier that can be a directory's name."""
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"unsafe identifier {name!r}")
    return name


class Store:
    def __init__(self, root: str):
        self.root = root

    def folder(self, stage: str, key: str) -> str:
        return os.path.join(self.root, safe(stage), safe(key))

    def _versions(self, stage: str, key: str) -> list[tuple[str, str]]:
        """Versions' files and the attempts that they name, oldest first; None stands for a file that isn't whole."""
        at = self.folder(stage, key)
        found = []
        for name in files.names(at):
            if name.startswith("version-"):
                told = files.read(os.path.join(at, name)).decode()
                found.append((name, told.removesuffix(_END) if told.endswith(_END) else None))
        return found

    def keys(self, stage: str) -> list[str]:
        return [x for x in files.names(os.path.join(self.root, safe(stage))) if self.has(stage, x)]

    def path(self, stage: str, key: str) -> str:
        """Where the published files are."""
        whole = [attempt for _, attempt in self._versions(stage, key) if attempt is not None]
        return os.path.join(self.folder(stage, key), whole[-1] if whole else "nothing")

    def lookup(self, stage: str, key: str) -> str | None:
        return self.path(stage, key) if self.has(stage, key) else None

    def has(self, stage: str, key: str) -> bool:
        return any(attempt is not None for _, attempt in self._versions(stage, key))

    @contextmanager
    def reserve(self, stage: str, key: str, replace: bool = False) -> Iterator[str]:
        """A folder that becomes the key's when the block ends well. The first to publish wins; with `replace`, the last.

        A failure leaves the key as it was.
        """
        at = self.folder(stage, key)
        attempt = f"attempt-{uuid.uuid4().hex}"
        scratch = os.path.join(at, attempt)
        files.make_dir(scratch)
        published = False
        try:
            yield scratch
            published = self._publish(stage, key, attempt, replace)
        finally:
            if not published:
                files.remove(scratch)
        if published:
            self._sweep(stage, key)

    def _publish(self, stage: str, key: str, attempt: str, replace: bool) -> bool:
        while True:
            versions = self._versions(stage, key)
            if not replace and any(x is not None for _, x in versions):
                return False
            number = 1 + max((int(name.rsplit("-", 1)[-1]) for name, _ in versions), default=0)
            if files.create(os.path.join(self.folder(stage, key), f"version-{number:09d}"), (attempt + _END).encode()):
                return True

    def _sweep(self, stage: str, key: str) -> None:
        """Drop versions but the last two whole ones: who reads the one before may go on."""
        whole = [(name, attempt) for name, attempt in self._versions(stage, key) if attempt is not None]
        for name, attempt in whole[:-2]:
            files.remove(os.path.join(self.folder(stage, key), name))
            files.remove(os.path.join(self.folder(stage, key), attempt))

    def forget(self, stage: str, key: str) -> None:
        files.remove(self.folder(stage, key))

    def cached(self, stage: str, key: str, load: Callable[[str], T], make: Callable[[str], None]) -> tuple[T, bool]:
        """What `load` reads from the key's files, and whether they were there; `make` writes them where they are missing or `load` refuses them."""
        there = self.lookup(stage, key)
        if there is not None:
            with suppress(OSError, ValueError):
                return load(there), True
        with self.reserve(stage, key, replace=there is not None) as at:
            make(at)
        return load(self.path(stage, key)), False
