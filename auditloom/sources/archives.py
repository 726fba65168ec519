"""Members of ZIP and TAR archives, unpacked by the tasks that hold the archive's bytes."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Guards: bytes of a member, folders deep. What they refuse is listed by refused.
MAX_MEMBER, MAX_DEPTH = 500 * 1024 * 1024, 25


def safe_member(name: str) -> bool:
    """Whether a member stays inside the folder that it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0] and len(parts) <= MAX_DEPTH


def _refusal(name: str, size: int) -> str | None:
    return "unsafe or deep path" if not safe_member(name) else "too large" if size > MAX_MEMBER else None


def _members(content: bytes) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """Name, size, content and why it is refused, for each member that is no folder; of links and devices no content."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    why = _refusal(m.filename, m.file_size)
                    yield m.filename, m.file_size, None if why else z.read(m), why
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if not m.isdir():
                    why = _refusal(m.name, m.size) if m.isfile() else "not a file"
                    yield m.name, m.size, None if why else t.extractfile(m).read(), why


def members(archives: DataFrame) -> DataFrame:
    """path, content → a row for each file inside: archive, member, length, content, error (for archives that don't open).

    Members that the guards refuse have no row here but one in refused.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    for name, size, data, why in _members(content):
                        if why:
                            continue
                        yield pd.DataFrame({"archive": [path], "member": [name], "length": [size], "content": [data], "error": [None]})
                except (zipfile.BadZipFile, tarfile.TarError, OSError, RuntimeError) as e:
                    yield pd.DataFrame({"archive": [path], "member": [None], "length": [None], "content": [None], "error": [type(e).__name__]})

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, length long, content binary, error string")


def refused(archives: DataFrame) -> DataFrame:
    """path, content → a row for each member that members leaves out: archive, member, length, error (the reason)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    for name, size, _, why in _members(content):
                        if why:
                            rows.append((path, name, size, why))
                except (zipfile.BadZipFile, tarfile.TarError, OSError, RuntimeError):
                    pass  # members reports it
            yield pd.DataFrame(rows, columns=["archive", "member", "length", "error"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, length long, error string")
