"""A sink that copies files out, verified, all or nothing.

Rows are (path, content, sha256, bytes): a file and what its manifest says of it. Tasks write below
a staging folder beside the target and digest what they write; the commit publishes the folder by
one rename, and only if every file of every task had its manifest's digest and size. What fails,
in a task or in the check, leaves nothing at the target. An existing target is refused, at the
start and again at the commit.

    spark.dataSource.register(CopyOut)
    rows.write.format("copyout").mode("append").save("/shared/target")

The target is a path or URI of a file system that all executors share (file, hdfs, gs, abfss, s3).

Defined results: a path that is null, absolute, empty, or holds ``..``, ``\\\\``, ``:`` or an empty part is
refused; so is a file without content, and a path that repeats within a task (repeats over tasks
end in one file of the same digest, or in a mismatch of counts). Null digests match nothing. An
empty table makes an empty target. Driver and commit see counts and a few names, never a list of files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of refused files that an error tells.
NAMED = 10


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:").rstrip("/")
    found, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return found, path.rstrip("/")


def _there(system: pafs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != pafs.FileType.NotFound


def refused(path: str | None) -> str | None:
    """Why a path can't be copied to, or None."""
    if not path:
        return "no path"
    if path.startswith("/") or "\\" in path or ":" in path or {"", ".", ".."} & set(path.split("/")):
        return "bad path"
    return None


@dataclass
class Copied(WriterCommitMessage):
    files: int
    bytes: int
    bad: list[str]
    n_bad: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, target: str):
        self.target = target.rstrip("/")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex[:12]}"
        system, path = _place(self.target)
        if _there(system, path):
            raise FileExistsError(f"target exists: {self.target}")

    def write(self, iterator: Iterator) -> Copied:
        system, root = _place(self.staging)
        system.create_dir(root, recursive=True)
        seen, done, size, bad, n_bad = set(), 0, 0, [], 0
        for batch in iterator:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "content", "sha256", "bytes")), strict=True):
                path, content, digest, length = row
                why = refused(path) or ("no content" if content is None else "repeated" if path in seen else None)
                if why is None:
                    seen.add(path)
                    found = hashlib.sha256(content)
                    if found.hexdigest() != digest or len(content) != length:
                        why = "not what the manifest says"
                if why:
                    n_bad += 1
                    if len(bad) < NAMED:
                        bad.append(f"{path}: {why}")
                    continue
                if "/" in path:
                    system.create_dir(f"{root}/{path.rpartition('/')[0]}", recursive=True)
                part = f"{root}/{path}.{uuid.uuid4().hex[:8]}"  # an attempt that dies leaves no half file under the name
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content)
                system.move(part, f"{root}/{path}")
                done, size = done + 1, size + len(content)
        return Copied(done, size, bad, n_bad)

    def commit(self, messages: list[Copied | None]) -> None:
        told = [m for m in messages if m is not None]
        system, root = _place(self.staging)
        target = _place(self.target)[1]
        n_bad = sum(m.n_bad for m in told)
        try:
            if n_bad or len(told) < len(messages):
                raise ValueError(f"{n_bad} files refused, nothing published: {'; '.join([b for m in told for b in m.bad][:NAMED])}")
            if _there(system, target):
                raise FileExistsError(f"target exists: {self.target}")
            system.create_dir(root, recursive=True)
            self._count(system, root, sum(m.files for m in told))
            system.move(root, target)
        except Exception:
            self._clear(system, root)
            raise

    @staticmethod
    def _count(system: pafs.FileSystem, root: str, files: int) -> None:
        """Files there, without what attempts that died have left, are those that were told."""
        left, there = 0, 0
        for info in system.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type == pafs.FileType.File:
                suffix = info.base_name.rpartition(".")[2]
                part = len(suffix) == 8 and all(c in "0123456789abcdef" for c in suffix) and _there(system, info.path[: -len(suffix) - 1])
                if part:
                    system.delete_file(info.path)
                left, there = left + part, there + (not part)
        if there != files:
            raise ValueError(f"{there} files are there, {files} were written: a path repeats over tasks")

    def abort(self, messages: list[Copied | None]) -> None:
        self._clear(*_place(self.staging))

    @staticmethod
    def _clear(system: pafs.FileSystem, root: str) -> None:
        if _there(system, root):
            system.delete_dir(root)


class CopyOut(DataSource):
    """Sink ``copyout``: option ``path`` (the target)."""

    @classmethod
    def name(cls) -> str:
        return "copyout"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("copyout never overwrites")
        if missing := {"path", "content", "sha256", "bytes"} - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return _Writer(self.options["path"])
