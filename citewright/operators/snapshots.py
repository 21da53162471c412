"""Tables in numbered snapshots under a folder: readers keep what they opened, writers take turns, and a writer that died stops nobody.

A writer takes the next number by creating `_<number>.lock`, a file that must not exist yet, then reads the newest snapshot, writes to a hidden folder, and renames it to
`<number>-<id>`: only then can it be read. While a lock without a snapshot is younger than the lease, its writer is taken to be alive. An older one is passed over: the next
writer takes the number above. The writer that was passed over finds a higher number when it wants to commit, drops what it wrote and fails, so no snapshot can hide another's rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Busy(RuntimeError):
    """Another writer holds the next number."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, keep: int = 3, lease_s: float = 6 * 3600):
        """keep: snapshots that stay, for readers that are still at an older one."""
        self.spark, self.root, self.keep, self.lease_s = spark, root, keep, lease_s

    def _fs(self):
        path = self._path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))

    def _listed(self) -> tuple[dict[int, str], dict[int, float]]:
        """(snapshots, locks with their times in seconds) by number."""
        fs, path = self._fs()
        done, locks = {}, {}
        if fs.exists(path):
            for s in fs.listStatus(path):
                name = s.getPath().getName()
                if s.isDirectory() and name[:1].isdigit():
                    done[int(name.split("-")[0])] = s.getPath().toString()
                elif name.endswith(".lock"):
                    locks[int(name[1:-5])] = s.getModificationTime() / 1000
        return done, locks

    def current(self) -> str | None:
        """The newest snapshot's folder."""
        done = self._listed()[0]
        return done[max(done)] if done else None

    def _take(self) -> int:
        done, locks = self._listed()
        last = max([-1, *done, *locks])
        if last not in done and last >= 0 and time.time() - locks[last] < self.lease_s:
            raise Busy(f"another writer is at snapshot {last} of {self.root}")
        fs, path = self._fs()
        fs.mkdirs(path)
        try:
            fs.create(self._path(self.root, f"_{last + 1:08d}.lock"), False).close()
        except Exception as e:
            raise Busy(f"another writer is at snapshot {last + 1} of {self.root}") from e
        return last + 1

    @contextmanager
    def writer(self, wait_s: float = 0.0) -> Iterator[tuple[str | None, str]]:
        """(folder of the newest snapshot, folder to write the next one into). Committed when the block ends; dropped if it fails. Waits up to wait_s for another writer, then raises Busy."""
        until = time.time() + wait_s
        while True:
            try:
                n = self._take()
                break
            except Busy:
                if time.time() >= until:
                    raise
                time.sleep(min(0.5, max(0.0, until - time.time())))
        fs, _ = self._fs()
        lock, name = self._path(self.root, f"_{n:08d}.lock"), f"{n:08d}-{uuid.uuid4().hex[:8]}"
        hidden = self._path(self.root, f"_{name}")
        try:
            yield self.current(), hidden.toString()
            done, locks = self._listed()
            if max([n, *done, *locks]) > n:
                raise Busy(f"snapshot {n} of {self.root} took longer than its lease, and another writer has gone on")
            fs.rename(hidden, self._path(self.root, name))
        except BaseException:
            fs.delete(hidden, True)
            if max([n, *self._listed()[1]]) == n:
                fs.delete(lock, False)  # the number is free again
            raise
        self._tidy()

    def _tidy(self) -> None:
        """Old snapshots, their locks, and what dead writers left beside them go."""
        fs, path = self._fs()
        done, _ = self._listed()
        oldest = sorted(done)[-self.keep :][0]
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            number = name.lstrip("_").split("-")[0].split(".")[0]
            if number.isdigit() and int(number) < oldest:
                fs.delete(s.getPath(), True)
