"""Side effects on files: a port, and the driver's loop that carries out a plan item by item."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol


class FileOps(Protocol):
    def same_volume(self, a: str, b: str) -> bool: ...

    def free_space(self, path: str) -> int: ...

    def move(self, a: str, b: str) -> None: ...

    def copy(self, a: str, b: str) -> None: ...

    def checksum(self, path: str) -> str: ...

    def trash(self, path: str) -> None: ...

    def restore(self, path: str) -> None: ...

    def exists(self, path: str) -> bool: ...

    def remove(self, path: str) -> None: ...


class LocalFiles:
    """Files of the machine that runs the driver, with a trash folder of its own."""

    def __init__(self, trash_dir: str):
        self.trash_dir = trash_dir

    def _trashed(self, path: str) -> str:
        return os.path.join(self.trash_dir, hashlib.sha256(path.encode()).hexdigest())

    def same_volume(self, a: str, b: str) -> bool:
        def volume(p: str) -> int:
            while not os.path.exists(p):
                p = os.path.dirname(p)
            return os.stat(p).st_dev

        return volume(a) == volume(b)

    def free_space(self, path: str) -> int:
        while not os.path.exists(path):
            path = os.path.dirname(path)
        return shutil.disk_usage(path).free

    def move(self, a: str, b: str) -> None:
        os.makedirs(os.path.dirname(b), exist_ok=True)
        os.rename(a, b)

    def copy(self, a: str, b: str) -> None:
        """By a partial file, so that no broken file ever has the final name."""
        os.makedirs(os.path.dirname(b), exist_ok=True)
        shutil.copy2(a, f"{b}.part")
        os.replace(f"{b}.part", b)

    def checksum(self, path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def trash(self, path: str) -> None:
        os.makedirs(self.trash_dir, exist_ok=True)
        shutil.move(path, self._trashed(path))

    def restore(self, path: str) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        shutil.move(self._trashed(path), path)

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def remove(self, path: str) -> None:
        for p in (path, f"{path}.part"):
            if os.path.exists(p):
                os.remove(p)


@dataclass
class Item:
    media_id: str
    from_path: str
    to_path: str
    same_drive: bool
    state: str = "pending"


class NotEnoughSpace(Exception):
    """The target volume has less room than a plan needs."""


#: Gets (item, new state, checksum or error) after each step and keeps it before the next one begins.
Record = Callable[[Item, str, str | None], None]


def apply(items: Iterable[Item], ops: FileOps, record: Record, target_root: str, space_required: int = 0, stop_on_error: bool = False) -> str:
    """Carry out a plan, each item from the state it is in, and say how the plan ends: done or failed.

    Every step is recorded as soon as it is done; a run that was cut off goes on where the log says, and a file
    that had already reached its place is recognised.  Originals go to the trash only after checksums agree.
    """
    if space_required > 0 and ops.free_space(target_root) < space_required:
        raise NotEnoughSpace(f"{space_required} bytes are needed")
    failed = False
    for item in items:
        if item.state in ("done", "failed"):
            failed |= item.state == "failed"
            continue
        try:
            for state, note in _steps(item, ops):
                item.state = state
                record(item, state, note)
        except OSError as e:
            failed, item.state = True, "failed"
            record(item, "failed", str(e))
            if stop_on_error:
                raise
    return "failed" if failed else "done"


def _steps(item: Item, ops: FileOps) -> Iterable[tuple[str, str | None]]:
    a, b = item.from_path, item.to_path
    if item.same_drive:
        if item.state == "pending":
            if ops.exists(a) or not ops.exists(b):
                ops.move(a, b)
            yield "renamed", None
        yield "done", None
        return
    if item.state == "pending":
        ops.copy(a, b)
        yield "copied", None
    if item.state == "copied":
        want, got = ops.checksum(a), ops.checksum(b)
        if want != got:
            ops.remove(b)
            raise OSError(f"checksum of {b} differs; the original is untouched")
        yield "verified", got
    if item.state == "verified":
        if ops.exists(a):
            ops.trash(a)
        yield "source_trashed", None
    yield "done", None


def undo(steps: Iterable[tuple[str, str, str]], ops: FileOps) -> None:
    """Take back journaled steps (op, present path, former path), given last first."""
    for op, now_at, was_at in steps:
        if op == "move":
            ops.move(now_at, was_at)
        else:
            try:
                ops.restore(was_at)
            except OSError:
                ops.copy(now_at, was_at)
            ops.trash(now_at)
