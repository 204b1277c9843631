"""Files that arrive in numbered chunks."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass


class UploadError(ValueError):
    """A chunk or an upload that is not the expected one."""


@dataclass
class Upload:
    path: str
    name: str
    next_chunk: int = 0
    size: int = 0
    finished: bool = False


class Uploads:
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.open: dict[str, Upload] = {}

    def begin(self, name: str) -> str:
        if not name.lower().endswith(".nt"):
            raise UploadError("only .nt files are accepted")
        os.makedirs(self.folder, exist_ok=True)
        key = uuid.uuid4().hex
        path = os.path.join(self.folder, f"{key}.nt")
        open(path, "wb").close()
        self.open[key] = Upload(path, os.path.basename(name))
        return key

    def chunk(self, key: str, number: int, data: bytes, last: bool = False) -> Upload:
        """Append the next chunk; any other number is refused."""
        if key not in self.open:
            raise UploadError("unknown upload")
        up = self.open[key]
        if up.finished or number != up.next_chunk:
            raise UploadError(f"expected chunk {up.next_chunk}, got {number}")
        with open(up.path, "ab") as f:
            f.write(data)
        up.next_chunk, up.size, up.finished = up.next_chunk + 1, up.size + len(data), last
        return up

    def take(self, key: str) -> str:
        if key not in self.open:
            raise UploadError("unknown upload")
        return self.open[key].path

    def drop(self, key: str) -> None:
        up = self.open.pop(key, None)
        if up and os.path.exists(up.path):
            os.remove(up.path)
