"""Files in the shared folder, from executors: each written whole under a name of its own, read by byte ranges."""

from __future__ import annotations

import uuid
from functools import lru_cache


@lru_cache(8)
def _store(scheme: str, host: str):
    from pyarrow import fs

    if not scheme or scheme == "file":
        return fs.LocalFileSystem()
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def store_and_path(uri: str):
    """The file system of a uri such as spark.checkpoint.dir's, and the path in it."""
    scheme, found, rest = uri.partition("://")
    if not found:
        return (_store("", ""), uri.removeprefix("file:"))
    host, _, path = rest.partition("/")
    if scheme == "file":
        return _store(scheme, ""), "/" + path
    return _store(scheme, host), ("/" + path if scheme in ("hdfs", "viewfs") else f"{host}/{path}")


class NewFile:
    """A file that no other attempt of the task writes to; only rows of a finished attempt name it."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        store, path = store_and_path(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None, buffer_size=1 << 20)
        self.size = 0

    def write(self, data) -> int:
        """Returns the offset at which data begins."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Ranges:
    """Reads byte ranges of files, the last file kept open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            store, path = store_and_path(uri)
            self.uri, self.file = uri, store.open_input_file(path)
        out = self.file.read_at(length, offset)
        if len(out) != length:
            raise OSError(f"{uri}: {len(out)} of {length} bytes at {offset}")
        return bytes(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.uri, self.file = None, None
