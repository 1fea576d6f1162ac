"""Binary files in the shared folder, written and read by executors.

The folder is reached through Arrow's file systems, so it may be a local mount or
any store that Arrow knows.  A file's name holds the attempt that wrote it, and
readers go by the manifest that the successful attempts returned; a task that is
run again leaves at most an unread file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def write(folder: str, stem: str, suffix: str):
    """An open output stream and the file's URI."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None), uri


def read(uri: str):
    """The file, open for random access."""
    store, path = _open(uri)
    return store.open_input_file(path)
