"""Binary files in the shared folder, opened from inside tasks.

``pyarrow.fs`` resolves the same addresses as Spark's own writers do (file,
hdfs, s3, gs), so executors need no folder of their own.
"""

from __future__ import annotations

from pyarrow import fs


def _place(address: str) -> tuple[fs.FileSystem, str]:
    if "://" not in address and address.startswith("file:"):
        address = address[5:]
    return fs.FileSystem.from_uri(address)


def open_output(address: str):
    system, path = _place(address)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_input(address: str):
    """Random access: ``size()``, ``seek()``, ``read()``."""
    system, path = _place(address)
    return system.open_input_file(path)


def read_range(address: str, start: int, length: int) -> bytes:
    with open_input(address) as f:
        f.seek(start)
        return f.read(length)


def map_file(address: str):
    """The file's bytes as an array; mapped, not read, where the shared folder
    is a mounted one."""
    import numpy as np
    import pyarrow as pa
    system, path = _place(address)
    if isinstance(system, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer(), np.uint8)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)
