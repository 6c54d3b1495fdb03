"""Files in the shared folder, from any task: local paths, or any file system that pyarrow knows by URI."""

from __future__ import annotations

import numpy as np
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    system, path = opened(uri)
    return system.open_output_stream(path, compression=None)


def whole(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def mapped(uri: str, dtype: str):
    """The file as an array: memory-mapped where it is local, else a reader that fetches the ranges it is asked for."""
    system, path = opened(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.zeros(0, dtype)
    return _Ranges(system.open_input_file(path), np.dtype(dtype))


class _Ranges:
    def __init__(self, file, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, s: slice) -> np.ndarray:
        a, b, _ = s.indices(len(self))
        self.file.seek(a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)
