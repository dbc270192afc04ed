"""Groups of arrays as files in the shared folder, memory-mapped by workers.

A file begins with the length of its header, the header (type and length of each array) and zeros up to ``ALIGN``; each
array follows at a multiple of ``ALIGN``.
"""
from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

ALIGN = 64


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def smallest(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _padding(n: int) -> int:
    return -n % ALIGN


def save(uri: str, *arrays: np.ndarray) -> None:
    """Write under another name, then move: a task that is run again leaves the same file."""
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    header = json.dumps([[x.dtype.str, len(x)] for x in arrays]).encode()
    with system.open_output_stream(draft) as out:
        out.write(len(header).to_bytes(8, "little") + header + bytes(_padding(8 + len(header))))
        for x in arrays:
            out.write(np.ascontiguousarray(x).data)
            out.write(bytes(_padding(x.nbytes)))
    system.move(draft, path)


def mapped(uri: str) -> list[np.ndarray] | None:
    """The arrays, mapped in place where the shared folder is mounted; else from a copy whose name is gone at once. None if there is no such file."""
    system, path = opened(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(system, fs.LocalFileSystem):
        return _arrays(np.memmap(path, np.uint8, "r"))
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return _arrays(np.memmap(copy.name, np.uint8, "r"))


def _arrays(raw: np.ndarray) -> list[np.ndarray]:
    n = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + n + _padding(8 + n), []
    for kind, length in json.loads(raw[8 : 8 + n].tobytes()):
        size = length * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size + _padding(size)
    return out


class Maps:
    """Files by name, each mapped when it is first needed; beyond ``most`` of them, the one unused longest is unmapped."""

    def __init__(self, folder: str, most: int = 4096):
        self.folder, self.most, self.held = folder, most, OrderedDict()

    def __getitem__(self, name: str) -> list[np.ndarray] | None:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        self.held[name] = found = mapped(f"{self.folder}/{name}")
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return found
