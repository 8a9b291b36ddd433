"""Files of numpy arrays in the shared folder, written whole and mapped by workers."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

from ..session import local_path


def _open(path: str):
    """(file system, path on it); a folder of this machine's file tree can be mapped."""
    if path.startswith("file:") or "://" not in path:
        return None, "/" + local_path(path).lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another behind a header.  Written aside, then moved into
    place, so a task that runs twice leaves one whole file."""
    at, head, body = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, a.shape, at)
        body += [a.tobytes(), bytes(-a.nbytes % 64)]
        at += a.nbytes + -a.nbytes % 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    raw = b"".join([len(text).to_bytes(8, "little"), text, *body])
    system, p = _open(path)
    aside = f"{p}.{uuid.uuid4().hex[:8]}"
    if system is None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(aside, "wb") as f:
            f.write(raw)
        os.replace(aside, p)
    else:
        system.create_dir(os.path.dirname(p), recursive=True)
        with system.open_output_stream(aside) as f:
            f.write(raw)
        system.move(aside, p)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """Arrays of a file: mapped where the shared folder is mounted, else read."""
    system, p = _open(path)
    if system is None:
        raw = np.memmap(p, dtype=np.uint8, mode="r")
    else:
        with system.open_input_file(p) as f:
            raw = np.frombuffer(f.read(), dtype=np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8:8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + n + at:8 + n + at + size].view(kind).reshape(shape) if size else np.empty(shape, kind)
    return out
