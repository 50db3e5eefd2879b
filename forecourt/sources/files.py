"""Small files beside the tables (manifests, pointers), in any store that Arrow knows."""

from __future__ import annotations

import json


def store_of(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, data: bytes) -> None:
    store, at = store_of(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at, compression=None) as f:
        f.write(data)


def write_json(path: str, value: object) -> None:
    write_bytes(path, json.dumps(value, indent=2).encode())


def swap_json(path: str, value: object) -> None:
    """Replaces a JSON file at once: readers see the old one or the new one."""
    write_json(f"{path}.next", value)
    store, at = store_of(path)
    store.move(f"{at}.next", at)


def read_json(path: str, default: object = None) -> object:
    store, at = store_of(path)
    try:
        with store.open_input_stream(at, compression=None) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return default


def names(path: str, suffix: str = "", folders: bool = False) -> list[str]:
    """Names of the files (or folders) in a folder; none if there is no such folder."""
    from pyarrow import fs

    store, at = store_of(path)
    kind = fs.FileType.Directory if folders else fs.FileType.File
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind and f.base_name.endswith(suffix))


def remove(path: str) -> None:
    """Deletes a folder and what is in it, if it is there."""
    from pyarrow import fs

    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)
