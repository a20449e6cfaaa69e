"""Byte-level file access for Python workers, by URI, so that any shared store can be used."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    if ":" not in uri.split("/", 1)[0]:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def committed_output(uri: str):
    """A binary output stream whose file appears under its name only once it is complete."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with _removed_on_error(fs, part), fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


@contextmanager
def attempt_output(folder: str, stem: str, suffix: str):
    """(name, stream) of a file in a folder whose name no other attempt has.

    A repeated or speculative attempt of a task writes a file of its own.  What
    the task returns must carry the name: then the attempt whose result counts
    is the one whose file is read, whatever order rows came in.  Files of other
    attempts stay unread; nothing is moved, which object stores can't do.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with _removed_on_error(fs, f"{path}/{name}"), fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield name, out


@contextmanager
def _removed_on_error(fs: pafs.FileSystem, path: str):
    try:
        yield
    except BaseException:
        try:
            fs.delete_file(path)
        except OSError:
            pass
        raise


def open_input(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def remove(uri: str) -> None:
    """Delete a folder with what is in it, if it is there."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
