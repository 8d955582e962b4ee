"""Fetching a catalogue: download with a digest, unpacking, and links to files that stay where they are."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import urllib.request

_PIECE = 1 << 20


def md5_of(path: str) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as f:
        while piece := f.read(_PIECE):
            digest.update(piece)
    return digest.hexdigest()


def fetch(url: str, path: str, md5: str | None = None) -> str:
    """Download to ``path``, unless it is there with the right digest; a wrong digest is an error and leaves no file."""
    if md5 is not None and os.path.exists(path) and md5_of(path) == md5:
        return path
    part = f"{path}.part"
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, _PIECE)
    if md5 is not None and (got := md5_of(part)) != md5:
        os.remove(part)
        raise ValueError(f"{url} has the digest {got}, expected {md5}")
    os.replace(part, path)
    return path


def unpack(archive: str, folder: str) -> list[str]:
    """Unpack a tar archive of any compression; members that would land outside ``folder`` are errors."""
    with tarfile.open(archive) as tar:
        tar.extractall(folder, filter="data")
        return tar.getnames()


def link_files(paths: list[str], folder: str) -> list[str]:
    """Symbolic links to the files in ``folder``; links that exist are kept."""
    os.makedirs(folder, exist_ok=True)
    links = []
    for path in paths:
        link = os.path.join(folder, os.path.basename(path))
        if not os.path.lexists(link):
            os.symlink(os.path.abspath(path), link)
        links.append(link)
    return links
