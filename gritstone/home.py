"""What a user keeps between runs: settings, and templates of their own.

The folder is $GRITSTONE_HOME, else ~/.config/gritstone. Settings in config.yaml stand in for options that the command
line wasn't given. Template archives are installed from a file, never from the network.
"""

from __future__ import annotations

import os
import shutil
import stat
import tempfile
import zipfile
from dataclasses import dataclass, fields
from pathlib import Path, PurePosixPath

import yaml

MOST_FILES, MOST_BYTES = 10_000, 64 << 20


def folder() -> Path:
    return Path(os.environ.get("GRITSTONE_HOME") or Path.home() / ".config" / "gritstone")


@dataclass(frozen=True)
class Config:
    """templates: a path in place of the detectors; min_severity, strict_imports: as the options of these names."""

    templates: str = ""
    min_severity: str = ""
    strict_imports: bool = False

    @staticmethod
    def load() -> Config:
        """The settings; the usual ones where there is no file. A key that isn't known, or a value of another type, is an error."""
        path = folder() / "config.yaml"
        if not path.is_file():
            return Config()
        try:
            given = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"{path}: {e}") from e
        known = {f.name: type(f.default) for f in fields(Config)}
        if not isinstance(given, dict) or set(given) - set(known):
            raise ValueError(f"{path}: settings are {sorted(known)}")
        for k, v in given.items():
            if type(v) is not known[k]:
                raise ValueError(f"{path}: {k} is a {known[k].__name__}")
        return Config(**given)


def install(archive: str) -> Path:
    """Put the templates of a zip file in place of those installed before, all or none: no links, nothing outside the folder, bounded in number and size."""
    target = folder() / "templates"
    target.parent.mkdir(parents=True, exist_ok=True)
    fresh = Path(tempfile.mkdtemp(prefix="templates-", dir=target.parent))
    try:
        with zipfile.ZipFile(archive) as z:
            members = [m for m in z.infolist() if not m.is_dir()]
            if len(members) > MOST_FILES or sum(m.file_size for m in members) > MOST_BYTES:
                raise ValueError(f"{archive} holds too much")
            for m in members:
                inner = PurePosixPath(m.filename.replace("\\", "/"))
                if inner.is_absolute() or ".." in inner.parts or ":" in m.filename or stat.S_ISLNK(m.external_attr >> 16):
                    raise ValueError(f"{archive}: {m.filename} leads outside")
                if inner.suffix not in (".yaml", ".yml"):
                    continue
                out = fresh.joinpath(*inner.parts)
                out.parent.mkdir(parents=True, exist_ok=True)
                with z.open(m) as source, out.open("wb") as sink:
                    left = m.file_size + 1
                    while left > 0 and (piece := source.read(min(1 << 16, left))):
                        sink.write(piece)
                        left -= len(piece)
                    if left <= 0:
                        raise ValueError(f"{archive}: {m.filename} is larger than it says")
        old = target.with_name(fresh.name + "-old")
        if target.exists():
            target.rename(old)
        fresh.rename(target)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)
    return target
