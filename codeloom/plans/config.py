"""Configuration: environment over file over defaults."""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import dataclass, field, fields

LEVELS = {"DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "WARNING": logging.WARNING, "ERROR": logging.ERROR}
VARIABLES = {
    "cache_root": "CODELOOM_CACHE",
    "log_level": "CODELOOM_LOG_LEVEL",
    "log_file": "CODELOOM_LOG_FILE",
    "max_files": "CODELOOM_MAX_FILES",
    "batch_size": "CODELOOM_ENRICH_BATCH_SIZE",
}


@dataclass
class Config:
    cache_root: str = field(default_factory=lambda: os.path.expanduser("~/.codeloom"))
    cache_shared: bool = False
    log_level: str = "WARNING"
    log_file: str = ""
    max_file_bytes: int = 2 << 20
    null_share: float = 0.001
    extra_secret_filenames: list[str] = field(default_factory=list)
    extra_ignore_filenames: list[str] = field(default_factory=list)
    extra_secret_patterns: list[str] = field(default_factory=list)
    max_files: int = 500
    batch_size: int = 4
    enrich_timeout_s: float = 60.0
    enrich_disabled: bool = False


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """The configuration; a file that doesn't exist is as good as an empty one, one that can't be read is an error."""
    environ = dict(os.environ) if environ is None else environ
    out = Config()
    if root := environ.get(VARIABLES["cache_root"]):
        out.cache_root = root
    path = path or os.path.join(out.cache_root if "://" not in out.cache_root else os.path.expanduser("~/.codeloom"), "config.toml")
    if os.path.exists(path):
        with open(path, "rb") as f:
            said = tomllib.load(f)
        flat = {k: v for part in said.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in said.items() if not isinstance(v, dict)}
        for f_ in fields(Config):
            if f_.name in flat:
                setattr(out, f_.name, flat[f_.name])
    for name, variable in VARIABLES.items():
        if variable in environ:
            kind = type(getattr(out, name))
            setattr(out, name, kind(environ[variable]))
    return out


def log_level(name: str) -> int:
    """Warnings for a name that isn't known."""
    return LEVELS.get(name.strip().upper(), logging.WARNING)
