"""Registry of models, process-wide on the driver, and the cache that holds their files."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.request
from pathlib import Path

from impactspark.functions.encoders import Encoder
from impactspark.sources.vocabulary import vocab_sha256

MAX_MODELS = 16
QUANTS = ("q8", "f16")
ALIASES: dict[str, str] = {"mini": "mini", "base": "base", "multilingual": "multilingual"}
_MODELS: dict[str, Encoder] = {}


def register_model(name: str, encoder: Encoder) -> str:
    """Make an encoder known by name; a name that is known is replaced."""
    if not re.fullmatch(r"\S+", name or ""):
        raise ValueError("a model needs a name without spaces")
    if name not in _MODELS and len(_MODELS) >= MAX_MODELS:
        raise RuntimeError("model registry full")
    _MODELS[name] = encoder
    return "ok"


def get_model(name: str) -> Encoder:
    if name not in _MODELS:
        raise LookupError(f"model '{name}' is not registered")
    return _MODELS[name]


def vocab_hash(encoder: Encoder) -> str:
    """The hash of an encoder's vocabulary, counted once."""
    if not hasattr(encoder, "_vocab_sha256"):
        encoder._vocab_sha256 = vocab_sha256(encoder.vocab())  # type: ignore[attr-defined]
    return encoder._vocab_sha256  # type: ignore[attr-defined]


def is_registered(name: str) -> bool:
    return name in _MODELS


def unregister_model(name: str) -> None:
    _MODELS.pop(name, None)


def cache_dir() -> Path:
    """Where model files are kept: IMPACTSPARK_CACHE, else the user's cache folder."""
    own = os.environ.get("IMPACTSPARK_CACHE")
    path = Path(own) if own else Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "impactspark"
    path.mkdir(parents=True, exist_ok=True)
    return path


def fetch(alias: str = "mini", quant: str = "q8", source: str | None = None, sha256: dict[str, str] | None = None) -> tuple[Path, Path]:
    """model_files(), after getting what is missing from source/alias/file; the source is a URL, or IMPACTSPARK_MODELS.

    A file is written under another name until it is whole and, where sha256 holds its name, has that hash.
    """
    source = source or os.environ.get("IMPACTSPARK_MODELS")
    for path in _paths(alias, quant):
        if path.exists():
            continue
        if not source:
            raise FileNotFoundError(f"cannot open {path}, and there is no source to fetch it from")
        path.parent.mkdir(parents=True, exist_ok=True)
        part, h = path.with_name(f"{path.name}.part"), hashlib.sha256()
        with urllib.request.urlopen(f"{source.rstrip('/')}/{alias}/{path.name}") as got, part.open("wb") as out:
            while data := got.read(1 << 20):
                out.write(data)
                h.update(data)
        want = (sha256 or {}).get(path.name)
        if want and want != h.hexdigest():
            part.unlink()
            raise ValueError(f"{path.name} has another hash than {want}")
        part.replace(path)
    return model_files(alias, quant)


def _paths(alias: str, quant: str) -> tuple[Path, Path]:
    if alias not in ALIASES:
        raise KeyError("unknown model alias " + alias + ", known are " + ", ".join(sorted(ALIASES)))
    if quant not in QUANTS:
        raise ValueError("quant must be one of " + ", ".join(QUANTS))
    folder = cache_dir() / alias
    return folder / f"{ALIASES[alias]}_{quant}.gguf", folder / f"{ALIASES[alias]}.sprs"


def model_files(alias: str, quant: str = "q8") -> tuple[Path, Path]:
    """The cached weight file and sidecar of an alias; fetch() gets those that are missing."""
    found = _paths(alias, quant)
    missing = [str(p) for p in found if not p.exists()]
    if missing:
        raise FileNotFoundError("cannot open " + ", ".join(missing))
    return found
