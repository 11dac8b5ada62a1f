"""Sidecar files of a masked-language-model head: header, seven little-endian float arrays, and the vocabulary."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

MAGIC, VERSION = b"SPRS", 1
_HEADER = struct.Struct("<4s5I8x")
_LENGTH = struct.Struct("<I")
MIN_DIM, MAX_HIDDEN, MAX_VOCAB = 8, 16_384, 1 << 24


@dataclass
class Sidecar:
    dense_w: np.ndarray
    dense_b: np.ndarray
    norm_gain: np.ndarray
    norm_bias: np.ndarray
    decoder_w: np.ndarray
    decoder_b: np.ndarray
    query_w: np.ndarray
    tokens: list[str]
    activation: int = 0
    sha256: str = field(default="", compare=False)

    @property
    def hidden(self) -> int:
        return len(self.dense_b)


def _shapes(hidden: int, terms: int) -> list[tuple[int, ...]]:
    return [(hidden, hidden), (hidden,), (hidden,), (hidden,), (terms, hidden), (terms,), (terms,)]


def read_sidecar(path: str) -> Sidecar:
    """Parse a file; one of another version, form or size is refused."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"cannot open {path}")
    data = p.read_bytes()
    if len(data) < _HEADER.size:
        raise ValueError(f"{path} is not a sidecar file")
    magic, version, hidden, terms, form, activation = _HEADER.unpack_from(data)
    fits = MIN_DIM <= hidden <= MAX_HIDDEN and MIN_DIM <= terms <= MAX_VOCAB
    if magic != MAGIC or version != VERSION or form != 0 or activation > 1 or not fits:
        raise ValueError(f"{path} is not a sidecar file of version {VERSION}")
    at, arrays = _HEADER.size, []
    for shape in _shapes(hidden, terms):
        n = int(np.prod(shape))
        if at + 4 * n > len(data):
            raise ValueError(f"{path} ends too early")
        arrays.append(np.frombuffer(data, "<f4", n, at).reshape(shape))
        at += 4 * n
    if at + _LENGTH.size > len(data):
        raise ValueError(f"{path} ends too early")
    (size,) = _LENGTH.unpack_from(data, at)
    blob = data[at + _LENGTH.size : at + _LENGTH.size + size]
    if len(blob) != size:
        raise ValueError(f"{path} ends too early")
    return Sidecar(*arrays, tokens=blob.decode().split("\n"), activation=activation, sha256=hashlib.sha256(data).hexdigest())


def write_sidecar(path: str, s: Sidecar) -> None:
    parts = [s.dense_w, s.dense_b, s.norm_gain, s.norm_bias, s.decoder_w, s.decoder_b, s.query_w]
    for a, shape in zip(parts, _shapes(s.hidden, len(s.decoder_b)), strict=True):
        if a.shape != shape:
            raise ValueError(f"an array has shape {a.shape}, not {shape}")
    blob = "\n".join(s.tokens).encode()
    with open(path, "wb") as f:
        f.write(_HEADER.pack(MAGIC, VERSION, s.hidden, len(s.decoder_b), 0, s.activation))
        for a in parts:
            f.write(np.ascontiguousarray(a, "<f4").tobytes())
        f.write(_LENGTH.pack(len(blob)) + blob)


def extract_sidecar(model_id: str, path: str, activation: int = 0) -> Sidecar:
    """Write the sidecar of a checkpoint; needs torch and transformers, which are optional."""
    try:
        from transformers import AutoModelForMaskedLM, AutoTokenizer
    except ImportError as e:
        raise RuntimeError("extracting a sidecar needs the optional packages torch and transformers") from e
    model = AutoModelForMaskedLM.from_pretrained(model_id)
    state = {name: t.float().cpu().numpy() for name, t in model.state_dict().items()}
    head = "cls.predictions."
    decoder = state["bert.embeddings.word_embeddings.weight"]
    tokenizer = AutoTokenizer.from_pretrained(model_id)
    weights = state.get("query_weight", np.zeros(len(decoder), np.float32)).ravel()
    out = Sidecar(
        state[head + "transform.dense.weight"],
        state[head + "transform.dense.bias"],
        state[head + "transform.LayerNorm.weight"],
        state[head + "transform.LayerNorm.bias"],
        decoder,
        state[head + "bias"],
        weights,
        tokenizer.convert_ids_to_tokens(list(range(len(decoder)))),
        activation,
    )
    write_sidecar(path, out)
    return out
