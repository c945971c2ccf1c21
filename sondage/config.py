"""Configuration: defaults, validation per key, TOML file, move from an older JSON file."""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

from sondage.errors import InvalidInput
from sondage.operators.quant import QuantConfig


def _int(least: int) -> Callable:
    def check(key: str, value) -> int:
        try:
            n = int(value) if not isinstance(value, bool) else None
        except (TypeError, ValueError):
            n = None
        if n is None or n < least:
            raise InvalidInput(f"{key} is {value!r}", f"a whole number of at least {least}")
        return n

    return check


def _bool(key: str, value) -> bool:
    text = str(value).lower()
    if text not in ("true", "false", "1", "0", "t", "f"):
        raise InvalidInput(f"{key} is {value!r}", "true or false")
    return text in ("true", "1", "t")


def _one_of(*allowed) -> Callable:
    def check(key: str, value):
        for a in allowed:
            if str(value) == str(a):
                return a
        raise InvalidInput(f"{key} is {value!r}", "one of " + ", ".join(map(str, allowed)))

    return check


def _text(key: str, value) -> str:
    return str(value)


def _required(key: str, value) -> str:
    if not str(value):
        raise InvalidInput(f"{key} has no value")
    return str(value)


@dataclass
class Config:
    ollama_url: str = "http://localhost:11434/api/embeddings"
    model: str = "qwen3-embedding:0.6b"
    embedding_dim: int = 768
    timeout_seconds: int = 120
    retry_count: int = 2
    retry_backoff_ms: int = 500
    index_cooldown_seconds: int = 5
    vector_backend: str = "parquet"
    vector_quantization: str = "off"
    vector_quant_bits: int = 4
    vector_quantized_shortlist: int = 200
    vector_exact_rerank: bool = True
    rerank_query: bool = False
    rerank_model: str = ""
    rerank_timeout_seconds: int = 120
    expand_query: bool = False
    expand_model: str = ""
    expand_timeout_seconds: int = 120

    def set(self, key: str, value) -> None:
        if key not in CHECKS:
            raise InvalidInput(f"no key {key}", "keys: " + ", ".join(CHECKS))
        setattr(self, key, CHECKS[key](key, value))

    def quant(self) -> QuantConfig | None:
        if self.vector_quantization in ("", "off"):
            return None
        return QuantConfig(self.vector_quant_bits, self.vector_quantization, 42, self.vector_quantized_shortlist, self.vector_exact_rerank)


CHECKS: dict[str, Callable] = {
    "ollama_url": _required, "model": _required, "embedding_dim": _int(1), "timeout_seconds": _int(1), "retry_count": _int(0), "retry_backoff_ms": _int(1),
    "index_cooldown_seconds": _int(1), "vector_backend": _one_of("parquet"), "vector_quantization": _one_of("off", "turbo-prod"), "vector_quant_bits": _one_of(2, 3, 4),
    "vector_quantized_shortlist": _int(1), "vector_exact_rerank": _bool, "rerank_query": _bool, "rerank_model": _text, "rerank_timeout_seconds": _int(1),
    "expand_query": _bool, "expand_model": _text, "expand_timeout_seconds": _int(1),
}


def load(path: str) -> Config:
    """Defaults overlaid with the file's values; a JSON file beside a missing TOML file is moved to it first."""
    old = os.path.splitext(path)[0] + ".json"
    config = Config()
    if not os.path.exists(path) and os.path.exists(old):
        with open(old) as f:
            values = json.load(f)
        _overlay(config, values, known_only=True)
        save(path, config)
        os.rename(old, old + ".bak")
    if os.path.exists(path):
        with open(path, "rb") as f:
            _overlay(config, tomllib.load(f))
    return config


def _overlay(config: Config, values: dict, known_only: bool = False) -> None:
    for key, value in values.items():
        if key in CHECKS or not known_only:
            config.set(key, value)


def save(path: str, config: Config) -> None:
    lines = [f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in dataclasses.asdict(config).items()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w") as f:
        f.writelines(lines)
    os.replace(path + ".tmp", path)
