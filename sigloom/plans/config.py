"""Index settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from sigloom.functions.params import parse_size


@dataclass(frozen=True)
class IndexConfig:
    """k-mer size, filter bits and hashes; `compression` is that of the index's Parquet files."""

    k: int = 31
    m: int = 25_000_000
    h: int = 3
    path: str = "index"
    compression: str = "zstd"
    max_build_bytes: int | None = None

    def __post_init__(self) -> None:
        if min(self.k, self.m, self.h) < 1:
            raise ValueError("k, m and h are positive")

    @staticmethod
    def load(path: str | None = None, variable: str = "SIGLOOM_CONFIG") -> IndexConfig:
        """From a JSON file or one of plain `key: value` lines, named here or by an environment variable; else the defaults."""
        path = path or os.environ.get(variable)
        if not path:
            return IndexConfig()
        with open(path) as file:
            text = file.read()
        if text.lstrip().startswith("{"):
            found = json.loads(text)
        else:
            pairs = (line.split("#")[0].partition(":") for line in text.splitlines())
            found = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs if v.strip() and k == k.lstrip()}
        if "max_build_mem_bytes" in found:
            found["max_build_bytes"] = parse_size(str(found["max_build_mem_bytes"]))
        known = {f.name for f in fields(IndexConfig)}
        whole = ("k", "m", "h", "max_build_bytes")
        return IndexConfig(**{k: int(v) if k in whole and v is not None else v for k, v in found.items() if k in known})
