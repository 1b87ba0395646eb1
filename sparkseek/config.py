"""Settings, validated where they are made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Metric(Enum):
    """Scores are higher for closer vectors under each: Euclidean's is the negated distance."""

    COSINE = "cosine"
    DOT = "dot"
    EUCLIDEAN = "euclidean"


class Quantization(Enum):
    NONE = "none"
    INT8 = "int8"
    BINARY = "binary"


def at_least(name: str, value: int, least: int = 1) -> int:
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


@dataclass(frozen=True)
class GraphConfig:
    """Of the approximate graph strategy; layer 0 has up to 2 * m links."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42
    quantization: Quantization = Quantization.NONE

    def __post_init__(self):
        at_least("m", self.m, 2)
        at_least("ef_construction", self.ef_construction)
        at_least("ef_search", self.ef_search)


@dataclass(frozen=True)
class Bm25Config:
    """k1 is a 32-bit float that is widened, as scores depend on it."""

    k1: float = 1.2000000476837158
    b: float = 0.75

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 >= 0 and 0 <= b <= 1")
