"""Sketch parameters and the fixed values of the encoding."""

from __future__ import annotations

from dataclasses import dataclass

# They must be these for hashes to agree with existing sketch files.
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
#: Codes of three bits; the complement of a base is its code with the bits reversed. Any other letter is invalid.
BASE_CODES = {"A": 1, "C": 6, "G": 3, "T": 4}
MAX_K = 42
#: Up to this K a k-mer's code fits 63 bits.
ONE_LIMB_K = 21
_WORD = 1 << 64


def seed_of(value: int | str | None) -> int:
    """A hash seed: the default as it stands; else a number (text may be 0x...) with odd seeds raised to the next even one."""
    if value is None:
        return MIX_1
    s = int(value, 0) if isinstance(value, str) else int(value)
    return (s + s % 2) % _WORD


def scale_of(value: int | str) -> tuple[int, int]:
    """(numerator, denominator) of the kept share: an integer scale S keeps 1/S; text N/M keeps N/M."""
    if isinstance(value, str) and "/" in value:
        n, m = (int(x) for x in value.split("/", 1))
        if not 0 < n <= m:
            raise ValueError(f"a share must be between 0 and 1, not {value}")
        return n, m
    s = int(value)
    if s < 1:
        raise ValueError(f"scale must be at least 1, not {value}")
    return 1, s


@dataclass(frozen=True)
class SketchParams:
    """k, scale (or a share N/M), seed, min_count (1 and below: off) and max_simplicity (None: off)."""

    k: int = 21
    scale: int | str = 1000
    seed: int | str | None = None
    min_count: int = 0
    max_simplicity: int | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be from 1 to {MAX_K}, not {self.k}")
        scale_of(self.scale)
        seed_of(self.seed)

    @property
    def threshold(self) -> int:
        """Hashes below this are kept."""
        n, m = scale_of(self.scale)
        return (_WORD - 1) * n // m

    @property
    def multiplier(self) -> int:
        return seed_of(self.seed) ^ MIX_2

    @property
    def signed(self) -> bool:
        """Whether kept hashes may exceed 2^63 - 1, so that their signed order is not their order."""
        return self.threshold > 1 << 63


def simplicity_limit(k: int) -> int:
    """A limit for max_simplicity that drops only very repetitive k-mers."""
    return int(k / 4 * 16.266 + k * k / 4)
