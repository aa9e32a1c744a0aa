"""Words of whole texts and hashes of word windows, as numpy arrays inside tasks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Odd multipliers of the rolling polynomials and of the final mixing step.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    """Words of a text, divided by blanks and the ASCII controls 9 to 13; none of a null text."""
    return WORD.findall(text) if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; a bijection, so that it adds no collision."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(_MIX[0])
    values = (values ^ (values >> np.uint64(27))) * np.uint64(_MIX[1])
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 64)


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, in time linear in the text.

    Prefix sums of a polynomial modulo 2**64 give each run by one subtraction;
    multiplying by the inverse power of the base takes its position out again.
    """
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = _BASES[seed]
    values = mixed(hashes ^ np.uint64(base)) if seed else hashes
    steps = np.full(len(hashes), base, np.uint64)
    steps[0] = 1
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * np.cumprod(steps), out=sums[1:])
    back = np.full(count, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    return mixed((sums[size:] - sums[:-size]) * np.cumprod(back))
