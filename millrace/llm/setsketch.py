"""SetSketch: registers that hold exponentially spaced, truncated minima of a set's hashes.

Register i of a set is floor(1 - log_b(m_i)), held between 0 and LIMIT, for the least m_i of one exponential variate of
rate RATE for each element. Sketches of a union are the registers' maxima. Two sets have equal registers about as often as
their Jaccard similarity, since b is near 1, and the registers that are larger in one or the other tell, together with
both cardinalities, the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.text import mix

#: Bands, registers of a band; base, rate and largest value of a register.
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
_DRAW = np.random.default_rng(20_240_117)
_FACTOR = _DRAW.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64 - 1, REGISTERS, dtype=np.uint64)


def registers(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each set; set k has the elements from starts[k] to the next start, one at least."""
    out = np.empty((len(starts), REGISTERS), np.uint64)
    scratch = np.empty_like(elements)
    for i in range(REGISTERS):
        np.multiply(elements, _FACTOR[i], out=scratch)
        scratch += _SHIFT[i]
        scratch ^= scratch >> np.uint64(32)
        scratch *= _FACTOR[i]
        out[:, i] = np.minimum.reduceat(scratch, starts)
    least = -np.log1p(-((out >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A hash of each band's registers and number, a row of BANDS for each sketch."""
    bands = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r] + np.uint64(1))
    return key


def _chance(ratio: np.ndarray) -> np.ndarray:
    """-log_b(1 - ratio * (b - 1) / b)."""
    return -np.log1p(-ratio * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(larger: np.ndarray, smaller: np.ndarray, u: np.ndarray, v: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, when so many registers of the first set are larger and smaller than the second's, and the
    sets' shares of the sum of both cardinalities are u and v."""
    a = _chance(np.clip(u - v * jaccard, 1e-12, 1))
    b = _chance(np.clip(v - u * jaccard, 1e-12, 1))
    equal = np.clip(1 - a - b, 1e-12, 1)
    return larger * np.log(a) + smaller * np.log(b) + (REGISTERS - larger - smaller) * np.log(equal)


#: Similarities at which the likelihood is compared, and how much likelier (as a logarithm) the best must be than every
#: one from the threshold on before a pair is passed over unverified: a pair at the threshold is passed over about once in a million times.
_GRID, MARGIN = np.linspace(0.005, 0.995, 100), 12.0


def plausible(first: np.ndarray, second: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, threshold: float = 0.75) -> np.ndarray:
    """Which pairs of sketches may belong to sets of at least this similarity."""
    larger, smaller = (first > second).sum(1), (first < second).sum(1)
    total = (n_first + n_second).astype(np.float64)
    u, v = n_first / total, n_second / total
    most = np.minimum(u / v, v / u)
    logs = np.stack([np.where(g <= most + 0.01, log_likelihood(larger, smaller, u, v, np.minimum(g, most)), -np.inf) for g in _GRID])
    best, enough = logs.max(0), logs[_GRID >= threshold - 0.005].max(0)
    return enough >= best - MARGIN
