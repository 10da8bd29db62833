"""The sparse recovery score of readings: how well a reading's sparse code survives few random measurements.

Off by default everywhere: it is slow and was reported to lower accuracy.
"""

from __future__ import annotations

import numpy as np

# The slots of the code, in order, and the generator of the matrix.
SLOTS = (
    ("CLASS", ("nimisana", "teonsana", "laatusana", "seikkasana", "lukusana", "asemosana", "sidesana", "suhdesana", "kieltosana", "huudahdussana", "etuliite", "lyhenne", "paikannimi", "sukunimi", "etunimi")),
    ("SIJAMUOTO", ("nimento", "omanto", "osanto", "olento", "tulento", "kohdanto", "sisaolento", "sisaeronto", "sisatulento", "ulkoolento", "ulkoeronto", "ulkotulento", "vajanto", "keinonto", "seuranto")),
    ("NUMBER", ("singular", "plural", "dual")), ("PERSON", ("1", "2", "3", "4", "passive")),
    ("TENSE", ("present_simple", "past_imperfective", "past_perfective", "future")),
    ("MOOD", ("indicative", "conditional", "potential", "imperative", "A-infinitive", "E-infinitive")),
    ("PARTICIPLE", ("past_active", "past_passive", "present_active", "present_passive", "agent")), ("POSSESSIVE", ("1s", "2s", "3", "1p", "2p")),
)
HASHES = 100
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
SEED, LCG_FACTOR = 42, 6364136223846793005
# End of fixed values.
_ONE_HOT = {(name, value): k for k, (name, value) in enumerate((n, v) for n, values in SLOTS for v in values)}
LENGTH_AT = len(_ONE_HOT)
DIMENSIONS = LENGTH_AT + 1 + HASHES
_MASK = (1 << 64) - 1


def encode(reading: dict[str, str]) -> np.ndarray:
    """One-hot attributes, the structure's length over 20 (at most 1), and a hash of the base form."""
    out = np.zeros(DIMENSIONS)
    for item in reading.items():
        if item in _ONE_HOT:
            out[_ONE_HOT[item]] = 1
    if reading.get("STRUCTURE") is not None:
        out[LENGTH_AT] = min(1.0, len(reading["STRUCTURE"].encode()) / 20)
    if reading.get("BASEFORM") is not None:
        h = FNV_START
        for byte in reading["BASEFORM"].encode():
            h = (h ^ byte) * FNV_FACTOR & _MASK
        out[LENGTH_AT + 1 + h % HASHES] = 1
    return out


def measurements(m: int, n: int = DIMENSIONS) -> np.ndarray:
    """The seeded Gaussian matrix, m x n, scaled by the root of m."""
    state, values = SEED, []

    def uniform() -> float:
        nonlocal state
        state = (state * LCG_FACTOR + 1) & _MASK
        return state / _MASK

    while len(values) < m * n:
        u, v = uniform(), uniform()
        if u > 1e-15:
            values.append(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    return np.array(values).reshape(m, n) / np.sqrt(m)


class Recovery:
    """Accelerated shrinkage for ``min |Ax - b|^2 / 2 + penalty * |x|_1``."""

    def __init__(self, m: int = 50, penalty: float = 0.1, steps: int = 200, tolerance: float = 1e-6, matrix: np.ndarray | None = None):
        self.a = measurements(m) if matrix is None else matrix
        self.penalty, self.steps, self.tolerance = penalty, steps, tolerance
        self.rate = 1 / max(1e-10, float(np.linalg.eigvalsh(self.a.T @ self.a)[-1]))

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = look = np.zeros(self.a.shape[1])
        t = 1.0
        for _ in range(self.steps):
            z = look - self.rate * (self.a.T @ (self.a @ look - b))
            after = np.sign(z) * np.maximum(np.abs(z) - self.penalty * self.rate, 0)
            if np.linalg.norm(after - x) < self.tolerance * max(np.linalg.norm(after), 1e-10):
                return after
            faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, x, t = after + (t - 1) / faster * (after - x), after, faster
        return x

    def score(self, reading: dict[str, str]) -> float:
        """Minus the squared error of the recovered code."""
        code = encode(reading)
        return -float(((code - self.solve(self.a @ code)) ** 2).sum())
