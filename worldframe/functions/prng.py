"""The seeded generator of the map model: three lags and a carry, seeded by hashing a string.

A stream is sequential, so it is drawn inside one task per seed; different seeds run in parallel.
"""

from collections.abc import Iterator

# Fixed values of the generator.
HASH_START, HASH_FACTOR, LAG_FACTOR = 4022871197, 0.02519603282416938, 2091639
TWO_32, INVERSE_32 = 4294967296.0, 2.3283064365386963e-10


def _unsigned(x: float, saturate: bool) -> float:
    """Truncation to 32 bits: wrapped around, or held at the ends of the range."""
    if saturate:
        return float(min(max(int(x), 0), 0xFFFFFFFF))
    return float(int(x) & 0xFFFFFFFF)


class _StringHash:
    def __init__(self, saturate: bool):
        self.state, self.saturate = float(HASH_START), saturate

    def __call__(self, text: str) -> float:
        n = self.state
        for ch in text:
            n += ord(ch)
            part = HASH_FACTOR * n
            n = _unsigned(part, self.saturate)
            part -= n
            part *= n
            n = _unsigned(part, self.saturate)
            part -= n
            n += part * TWO_32
        self.state = n
        return _unsigned(n, self.saturate) * INVERSE_32


def stream(seed: str, saturate: bool = False) -> Iterator[float]:
    """Endless uniform numbers in [0, 1) for a seed string."""
    hashed = _StringHash(saturate)
    lags = [hashed(" ") for _ in range(3)]
    for i in range(3):
        lags[i] -= hashed(seed)
        if lags[i] < 0:
            lags[i] += 1
    carry = 1
    while True:
        t = LAG_FACTOR * lags[0] + carry * INVERSE_32
        carry = int(t)
        lags = [lags[1], lags[2], t - carry]
        yield lags[2]


def unsigned_32(u: float) -> int:
    return int(u * TWO_32)


def fraction_53(draw: Iterator[float]) -> float:
    """53 random bits from two draws."""
    return next(draw) + int(next(draw) * 0x200000) * 1.1102230246251565e-16
