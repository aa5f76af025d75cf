"""Tokens of many texts at once, as arrays: places, kinds and hashes of the small spelling."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
GAP, LETTER, DIGIT, SIGN, LINE, EDGE = range(6)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character up to 0xFFFF: its class, its small spelling, whether it is a capital. Others count as signs."""
    kind, small, big = np.full(1 << 16, SIGN, np.uint8), np.arange(1 << 16, dtype=np.uint64), np.zeros(1 << 16, bool)
    for o in range(1 << 16):
        c = chr(o)
        if c.isalpha():
            kind[o], big[o] = LETTER, c.isupper() or c.istitle()
            if len(c.lower()) == 1:
                small[o] = ord(c.lower())
        elif c.isdecimal() or c.isnumeric():
            kind[o] = DIGIT
        elif c.isspace() or c == "_":
            kind[o] = GAP
    kind[10], kind[0] = LINE, EDGE
    return kind, small, big


TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hash(word: str) -> int:
    """What ``Texts`` gives a token, from its small spelling."""
    out, power = 0, 1
    for c in word.lower():
        out = (out + (ord(c) + 1) * power) & 0xFFFFFFFFFFFFFFFF
        power = (power * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return out


class Texts:
    """Texts joined by a zero character, with tokens: runs of letters (over - and '), of digits, single signs, line ends."""

    def __init__(self, texts: list[str | None]):
        self.text = "\0" + "\0".join("" if t is None else t.replace("\0", " ") for t in texts) + "\0"
        if not TABLES:
            TABLES.append(_tables())
        kinds, small, big = TABLES[0]
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, 0xFFFF)
        kind = kinds[code]
        joins = np.nonzero((code == 45) | (code == 39) | (code == 0x2019))[0]
        joins = joins[(kind[joins - 1] == LETTER) & (kind[joins + 1] == LETTER)]
        kind[joins] = LETTER
        first = kind != GAP
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] >= SIGN)
        ends = kind != GAP
        ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] >= SIGN)
        self.start, self.end = np.nonzero(first)[0], np.nonzero(ends)[0] + 1
        self.kind, self.code = kind[self.start], code
        power, self.inverse = _powers(len(code))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((small[code] + np.uint64(1)) * power)])
        self.capitals = np.concatenate([[0], np.cumsum(big[code])])
        self.joins = np.zeros(len(code) + 1, np.int64)
        self.joins[joins + 1] = 1
        self.joins = np.cumsum(self.joins)
        self.hash = self.span(self.start, self.end)
        self.big = big[code[self.start]]
        self.edge = np.nonzero(code == 0)[0]  # before text d is edge d

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the small spelling of characters a to b."""
        return (self.sums[b] - self.sums[a]) * self.inverse[np.minimum(a, len(self.inverse) - 1)]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, at, "right") - 1
