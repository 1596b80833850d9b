"""Text rules that several operators share."""

from __future__ import annotations

import numpy as np

#: Words are runs without space, tab, line feed, vertical tab, form feed or carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased. bytes.split() and bytes.lower() follow ASCII rules only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


M = 0x9E3779B97F4A7C15
MI = pow(M, -1, 1 << 64)
_BYTES = np.random.RandomState(8).randint(0, 1 << 64, 256, np.uint64)  # a number for each byte
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
PIECE = 1 << 20  # bytes hashed at once
_powers: dict[int, np.ndarray] = {}


def mix(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(29))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """At least n powers of base from 0 on, kept for the next text."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        every = np.full(max(n, 1 << 15), base, np.uint64)
        every[0] = 1
        held = _powers[base] = np.cumprod(every, dtype=np.uint64)
    return held


def spans(code: np.ndarray):
    """A function of arrays of starts and ends: hashes of the codes between, by their sum over powers."""
    n = len(code)
    down = _power(MI, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(code * _power(M, n)[:n], dtype=np.uint64, out=sums[1:])
    return lambda a, b: mix((sums[b] - sums[a]) * down[a])


def hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order: of ``words(text)``, but without making them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        size = PIECE
        while True:  # a piece ends at a space, or with the text
            part = raw[at : at + size]
            space = _SPACE[part]
            if at + size >= len(raw):
                end = len(part)
                break
            end = len(part) - int(space[::-1].argmax())
            if space[end - 1]:
                break
            size *= 2
        part, space = part[:end], space[:end]
        edge = np.ones(end + 2, bool)
        edge[1:-1] = space
        edge = np.flatnonzero(edge[1:] != edge[:-1])
        out.append(spans(_BYTES[part])(edge[::2], edge[1::2]))
        at += end
    return np.concatenate(out)
