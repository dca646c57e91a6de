"""Deterministic draws: the only source of randomness is the MD5 of "<seed>:<key>"."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A BIGINT in [0, 2^32) from the keys joined by ':'; equal in every engine that has MD5."""
    parts = [k if isinstance(k, Column) else F.lit(k) if isinstance(k, int) else F.col(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


# MD5 of one block (RFC 1321): turns, constants and the word of each step.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]
_WORDS = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Longest message of one block.
BLOCK_BYTES = 55
#: Messages that are hashed together; their state stays in a core's cache.
TILE = 1 << 15


def _md5_block(words: list[np.ndarray | int], shape: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """The four state words of MD5 for messages of one block; a word is one number or an array that broadcasts to shape."""
    u = np.uint32
    a, b, c, d = (np.full(shape, s, u) for s in _START)
    t, s = np.empty(shape, u), np.empty(shape, u)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif k < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif k < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        word = words[_WORDS[k]]
        np.add(a, t, out=t)
        if isinstance(word, int):
            np.add(t, u((word + _SINES[k]) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, word + u(_SINES[k]), out=t)
        np.left_shift(t, u(_TURNS[k]), out=s)
        np.right_shift(t, u(32 - _TURNS[k]), out=t)
        np.bitwise_or(t, s, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    for x, start in zip((a, b, c, d), _START):
        np.add(x, u(start), out=x)
    return a, b, c, d


def _padded(texts: list[bytes], at: int, end: bool) -> np.ndarray:
    """(texts x 16) little-endian words of a block with each text from byte ``at`` on, and MD5's end mark and length."""
    block = np.zeros((len(texts), 64), np.uint8)
    sizes = np.array([len(t) for t in texts])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        block[rows, at : at + size] = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8).reshape(len(rows), size)
        if end:
            block[rows, at + size] = 0x80
            block[rows, 56:58] = np.frombuffer((8 * int(at + size)).to_bytes(2, "little"), np.uint8)
    return block.view("<u4").astype(np.uint32)


def uniforms(units: list[str], first: int, draws: int, seed: str) -> np.ndarray:
    """(units x draws) numbers of 32 bits from replicate first on (a multiple of four), four to the MD5 of "seed:number:unit"."""
    told, heads = [u.encode() for u in units], [f"{seed}:{k}:".encode() for k in range(first // 4, -(-(first + draws) // 4))]
    out = np.empty((len(units), len(heads), 4), np.uint32)
    sizes = [len(h) for h in heads]
    cuts = [0, *(k for k in range(1, len(heads)) if sizes[k] != sizes[k - 1]), len(heads)]
    runs = [(x, y, _padded(heads[x:y], 0, False)) for x, y in zip(cuts, cuts[1:])]  # numbers of equal length
    short = [r for r, text in enumerate(told) if len(text) + max(sizes, default=0) <= BLOCK_BYTES]
    step = max(1, TILE // max(1, len(heads)))
    for start in range(0, len(short), step):
        rows = short[start : start + step]
        texts = [told[r] for r in rows]
        sides = [(x, y, left, _padded(texts, sizes[x], True)) for x, y, left in runs]
        words: list[np.ndarray | int] = []
        for w in range(16):
            one = int(sides[0][2][0, w] | sides[0][3][0, w])
            if all((left[:, w] | right[0, w] == one).all() and (left[0, w] | right[:, w] == one).all() for _, _, left, right in sides):
                words.append(one)
            else:
                words.append(np.empty((len(rows), len(heads)), np.uint32))
                for x, y, left, right in sides:
                    np.bitwise_or(left[None, :, w], right[:, w, None], out=words[w][:, x:y])
        for k, state in enumerate(_md5_block(words, (len(rows), len(heads)))):
            out[rows, :, k] = state.byteswap()
    for r in set(range(len(units))).difference(short):
        out[r] = np.frombuffer(b"".join(hashlib.md5(h + told[r]).digest() for h in heads), ">u4").reshape(-1, 4)
    return out.reshape(len(units), 4 * len(heads))[:, :draws]
