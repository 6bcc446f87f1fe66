"""k-mers of one batch of records, as numpy arrays (used inside Spark tasks)."""

from __future__ import annotations

import numpy as np

from strandloom.functions.letters import IUPAC, IUPAC_COMPLEMENT, window_hashes

EXACT_K = 31  # windows up to this size have their base-4 code as key

_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
_COMPLEMENT = bytes.maketrans(IUPAC.encode(), IUPAC_COMPLEMENT.encode())


def window_codes(text: np.ndarray, width: int, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(base-4 code of every window, or of its reverse complement; whether it is all A, C, G or T), by doubling."""
    n = len(text) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
    code = _CODE[text]
    bad = np.concatenate(([0], np.cumsum(code == 4)))
    clean = bad[width:] == bad[:-width]
    kind = np.int32 if width <= 15 else np.int64
    part = (3 - (code & 3) if reverse else code & 3).astype(kind)
    length, out, done, rest = 1, None, 0, width
    while True:
        if rest & 1:
            piece = part[done : done + n]
            if out is None:
                out = piece
            else:
                out = (piece << (2 * done)) | out if reverse else (out << (2 * length)) | piece
            done += length
        rest >>= 1
        if not rest:
            return out, clean
        left, right = part[:-length], part[length:]
        part = (right << (2 * length)) | left if reverse else (left << (2 * length)) | right
        length *= 2


def reverse_complement_bytes(text: bytes) -> bytes:
    return text[::-1].translate(_COMPLEMENT)


def canonical_kmers(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(strand-neutral key of every window, whether the window is its own reverse complement).

    Windows of A, C, G and T only have their exact base-4 code for k up to 31.
    Windows with other letters, and all windows of a larger k, have a negative
    key: a 62-bit hash, whose last bit says whether the window is its own
    reverse complement.
    """
    a = np.frombuffer(text, dtype=np.uint8)
    if k <= EXACT_K:
        forward, clean = window_codes(a, k)
        backward, _ = window_codes(a, k, reverse=True)
        key, both = np.minimum(forward, backward).astype(np.int64), forward == backward
        if clean.all():
            return key, both
    else:
        key = np.zeros(max(0, len(a) - k + 1), dtype=np.int64)
        both = clean = np.zeros(len(key), dtype=bool)
    # only the stretches of windows without a code are hashed
    turn = np.diff(np.concatenate(([1], clean.view(np.int8), [1])))
    starts, stops = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    part = b"".join([text[x : y + k - 1] for x, y in zip(starts.tolist(), stops.tolist())])
    at = np.arange(len(clean) - np.count_nonzero(clean)) + np.repeat(np.arange(len(starts)) * (k - 1), stops - starts)
    forward = window_hashes(np.frombuffer(part, dtype=np.uint8), k)[at]
    backward = window_hashes(np.frombuffer(reverse_complement_bytes(part), dtype=np.uint8), k)[::-1][at]
    own = forward == backward
    key, both = key.copy(), both.copy()
    key[~clean] = -1 - ((np.minimum(forward, backward) >> np.uint64(1) & ~np.uint64(1)).astype(np.int64) | own)
    both[~clean] = own
    return key, both


def block_windows(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``canonical_kmers`` of many texts at once, with the number of each window's text, and the letters of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    keys, both = canonical_kmers(b"".join(texts), k)
    across = (np.cumsum(sizes)[:, None] - np.arange(1, k)).ravel()  # windows that pass a text's end
    inside = np.ones(len(keys), dtype=bool)
    inside[across[(across >= 0) & (across < len(keys))]] = False
    return keys[inside], both[inside], np.repeat(np.arange(len(texts)), np.maximum(sizes - k + 1, 0)), sizes


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; many times as fast as numpy's unique, which hashes them."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
