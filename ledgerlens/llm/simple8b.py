"""Simple-8b: word-aligned coding of integers, vectorised with numpy.

A stream is cut into blocks of ``BLOCK`` values.  Every 64-bit word holds a
selector in its top 4 bits and as many values as fit at the selector's width
in the other 60.  Values of more than 60 bits are escapes: selector 15 stands
for the next entry of an escape list of whole 64-bit values.  ``starts`` has
the first word and the first escape of each block, so that any run of blocks
decodes on its own, and all blocks decode in step.

Layout of ``pack``'s bytes, little-endian:
    u64  number of values | u64 blocks | u64 words | u64 escapes
    u64  starts[2][blocks + 1]   (words, then escapes)
    u64  words[...] | u64 escapes[...]
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values: (values in a word, bits of each) by selector; 14 is unused.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
          (2, 30), (1, 60)]
ESCAPE = 15
COUNTS = np.array([c for c, _ in LAYOUT] + [0, 1], dtype=np.int64)
WIDTHS = [w for _, w in LAYOUT]


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value, 0 for 0, from the exponent of its double
    (above 53 bits rounding may say one more, which still fits)."""
    exponent = values.astype(np.float64).view(np.uint64) >> np.uint64(52)
    return (np.maximum(exponent, np.uint64(1022)) - np.uint64(1022)).astype(np.uint8)


def selectors(widths: np.ndarray) -> np.ndarray:
    """For each position of ``blocks x BLOCK`` widths the selector that takes
    most values from there on; a word ends with its block."""
    widest = {1: np.concatenate([widths, np.zeros((len(widths), 60), np.uint8)], axis=1)}  # beyond the end all fits
    choice = np.where(widths <= 60, 13, ESCAPE).astype(np.uint8)
    for s in range(12, -1, -1):  # more and more values: the widest of the next ``count``
        count, width = LAYOUT[s]
        half = min(c for c in widest if 2 * c >= count)
        part = widest[half]
        widest[count] = np.maximum(part[:, :part.shape[1] - (count - half)], part[:, count - half:])
        fits = widest[count][:, :BLOCK] <= width
        if not fits.any():
            break
        choice -= fits  # a layout that takes a window comes after all the wider ones, which take it too
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, escapes, starts)`` of a uint64 array; all blocks are coded in
    step, one word of each at a time."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((2, 1), np.uint64)
    grid = np.zeros(blocks * BLOCK + 64, dtype=np.uint64)
    grid[:n] = values
    choice = selectors(bit_widths(grid[:blocks * BLOCK]).reshape(blocks, BLOCK)).ravel()
    step = COUNTS[choice]
    begins = np.zeros(blocks * BLOCK, dtype=bool)
    pos = np.arange(blocks) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    while len(pos):
        begins[pos] = True
        pos = pos + step[pos]
        live = pos < end
        if not live.all():
            pos, end = pos[live], end[live]
    at = np.flatnonzero(begins)
    sel, of = choice[at], at // BLOCK
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(LAYOUT):
        i = np.flatnonzero(sel == s)
        if not len(i):
            continue
        p, w = at[i], words[i]
        inside = (p % BLOCK + count <= BLOCK).all()
        for k in range(count):
            v = grid[p + k]
            if not inside:
                v[p % BLOCK + k >= BLOCK] = 0
            w |= v << np.uint64(k * width)
        words[i] = w
    escaped = sel == ESCAPE
    starts = np.zeros((2, blocks + 1), dtype=np.uint64)
    starts[0, 1:] = np.cumsum(np.bincount(of, minlength=blocks))
    starts[1, 1:] = np.cumsum(np.bincount(of[escaped], minlength=blocks))
    return words, grid[at[escaped]], starts


def decode(words: np.ndarray, escapes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of whole blocks, each selector's words at once."""
    blocks = starts.shape[1] - 1
    out = np.zeros(blocks * BLOCK + 64, dtype=np.uint64)
    if not blocks:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    first = np.cumsum(counts) - counts
    bounds = starts[0].astype(np.int64)
    block = np.repeat(np.arange(blocks), np.diff(bounds))
    at = first - first[bounds[:-1]][block] + block * BLOCK
    for s, (count, width) in enumerate(LAYOUT):
        i = np.flatnonzero(sel == s)
        if not len(i):
            continue
        w, p, mask = words[i], at[i], np.uint64((1 << width) - 1)
        limit = (p // BLOCK + 1) * BLOCK
        for k in range(count):
            q = p + k
            inside = q < limit
            v = (w >> np.uint64(k * width)) & mask
            if inside.all():
                out[q] = v
            else:
                out[q[inside]] = v[inside]
    out[at[sel == ESCAPE]] = escapes
    return out[:n]


def pack(values: np.ndarray) -> bytes:
    words, escapes, starts = encode(values)
    head = np.array([len(values), starts.shape[1] - 1, len(words), len(escapes)], dtype="<u8")
    return b"".join(x.astype("<u8").tobytes() for x in (head, starts, words, escapes))


def unpack(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The values of blocks ``first_block`` to ``last_block`` (exclusive; all
    to the end if None), read through the block offsets."""
    n, blocks, n_words, _ = (int(x) for x in np.frombuffer(data, "<u8", 4))
    starts = np.frombuffer(data, "<u8", 2 * (blocks + 1), 32).reshape(2, blocks + 1)
    last = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last:
        return np.zeros(0, np.uint64)
    base = 32 + 16 * (blocks + 1)
    (w0, e0), (w1, e1) = starts[:, first_block].tolist(), starts[:, last].tolist()
    words = np.frombuffer(data, "<u8", w1 - w0, base + 8 * w0)
    escapes = np.frombuffer(data, "<u8", e1 - e0, base + 8 * (n_words + e0))
    own = starts[:, first_block:last + 1] - starts[:, first_block:first_block + 1]
    return decode(words, escapes, own, min(n, last * BLOCK) - first_block * BLOCK)
