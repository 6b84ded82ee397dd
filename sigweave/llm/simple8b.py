"""Simple-8b word-aligned coding of id blocks, encoded and decoded in numpy batches.

A 64-bit word holds a 4-bit selector and up to 60 bits of ids; the selector says how many ids
of which width. Blocks hold ``BLOCK`` ids and begin a new word; the offset of every block's
first word is stored, so blocks decode alone or all at once. An id that the widest slot cannot
hold is written as that slot's all-ones pattern and kept in the escapes, in order.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Selector: (ids in a word, bits of each), fixed values of this file format, most ids first.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
ESCAPE = (1 << 20) - 1
#: Bits that each value up to ``ESCAPE`` takes.
WIDTH = np.repeat(np.arange(21, dtype=np.uint8), [1, *(1 << np.arange(20))])


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), each block's first word (int32), escapes (uint64), each block's first escape (int32)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    wide = ids >= ESCAPE
    escapes = ids[wide]
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = np.where(wide, np.uint64(ESCAPE), ids)
    bits = np.zeros((blocks, BLOCK), np.uint8)
    bits.reshape(-1)[:n] = WIDTH[flat[:n].astype(np.int32)]
    # choice[b, i]: the first selector all of whose ids from i on fit; ids past a block's end always do.
    choice = np.full((blocks, BLOCK), len(SELECTORS) - 1, np.uint8)
    after = np.zeros((blocks, BLOCK + 64), np.uint8)
    after[:, :BLOCK] = bits
    tops = {1: after}  # the widest of so many ids from each one on
    for run in (1, 2, 4, 8, 16):
        tops[2 * run] = np.maximum(tops[run][:, :-run], tops[run][:, run:])
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        run = 1 << (count.bit_length() - 1)
        top = tops[run]
        fits = np.maximum(top[:, :BLOCK], top[:, count - run : count - run + BLOCK]) <= width
        np.putmask(choice, fits, s)
    counts = np.array([c for c, _ in SELECTORS], np.int32)
    # Walk all blocks at once, one word a step.
    at, live = np.zeros(blocks, np.int32), np.arange(blocks)
    steps_block, steps_at, steps_sel = [], [], []
    while len(live):
        sel = choice[live, at[live]]
        steps_block.append(live)
        steps_at.append(at[live])
        steps_sel.append(sel)
        at[live] += counts[sel]
        live = live[at[live] < BLOCK]
        live = live[live * BLOCK + at[live] < n]
    block, pos, sel = (np.concatenate(x) for x in (steps_block, steps_at, steps_sel))
    order = np.argsort(block.astype(np.uint16 if blocks < 1 << 16 else np.int64), kind="stable")
    block, pos, sel = block[order], pos[order], sel[order]
    padded = np.concatenate([flat, np.zeros(64, np.uint64)])
    start = block.astype(np.int64) * BLOCK + pos
    ends = (block.astype(np.int64) + 1) * BLOCK
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            here = start[mine, None] + np.arange(count)
            slots = np.where(here < ends[mine, None], padded[np.minimum(here, len(padded) - 1)], np.uint64(0))
            words[mine] |= np.bitwise_or.reduce(slots << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
    first_word = np.searchsorted(block, np.arange(blocks)).astype(np.int32)
    first_escape = np.searchsorted(np.flatnonzero(wide) // BLOCK, np.arange(blocks)).astype(np.int32)
    return words, first_word, escapes, first_escape


def decode(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids (uint64) of whole blocks."""
    out = np.zeros(len(first_word) * BLOCK + 64, np.uint64)
    if not n:
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[sel]
    ends = np.cumsum(counts)
    block = np.repeat(np.arange(len(first_word)), np.diff(np.append(first_word, len(words))))
    before = np.concatenate([[0], ends])[first_word]
    start = ends - counts - before[block] + block * BLOCK
    limit = (block + 1) * BLOCK
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            slots = (words[mine, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            here = start[mine, None] + np.arange(count)
            inside = here < limit[mine, None]
            out[here[inside]] = slots[inside]
    out = out[:n]
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def decode_block(k: int, words, first_word, escapes, first_escape, n: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    last = first_word[k + 1] if k + 1 < len(first_word) else len(words)
    until = first_escape[k + 1] if k + 1 < len(first_escape) else len(escapes)
    return decode(words[first_word[k] : last], np.zeros(1, np.int32), escapes[first_escape[k] : until], min(BLOCK, n - k * BLOCK))
