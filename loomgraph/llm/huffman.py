"""Canonical Huffman codes of bounded length, with numpy: code lengths from counts, bit packing, table decoding.

Codes go into 64-bit words, highest bit first. A checkpoint is the bit offset of every STEP-th code of a
block; decoding advances from all checkpoints of many blocks at once, one table look-up each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_LENGTH = 16
STEP = 128


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Optimal lengths of at most `most` bits, 0 for ids that never occur, by package-merge.

    A level's list holds the ids by count, merged with the pairs of the list before. Of the last list the
    first 2n - 2 items are taken; the ids among a list's taken items are always its rarest, and its taken
    pairs say how many items of the list before are taken. Each time an id is taken its code gets a bit.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << most:
        raise ValueError(f"{n} ids don't fit codes of {most} bits")
    if n < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    is_id, level = [], np.zeros(0)
    for _ in range(most):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_id.append(by < n)
    taken, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for ids in reversed(is_id):
        own = int(ids[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    out[order] = lengths
    return out


@dataclass
class Code:
    lengths: np.ndarray
    codes: np.ndarray
    ids: np.ndarray  # by the next MAX_LENGTH bits
    steps: np.ndarray  # their codes' lengths


def canonical(lengths: np.ndarray) -> Code:
    """Codes in the order of length, then id: the lengths alone define them."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    bits = lengths[order].astype(np.int64)
    span = np.int64(1) << (MAX_LENGTH - bits)
    start = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (start >> (MAX_LENGTH - bits)).astype(np.uint64)
    ids, steps = np.zeros(1 << MAX_LENGTH, np.uint16), np.ones(1 << MAX_LENGTH, np.uint8)
    end = int(span.sum())
    ids[:end], steps[:end] = np.repeat(order.astype(np.uint16), span), np.repeat(lengths[order], span)
    return Code(lengths, codes, ids, steps)


def encode(code: Code, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed bits, and the bit offset of every STEP-th id."""
    n = code.lengths[ids].astype(np.int64)
    if not n.all():
        raise ValueError("an id without a code")
    end = np.cumsum(n)
    at = end - n
    value = code.codes[ids]
    word, room = at >> 6, 64 - (at & 63) - n
    whole = room >= 0
    first = np.where(whole, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    total = int(end[-1]) if len(end) else 0
    out = np.zeros((total + 63) // 64, np.uint64)
    if len(ids):
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[begin]] = np.bitwise_or.reduceat(first, begin)
        cut = np.flatnonzero(~whole)
        out[word[cut] + 1] |= value[cut] << (64 + room[cut]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], at[::STEP].astype(np.uint32)


def decode(code: Code, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
    """The ids of each block. Any blocks can be decoded together, or any alone."""
    pad = b"\0" * 4
    data = np.frombuffer(b"".join(p + pad for p in payloads), np.uint8)
    base = np.cumsum([0, *(len(p) + 4 for p in payloads)])[:-1]
    lanes = np.array([len(c) for c in checkpoints])
    at = np.concatenate([np.asarray(c, np.int64) + 8 * b for c, b in zip(checkpoints, base, strict=True)]) if len(payloads) else np.zeros(0, np.int64)
    left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(k)) for n, k in zip(counts, lanes, strict=True)]) if len(payloads) else at
    # lanes that end early are at the back, so that each step works on a prefix
    order = np.argsort(-left, kind="stable")
    at, most = at[order], left[order]
    ids = np.zeros((STEP, len(at)), np.uint16)
    for step in range(int(most.max()) if len(most) else 0):
        live = int(np.searchsorted(-most, -step, "left"))
        where = at[:live]
        byte = where >> 3
        seen = (data[byte].astype(np.uint32) << 16) | (data[byte + 1].astype(np.uint32) << 8) | data[byte + 2]
        peek = (seen >> (8 - (where & 7)).astype(np.uint32)) & 0xFFFF
        ids[step, :live] = code.ids[peek]
        at[:live] += code.steps[peek]
    lane_ids = np.empty_like(ids.T)
    lane_ids[order] = ids.T
    out, lane = [], 0
    for n, k in zip(counts, lanes, strict=True):
        out.append(lane_ids[lane : lane + k].reshape(-1)[:n])
        lane += k
    return out
