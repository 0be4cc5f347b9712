"""SuperMinHash signatures (Ertl, 2017) of many sets at once.

Element j walks a random permutation of the m slots. At its k-th step it offers the value ``k + u`` with a
fresh uniform u to the slot that its permutation names there; a slot keeps the least offer. All m ranks of
an element come from one permutation, so its offers to different slots are negatively correlated and the
estimate's variance is below MinHash's. A set is done as soon as every slot holds a value below k + 1: no
later step can be lower. Sets here walk in step, and the elements of finished sets leave.
"""

from __future__ import annotations

import numpy as np

from .textblocks import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(values: np.ndarray, bounds: np.ndarray, slots: int, budget: int = 1 << 24) -> np.ndarray:
    """Array (sets, slots) of uint64; the top byte is the step, the rest the uniform part. Empty sets: all ones.

    budget: bytes of permutation state at a time.
    """
    if slots > 256:
        raise ValueError("at most 256 slots")
    out = np.full((len(bounds) - 1, slots), _EMPTY, dtype=np.uint64)
    sizes = np.diff(bounds)
    per = max(1, budget // slots)
    d, n = 0, len(sizes)
    while d < n:
        last = max(d + 1, int(np.searchsorted(bounds, bounds[d] + per, side="right")) - 1)
        last = min(last, n)
        _walk(values[bounds[d] : bounds[last]], np.repeat(np.arange(d, last), sizes[d:last]), out, slots)
        d = last
    return out


def _offer(out: np.ndarray, of: np.ndarray, slot: np.ndarray, k: int, random: np.ndarray, slots: int) -> None:
    value = (random >> np.uint64(8)) | np.uint64(k << 56)
    np.minimum.at(out.reshape(-1), of * slots + slot, value)


def _walk(values: np.ndarray, of: np.ndarray, out: np.ndarray, slots: int) -> None:
    # The first step needs no permutation state, and completes most long sets.
    random = mix(values + _STEP)
    pick = (mix(random) % np.uint64(slots)).astype(np.int64)
    _offer(out, of, pick, 0, random, slots)
    open_ = np.flatnonzero((out[of[0] : of[-1] + 1] == _EMPTY).any(axis=1)) + of[0] if len(of) else np.zeros(0, dtype=np.int64)
    keep = np.isin(of, open_)
    values, of, pick = values[keep], of[keep], pick[keep]
    _rest(values, of, pick, out, slots)


def _rest(values: np.ndarray, of: np.ndarray, pick: np.ndarray, out: np.ndarray, slots: int) -> None:
    if not len(values):
        return
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
    row = np.arange(len(values))
    order[row, pick], order[:, 0] = 0, pick.astype(np.uint8)
    for k in range(1, slots):
        random = mix(values + np.uint64(((k + 1) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF))
        pick = k + (mix(random) % np.uint64(slots - k)).astype(np.int64)
        slot = order[row, pick]
        order[row, pick] = order[:, k]
        order[:, k] = slot
        _offer(out, of, slot.astype(np.int64), k, random, slots)
        sets = np.unique(of)
        done = sets[(out[sets] >> np.uint64(56)).max(axis=1) <= k]
        if len(done):
            keep = ~np.isin(of, done)
            values, of, order = values[keep], of[keep], order[keep]
            row = np.arange(len(values))
            if not len(values):
                return


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity: the share of equal slots."""
    return (a == b).mean(axis=-1)
