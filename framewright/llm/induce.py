"""The numpy kernels of the suffix-array operator: anchors, and induced sorting around them."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Length of a repeat; length of an anchor; how far an anchor can stand from a window's start.
SPAN, GRAM = 200, 64
REACH = SPAN - GRAM
#: Parts into which a level of the recursion cuts a group's windows.
FAN = 4
#: Window starts handled at a time.
BLOCK = 1 << 18
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C17


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


@cache
def byte_codes() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _inverse(n: int) -> np.ndarray:
    return powers(pow(_BASE, -1, 1 << 64), n)


def anchors(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Snippets of the texts that lie end to end in ``flat``: (text, start, d, size, h, s).

    A window of SPAN bytes has as its anchor the least of its GRAM-grams by hash, the first such:
    equal windows have their anchors at the same place. Neighbouring windows with one anchor are
    a snippet, the bytes that any of them covers: it starts d bytes before its anchor. h is the
    anchor's hash, s the snippet's.
    """
    starts = np.r_[0, ends[:-1]]
    n = len(flat)
    closed = np.zeros(n + 1, np.int32)  # no window starts so near a text's end
    np.add.at(closed, np.maximum(starts, ends - SPAN + 1), 1)
    np.add.at(closed, ends, -1)
    np.cumsum(closed, out=closed)
    found: list[tuple[np.ndarray, ...]] = []
    width = REACH + 1
    for lo in range(0, max(0, n - SPAN + 1), BLOCK):
        part = flat[lo : lo + BLOCK + SPAN - 1]
        m = len(part)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(byte_codes()[part] * powers(_BASE, BLOCK + SPAN)[:m], out=sums[1:])
        back = _inverse(BLOCK + SPAN)
        grams = mix((sums[GRAM:] - sums[: m - GRAM + 1]) * back[: m - GRAM + 1])
        k = len(grams)
        rows = -(-k // width)
        keyed = np.full(rows * width, ~np.uint64(0))
        keyed[:k] = (grams & ~_LOW) | np.arange(k, dtype=np.uint64)
        keyed = keyed.reshape(rows, width)
        fore = np.minimum.accumulate(keyed, axis=1).ravel()
        rear = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - SPAN + 1
        at = (np.minimum(rear[:windows], fore[width - 1 : width - 1 + windows]) & _LOW).astype(np.int64)
        own = np.flatnonzero(closed[lo : lo + windows] == 0)
        if not len(own):
            continue
        at = at[own]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)])
        first, last, at = own[new], own[np.r_[new[1:], len(own)] - 1], at[new]
        size, d = last - first + SPAN, at - first
        whole = (sums[first + size] - sums[first]) * back[first]
        s = mix(whole + (size.astype(np.uint64) << np.uint64(9) | d.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
        text = np.searchsorted(ends, lo + first, side="right")
        found.append((text, lo + first - starts[text], d, size, grams[at].view(np.int64), s.view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a + 1 : b + 1]) for each pair a < b."""
    gap = b - a
    out = values[b].copy()
    far = np.flatnonzero(gap > 1)
    if not len(far):
        return out
    level, table = np.zeros(len(far), np.int64), [values]
    level = np.frexp(gap[far].astype(np.float64))[1] - 1  # floor of log2
    for k in range(int(level.max())):
        prior, half = table[-1], 1 << k
        table.append(np.minimum(prior[:-half], prior[half:]) if len(prior) > half else prior)
    for k in range(1, int(level.max()) + 1):
        pick = far[level == k]
        out[pick] = np.minimum(table[k][a[pick] + 1], table[k][b[pick] - (1 << k) + 1])
    pick = far[level == 0]
    out[pick] = values[b[pick]]
    return out


def parts(d: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of snippets for the next level of the recursion: (row, offset, d, size, low, high, group, s).

    A group's windows start low to high bytes before its anchor; that range is cut into FAN parts,
    low and high are a part's own. All windows of a part that equal each other have its core, the
    bytes from ``low`` before the anchor to SPAN - high after it, so the core's hash is the part's
    group. A piece is what a snippet has of a part: the bytes of its windows in that range.
    """
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(byte_codes()[flat] * powers(_BASE, len(flat)), out=sums[1:])
    back = _inverse(len(flat) + 1)
    hashed = lambda at, n: (sums[at + n] - sums[at]) * back[at]
    least, width = d - (size - SPAN), -(-(high - low + 1) // FAN)
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(FAN):
        a = low + k * width
        b = np.minimum(a + width - 1, high)
        from_, to = np.maximum(a, least), np.minimum(b, d)
        r = np.flatnonzero((from_ <= to) & (a <= high))
        if not len(r):
            continue
        a, b, from_, to = a[r], b[r], from_[r], to[r]
        anchor = (ends - size + d)[r]
        core = mix(hashed(anchor - a, SPAN - (b - a)) ^ ((a << 16 | b).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        n = SPAN + to - from_
        s = mix(hashed(anchor - to, n) + (n << 9 | to).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out.append((r, d[r] - to, to, n, a, b, core.view(np.int64), s.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def induce(group: np.ndarray, copies: np.ndarray, d: np.ndarray, size: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Sorts all suffixes that start at or before the anchors of snippets, group by group.

    group: ascending numbers of the groups, whose members share their anchor's text. copies: how
    often a snippet occurs. chars: (2 * SPAN - GRAM, rows) bytes, aligned so that the anchor is at
    REACH.

    The suffixes at the anchors are sorted outright. Those one byte before are then induced: the
    tuples (byte, rank of the next suffix) are sorted by a stable distribution on the byte, and a
    tuple's common prefix with the one before is one more than the least common prefix between the
    ranks that both come from. Windows whose common prefix reaches SPAN occur elsewhere.

    Returns marks (rows, REACH + 1): whether the window at that offset from the snippet's start
    occurs more than once.
    """
    rows = len(group)
    last = d - (size - SPAN)  # windows start from d bytes before the anchor to ``last`` before
    tail = size - d
    right = chars[REACH:]
    words = np.ascontiguousarray(right.T).view(">u8")
    order = np.lexsort((tail, *(words[:, k].astype(np.uint64) for k in range(words.shape[1] - 1, -1, -1)), group))
    same = np.ones(len(order), bool)
    same[0] = False
    same[1:] = group[order[1:]] == group[order[:-1]]
    lcp = np.zeros(rows, np.int16)
    for at in range(1, rows, 8192):
        a, b = order[at - 1 : min(at + 8192, rows) - 1], order[at : at + 8192]
        differ = (words[a] != words[b])
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1] - 1)
        x = np.ascontiguousarray(words[a, first] ^ words[b, first], dtype=">u8").view(np.uint8).reshape(-1, 8)
        equal = first * 8 + np.where((x != 0).any(axis=1), (x != 0).argmax(axis=1), 8)
        lcp[at : at + 8192] = np.minimum(equal, np.minimum(tail[a], tail[b]))
    lcp[~same] = 0
    marks = np.zeros((rows, REACH + 1), bool)
    number = (group - group[0]).astype(np.int64)
    short = number.astype(np.uint16) if number[-1] < 1 << 16 else number
    for step in range(REACH + 1):
        if step:
            keep = np.flatnonzero(d[order] >= step)
            if not len(keep):
                break
            if len(keep) < len(order):
                lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.r_[0, keep[:-1] + 1])
                order = order[keep]
            char = chars[REACH - step][order]
            p = np.argsort(char, kind="stable")
            p = p[np.argsort(short[order][p], kind="stable")]
            order, char = order[p], char[p]
            like = np.flatnonzero((char[1:] == char[:-1]) & (number[order[1:]] == number[order[:-1]])) + 1
            new = np.zeros(len(order), np.int16)
            new[like] = least_between(lcp, p[like - 1], p[like]) + 1
            lcp = new
        full = lcp >= SPAN
        twice = full | np.r_[full[1:], False] | (copies[order] > 1)
        own = np.flatnonzero(last[order] <= step)
        rows_own = order[own]
        marks[rows_own, d[rows_own] - step] = twice[own]
    return marks
