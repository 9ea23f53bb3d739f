"""Sorted byte strings as front-coded runs, and their merge by a loser tree that knows common
prefixes: a byte that an earlier comparison found equal is not looked at again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import zstandard


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    most, step = min(len(a), len(b)), 16
    while known < most:
        if a[known:known + step] == b[known:known + step]:
            known += step
            step *= 2
        elif step == 1:
            return known
        else:
            step = max(1, step // 4)
    return min(known, most)


def front_code(strings: Sequence[bytes]) -> bytes:
    """A sorted run: per string the length of the prefix shared with the one before, and the rest."""
    shared, before = [], b""
    for s in strings:
        shared.append(common_prefix(before, s))
        before = s
    lengths = np.array([[h, len(s) - h] for h, s in zip(shared, strings)], "<u4").reshape(-1, 2)
    body = lengths.T.tobytes() + b"".join([s[h:] for h, s in zip(shared, strings)])
    return len(strings).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def decode_run(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, prefix shared with the one before) of a front-coded run."""
    n = int.from_bytes(data[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(data[4:])
    shared, rest = np.frombuffer(body, "<u4", 2 * n).reshape(2, n).tolist()
    at, before = 8 * n, b""
    for h, k in zip(shared, rest):
        before = before[:h] + body[at:at + k]
        at += k
        yield before, h


def merge(runs: Sequence[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(string, prefix shared with the output before, run) in order. Every entry of the tree holds
    its common prefix with the last string that beat it; of two entries the one with the longer
    prefix is smaller, and only equal prefixes need a look at the bytes behind them."""
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [None] * size
    shared = [0] * size

    def step(r: int) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        heads[r], shared[r] = got if got else (None, 0)

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        a, b = heads[x], heads[y]
        if b is None:
            return x, y
        if a is None:
            return y, x
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        h = common_prefix(a, b, shared[x])
        if a[h:h + 1] <= b[h:h + 1]:
            shared[y] = h
            return x, y
        shared[x] = h
        return y, x

    for r in range(size):
        step(r)
        shared[r] = 0
    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        yield heads[top], shared[top], top
        step(top)
        node, now = (top + size) // 2, top
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        top = now
