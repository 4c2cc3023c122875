"""Deep-shallow sorting of byte strings with their common-prefix lengths, for worker code.

Strings are sorted within groups. The shallow part is a multikey quicksort whose characters are 8-byte words, down to
`SHALLOW` bytes; the segments of all groups are partitioned together, a round at a time. Strings still equal there have
long common prefixes and go to a blind trie, which looks at branching positions only and compares each new string with
one other in full.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
#: Beyond the end of a string; no UTF-8 byte has this value, so it sorts last and is equal to none.
END = 0xFF


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> list[tuple[int, int]]:
    """(member, common prefix with the one before) in sorted order; the first has 0."""
    same: dict[int, list[int]] = {members[0]: [members[0]]}
    root: object = members[0]
    for new in members[1:]:
        s, node = strings[new], root
        while isinstance(node, list):
            at, kids = node
            node = kids.get(s[at] if at < len(s) else END)
            if node is None:
                node = next(iter(kids.values()))
        leaf = node
        other = strings[leaf]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            same[leaf].append(new)
            continue
        same[new] = [new]
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = (node, s[node[0]]), node[1][s[node[0]]]
        mine = s[depth] if depth < len(s) else END
        if isinstance(node, list) and node[0] == depth:
            node[1][mine] = new
            continue
        split = [depth, {mine: new, other[depth] if depth < len(other) else END: node}]
        if above is None:
            root = split
        else:
            above[0][1][above[1]] = split
    out: list[tuple[int, int]] = []
    stack: list[tuple[object, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, list):
            kids = sorted(node[1].items(), reverse=True)
            stack += [(kid, node[0]) for _, kid in kids[:-1]] + [(kids[-1][1], shared)]
        else:
            first, *rest = same[node]
            out.append((first, shared))
            out += [(k, len(strings[k])) for k in rest]
    return out


def multikey_quicksort(words: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, words), and the starts of its runs of equal (group, words).

    Three-way partitions by the median of three, a character (8-byte word) at a time: what is smaller or larger than
    the pivot stays at its depth, what equals it goes one deeper. All segments of a round are partitioned together.
    """
    n, depths = words.shape
    order = np.argsort(groups, kind="stable")
    grouped = groups[order]
    starts = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
    sizes, depth = np.diff(np.r_[starts, n]), np.zeros(len(starts), np.int64)
    done: list[np.ndarray] = []
    while len(starts):
        ended = (sizes == 1) | (depth == depths)
        done.append(starts[ended])
        starts, sizes, depth = starts[~ended], sizes[~ended], depth[~ended]
        if not len(starts):
            break
        first, middle, last = (words[order[starts + k], depth] for k in (0, sizes // 2, sizes - 1))
        pivot = np.maximum(np.minimum(first, middle), np.minimum(np.maximum(first, middle), last))
        segment = np.repeat(np.arange(len(starts)), sizes)
        base = np.cumsum(sizes) - sizes
        at = np.arange(len(segment)) - base[segment] + starts[segment]
        value = words[order[at], depth[segment]]
        side = 1 + (value > pivot[segment]).astype(np.int64) - (value < pivot[segment])
        counts = np.bincount(3 * segment + side, minlength=3 * len(starts)).reshape(-1, 3)
        inner = np.cumsum(counts, axis=1) - counts
        target = np.empty(len(at), np.int64)
        for k in range(3):
            here = side == k
            rank = np.cumsum(here) - here
            target[here] = (starts + inner[:, k])[segment[here]] + (rank - rank[base][segment])[here]
        order[target] = order[at]
        some = counts.ravel() > 0
        starts = (starts[:, None] + inner).ravel()[some]
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()[some]
        sizes = counts.ravel()[some]
    return order, np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, bytes) and each one's common prefix with its predecessor (-1 at a group's start)."""
    n = len(strings)
    padded = np.frombuffer(b"".join([s[:SHALLOW].ljust(SHALLOW, b"\xff") for s in strings]), ">u8").astype(np.uint64).reshape(n, SHALLOW // 8)
    order, starts = multikey_quicksort(padded, groups)
    grouped = groups[order]
    prefix = np.full(n, -1, np.int64)
    inside = starts[1:][grouped[starts[1:]] == grouped[starts[1:] - 1]]
    for k in inside.tolist():
        prefix[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    sizes = np.diff(np.r_[starts, n])
    for lo, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        deep = blind_trie(strings, order[lo : lo + size].tolist())
        order[lo : lo + size] = [k for k, _ in deep]
        prefix[lo + 1 : lo + size] = [p for _, p in deep[1:]]
    return order, prefix
