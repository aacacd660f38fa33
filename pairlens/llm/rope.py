"""Texts as balanced trees of leaves, which are cut and joined without copying what lies between the cuts.

A unit is a word with the white space before it, or the white space at the end of a text. Every leaf and fork caches how
many units and code points lie below it, so that a tree is split at the k-th of either by one walk from the root. Trees are
never changed: what a split or join makes shares the leaves that it leaves whole. Two trees of any heights are joined in
steps that grow with the difference of their heights, and stay balanced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._text import SPACES

#: Units in a leaf, at most.
LEAF = 256


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of all texts begin, where text k is data[offsets[k]:offsets[k + 1]]."""
    space = ~SPACES[data]
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(opens)


def is_point(data: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 opens a code point."""
    return (data & 0xC0) != 0x80


class Leaf:
    __slots__ = ("data", "points", "units")
    height = 0

    def __init__(self, data: bytes, units: int, points: int):
        self.data, self.units, self.points = data, units, points

    def cut(self, at: int) -> tuple[Leaf | None, Leaf | None]:
        """The parts before and from a byte position."""
        return leaf(self.data[:at]), leaf(self.data[at:])

    def place(self, rank: int, by: str) -> int:
        """Byte position of the unit or code point of that rank."""
        data = np.frombuffer(self.data, np.uint8)
        found = unit_starts(data, np.array([0, len(data)])) if by == "units" else np.flatnonzero(is_point(data))
        return int(found[rank]) if rank < len(found) else len(data)


class Fork:
    __slots__ = ("height", "left", "points", "right", "units")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


#: A tree; None is the empty text.
Rope = Leaf | Fork


def leaf(data: bytes, units: int | None = None) -> Leaf | None:
    if not data:
        return None
    codes = np.frombuffer(data, np.uint8)
    return Leaf(data, len(unit_starts(codes, np.array([0, len(codes)]))) if units is None else units, int(is_point(codes).sum()))


def build(leaves: list[Leaf]) -> Rope | None:
    """A tree of equal heights over leaves in their order."""
    level: list = list(leaves)
    while len(level) > 1:
        level = [Fork(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def ropes(data: np.ndarray, offsets: np.ndarray, size: int = LEAF) -> Iterator[Rope | None]:
    """A tree for each text, with at most `size` units in a leaf."""
    starts = unit_starts(data, offsets)
    first = np.searchsorted(starts, offsets)
    points = np.concatenate([[0], np.cumsum(is_point(data))])
    for lo, hi, end in zip(first[:-1].tolist(), first[1:].tolist(), offsets[1:].tolist(), strict=True):
        edges = [*starts[lo:hi:size].tolist(), end]
        count = [*range(lo, hi, size), hi]
        yield build([Leaf(data[a:b].tobytes(), m - k, int(points[b] - points[a])) for a, b, k, m in zip(edges, edges[1:], count, count[1:], strict=False)])


def _balanced(left: Rope, right: Rope) -> Rope:
    """A fork of two trees whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Fork(left.left, Fork(left.right, right))
        return Fork(Fork(left.left, left.right.left), Fork(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Fork(Fork(left, right.left), right.right)
        return Fork(Fork(left, right.left.left), Fork(right.left.right, right.right))
    return Fork(left, right)


def join(left: Rope | None, right: Rope | None) -> Rope | None:
    if left is None or right is None:
        return right if left is None else left
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return Fork(left, right)


def joined(*parts: Rope | None) -> Rope | None:
    out = None
    for part in parts:
        out = join(out, part)
    return out


def split(rope: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """The first `rank` units (or points) and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if isinstance(rope, Leaf):
        return rope.cut(rope.place(rank, by))
    below = getattr(rope.left, by)
    if rank <= below:
        left, right = split(rope.left, rank, by)
        return left, join(right, rope.right)
    left, right = split(rope.right, rank - below, by)
    return join(rope.left, left), right


def leaves(rope: Rope | None) -> Iterator[Leaf]:
    todo = [] if rope is None else [rope]
    while todo:
        node = todo.pop()
        if isinstance(node, Leaf):
            yield node
        else:
            todo += [node.right, node.left]


def find(rope: Rope | None, mark: bytes) -> int:
    """Code points before the first place of a mark that has no white space and so lies within one leaf; -1 if there is none."""
    before = 0
    for node in leaves(rope):
        at = node.data.find(mark)
        if at >= 0:
            return before + int(is_point(np.frombuffer(node.data, np.uint8)[:at]).sum())
        before += node.points
    return -1


def text(rope: Rope | None) -> bytes:
    return b"".join(node.data for node in leaves(rope))
