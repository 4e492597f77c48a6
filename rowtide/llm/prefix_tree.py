"""A prefix tree of sets in one global order, to find the sets that a set overlaps enough."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

# Least overlap that counts, for two sizes. For a subtree it is taken at its least and largest
# size, so between these it must not fall below both by more than one.
Need = Callable[[int, int], int]


class Node:
    """A run of tokens that the sets below share, and bounds over those sets."""

    __slots__ = ("run", "children", "ends", "rest", "low", "high", "last")

    def __init__(self, run: tuple[int, ...]):
        self.run, self.children, self.ends = run, [], []
        self.rest = 0  # most tokens that a set has below this node
        self.low = self.high = 0  # least and largest size of the sets
        self.last = run[-1] if run else -1


def build(members: list[tuple[tuple[int, ...], int, int]], depth: int = 0) -> Node:
    """A tree of (ascending tokens, size, number); sets are sorted, so prefixes lie together."""
    root = Node(())
    work = [(root, 0, len(members), depth)]
    made = [root]
    while work:
        parent, start, stop, at = work.pop()
        while start < stop and len(members[start][0]) == at:
            parent.ends.append(members[start][1:])
            start += 1
        while start < stop:
            first = members[start][0]
            # Sets that share the next token, and how far the first and last of them agree.
            end = start + 1
            while end < stop and members[end][0][at] == first[at]:
                end += 1
            final = members[end - 1][0]
            to, most = at + 1, min(len(first), len(final))
            if end - start == 1:
                to = len(first)
            else:
                while to < most and first[to] == final[to]:
                    to += 1
            child = Node(first[at:to])
            parent.children.append(child)
            made.append(child)
            work.append((child, start, end, to))
            start = end
    for node in reversed(made):
        sizes = [s for s, _ in node.ends]
        node.low = min([*sizes, *(c.low for c in node.children)], default=0)
        node.high = max([*sizes, *(c.high for c in node.children)], default=0)
        node.rest = max((len(c.run) + c.rest for c in node.children), default=0)
    return root


def overlapping(root: Node, tokens: tuple[int, ...], size: int, need: Need, fits: Callable[[int, int], bool], wanted: Callable[[int], bool]) -> Iterator[int]:
    """Numbers of the sets in the tree that have the needed overlap with ``tokens``.

    Going down, the overlap with a shared run is counted once for all sets below it. A
    subtree is left out if the overlap so far and the fewer of the tokens left on either side
    cannot reach what the sizes in it need, or if ``wanted`` turns down its only set. Sizes of
    two sets must fit each other.
    """
    have, stack = frozenset(tokens), [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        for other, number in node.ends:
            if fits(size, other) and overlap >= need(size, other) and wanted(number):
                yield number
        left = len(tokens) - bisect_left(tokens, node.last + 1)
        for child in node.children:
            least = min(need(size, child.low), need(size, child.high)) - 1
            if overlap + min(left, len(child.run) + child.rest) < least:
                continue
            if not child.children and len(child.ends) == 1 and not wanted(child.ends[0][1]):
                continue
            stack.append((child, overlap + len(have.intersection(child.run))))
