"""An adaptive radix tree over byte strings, for one task's bounded block of keys."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

#: Children that a sorted layout holds, small then large, and an indexed one.
SMALL, SORTED, INDEXED = 4, 16, 48


class Node:
    """A node: the bytes after its branching byte (path compression), the value
    of the key that ends here, and children in a layout that grows with them.

    Up to 16 children: sorted branching bytes beside a list (4, then 16 places);
    up to 48: a 256-byte index into the list; more: a list of 256 places.
    """

    __slots__ = ("index", "kids", "layout", "prefix", "value")

    def __init__(self, prefix: bytes, value: Any = None):
        self.prefix, self.value = prefix, value
        self.layout, self.index, self.kids = SMALL, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.layout <= SORTED:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == INDEXED:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, kid: Node) -> None:
        """A child for a branching byte that has none yet."""
        if self.layout <= INDEXED and len(self.kids) == self.layout:
            self._grow()
        if self.layout <= SORTED:
            at = bisect_left(self.index, byte)
            self.index.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.layout == INDEXED:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.layout == SMALL:
            self.layout = SORTED
        elif self.layout == SORTED:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.layout, self.index = INDEXED, index
        else:
            self.kids = [self.kids[at - 1] if at else None for at in self.index]
            self.layout, self.index = 256, bytearray()

    def children(self) -> Iterator[tuple[int, Node]]:
        """(branching byte, child) in byte order."""
        if self.layout <= SORTED:
            yield from zip(self.index, self.kids)
        elif self.layout == INDEXED:
            yield from ((byte, self.kids[at - 1]) for byte, at in enumerate(self.index) if at)
        else:
            yield from ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)

    def split(self, at: int) -> None:
        """Keep ``prefix[:at]`` here and move the rest to an only child."""
        below = Node(self.prefix[at + 1 :], self.value)
        below.layout, below.index, below.kids = self.layout, self.index, self.kids
        byte, self.prefix, self.value = self.prefix[at], self.prefix[:at], None
        self.layout, self.index, self.kids = SMALL, bytearray(), []
        self.add(byte, below)


class RadixTree:
    def __init__(self) -> None:
        self.root: Node | None = None

    def insert(self, key: bytes, value: Any) -> None:
        """Add a key, or replace its value; values are not None."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                own = key[at : at + len(prefix)]
                apart = int.from_bytes(own) ^ int.from_bytes(prefix[: len(own)])
                node.split(len(own) - (apart.bit_length() + 7) // 8)
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            kid = node.find(key[at])
            if kid is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            node, at = kid, at + 1

    def walk(self) -> Iterator[tuple[bytes, Node, int]]:
        """(branching byte and prefix, node, nodes above it), in key order."""
        stack = [] if self.root is None else [(self.root.prefix, self.root, 0)]
        while stack:
            edge, node, above = stack.pop()
            yield edge, node, above
            stack.extend((bytes([byte]) + kid.prefix, kid, above + 1) for byte, kid in reversed(list(node.children())))
