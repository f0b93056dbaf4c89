"""Adaptive radix trees over byte keys: node layouts that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any


class Few:
    """Children by sorted edge bytes: 4, then 16."""

    __slots__ = ("kids", "keys", "most")

    def __init__(self, most: int = 4):
        self.most, self.keys, self.kids = most, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, node: Node) -> Few | Indexed:
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = node
            return self
        if len(self.keys) == self.most:
            return _grown(self, Few(16) if self.most == 4 else Indexed()).put(byte, node)
        self.keys.insert(at, byte)
        self.kids.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.kids, strict=True)


class Indexed:
    """Up to 48 children in the order they came, and the place of each edge byte's child."""

    __slots__ = ("index", "kids")
    most = 48

    def __init__(self) -> None:
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if at := self.index[byte]:
            self.kids[at - 1] = node
        elif len(self.kids) == self.most:
            return _grown(self, Full()).put(byte, node)
        else:
            self.kids.append(node)
            self.index[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.index) if at)


class Full:
    """A place for the child of each of the 256 edge bytes."""

    __slots__ = ("kids",)
    most = 256

    def __init__(self) -> None:
        self.kids: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.kids[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.kids) if node is not None)


def _grown(old: Few | Indexed, new: Few | Indexed | Full) -> Few | Indexed | Full:
    for byte, node in old.items():
        new.put(byte, node)
    return new


class Node:
    """path: the bytes after the edge byte that all keys below share; value: of the key that ends here; own: a place for the user."""

    __slots__ = ("children", "own", "path", "value")

    def __init__(self, path: bytes, value: Any = None):
        self.path, self.value, self.children, self.own = path, value, None, None

    def add(self, byte: int, node: Node) -> None:
        self.children = (self.children or Few()).put(byte, node)

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.children.items() if self.children is not None else iter(())


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of a stand in b from there on."""
    if b.startswith(a, at):
        return len(a)
    low, high = 0, len(a)
    while low + 1 < high:  # a[:low] stands there, a[:high] does not
        middle = (low + high) // 2
        low, high = (middle, high) if b.startswith(a[:middle], at) else (low, middle)
    return low


class Tree:
    """One value for each key."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def put(self, key: bytes, value: Any) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, above, edge, at = self.root, None, 0, 0
        while True:
            n = _shared(node.path, key, at)
            if n < len(node.path):  # the path parts here
                fork = Node(node.path[:n])
                fork.add(node.path[n], node)
                node.path = node.path[n + 1 :]
                if above is None:
                    self.root = fork
                else:
                    above.add(edge, fork)
                node = fork
            at += n
            if at == len(key):
                node.value = value
                return
            above, edge = node, key[at]
            below = node.children.get(edge) if node.children is not None else None
            at += 1
            if below is None:
                node.add(edge, Node(key[at:], value))
                return
            node = below

    def way(self, key: bytes) -> Iterator[Node]:
        """The nodes from the root to a key of the tree."""
        node, at = self.root, 0
        while node is not None:
            yield node
            at += len(node.path)
            if at >= len(key):
                return
            node = node.children.get(key[at]) if node.children is not None else None
            at += 1
