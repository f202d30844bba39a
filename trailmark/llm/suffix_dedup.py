"""Suffix-array dedup of bytes, sorted deep and shallow.

A byte goes if a string of 400 bytes around it also starts anywhere else, in the same document
or another; matches never cross documents. Candidate passages are dealt to tasks by the anchor
they hold (see ``passages``); each group is a small shard, whose suffixes of at least 400 bytes
are sorted to that depth. Multikey quicksort takes eight bytes at a time as one symbol and
refines all groups of equal prefixes until ``SHALLOW`` bytes. What still ties then has a long
common prefix and is inserted into a blind trie, which keeps only branching depths and bytes:
a suffix goes down without comparing, is compared once with the leaf it reaches, and branches
off where the two part. Suffixes that part from a leaf nowhere within 400 bytes are equal.

Defined cases: a null text has no bytes; repeated rows repeat each other's bytes and lose them;
null ids are documents like others; other columns are carried along. What is kept is bytes, as
a cut may fall inside a character.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from trailmark.llm.keys import keyed
from trailmark.llm.passages import Spec, ranges_of, remove_repeated

WINDOW = 400
SPEC = Spec(words=False, window=WINDOW, gram=204, sub=8)
SHALLOW = 32
SYMBOL = 8


def sort_shallow(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and where each tie begins."""
    order = np.arange(len(starts))
    tie = np.zeros(len(starts), np.int64)
    for at in range(0, depth, SYMBOL):
        places = starts[order][:, None] + np.arange(at, at + SYMBOL)
        symbol = data[places].view(">u8").ravel()
        inner = np.lexsort((symbol, tie))
        order, symbol, tie = order[inner], symbol[inner], tie[inner]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (tie[1:] != tie[:-1])
        tie = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, tie


class Leaf:
    """Suffixes that are equal up to the depth of the sort."""

    __slots__ = ("suffixes",)

    def __init__(self, suffix: int):
        self.suffixes = [suffix]


class Branch:
    """Suffixes that part at ``depth``, by the byte they have there."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict[int, Leaf | Branch]):
        self.depth, self.children = depth, children


class BlindTrie:
    """Sorts suffixes with a long common prefix."""

    def __init__(self, data: bytes, first: int, depth: int):
        self.data, self.depth = data, depth
        self.root: Leaf | Branch = Leaf(first)

    def insert(self, suffix: int) -> None:
        data, node = self.data, self.root
        while type(node) is Branch:  # blindly: bytes between branches are not looked at
            found = node.children.get(data[suffix + node.depth])
            node = found or next(iter(node.children.values()))
        leaf, other = node, node.suffixes[0]
        mine, its = data[suffix : suffix + self.depth], data[other : other + self.depth]
        if mine == its:
            leaf.suffixes.append(suffix)
            return
        common = np.frombuffer(mine, np.uint8) != np.frombuffer(its, np.uint8)
        part = int(common.argmax())
        above, node = None, self.root
        while type(node) is Branch and node.depth < part:
            above, node = node, node.children[data[suffix + node.depth]]
        if type(node) is Branch and node.depth == part:
            node.children[mine[part]] = Leaf(suffix)
            return
        branch = Branch(part, {its[part]: node, mine[part]: Leaf(suffix)})
        if above is None:
            self.root = branch
        else:
            above.children[data[suffix + above.depth]] = branch

    def leaves(self) -> list[list[int]]:
        """Groups of equal suffixes, in order."""
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is Leaf:
                found.append(node.suffixes)
            else:
                stack += [node.children[byte] for byte in sorted(node.children, reverse=True)]
        return found


def sort_suffixes(data: bytes, starts: np.ndarray, depth: int) -> list[list[int]]:
    """The suffixes in order of their first ``depth`` bytes, equal ones in one list."""
    order, tie = sort_shallow(np.frombuffer(data, np.uint8), starts, min(depth // SYMBOL * SYMBOL, SHALLOW))
    ordered = starts[order].tolist()
    first = np.flatnonzero(tie == np.arange(len(tie))).tolist()
    result: list[list[int]] = []
    for lo, hi in zip(first, [*first[1:], len(ordered)]):
        if hi - lo == 1:
            result.append([ordered[lo]])
        else:
            trie = BlindTrie(data, ordered[lo], depth)
            for suffix in ordered[lo + 1 : hi]:
                trie.insert(suffix)
            result += trie.leaves()
    return result


def match_passages(group: list[dict]) -> list[list[int]]:
    """For each passage that has a single place, its windows that are also in other passages."""
    if all(row["n"] > 1 for row in group):
        return [[] for _ in group]
    bodies = [row["body"] for row in group]
    base = np.cumsum([0, *map(len, bodies)])
    starts = np.concatenate([np.arange(b, b + len(x) - WINDOW + 1) for b, x in zip(base, bodies)])
    repeated = np.zeros(base[-1], bool)
    for equal in sort_suffixes(b"".join(bodies), starts, WINDOW):
        if len(equal) > 1:
            repeated[equal] = True
    return [
        ranges_of(repeated[lo : hi - WINDOW + 1]) if row["n"] == 1 else []
        for row, lo, hi in zip(group, base, base[1:])
    ]


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``row`` (the document), ``kept`` (bytes), ``n_symbols, n_removed, n_spans``."""
    return remove_repeated(keyed(docs), SPEC, match_passages, ordered=False)
