"""Substring dedup: suffix automata of reference passages, matching statistics of the rest.

A word goes if a window of 50 words around it also starts in a document with a smaller id.
Reference passages are dealt to tasks by the anchor they hold, as a broadcast of all of them
would grow with the corpus, and so are the passages to look up (see ``passages``). In each
group the passages come by rising id: a passage is streamed through the automaton of those
from smaller ids, which gives at each word the length of the longest match that ends there;
windows are found where that reaches the threshold. Then the passage is added.

Defined cases: a null text has no words; documents without an id are neither references nor
cut; of documents with one id none counts as smaller; repeated rows get equal results; other
columns are carried along.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame

from trailmark.llm.keys import keyed
from trailmark.llm.passages import Spec, ranges_of, remove_repeated

WINDOW = 50
SPEC = Spec(words=True, window=WINDOW, gram=27, sub=4)


class SuffixAutomaton:
    """All substrings of the passages added so far."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the substrings of ``q`` that end at ``p`` and ``word``."""
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, word: bytes) -> int:
        q = self.next[p].get(word)
        if q is not None:  # this prefix is known from another passage
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            known = self.length[q] == self.length[p] + 1
            self.link[state] = q if known else self._split(p, q, word)
        return state

    def matching_statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word, the length of the longest known substring that ends with it."""
        found = np.zeros(len(words), np.int64)
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            found[i] = length
        return found


def match_passages(group: list[dict]) -> list[list[int]]:
    """For each passage (by rising owner) the windows that passages of smaller owners have."""
    automaton = SuffixAutomaton()
    found: list[list[int]] = []
    for _, same in groupby(group, key=lambda row: row["owner"]):
        passages = [row["body"].split(b" ") for row in same]
        for words in passages:
            statistics = automaton.matching_statistics(words) if found else np.zeros(len(words), np.int64)
            found.append(ranges_of(statistics[WINDOW - 1 :] >= WINDOW))
        if len(found) < len(group):
            for words in passages:
                automaton.add(words)
    return found


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``row`` (the document), ``kept`` (words joined by blanks), ``n_symbols, n_removed, n_spans``."""
    return remove_repeated(keyed(docs), SPEC, match_passages, ordered=True)
