import random
from collections import Counter, defaultdict

import numpy as np
from cases import documents, fresh, no_documents, odd_texts, prose, words

from trailmark.llm.substring_dedup import SuffixAutomaton, dedup_substrings
from trailmark.llm.suffix_dedup import dedup_bytes, sort_suffixes


def test_matching_statistics_equal_brute_force():
    rng = fresh(7)
    for _ in range(200):
        automaton = SuffixAutomaton()
        texts = [[rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(3)]
        for text in texts:
            automaton.add(text)
        query = [rng.choice("abcd") for _ in range(15)]
        known = {"".join(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [
            max([0] + [n for n in range(1, i + 2) if "".join(query[i + 1 - n : i + 1]) in known])
            for i in range(len(query))
        ]
        assert automaton.matching_statistics(query).tolist() == want


def test_suffixes_are_sorted_and_equal_ones_found():
    rng = random.Random(8)
    for _ in range(200):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(60, 150)))
        starts = np.arange(len(data) - 39)
        want = defaultdict(list)
        for i in starts.tolist():
            want[data[i : i + 40]].append(i)
        assert [sorted(equal) for equal in sort_suffixes(data, starts, 40)] == [want[k] for k in sorted(want)]


def cover(n, window, starts):
    gone = [False] * n
    for i in starts:
        gone[i : i + window] = [True] * window
    return gone


def passages(rng):
    """Long texts that share passages of all lengths around the thresholds, and odd ones."""
    shared = [prose(rng, n) for n in (30, 49, 50, 51, 70, 120, 400)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(prose(rng, rng.randrange(60)))
            passage = rng.choice(shared).split()
            cut = rng.randrange(3)
            parts.append(" ".join(passage[cut : len(passage) - rng.randrange(3)]))
        texts.append("\n".join(parts))
    texts += ["x" * 900, "ab" * 700, prose(rng, 45) + " é" * 300, texts[3], texts[4]]
    return texts + odd_texts(rng)


def test_words_removed_equal_brute_force(spark):
    texts = passages(fresh(9))
    docs = documents(spark, texts)
    first = {}
    for row in docs.collect():
        w = words(row.text)
        for i in range(len(w) - 49):
            if row.doc_id is not None:
                gram = tuple(w[i : i + 50])
                first[gram] = min(first.get(gram, row.doc_id), row.doc_id)
    removed = 0
    for row in dedup_substrings(docs).collect():
        w = words(row.row.text)
        starts = [
            i
            for i in range(len(w) - 49)
            if row.row.doc_id is not None and first[tuple(w[i : i + 50])] < row.row.doc_id
        ]
        gone = cover(len(w), 50, starts)
        assert bytes(row.kept).decode() == " ".join(x for x, g in zip(w, gone) if not g)
        assert (row.n_symbols, row.n_removed) == (len(w), sum(gone))
        removed += sum(gone)
    assert removed > 1000


def test_bytes_removed_equal_brute_force(spark):
    texts = passages(fresh(10))
    docs = documents(spark, texts)
    count = Counter()
    for row in docs.collect():
        raw = (row.text or "").encode()
        count.update(raw[i : i + 400] for i in range(len(raw) - 399))
    removed = 0
    for row in dedup_bytes(docs).collect():
        raw = (row.row.text or "").encode()
        gone = cover(len(raw), 400, [i for i in range(len(raw) - 399) if count[raw[i : i + 400]] > 1])
        assert bytes(row.kept) == bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        assert (row.n_symbols, row.n_removed, row.n_spans) == (len(raw), sum(gone), spans)
        removed += sum(gone)
    assert removed > 1000


def test_empty_tables(spark):
    assert dedup_substrings(no_documents(spark)).collect() == []
    assert dedup_bytes(no_documents(spark)).collect() == []
