import hashlib

import numpy as np
import pytest
from cases import documents, fresh, low_words, no_documents, odd_texts, prose

from trailmark.llm.decontaminate import find_contamination, remove_contamination
from trailmark.llm.fm_index import FMIndex, suffix_array


def brute(text, items, window):
    w, hit, found = low_words(text), set(), set()
    for name, item in items:
        phrase = low_words(item)
        k = min(window, len(phrase))
        grams = {tuple(phrase[i : i + k]) for i in range(len(phrase) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add("null" if name is None else str(name))
    return len(w), sorted(hit), sorted(found)


def test_suffix_array_and_search_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        symbols = rng.integers(0, 4, n)
        symbols[-1] = 0
        zero = np.flatnonzero(symbols == 0)
        rank = symbols + len(zero)
        rank[zero] = np.arange(len(zero))
        assert suffix_array(symbols).tolist() == sorted(range(n), key=lambda i: rank[i:].tolist())
        starts = np.concatenate([[0], zero[:-1] + 1])
        index = FMIndex(symbols, starts)
        for phrase in rng.integers(1, 5, (10, 3)):
            low, high = index.search(phrase[None, :])
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert got == [i for i in range(n - 2) if (symbols[i : i + 3] == phrase).all()]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_hits_equal_brute_force_in_one_part_or_many(spark, part_bytes):
    rng = fresh(3)

    def text(n):
        return " ".join(rng.choice(["a", "B", "c,", "é", "1-x"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 3, 6, 9]))) for i in range(8)] + [(None, "é é c b"), (3, "x"), (9, None)]
    texts = [text(rng.randrange(40)) for _ in range(30)] + odd_texts(rng)
    docs = documents(spark, texts).withColumnRenamed("hash", "Spans")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for row in find_contamination(docs, benchmark, window=4, part_bytes=part_bytes).collect():
        n, hit, found = brute(row.text, items, 4)
        spans = [i for s in row.spans for i in range(s.word, s.end_word)]
        assert (row.n_words, spans, row["items"]) == (n, hit, found)


def test_spans_are_cut_and_the_rest_stays(spark):
    rng = fresh(4)
    leak = prose(rng, 15)
    texts = [f"Before {leak.upper()}, after", leak, prose(rng, 40), None, "", f"x {leak} y {leak} z"]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(1, leak)], "item_id int, text string")
    got = {row.doc_id: row for row in remove_contamination(docs, benchmark).collect()}
    assert got[0].text == "Before , after" and got[0].n_chars == 14
    assert got[1].text == "" and got[1].n_chars == 0
    assert (got[2].text, got[3].text, got[4].text) == (texts[2], None, "")
    assert got[5].text == "x  y  z"
    assert remove_contamination(docs, benchmark).columns == docs.columns
    empty = benchmark.limit(0)
    assert hashlib.md5(str([r.text for r in remove_contamination(docs, empty).collect()]).encode()).digest() == (
        hashlib.md5(str(texts).encode()).digest()
    )
    assert remove_contamination(no_documents(spark), benchmark).collect() == []
