import pyarrow as pa
import pytest
from cases import fresh, low_words, odd_texts, words

from trailmark.llm.words import LOWERED, PLAIN, blocks, find_words, hash_words


@pytest.mark.parametrize("table, fold, plain", [(PLAIN, False, words), (LOWERED, True, low_words)])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_words_are_those_of_the_pattern(table, fold, plain, size):
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts(fresh())] + ["X", " x"]
    column, seen = pa.array(texts), {}
    rows = 0
    for block in blocks(column, size):
        found = find_words(block, table)
        hashes = hash_words(block, found, fold)
        for r in range(block.n_rows):
            mine = range(found.first[r], found.first[r + 1])
            got = [block.data[found.start[i] : found.end[i]].tobytes().decode() for i in mine]
            want = plain(texts[block.first_row + r])
            assert (list(map(str.lower, got)) if fold else got) == (
                list(map(str.lower, want)) if fold else want
            )
            for i, word in zip(mine, want):
                assert seen.setdefault(int(hashes[i]), word) == word
        rows += block.n_rows
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_no_texts_make_no_blocks():
    assert list(blocks(pa.array([], pa.string()))) == []
