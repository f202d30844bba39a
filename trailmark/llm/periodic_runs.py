"""Periodic runs of words: stretches that repeat with some period, found in one scan of a text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at
least ``MIN_LENGTH`` words and ``MIN_PERIODS`` periods long, that no neighbouring word extends.

The scan is an online dynamic program over lags. For each word, its earlier occurrences at the
active lags make their match lengths one longer; a lag whose earlier word differs ends there,
and is emitted at once if its match is long enough. Only lags that can become a run are
admitted, so the table of active lags is sparse in any text, however often a word occurs:

- A run of period q repeats its grams of g words at lag q, where g is the power of two with
  g/2 < q <= g. Inside the run the nearest earlier occurrence of such a gram is exactly q words
  back: a nearer one would give g + q words two periods and, by Fine and Wilf, the run a smaller
  one. So at each g a word admits at most one lag, that of the nearest occurrence of its gram.
- It is admitted where its match is exactly g words long, which in a run happens once.

Grams get names by doubling (a gram is the pair of names of its halves) from the words' own
bytes, so equality is exact, and words whose gram occurs once in the text leave the next
doubling. Time is n log n for a text of n words, and much less where little repeats.

Defined cases: null, empty and blank texts have no words, no runs and an empty ``collapsed``;
overlapping runs are all found, and a word goes if any of them drops it; repeated documents
each get their row; columns of any name are carried along in ``row``; an empty table gives none.
Memory is that of a block of texts (words.BLOCK_BYTES), or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trailmark.llm.tasks import map_batches
from trailmark.llm.words import PLAIN, Block, Words, blocks, find_words

MIN_LENGTH = 6
MIN_PERIODS = 4

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in RUN.names]))


def number_words(block: Block, words: Words) -> np.ndarray:
    """A number for each word, equal if and only if the bytes are."""
    offsets = np.concatenate([[0], np.cumsum(words.end - words.start)])
    letters = block.data[PLAIN[block.data]]
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def admitted_lags(numbers: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words (rows of: word, lag, words matched) at which a lag enters the scan, in order."""
    found = [np.zeros((0, 3), np.int64)]
    at = np.arange(len(numbers))
    key = row * (int(numbers.max(initial=0)) + 1) + numbers
    size = 1
    while len(at):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        at, name = at[count[name] > 1], name[count[name] > 1]
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        here, lag = at[order[1:]][same], (at[order[1:]] - at[order[:-1]])[same]
        near = (lag <= size) & (2 * lag > size)
        here, lag = here[near], lag[near]
        ahead = here - size  # the word in front of the gram, which must not match too
        starts = ahead - lag < first[row[here]]
        starts |= numbers[ahead] != numbers[np.where(starts, 0, ahead - lag)]
        found.append(np.stack([here, lag, np.full(len(here), size)], 1)[starts])
        names = np.full(len(numbers), -1)
        names[at] = name
        left = at - size
        whole = left >= first[row[at]]
        whole &= names[np.where(whole, left, 0)] >= 0
        at, left = at[whole], left[whole]
        key = names[left] * (int(name.max(initial=0)) + 1) + names[at]
        size *= 2
    lags = np.concatenate(found)
    return lags[np.argsort(lags[:, 0], kind="stable")]


def scan(numbers: list[int], admitted: list[list[int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text, from its words and the lags admitted at them."""
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> words matched so far

    def end(lag: int, i: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(MIN_LENGTH, MIN_PERIODS * lag):
            runs.append((i - length, length, lag))

    i = upcoming = 0
    while active or upcoming < len(admitted):
        if not active:
            i = admitted[upcoming][0]
        if i == len(numbers):
            for lag in list(active):
                end(lag, i)
            break
        for lag in list(active):
            if numbers[i] == numbers[i - lag]:
                active[lag] += 1
            else:
                end(lag, i)
        while upcoming < len(admitted) and admitted[upcoming][0] == i:
            active[admitted[upcoming][1]] = admitted[upcoming][2]
            upcoming += 1
        i += 1
    return sorted(runs, key=lambda run: (run[0], run[2]))


def join_words(block: Block, words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = np.where(kept, words.end - words.start + 1, 0)
    to = np.concatenate([[0], np.cumsum(size)])
    has = np.add.reduceat(np.append(size, 0), words.first[:-1]) * (np.diff(words.first) > 0)
    ends = to[words.first]  # behind the space that ends each text so far
    out = np.full(int(to[-1]), 0x20, np.uint8)
    shift = np.repeat(to[:-1] - words.start, words.end - words.start)
    chosen = np.repeat(kept, words.end - words.start)
    inside = np.flatnonzero(PLAIN[block.data])
    out[(inside + shift)[chosen]] = block.data[inside[chosen]]
    if len(out):
        # the last space of every text that has words left is not part of it
        out = np.delete(out, ends[1:][has > 0] - 1)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(has - 1, 0))])
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)
    ).cast(pa.string())


def runs_of_block(block: Block) -> tuple[Words, list[list[dict]], pa.Array]:
    """Words, runs by text, and the texts without the repeats of their runs."""
    words = find_words(block, PLAIN)
    numbers, row = number_words(block, words), words.row
    admitted = admitted_lags(numbers, row, words.first)
    split = np.searchsorted(admitted[:, 0], words.first)
    runs: list[list[dict]] = [[] for _ in range(block.n_rows)]
    edges = np.zeros(len(numbers) + 1, np.int64)
    for r in np.flatnonzero(np.diff(split)):
        first, end = words.first[r], words.first[r + 1]
        lags = admitted[split[r] : split[r + 1]] - np.array([first, 0, 0])
        for start, length, period in scan(numbers[first:end].tolist(), lags.tolist()):
            runs[r].append({"start": start, "length": length, "period": period})
            edges[first + start + period] += 1
            edges[first + start + length] -= 1
    return words, runs, join_words(block, words, np.cumsum(edges)[:-1] == 0)


def find_runs(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns but ``text``), ``n_words``, ``runs`` by start and period, ``collapsed``."""
    others = [name for name in docs.columns if name != "text"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words, runs, collapsed = runs_of_block(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(block.first_row, block.n_rows),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(runs, _RUNS),
                        collapsed,
                    ],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.struct(*others).alias("row"), "text")
    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return map_batches(rows, search, schema)
