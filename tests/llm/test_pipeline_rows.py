"""All rows of the pipeline against a plain chain of its five stages."""

import re

import corpus_pipeline
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from cases import LOW_WORD, fresh, low_words, prose, words
from compare import canonical, oracle_rows
from test_line_runs import pairs
from test_near_dedup import edited, plain_similarity, shingles

from trailmark.llm.oracle import MIXING, QUALITY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def fixture(rng):
    """Prose of two sources with near copies, repeated lines, benchmark passages, junk and empty texts."""
    items = [prose(rng, 30, 900) for _ in range(4)]
    block = [prose(rng, 9) for _ in range(3)]
    texts = []
    for i in range(60):
        lines = [prose(rng, rng.randrange(20, 40)) for _ in range(5)]
        if i % 7 == 1:
            lines[2:2] = block
        if i % 9 == 2:
            passage = items[i % 4].split()
            lines[1] = " ".join([lines[1], *passage[3:17], prose(rng, 5)])
        texts.append("\n".join(lines))
    texts += [edited(rng, texts[i], 2) for i in (3, 3, 10)] + [texts[20]]
    texts += [" ".join(["same"] * 90), prose(rng, 70).replace(" ", " ### "), None, "", "too short"]
    docs = [(i, t, "en", "web" if i % 3 else "news", None if t is None else len(t)) for i, t in enumerate(texts)]
    return docs, list(enumerate(items))


def good(docs):
    con = duckdb.connect()
    con.register("documents", pa.table([list(c) for c in zip(*docs)], schema=pa.schema(list(zip(COLUMNS, TYPES)))))
    columns, rows = oracle_rows(con, QUALITY)
    kept = {r[columns.index("doc_id")] for r in rows if r[columns.index("kept")]}
    return [d for d in docs if d[0] in kept]


def without_repeated_runs(docs):
    first, out = {}, []
    for doc in sorted(docs):
        lines, gone = doc[1].split("\n"), set()
        for number, (a, b, both) in enumerate(pairs(doc[1])):
            place = first.setdefault(both, (doc[0], number))
            if place[0] != doc[0] or number - place[1] > 1:
                gone |= {a, b}
        full = [i for i, line in enumerate(lines) if words(line)]
        for a, b in zip(full, full[1:]):
            if a in gone and b in gone:
                gone |= set(range(a, b))
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or words(text):
            out.append((doc[0], text, *doc[2:4], len(text)))
    return out


def one_of_each(docs):
    sets, parent = [shingles(d[1]) for d in docs], list(range(len(docs)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(docs)):
        for j in range(i):
            if plain_similarity(sets[i], sets[j]) >= 0.8 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [d for i, d in enumerate(docs) if root(i) == i]


def decontaminated(docs, items, window=10):
    grams = {tuple(w[i : i + window]) for _, t in items for w in [low_words(t)] for i in range(len(w) - window + 1)}
    out = []
    for doc in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), doc[1])
        found = list(LOW_WORD.finditer(low))
        hit = set()
        for i in range(len(found) - window + 1):
            if tuple(m[0] for m in found[i : i + window]) in grams:
                hit |= set(range(i, i + window))
        text, at = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                text, at = text + doc[1][at : found[i].start()], None
            if i + 1 not in hit:
                at = found[i].end()
        out.append((doc[0], text + doc[1][at:], *doc[2:4], len(text + doc[1][at:])))
    return out


def mixed(docs):
    con = duckdb.connect()
    con.register("documents", pa.table([list(c) for c in zip(*docs)], schema=pa.schema(list(zip(COLUMNS, TYPES)))))
    return oracle_rows(con, MIXING)


def test_rows_equal_a_plain_chain(spark, tmp_path):
    docs, items = fixture(fresh(31))
    schema = pa.schema(list(zip(COLUMNS, TYPES)))
    pq.write_table(pa.table([list(c) for c in zip(*docs)], schema=schema), f"{tmp_path}/documents.parquet")
    benchmark = pa.table([[i for i, _ in items], [t for _, t in items]], names=["item_id", "text"])
    pq.write_table(benchmark, f"{tmp_path}/benchmark.parquet")
    left = [docs]
    for stage in (good, without_repeated_runs, one_of_each, lambda d: decontaminated(d, items)):
        left.append(stage(left[-1]))
    # every stage has something to do
    assert [len(x) for x in left] == sorted((len(x) for x in left), reverse=True)
    assert len(left[1]) < len(left[0]) and left[2] != left[1] and len(left[3]) < len(left[2]) and left[4] != left[3]
    columns, rows = mixed(left[-1])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, rows)
