import corpus_pipeline
import pyarrow as pa
from cases import documents, fresh, no_documents, prose, words
from test_line_dedup import texts

from trailmark.llm.keys import keyed
from trailmark.llm.line_dedup import dedup_runs, find_chunks, find_repeated_runs
from trailmark.llm.words import blocks


def pairs(text):
    """Neighbours among the lines that are not blank: (first line, second line, lines between included)."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if words(line)]
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(full, full[1:])]


def test_every_repeated_run_goes(spark):
    rng = fresh(21)
    made = texts(rng) + ["same\n" * 5, "a\n\nb\n\nc", "x\na\n\nb\n\nc\ny", "a\nb", "x\r\n \nz", "x\r\n \nz\n"]
    docs = documents(spark, made)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    first, want = {}, {}
    for row in order:
        text, key = row.text or "", (row.doc_id, row.text)
        lines, gone = text.split("\n"), set()
        for number, (a, b, both) in enumerate(pairs(text)):
            place = first.setdefault(both, (key, number))
            if place[0] != key or number - place[1] > 1:
                gone |= {a, b}
        full = [i for i, line in enumerate(lines) if words(line)]
        for a, b in zip(full, full[1:]):
            if a in gone and b in gone:
                gone |= set(range(a, b))
        runs = sum(i - 1 not in gone for i in gone)
        want[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), runs, len(gone))
    got = dedup_runs(docs).collect()
    assert len(got) == len(order) and sum(n for *_, n in want.values()) > 500
    for row in got:
        counts = row.n_lines, row.n_removed_chunks, row.n_removed_lines
        assert (row.text or "", *counts) == want[row.row.doc_id, row.row.text]
    assert dedup_runs(no_documents(spark)).collect() == []


def test_the_stage_removes_short_runs_in_mid_document(spark):
    rng = fresh(22)
    for n in (2, 3, 4, 8):
        block = [prose(rng, 9) for _ in range(n)]
        around = [[prose(rng, 9) for _ in range(6)] for _ in range(5)]
        docs = documents(spark, ["\n".join([*a[:3], *block, *a[3:]]) for a in around])
        got = {row.doc_id: row.text for row in corpus_pipeline.line_dedup(spark, docs, "").collect()}
        assert got == {
            i: "\n".join([*a[:3], *([] if i else block), *a[3:]]) for i, a in enumerate(around)
        }


def test_whole_chunks_are_looked_up_where_they_repeat(spark):
    rng = fresh(23)
    block = [prose(rng, 9) for _ in range(40)]
    made = ["\n".join([*(prose(rng, 9) for _ in range(4)), *block, *(prose(rng, 9) for _ in range(4))]) for _ in range(4)]
    docs = documents(spark, made)
    sent = {row.key_id: row.sent for row in find_repeated_runs(keyed(docs)).collect()}
    assert sorted(sent) == [1, 2, 3]
    text = blocks(pa.array(made))
    chunks = [find_chunks(b) for b in text][0]
    for i, units in sent.items():
        mine = [n for n, row in enumerate(chunks.row) if row == i]
        inner = [n for n in mine if chunks.n_filled[n] >= 2 and (chunks.hash == chunks.hash[n]).sum() == 4]
        whole = {unit.number for unit in units if unit.whole}
        assert whole == {int(chunks.number[n]) for n in inner} and len(whole) >= 4
        # what is left for pairs: where chunks meet, and at the ends of the block
        assert sum(not unit.whole for unit in units) <= len(mine) + 8
    got = {row.row.doc_id: row.n_removed_lines for row in dedup_runs(docs).collect()}
    assert got == {0: 0, 1: 40, 2: 40, 3: 40}
