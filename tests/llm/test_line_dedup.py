import pyarrow as pa
from cases import documents, fresh, no_documents, odd_texts, prose, words

from trailmark.llm.line_dedup import dedup_lines, find_chunks, without_repeated_lines
from trailmark.llm.words import blocks


def chunks(text):
    block = next(blocks(pa.array([text])))
    found = find_chunks(block)
    return [block.data[s:e].tobytes().decode() for s, e in zip(found.start, found.end)]


def texts(rng):
    shared = [[prose(rng, 6) for _ in range(n)] for n in (2, 6, 12, 25)]
    made = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += [prose(rng, 5) for _ in range(rng.randrange(4))] + rng.choice(shared)
        made.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    return made + odd_texts(rng) + ["\n" * 50, "\n" * 50]


def test_removal_equals_brute_force(spark):
    docs = documents(spark, texts(fresh(11)))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    first, want, removed = {}, {}, 0
    for row in rows:
        kept = []
        for number, chunk in enumerate(chunks(row.text or "")):
            place = (row.doc_id, row.text, number)
            many = sum(1 for line in chunk.split("\n") if words(line)) >= 2
            if many and first.setdefault(chunk, place) != place:
                removed += 1
            else:
                kept.append(chunk)
        want[row.doc_id, row.text] = "\n".join(kept)
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows) and removed > 50
    for row in got:
        assert (row.text or "") == want[row.row.doc_id, row.row.text]
        assert row.n_lines == len((row.row.text or "").split("\n"))


def test_boundaries_do_not_shift():
    rng = fresh(12)
    lines = [prose(rng, 5) for _ in range(60)]
    whole = chunks("\n".join(lines))
    assert len(whole) > 5
    assert set(whole[2:]) <= set(chunks("\n".join(["new line", "another", *lines])))


def test_columns_stay_and_emptied_documents_go(spark):
    rng = fresh(13)
    body = "\n".join(prose(rng, 6) for _ in range(30))
    single = sum("\n" not in chunk for chunk in chunks(body))
    docs = documents(spark, [body, body, "", None, prose(rng, 3)])
    left = without_repeated_lines(docs)
    assert left.columns == docs.columns
    got = {row.doc_id: row for row in left.collect()}
    assert got[0].text == body and got[2].text == "" and got[3].text is None
    assert (1 in got) == bool(single)
    if single:
        assert got[1].n_chars == len(got[1].text)
    assert without_repeated_lines(no_documents(spark)).collect() == []
