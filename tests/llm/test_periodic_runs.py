import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from cases import documents, fresh, no_documents, odd_texts, words

from trailmark.llm.periodic_runs import find_runs, runs_of_block
from trailmark.llm.queries import op11_periodic_runs, plant_repeats
from trailmark.llm.words import blocks


def brute(text):
    """All runs from the definition, by period, and the words that stay."""
    w, runs, dropped = words(text), [], set()
    numbers = np.array([list(dict.fromkeys(w)).index(x) if len(w) < 5000 else hash(x) for x in w])
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], numbers[q:] == numbers[:-q], [False]]).astype(int)
        edges = np.diff(same)
        for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + q):
            length = end - start
            if length < max(6, 4 * q):
                continue
            if next(p for p in range(1, q + 1) if all(w[j] == w[j - p] for j in range(start + p, end))) == q:
                runs.append((int(start), int(length), q))
                dropped |= set(range(start + q, end))
    return sorted(runs, key=lambda r: (r[0], r[2])), " ".join(x for j, x in enumerate(w) if j not in dropped)


def found(texts):
    out = []
    for block in blocks(pa.array(texts, pa.string()), 2000):
        _, runs, collapsed = runs_of_block(block)
        out += [
            ([(r["start"], r["length"], r["period"]) for r in of], text)
            for of, text in zip(runs, collapsed.to_pylist())
        ]
    return out


def random_texts(rng, n):
    for _ in range(n):
        alphabet = rng.choice([1, 2, 2, 3, 5, 30])
        parts = []
        for _ in range(rng.randrange(6)):
            part = [rng.choice("abcdefghijklmnopqrstuvwxyzäöüß")[:1] for _ in range(rng.randrange(1, 14))]
            part = [chr(97 + ord(x) % alphabet) for x in part]
            times = rng.choice([1, 1, 2, 3, 4, 5, 9])
            parts += part * times + part[: rng.randrange(len(part) + 1)]
        yield rng.choice([" ", "\n", "  "]).join(parts)


def test_runs_against_the_definition():
    texts = list(random_texts(random.Random(11), 3000))
    assert found(texts) == [brute(t) for t in texts]


def test_nested_periods_and_edges():
    nested = ("a a a a a b " * 6).strip()  # runs of one word inside a run of six
    fibonacci = ["a", "b"]
    while len(fibonacci) < 14:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    texts = [nested, fibonacci[-1], "x " * 5, "x " * 6, "a b " * 4, "a b " * 3 + "a", "", None, "a a", "ä ä ä ä ä ä"]
    assert found(texts) == [brute(t) for t in texts]
    runs, collapsed = found([nested])[0]
    assert (0, 36, 6) in runs and (0, 5, 1) not in runs and collapsed == "a a a a a b"


def test_a_long_text_of_one_word_is_no_work():
    text = "same " * 200_000 + "end"
    (runs, collapsed), *_ = found([text])
    assert runs == [(0, 200_000, 1)] and collapsed == "same end"


def test_odd_documents(spark):
    texts = odd_texts(fresh())
    docs = documents(spark, texts)
    got = find_runs(docs).collect()
    assert sorted((tuple((r.start, r.length, r.period) for r in row.runs), row.collapsed) for row in got) == sorted(
        (tuple(runs), kept) for runs, kept in (brute(t[1] if isinstance(t, tuple) else t) for t in texts)
    )
    assert got[0].row.asDict().keys() == set(docs.columns) - {"text"}
    assert find_runs(no_documents(spark)).collect() == []


def planted(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return " ".join(w)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = [*random_texts(rng, 150), *[" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(90))) for _ in range(250)]]
    docs = documents(spark, [*enumerate(texts), (None, "a " * 9), (7000, None), (7001, ""), (3, texts[3])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.text for r in plant_repeats(docs).collect()] != [r.text for r in docs.collect()]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = []
    for row in docs.collect():
        text = planted(row.doc_id, row.text)
        runs, kept = brute(text)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((row.doc_id, len(runs), *best, milli, sha(lines), sha(kept)))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert {dict(got.dtypes)[c] for c in got.columns[1:6]} == {"bigint"}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert any(e[1] for e in expected[150:])
