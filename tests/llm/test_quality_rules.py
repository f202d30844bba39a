from collections import Counter

from cases import documents, fresh, no_documents, odd_texts, prose, words

from trailmark.llm.quality import COUNTS, judge, keep_good


def counts(text):
    w, seen, repeated = words(text), Counter(), set()
    seen.update(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if words(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_counts_and_base_rules_equal_brute_force(spark):
    rng = fresh()
    texts = odd_texts(rng) + ["a b c a b c a b c d", "x\n\nx\n x", "<#> $ a|b", " ".join("abc") * 40]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = documents(spark, texts)
    for row in judge(docs.withColumnRenamed("n", "N_WORDS")).collect():
        want = counts(row.text)
        assert tuple(row[name] for name in COUNTS) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)


def test_a_document_unlike_its_source_goes_and_the_same_text_stays_elsewhere(spark):
    rng = fresh(2)
    plain = [prose(rng, 100) for _ in range(150)]
    piped = [" | ".join(prose(rng, 100).split()) for _ in range(150)]
    rows = [(i, t, "en", "prose") for i, t in enumerate(plain + piped[:2])]
    rows += [(1000 + i, t, "en", "tables") for i, t in enumerate(piped)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    kept = {row.doc_id for row in keep_good(docs).collect()}
    assert kept == {*range(150), *range(1000, 1150)}


def test_columns_stay_and_empty_tables_are_empty(spark):
    docs = documents(spark, odd_texts(fresh()))
    good = keep_good(docs)
    assert good.columns == docs.columns
    assert {row.doc_id for row in good.collect()} == {6, 50, None, 11}
    assert keep_good(no_documents(spark)).collect() == []
    nothing = documents(spark, [None, ""])
    assert [row.kept for row in judge(nothing).collect()] == [False, False]


def test_no_python_in_the_plan(spark):
    docs = documents(spark, ["a b"])
    assert "Python" not in judge(docs)._jdf.queryExecution().toString()
