import pytest
from cases import documents, fresh, prose

from trailmark.llm import substring_dedup, suffix_dedup
from trailmark.llm.keys import keyed
from trailmark.llm.passages import remove_repeated
from test_passages import passages

MOST = 20


def bounded(match):
    def run(group):
        assert len(group) <= MOST, "a group of any size is gathered in one task"
        return match(group)

    return run


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_a_passage_in_a_third_of_all_rows_meets_by_window(spark, operator):
    rng = fresh(23)
    common = prose(rng, 160)
    third = [f"{prose(rng, rng.randrange(5, 40))} {common} {prose(rng, rng.randrange(40))}" for _ in range(60)]
    docs = documents(spark, third + [prose(rng, 90) for _ in range(80)] + passages(rng))
    ordered = operator is substring_dedup
    dealt = remove_repeated(keyed(docs), operator.SPEC, bounded(operator.match_passages), ordered, MOST)
    whole = remove_repeated(keyed(docs), operator.SPEC, operator.match_passages, ordered, 10**9)
    got, want = (
        sorted((r.row.text or "", str(r.row.doc_id), bytes(r.kept), r.n_removed, r.n_spans) for r in frame.collect())
        for frame in (dealt, whole)
    )
    assert got == want
    lost = sum(common in text and removed >= 160 for text, _, _, removed, _ in got)
    assert lost == (59 if ordered else 60)
