import pytest
from cases import documents, fresh, no_documents, odd_texts
from tokenizers import Tokenizer, models, pre_tokenizers

from trailmark.llm.token_counts import Counter, count_tokens, read_vocabulary

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def tokenizer(vocabulary, byte_fallback):
    made = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(made.encode(text or "", add_special_tokens=False).tokens)


def test_ties_and_unknowns_follow_the_tokenizer():
    rng = fresh(17)
    for _ in range(200):
        pieces = ["".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))]
        vocabulary = list({"<unk>": -3.0, **{p: float(-rng.randrange(1, 5)) for p in pieces}}.items())
        exact, counter = tokenizer(vocabulary, False), Counter(vocabulary)
        for _ in range(20):
            text = "".join(rng.choice("ab cé▁ ") for _ in range(rng.randrange(14)))
            assert counter.of_text(text)[0] == exact(text), (vocabulary, text)


@pytest.mark.parametrize("remembered", [3, 400_000])
def test_counts_of_a_public_vocabulary(spark, remembered, monkeypatch):
    monkeypatch.setattr("trailmark.llm.token_counts.REMEMBERED_WORDS", remembered)
    vocabulary = read_vocabulary(PATH)
    exact, counter = tokenizer(vocabulary, True), Counter(vocabulary)
    texts = [t[1] if isinstance(t, tuple) else t for t in odd_texts(fresh())]
    texts += ["☃☃x\n☃ <s> <0x0A> ▁▁  q", "日本語 テスト", "The quick brown fox, jumped."]
    assert [counter.of_text(t)[0] for t in texts] == [exact(t) for t in texts]


def test_the_operator(spark):
    vocabulary = read_vocabulary(PATH)
    exact = tokenizer(vocabulary, True)
    docs = documents(spark, odd_texts(fresh())).withColumnRenamed("n", "N_TOKENS")
    rows = count_tokens(docs, vocabulary).collect()
    assert len(rows) == docs.count()
    assert all(row.n_tokens == exact(row.text) for row in rows)
    assert count_tokens(no_documents(spark), vocabulary).collect() == []
