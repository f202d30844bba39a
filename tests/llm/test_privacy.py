import re

from cases import documents, fresh, no_documents, odd_texts
from pyspark.sql import functions as F

from trailmark.llm import privacy
from trailmark.llm.privacy import choose_surrogates, replace_entities
from trailmark.storage import materialize

TEXT = (
    "Mail jo.Smith9@mail7.example.com or JO.SMITH9@MAIL7.EXAMPLE.COM, and ann@mail7.example.com; call "
    "+1 (017) 555-7713 or +1-017-555-7713, 212-555-0100. Mr. John Smith met Mrs Smith and Frau Anna Müller. "
    "Card 4111 1111 1111 1111, 4111111111111111### at 10.1.2.3, 97.51.17.173 172.16.3.4, 123-45-6789, "
    "Госпожа Анна Иванова, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 3.14 2024-01-02 12345"
)


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def replaced(spark, texts, key="key"):
    rows = replace_entities(documents(spark, texts), key).collect()
    return {row.row.doc_id: row for row in rows}


def shape(text):
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", text))


def test_surrogates_keep_type_format_and_coreference(spark):
    got = replaced(spark, [TEXT, "again " + TEXT, "plain text"])
    text = got[0].text
    assert got[1].text == "again " + text and got[2].text == "plain text" and got[2].n_entities == 0
    for secret in ("mith9", "555", "John", "Smith", "Müller", "4111 1111", "10.1.2.3", "04dbe", "6789", "Анна"):
        assert secret not in text
    emails = re.findall(r"[\w.]+@[\w.]+\w", text)
    assert emails[0].lower() == emails[1].lower() and emails[1].isupper() and emails[2] not in emails[:2]
    assert len({e.split("@")[1].lower() for e in emails}) == 1
    assert [shape(e) for e in emails] == [shape(e) for e in re.findall(r"[\w.]+@[\w.]+\w", TEXT)]
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1-\d{3}-\d{3}-\d{4}", text)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    cards = re.findall(r"4\d{3} \d{4} \d{4} \d{4}|4\d{15}", text)
    assert len(cards) == 2 and all(map(luhn, cards)) and cards[0].replace(" ", "") == cards[1]
    hosts = re.findall(r"\d+\.\d+\.\d+\.\d+", text)
    assert hosts[0].startswith("10.") and hosts[2].startswith("172.")
    assert not hosts[1].startswith(("10.", "172.", "192.", "127."))
    names = re.search(r"Mr\. (\w+)n (\w+) met Mrs (\w+) and Frau (\w+)a (\w+)\.", text)
    assert names and names[2] == names[3]
    assert re.search(r"Госпожа [А-Я][а-я]*а [А-Я][а-я]*в,", text)
    assert re.search(r'token = "[0-9a-f]{40}" 3.14 2024-01-02 12345$', text)
    assert replaced(spark, [TEXT], "other")[0].text != text


def test_entities_stay_distinct_even_where_surrogates_are_scarce(spark):
    texts = [f"{a}@x.com {a}{b}@x.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "ab"]
    addresses = {e for t in texts for e in t.split()}
    got = replaced(spark, texts)
    pairs = {pair for i, t in enumerate(texts) for pair in zip(t.split(), got[i].text.split())}
    assert len(pairs) == len(addresses) == len({new for _, new in pairs})
    locals_ = {e.split("@")[0] for e in addresses}
    assert not locals_ & {new.split("@")[0] for _, new in pairs}


def test_scarce_names(spark):
    entities = spark.range(3000).select(
        F.lit("given_f").alias("type"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("canonical")
    )
    chosen = choose_surrogates(entities, "k").collect()
    assert len({row.surrogate for row in chosen}) == len(chosen) == 3000


def test_odd_texts(spark):
    docs = documents(spark, [*odd_texts(fresh()), (50, "a@b.de"), (50, "a@b.de"), (None, "a@b.de"), "@ 1.2.3.4.5 x@y"])
    rows = replace_entities(docs, "k").collect()
    assert len(rows) == docs.count()
    new = [row.text for row in rows if row.row.text == "a@b.de"]
    assert len(new) == 3 and len(set(new)) == 1 and new[0] != "a@b.de"
    assert all(row.text == row.row.text for row in rows if not row.n_entities)
    assert replace_entities(no_documents(spark), "k").collect() == []
    assert "Python" not in replace_entities(docs, "k")._jdf.queryExecution().toString()


def test_networks_nearly_used_up_end_in_one_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(privacy, "materialize", lambda frame, label: rounds.append(label) or materialize(frame, label))
    networks = {"192.168.": 60_000, "172.16.": 3000, "10.0.": 3000, "127.0.": 3000}
    rows = [
        ("ip", f"{prefix}{i // 256}.{i % 256}") for prefix, n in networks.items() for i in range(n)
    ]
    entities = spark.createDataFrame(rows, "type string, canonical string")
    got = privacy.choose_surrogates(entities, "k").collect()
    assert rounds.count("surrogates") == 1
    assert len(got) == len({r.surrogate for r in got}) == len(rows)
    for row in got:
        assert row.surrogate.split(".")[0] == row.canonical.split(".")[0]
        assert all(0 <= int(x) <= 255 for x in row.surrogate.split("."))
        if row.canonical.startswith("192.168."):
            assert row.surrogate.startswith("192.168.")
        if row.canonical.startswith("172."):
            assert 16 <= int(row.surrogate.split(".")[1]) <= 31
    few = entities.where("canonical LIKE '172.16.%'")
    again = {r.canonical: r.surrogate for r in privacy.choose_surrogates(few, "k").collect()}
    other = {r.canonical: r.surrogate for r in privacy.choose_surrogates(few, "l").collect()}
    assert again == {r.canonical: r.surrogate for r in got if r.canonical.startswith("172.")} and again != other


def test_a_form_that_is_used_up_ends(spark, monkeypatch):
    monkeypatch.setattr(privacy, "FREE_ATTEMPTS", 2)
    rows = [("phone_abroad", f"1{i:03}") for i in range(520)]  # of 1,000: no 520 others are free
    got = privacy.choose_surrogates(spark.createDataFrame(rows, "type string, canonical string"), "k").collect()
    assert len({r.surrogate for r in got}) == 520
