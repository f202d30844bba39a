r"""Surrogates for personal data, in DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, phone, card and social security numbers, long
hexadecimal secrets, and names behind a title that tells the gender. Each mention is made of
parts (the local part and domain of an address, the given name and surname of a person), and a
part is one entity wherever and however it is written: case and separators do not count.

An entity's surrogate is drawn from a keyed hash and looks like it: letters stay letters of
their script, digits digits; numbers keep their length, phone numbers with + their first digit, card numbers
their first digit and validity, addresses their top-level domain, private networks stay private; names are made of
syllables of their script with an ending of their gender. A mention's case and separators are
put back. So equal entities get equal surrogates in the whole corpus.

Surrogates are checked over all entities: two entities must not share one, and none may equal a
real entity. Of those that clash the smallest keeps its surrogate unless it is a real one; the
others draw again, with longer words from the second time on, until none clashes. Two kinds
keep distinctness but may equal real ones, as there may be no free ones: addresses of private
networks, which a keyed permutation of the network maps one to one without any draw, and what
has met real ones ``FREE_ATTEMPTS`` times, as of numbers of a form that is nearly used up.

Only entities and the documents that have any are shuffled.

Defined cases: null texts stay null; rows with equal id and text get equal results; texts
without entities stay as they are; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.llm.keys import KEY, bring_back, keyed
from trailmark.storage import materialize

# Titles and the gender they tell.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Señorita", "Doña", "Madame", "Mme",
          "Mademoiselle", "Mlle", "Госпожа", "Κυρία"],
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.\p{{L}}])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
SSN = r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"(?<![\p{L}\d+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\p{L}\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
)
CARD = r"(?<![\p{L}\d])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
LARGE_172 = r"^172\.(?:1[6-9]|2\d|3[01])\."
PRIVATE = r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"
#: Draws after which a surrogate may equal a real entity of its form.
FREE_ATTEMPTS = 12
SECRET = r"(?<![\p{L}\d])[0-9a-fA-F]{32,}(?![\p{L}\d])"
ANY_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
NAME = rf"(?<![\p{{L}}])(?:{ANY_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
#: In this order, kinds are told apart.
KINDS = {
    "email": EMAIL,
    "ip": IP,
    "secret": SECRET,
    "ssn": SSN,
    "card": CARD,
    "phone": PHONE,
    "name": NAME,
}
ENTITY = "|".join(KINDS.values())

# Syllables of names by script, and endings by gender.
SYLLABLES = {
    "latin": ["ba", "co", "da", "el", "fi", "ga", "ha", "jo", "ka", "li", "ma", "ne", "ol", "pe", "ra", "si",
              "ta", "ul", "vi", "wen", "ya", "zo", "bri", "cla", "dre", "fre", "gus", "hel", "mar", "ros"],
    "cyrillic": ["ба", "во", "га", "де", "жа", "за", "ки", "ла", "ми", "на", "ол", "па", "ра", "се", "та", "фе"],
    "greek": ["αν", "βα", "γε", "δη", "ελ", "ζω", "θε", "ιω", "κα", "λε", "μα", "νι", "πα", "ρο", "σο", "τα"],
}
ENDINGS = {
    "latin": {"m": "n", "f": "a", "s": "s"},
    "cyrillic": {"m": "р", "f": "а", "s": "в"},
    "greek": {"m": "ς", "f": "α", "s": "ς"},
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


def kind_of(mention: Column) -> Column:
    """The first kind whose pattern takes the whole mention."""
    kind = F.lit("name")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(mention.rlike(rf"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def alphanumerics(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def parts_of(mention: Column, kind: Column) -> Column:
    """The entities of a mention, in order: type and canonical form."""

    def part(kind: Column | str, canonical: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), canonical.alias("canonical"))

    lower = F.lower(mention)
    domain = F.regexp_extract(lower, r"@(.*)\.[^.]+$", 1)
    gender = F.when(mention.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? "), "f").otherwise("m")
    words = F.split(F.regexp_replace(lower, r"^\S+ ", ""), " ")
    person = F.when(
        F.size(words) > 1,
        F.array(part(F.concat(F.lit("given_"), gender), F.get(words, 0)), part("surname", F.get(words, 1))),
    ).otherwise(F.array(part("surname", F.get(words, 0))))
    return (
        F.when(kind == "email", F.array(part("email", lower), part("domain", domain)))
        .when(kind == "name", person)
        .when(kind == "ip", F.array(part("ip", lower)))
        .when(mention.startswith("+"), F.array(part("phone_abroad", alphanumerics(lower))))
        .otherwise(F.array(part(kind, alphanumerics(lower))))
    )


def draw(seed: Column, i: Column, n: Column | int) -> Column:
    """The ``i``-th number below ``n`` of an entity."""
    digits = F.substring(F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n).cast("int")


def script_of(value: Column) -> Column:
    script = F.lit("latin")
    for name, pattern in SCRIPTS.items():
        script = F.when(value.rlike(pattern), name).otherwise(script)
    return script


def by_script(script: Column, values: dict[str, Column]) -> Column:
    chosen = values["latin"]
    for name in SCRIPTS:
        chosen = F.when(script == name, values[name]).otherwise(chosen)
    return chosen


def similar_letters(value: Column, seed: Column, more: Column) -> Column:
    """Each letter and digit replaced by one of its sort, ``more`` letters behind."""
    length = F.char_length(value)

    def letter(i: Column) -> Column:
        old = F.substring(value, i + 1, 1)
        pools = {name: F.lit(letters) for name, letters in LETTERS.items()}
        pool = F.when(old.rlike(r"^\p{N}$"), "0123456789").otherwise(by_script(script_of(old), pools))
        return F.substring(pool, draw(seed, i, F.char_length(pool)) + 1, F.lit(1))

    # `more` keeps the sequence from being empty only where a draw asks for it
    drawn = F.transform(F.sequence(F.lit(0), F.greatest(length + more, F.lit(1)) - 1), letter)
    return F.array_join(drawn, "")


def luhn_sum(digits: Column) -> Column:
    """Check sum of a number whose last digit is the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(
        values, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def permuted(number: Column, bits: int, key: str) -> Column:
    """A keyed permutation of the numbers of ``bits`` bits (a Feistel network of eight turns)."""
    size = 1 << (bits // 2)
    halves = F.struct(
        F.floor(number / size).cast("int").alias("left"), (number % size).cast("int").alias("right")
    )

    def turned(state: Column, turn: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(f"{key}|{bits}"), turn.cast("string"), state.right.cast("string")), 256)
        mixed = state.left.bitwiseXOR(draw(seed, F.lit(0), size).cast("int"))
        return F.struct(state.right.alias("left"), mixed.alias("right"))

    turns = F.sequence(F.lit(1), F.lit(8))
    return F.aggregate(turns, halves, turned, lambda state: state.left * size + state.right)


def private_address(prefix: str, base: int, place: Column, bits: int, key: str) -> Column:
    """The address behind ``prefix`` that the permutation of its network puts in the place of another."""

    def written(number: Column) -> Column:
        octets = [F.floor(number / 65536), F.floor(number / 256) % 256, number % 256]
        return F.concat(F.lit(prefix), F.concat_ws(".", *[octet.cast("int").cast("string") for octet in octets]))

    return F.get(F.transform(F.array(permuted(place, bits, f"{key}|{prefix}") + base), written), 0)


def surrogate_of(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """What stands for an entity at the given attempt; in canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 256)
    more = F.greatest(attempt - 1, F.lit(0))
    number = similar_letters(canonical, seed, F.lit(0))
    body = F.concat(
        F.substring(canonical, 1, 1),
        F.substring(number, F.lit(2), F.char_length(number) - 2),
    )
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    valid = luhn_sum(canonical) % 10 == 0
    card = F.when(valid, F.concat(body, check)).otherwise(F.concat(body, F.right(number, F.lit(1))))
    octet = [draw(seed, F.lit(i), 254) + 1 for i in range(4)]
    low = F.transform(F.split(canonical, r"\."), lambda x: x.cast("int"))
    place = (F.get(low, 1) * 256 + F.get(low, 2)) * 256 + F.get(low, 3)
    public = F.array_except(F.sequence(F.lit(1), F.lit(223)), F.array(*map(F.lit, (10, 127, 172, 192))))
    first = F.get(public, draw(seed, F.lit(0), 219))
    ip = (
        F.when(canonical.startswith("10."), private_address("10.", 0, place, 24, key))
        .when(canonical.startswith("127."), private_address("127.", 0, place, 24, key))
        .when(canonical.startswith("192.168."), private_address("192.", 168 << 16, place % 65536, 16, key))
        .when(canonical.rlike(LARGE_172), private_address("172.", 16 << 16, place - (16 << 16), 20, key))
        .otherwise(F.concat_ws(".", first, *octet[1:]))
    )
    secret = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.char_length(canonical), F.lit(1)) - 1),
            lambda i: F.substring(F.lit("0123456789abcdef"), draw(seed, i, 16) + 1, F.lit(1)),
        ),
        "",
    )
    script = script_of(canonical)
    gender = F.right(kind, F.lit(1))
    pools = {name: F.array(*map(F.lit, values)) for name, values in SYLLABLES.items()}
    pool = by_script(script, pools)
    ending = by_script(
        script,
        {
            name: F.when(gender == "m", e["m"]).when(gender == "f", e["f"]).otherwise(e["s"])
            for name, e in ENDINGS.items()
        },
    )
    syllables = F.least(F.greatest(F.floor(F.char_length(canonical) / 2), F.lit(2)), F.lit(4)) + more
    name = F.concat(
        F.array_join(
            F.transform(F.sequence(F.lit(1), syllables.cast("int")), lambda i: F.get(pool, draw(seed, i, F.size(pool)))),
            "",
        ),
        ending,
    )
    return (
        F.when(kind == "email", similar_letters(alphanumerics(F.substring_index(canonical, "@", 1)), seed, more))
        .when(kind == "domain", similar_letters(alphanumerics(canonical), seed, more))
        .when(kind == "ip", ip)
        .when(kind == "secret", secret)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), number)
        .when(
            kind == "phone_abroad",
            F.concat(F.substring(canonical, 1, 1), F.substring(number, F.lit(2), F.char_length(number))),
        )
        .otherwise(name)
    )


def choose_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``type, canonical, surrogate`` for distinct entities, without clashes."""
    scope = F.when(F.col("type") == "email", F.substring_index("canonical", "@", -1)).otherwise("")
    own = F.when(F.col("type") == "email", alphanumerics(F.substring_index("canonical", "@", 1))).when(
        F.col("type") == "domain", alphanumerics(F.col("canonical"))
    ).otherwise(F.col("canonical"))
    drawn = entities.select("type", "canonical", scope.alias("scope"), own.alias("own")).withColumn(
        "attempt", F.lit(0)
    )
    real = entities.select(
        F.col("type").alias("real_type"), scope.alias("real_scope"), own.alias("real")
    ).distinct()
    real = materialize(real, "real-entities")
    while True:
        drawn = materialize(
            drawn.withColumn(
                "surrogate", surrogate_of(F.col("type"), F.col("canonical"), F.col("attempt"), key)
            ),
            "surrogates",
        )
        keepers = drawn.groupBy("type", "scope", "surrogate").agg(
            F.min(F.struct(-F.col("attempt"), "canonical")).alias("keeper")
        ).select(
            F.col("type").alias("t"), F.col("scope").alias("s"), F.col("surrogate").alias("u"), "keeper"
        )
        checked = drawn.join(
            keepers, (F.col("type") == F.col("t")) & (F.col("scope") == F.col("s")) & (F.col("surrogate") == F.col("u"))
        ).join(
            real,
            (F.col("type") == F.col("real_type"))
            & (F.col("scope") == F.col("real_scope"))
            & (F.col("surrogate") == F.col("real")),
            "left",
        )
        # addresses of private networks are permuted, hence distinct, among all that there are
        free = ~((F.col("type") == "ip") & F.col("canonical").rlike(PRIVATE)) & (F.col("attempt") < FREE_ATTEMPTS)
        clash = (F.col("keeper.canonical") != F.col("canonical")) | (F.col("real").isNotNull() & free)
        checked = materialize(
            checked.select("type", "canonical", "scope", "own", "attempt", "surrogate", clash.alias("clash")),
            "checked-surrogates",
        )
        if checked.where("clash").isEmpty():
            return checked.select("type", "canonical", "surrogate")
        drawn = checked.select(
            "type", "canonical", "scope", "own", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")
        )


def put_back(mention: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits at the places and in the case of the mention's.

    Characters that the mention has no place for follow behind its last letter or digit.
    """
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def step(state: Column, char: Column) -> Column:
        filled = char.rlike(r"^[\p{L}\p{N}]$")
        new = F.substring(surrogate, state.used + 1, F.lit(1))
        new = F.when(char.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)
        return F.struct(
            F.concat(state.text, F.when(filled, new).otherwise(char)).alias("text"),
            (state.used + filled.cast("int")).alias("used"),
        )

    return F.aggregate(
        chars, start, step, lambda s: F.concat(s.text, F.substring(surrogate, s.used + 1, F.char_length(surrogate)))
    )


def render(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The text that replaces a mention, from the surrogates of its parts."""
    shouted = (F.upper(mention) == mention) & mention.rlike(r"\p{Lu}")

    def in_case(value: Column) -> Column:
        return F.when(shouted, F.upper(value)).otherwise(value)

    first, second = F.get(surrogates, 0), F.get(surrogates, 1)
    local = put_back(F.substring_index(mention, "@", 1), first)
    domain = put_back(F.regexp_extract(mention, r"@(.*)\.[^.]+$", 1), second)
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    return (
        F.when(kind == "email", F.concat(in_case(local), F.lit("@"), in_case(domain), F.regexp_extract(mention, r"\.[^.]+$", 0)))
        .when(kind == "name", F.concat(title, F.initcap(F.concat_ws(" ", first, second))))
        .when(kind == "ip", first)
        .when(kind == "secret", F.when(mention.rlike("[A-F]"), F.upper(first)).otherwise(first))
        .otherwise(put_back(mention, first))
    )


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``row`` (the document), the new ``text``, and ``n_entities`` replaced."""
    rows = keyed(docs)
    found = rows.where(F.col("text").rlike(ENTITY)).select(
        *KEY, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("mentions")
    )
    found = materialize(found.dropDuplicates(KEY), "mentions")
    mentions = (
        found.select(F.explode("mentions").alias("mention"))
        .distinct()
        .withColumn("kind", kind_of(F.col("mention")))
        .withColumn("parts", parts_of(F.col("mention"), F.col("kind")))
    )
    mentions = materialize(mentions, "distinct-mentions")
    parts = mentions.select("mention", F.posexplode("parts").alias("place", "part"))
    parts = parts.select("mention", "place", "part.*")
    surrogates = choose_surrogates(parts.select("type", "canonical").distinct(), key)
    filled = (
        parts.join(surrogates, ["type", "canonical"])
        .groupBy("mention")
        .agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("chosen"))
        .withColumnRenamed("mention", "of")
    )
    replacements = materialize(
        mentions.join(filled, F.col("mention") == F.col("of")).select(
            F.col("mention").alias("of"),
            render(F.col("mention"), F.col("kind"), F.col("chosen.surrogate")).alias("replacement"),
        ),
        "replacements",
    )
    placed = found.select(*KEY, F.posexplode("mentions").alias("place", "mention"))
    # a mention may be in very many documents: it is one row here, and the other side is split
    by_doc = (
        placed.join(replacements, F.col("mention") == F.col("of"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("place", "replacement"))).alias("chosen"))
        .select(*KEY, F.col("chosen.replacement").alias("replacements"))
    )
    decided, others = bring_back(rows, materialize(by_doc, "replacements-by-document"))
    # what lies between the mentions, each followed by a replacement
    between = F.split("text", ENTITY, -1)
    woven = F.zip_with(
        between, F.col("replacements"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    )
    text = F.when(F.col("replacements").isNull(), F.col("text")).otherwise(F.array_join(woven, ""))
    n = F.coalesce(F.size("replacements"), F.lit(0))
    n = F.when(F.col("replacements").isNull(), 0).otherwise(n).cast("bigint").alias("n_entities")
    done = decided.select("row", text.alias("text"), n)
    if others is None:
        return done
    return done.unionByName(others.select("row", "text", F.lit(0).cast("bigint").alias("n_entities")))
