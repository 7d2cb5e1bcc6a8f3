"""Surrogates: every entity replaced in place, distinct and alike where they should be; entities are listed by hand."""

import hashlib
import hmac

import pytest
import regex
from pyspark.sql import functions as F

from veldra.llm import pii, queries

KEY = b"a test's key"
CARD = "Card 4111 1111 1111 1111 and 4111111111111111 x 9807915762804490\n"
#: (doc_id, text, what stands in it)
ROWS = [
    (1, "Mail John.Doe55@mail7.example.com or JOHN.DOE55@mail7.example.com. Call +1 (017) 555-7713, 017-555-7713; ip 97.51.17.173.", ["John.Doe55@mail7.example.com", "JOHN.DOE55@mail7.example.com", "+1 (017) 555-7713", "017-555-7713", "97.51.17.173"]),
    (2, "Dr. Anna Petrova met Mr. James Smith and James Smith; Frau Müller. Мария Иванова. SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00", ["Dr. Anna Petrova", "Mr. James Smith", "James Smith", "Frau Müller", "Мария Иванова", "123-45-6789", "DE89 3704 0044 0532 0130 00"]),
    (None, None, []), (3, "", []), (3, "clean text 1.2.3 version 12345", []), (4, "x " * 20000 + "a@b.co", ["a@b.co"]),
    (5, CARD, ["4111 1111 1111 1111", "4111111111111111", "9807915762804490"]), (5, CARD, ["4111 1111 1111 1111", "4111111111111111", "9807915762804490"]),
    (None, "Иван Петров: иван.п@почта.рф, +49 30 123456", ["Иван Петров", "иван.п@почта.рф", "+49 30 123456"]), (6, "97.51.17.173", ["97.51.17.173"]),
]


def replaced(text, entities, new):
    """What stands in ``new`` in the places of ``entities``; the rest must be equal."""
    gaps, at = [], 0
    for e in entities:
        i = text.index(e, at)
        gaps.append(text[at:i])
        at = i + len(e)
    gaps.append(text[at:])
    assert new.startswith(gaps[0])
    out, at = [], len(gaps[0])
    for i, gap in enumerate(gaps[1:], 1):
        end = len(new) - len(gap) if i == len(entities) else new.index(gap, at + 1)
        assert new[end:].startswith(gap) and end > at
        out.append(new[at:end])
        at = end + len(gap)
    return out


def check(rows):
    """``(text, entities, new text, n)`` rows: one entity maps to one surrogate and back."""
    forms = {}
    for text, entities, new, n in rows:
        assert n == len(entities)
        if not entities:
            assert new == text
            continue
        for value, made in zip(entities, replaced(text, entities, new), strict=True):
            assert forms.setdefault(value, made) == made != value
    assert len(set(forms.values())) == len(forms)
    return forms


def place(r):
    return repr(r[0]), len(r[1] or "")


def test_small_cases(spark):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string").selectExpr("*", "'c' AS canon", "2 AS value", "9 AS n_entities")
    out = pii.pseudonymise(docs, KEY)
    assert out.columns == ["doc_id", "text", "canon", "value", "n_entities"]
    before = {}
    for r in ROWS:
        before.setdefault((r[0], len(r[2])), []).append(r)
    got = [(*before[r.doc_id, r.n_entities][0][1:], r.text, r.n_entities) for r in out.collect() if r.n_entities]
    assert len(got) == sum(bool(r[2]) for r in ROWS)
    assert sorted(((r.doc_id, r.text) for r in out.where("n_entities = 0").collect()), key=repr) == sorted((r[:2] for r in ROWS if not r[2]), key=repr)
    forms = check(got)
    assert forms["John.Doe55@mail7.example.com"].lower() == forms["JOHN.DOE55@mail7.example.com"].lower()
    assert forms["Mr. James Smith"] == "Mr. " + forms["James Smith"]
    assert forms["James Smith"].split()[0] in pii.GIVEN[("latin", "m")]
    assert forms["Dr. Anna Petrova"].split()[1] in pii.GIVEN[("latin", "f")]
    assert forms["Мария Иванова"].split()[0] in pii.GIVEN[("cyrillic", "f")]
    assert forms["4111 1111 1111 1111"].replace(" ", "") == forms["4111111111111111"]
    assert regex.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", forms["+1 (017) 555-7713"])
    assert regex.fullmatch(r"\d{3}-\d{2}-\d{4}", forms["123-45-6789"])
    assert regex.fullmatch(r"DE\d\d( \d{4}){4} \d\d", forms["DE89 3704 0044 0532 0130 00"])
    assert all(0 < int(x) < 256 for x in forms["97.51.17.173"].split("."))
    digits = [int(c) for c in forms["4111111111111111"]]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert pii.pseudonymise(docs.limit(0), KEY).collect() == []


def test_persons_keep_their_names_and_titles(spark):
    text = "Mr. John Smith wrote; Mr. Smith left. Mrs. Smith stayed; Dr. Smith; Mr. John Miller, Dr. Kim Smith and Mrs. Kim Smith-Miller."
    names = ["Mr. John Smith", "Mr. Smith", "Mrs. Smith", "Dr. Smith", "Mr. John Miller", "Dr. Kim Smith", "Mrs. Kim Smith-Miller"]
    new = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first().text
    full, short, wife, doctor, other, kim, double = (n.split(" ") for n in replaced(text, names, new))
    assert full[0] == short[0] == "Mr." and wife[0] == "Mrs." and doctor[0] == "Dr."
    assert full[2] == short[1] == wife[1] == doctor[1] == kim[2] != "Smith"
    assert other[1] == full[1] in pii.GIVEN[("latin", "m")] and other[2] not in ("Miller", full[2])
    assert kim[1] == double[1] in pii.GIVEN[("latin", "f")] and "-" in double[2]


def test_documents(spark):
    kinds = [r"[\w.%+-]+@mail\d+\.example\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", r"(?<![0-9a-f])\d{16}(?![0-9a-f])"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = queries.op6_surrogates(spark, "/root/testdata/sf0.01").collect()
    found = {d: [m.group() for m in regex.finditer("|".join(kinds), t or "", regex.I)] for d, t in before.items()}
    forms = check([(before[r.doc_id], found[r.doc_id], r.text, r.n_entities) for r in out])
    assert len(out) == len(before) and len(forms) > 50
    assert not set(forms) & set(forms.values())


@pytest.mark.parametrize("real", [range(30), range(100)])
def test_collisions_are_redrawn(spark, real):
    # A draw of two digits, and of three once there is no room: surrogates collide until redrawn.
    draw = lambda key, kind, canon, gender, attempt: F.concat(F.lpad(F.pmod(F.xxhash64(canon, attempt), F.lit(100)).cast("string"), 2, "0"), F.repeat(F.lit("7"), F.floor(attempt / 6).cast("int")))
    rows = [("card", f"{i:02d}", "n") for i in real]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string, gender string"), KEY, draw).collect()
    assert len({r.surrogate for r in got}) == len(got) == len(rows)
    assert not {r.surrogate for r in got} & {c for _, c, _ in rows}


def test_a_space_that_is_full(spark):
    # Every number of this length is real, and so is every mail box of one letter.
    numbers = [f"+1 {i:02d}" for i in range(100)]
    boxes = [f"{a}@b.co" for a in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame([(1, ", ".join(numbers)), (2, ", ".join(boxes))], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    assert out[1].n_entities == 100 and out[2].n_entities == 26
    for r, real in ((out[1], numbers), (out[2], boxes)):
        made = r.text.split(", ")
        assert len(set(made)) == len(real) and not set(made) & set(real)


def test_many_given_names(spark):
    # More names of one gender than the list has.
    text = "; ".join(f"Mr. Xa{chr(97 + i // 26)}{chr(97 + i % 26)} Smith" for i in range(120))
    new = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first().text.split("; ")
    assert len(set(new)) == 120 and len({n.split()[-1] for n in new}) == 1


def test_addresses_of_any_length(spark):
    # Thousands of labels, marks at the end of a sentence, labels that do not end an address.
    long = "x@" + "a." * 20000 + "com"
    rows = [(1, long), (2, "to a.b@c.de. Or x@y.co-op, q@r.s1"), (3, "no@address and a@b or @c.de"), (4, "a" * 200000 + " " + "1-" * 50000 + "+" * 1000)]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert [out[i].n_entities for i in (1, 2, 3, 4)] == [1, 3, 0, 0]
    assert len(out[1].text) == len(long) and out[1].text != long
    made = replaced(rows[1][1], ["a.b@c.de", "x@y.co-op", "q@r.s1"], out[2].text)
    assert made[0].endswith(".de") and made[1].endswith(".co-op") and made[2].endswith(".s1")


def test_keys(spark):
    said = pii.keyed_stream(KEY, F.lit("é|1"), F.lit(20))
    want = "".join(hmac.new(KEY, f"{i}|é|1".encode(), hashlib.sha256).hexdigest() for i in range(2))
    assert "".join(spark.range(1).select(said.alias("s")).first().s) == want
    docs = spark.createDataFrame([(1, "a1@mail.example.com")], "doc_id long, text string")
    one, two, again = (pii.pseudonymise(docs, k).first().text for k in (b"one", b"two", b"one"))
    assert one == again != two
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"")
