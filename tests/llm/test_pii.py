"""Pseudonyms: bijective on whole small domains, valid, linked, reversible."""

import random
import re
from datetime import date, timedelta

import pytest

from dictgraph.llm import pii

SF = "/root/testdata/sf0.001"
KEY = b"k1"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 5041])
def test_permutation_is_one_cycle(size):
    f = pii.Permutation(KEY, "t", size)
    seen, x = set(), 0
    for _ in range(size):
        x = f(x)
        seen.add(x)
    assert x == 0 and len(seen) == size
    assert all(f(f(x), -1) == x for x in range(min(size, 50)))


def test_keys_and_tweaks_differ():
    a, b, c = (pii.Permutation(k, t, 10**9) for k, t in ((KEY, "t"), (b"k2", "t"), (KEY, "u")))
    assert len({f(12345) for f in (a, b, c)}) == 3


def is_card(s):
    d = re.sub(r"\D", "", s)
    return pii.luhn_digit(d[:-1]) == int(d[-1])


VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606"],
    "phone": ["+1 (386) 555-3733", "+44 20 7946 0958", "(386) 555-3733", "386-555-3733", "+1 (017) 555-7713"],
    "ip": ["61.131.143.218", "8.8.8.8"],
    "ssn": ["123-45-6789"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "1.2.2003", "2003/1/2"],
    "email": ["hoccrcif.96@mail8.example.com"],
    "secret": ['token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "password=e3b3ed3cc8548923d6", "API_KEY: abcDEF123_-x"],
}


@pytest.mark.parametrize("kind", VALID)
def test_values_are_replaced_in_their_format_and_restored(kind):
    for value in VALID[kind]:
        text = f"say {value}, again {value}!!"
        new, kinds = pii.pseudonymise(text, KEY)
        assert kinds == [kind, kind] and value not in new
        again = new[4:].split(", again")[0]
        if kind != "date":
            assert new == f"say {again}, again {again}!!"
            assert re.sub(r"\w", "x", again) == re.sub(r"\w", "x", value) or kind == "ip"
        assert pii.pseudonymise(new, KEY, -1)[0] == text or kind == "date"
        assert pii.pseudonymise(new, KEY)[1] == [kind, kind]  # still valid


def test_values_link_across_writings():
    plain = {re.sub(r"\D", "", pii.pseudonym("card", v, KEY)) for v in VALID["card"][:3]}
    assert len(plain) == 1 and is_card(plain.pop())
    phones = {re.sub(r"\D", "", pii.pseudonym("phone", v, KEY))[-10:] for v in ("+1 (386) 555-3733", "(386) 555-3733", "386-555-3733")}
    assert len(phones) == 1


def test_invalid_values_stay():
    text = "4111111111111112 256.1.1.1 01.2.3.4 2023-02-29 31/31/2020 2250-01-01 000-12-3456 666-12-3456 DE89370400440532013001 12345 a@b x4111111111111111 1.2.3.4.5 v4.0."
    assert pii.pseudonymise(text, KEY) == (text, [])


def test_dates_are_a_permutation_and_stay_readable():
    days = [date(1900, 1, 1) + timedelta(n) for n in range(0, 73049, 7)]
    iso = [pii.pseudonym("date", d.isoformat(), KEY) for d in days]
    assert len(set(iso)) == len(days) and all(a != d.isoformat() for a, d in zip(iso, days))
    for d in days[:300]:
        slash = pii.pseudonym("date", d.strftime("%m/%d/%Y"), KEY)
        assert slash == date.fromisoformat(pii.pseudonym("date", d.isoformat(), KEY)).strftime("%m/%d/%Y")
        if d.day > 12:
            new = pii.pseudonym("date", d.strftime("%d/%m/%Y"), KEY)
            assert int(new[:2]) > 12 and pii.pseudonym("date", new, KEY, -1) == d.strftime("%d/%m/%Y")


def test_random_cards_stay_valid_and_distinct():
    rng = random.Random(1)
    cards = {p + str(pii.luhn_digit(p)) for p in (str(rng.randrange(10**14, 10**15)) for _ in range(500))}
    new = {pii.pseudonym("card", c, KEY) for c in cards}
    assert len(new) == len(cards) and all(is_card(c) for c in new) and not new & cards


def test_two_cards_side_by_side_and_nesting():
    text = "4111111111111111 5500005555555559 x.4111111111111111@mail.example.com token=4111111111111111"
    new, kinds = pii.pseudonymise(text, KEY)
    assert kinds == ["card", "card", "email", "secret"] and "4111111111111111" not in new
    assert pii.pseudonymise(new, KEY, -1)[0] == text


def test_tables(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "no values", None), (None, "8.8.8.8", 1), (3, "8.8.8.8", 1), (4, "a" * 200_000 + " 1" * 50_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds int").repartition(2)
    new = pii.pseudonymise_documents(docs, KEY)
    assert new.columns == docs.columns
    got = sorted(map(tuple, new.collect()), key=repr)
    ip = pii.pseudonym("ip", "8.8.8.8", KEY)
    assert got == sorted([r if r[1] != "8.8.8.8" else (r[0], ip, r[2]) for r in rows], key=repr)
    assert sorted(map(tuple, pii.restore_documents(new, KEY).collect()), key=repr) == sorted(rows, key=repr)
    assert {(r.doc_id, r.n_values) for r in pii.pii_report(docs, KEY).collect()} == {(1, 0), (2, 0), (3, 0), (3, 1), (4, 0), (None, 1)}
    assert pii.pii_report(docs.limit(0), KEY).collect() == []


def test_query_on_the_given_table(spark):
    from dictgraph.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_pii_pseudonyms"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_values for r in rows) > 0
    for r in rows:
        for n in re.findall(r"(?<!\w)\d{16}(?!\w)", docs[r.doc_id]):
            assert (n in r.text) == (not is_card(n))
        for m in re.findall(r"\S+@\S+\.com", docs[r.doc_id]):
            assert m not in r.text
        if not r.n_values:
            assert r.text == docs[r.doc_id]


IN_CONTEXT = [
    ("iban", "ES91 2100 0418 4502 0005 1332", " USD"),
    ("iban", "AT611904300234573201", " BIC"),
    ("iban", "PL61109010140000071219812874", " 2024"),
    ("iban", "DE89370400440532013000", " EUR 100"),
    ("phone", "+1 555-123-4567", " 2024"),
    ("phone", "+44 20 7946 0958", " 20245"),
    ("phone", "555.123.4567", "."),
    ("phone", "555 123 4567", ", home"),
    ("phone", "(555) 123 4567", " 2024"),
    ("phone", "(555) 123-4567", ""),
    ("date", "2024-01-05", "T10:00:00Z"),
]


@pytest.mark.parametrize("kind,value,after", IN_CONTEXT)
def test_values_before_other_words(kind, value, after):
    new, kinds = pii.pseudonymise(f"at {value}{after}", KEY)
    assert kinds == [kind] and new == f"at {pii.pseudonym(kind, value, KEY)}{after}"
    assert pii.pseudonymise(new, KEY, -1)[0] == f"at {value}{after}"


def test_phones_link_whatever_follows():
    texts = ["+1 555-123-4567 2024", "+1 555-123-4567", "555.123.4567", "555 123 4567", "(555) 123 4567"]
    assert len({re.sub(r"\D", "", pii.pseudonymise(t, KEY)[0])[-14:].removesuffix("2024")[-10:] for t in texts}) == 1


def test_a_value_behind_a_failed_one_is_found():
    text = "AB12 4111 1111 1111 1111 and AT611904300234573201 ES9121000418450200051332"
    assert pii.pseudonymise(text, KEY)[1] == ["card", "iban", "iban"]


def test_phones_end_where_their_country_does():
    alone = pii.pseudonymise("+49 30 1234567", KEY)[0]
    assert pii.pseudonymise("+49 30 1234567 2024", KEY)[0] == alone + " 2024" and alone.startswith("+49 ")
    for value, after in (("+351 912 345 678", " 12345"), ("+33 1 42 68 53 00", " 2023"), ("+371 2123 4567", " 99")):
        assert pii.pseudonymise(value + after, KEY) == (pii.pseudonym("phone", value, KEY) + after, ["phone"])


NAMED = ["5 January 2024", "January 5, 2024", "Jan. 5, 2024", "31 Dec 1999", "1. März 2001", "3 février 2010", "2 de mayo de 2015", "May 1st, 2020", "7th August 1985"]


@pytest.mark.parametrize("value", NAMED)
def test_dates_with_names_of_months(value):
    new, kinds = pii.pseudonymise(f"on {value}, say", KEY)
    assert kinds == ["date"] and not new.startswith(f"on {value},") and pii.pseudonymise(new, KEY, -1)[0] == f"on {value}, say"
    assert re.sub(r"[^\W\d]+|\d+", "x", new) == re.sub(r"[^\W\d]+|\d+", "x", f"on {value}, say")


def test_dates_link_across_writings():
    iso = date.fromisoformat(pii.pseudonym("date", "2024-01-05", KEY))
    assert pii.pseudonym("named date", "5 January 2024", KEY) == f"{iso.day} {iso.strftime('%B')} {iso.year}"
    for text in ("30 February 2020", "5 January 2250", "January 2024", "5 Marchand 2020"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def test_mail_links_whatever_its_capitals():
    new = [pii.pseudonymise(f"{x}@mail.example.com", KEY)[0] for x in ("joe.b", "Joe.B", "JOE.B")]
    assert len({n.lower() for n in new}) == 1 and new[1].split("@")[0].istitle() and new[2].split("@")[0].isupper()
    assert pii.pseudonymise(new[1], KEY, -1)[0] == "Joe.B@mail.example.com"


def test_only_ascii_digits_make_values():
    for text in ("٤١١١١١١١١١١١١١١١", "٤١١١١١١١١١١١١١١١ and 7", "٢٠٢٤-٠١-٠٥ 1"):
        assert pii.pseudonymise(text, KEY) == (text, [])
    assert pii.pseudonymise("4111.1111.1111.1111", KEY)[1] == ["card"]


def test_planted_values_and_nothing_else(spark):
    """Known values among words, numbers and signs: what must come out is put
    together from their pseudonyms, without looking for them."""
    rng = random.Random(21)
    fixed = [(k, v) for k, vs in VALID.items() for v in vs if k not in ("secret",)]
    noise = ["the", "of", "Zug", "é", "12", "7,", "(a)", "2024", "v1.2", "x9", "A4", "--", "100%", "No.", "3/4", "99999"]
    bad = {"phone": {"12", "2024", "99999", "7,", "3/4"}, "iban": {"A4", "12", "2024", "99999", "No.", "Zug", "7,", "3/4"}, "card": {"12", "7,", "2024", "99999", "3/4"}, "date": set(), "ip": set(), "ssn": set(), "email": set()}
    texts, want = [], []
    for _ in range(300):
        parts, out = [], []
        for _ in range(rng.randrange(1, 12)):
            word = rng.choice(noise)
            parts.append(word)
            out.append(word)
            if rng.random() < 0.4:
                kind, value = rng.choice(fixed)
                parts.append(value)
                local, _, domain = value.partition("@")  # of an address the part before the sign is mapped
                out.append(pii.pseudonym(kind, local, KEY) + (f"@{domain}" if domain else ""))
                ends = [w for w in noise if w not in bad[kind] and not w[0].isdigit()]
                parts.append(follow := rng.choice(ends))
                out.append(follow)
                parts[-2] += ";" if kind in ("phone", "card", "iban", "date") else ""
                out[-2] += ";" if kind in ("phone", "card", "iban", "date") else ""
                word = "the"  # what stands before a value may be a number too, but not part of it
            if parts[-1][-1].isdigit() or parts[-1] in ("v1.2", "3/4", "7,"):
                parts.append("and")
                out.append("and")
        texts.append(" ".join(parts))
        want.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, TEXT string").repartition(3)
    got = {r.doc_id: r[1] for r in pii.pseudonymise_documents(docs, KEY, "text").collect()}
    assert {i: (texts[i], got[i], w) for i, w in enumerate(want) if got[i] != w} == {}


def test_without_a_key_none_is_known(spark):
    from dictgraph.llm.queries import pii_key

    assert spark.conf.get("spark.dictgraph.pii.key", None) is None
    key = pii_key(spark)
    assert len(key) == 32 and pii_key(spark) == key
    spark.conf.set("spark.dictgraph.pii.key", "given")
    try:
        assert pii_key(spark) == b"given"
    finally:
        spark.conf.unset("spark.dictgraph.pii.key")
