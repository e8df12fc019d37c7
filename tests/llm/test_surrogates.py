"""Surrogates over whole tables: what is found, formats, collisions."""

import re

import pytest
from pyspark.sql import functions as F

from codebrook.llm import pii

FOUND = [
    ("email", "ann.lee@mail.example.com"), ("phone", "+1 (509) 555-6973"), ("phone", "030 123 4567"), ("card", "4539 1488 0343 6467"),
    ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ip", "192.168.3.4"), ("ip", "8.8.4.4"), ("ssn", "123-45-6789"),
    ("street", "12 Maple Street"), ("street", "Hauptstraße 12"), ("street", "221 rue de la Paix"), ("street", "Calle Mayor 5"), ("secret", "0123456789abcdef0123"), ("hex", "0123456789abcdef" * 2),
]


@pytest.mark.parametrize("kind,text", FOUND)
def test_a_surrogate_is_found_as_its_original_is(kind, text):
    around = "token = {} " if kind == "secret" else "at {} now"
    assert [(kind, text)] == [(k, around.format(text)[a:b]) for a, b, k in pii.entities(around.format(text))]
    seen = set()
    for key in ("k", "other", "third"):
        made = pii.surrogate(key, kind, text)
        run = r"\w+" if kind == "ip" else r"\w"
        assert made != text and re.sub(run, "w", made) == re.sub(run, "w", text)
        assert [(kind, made)] == [(k, around.format(made)[a:b]) for a, b, k in pii.entities(around.format(made))]
        seen.add(made)
    assert len(seen) == 3


def test_formats():
    for n in range(50):
        card = pii.surrogate(f"k{n}", "card", "4539 1488 0343 6467")
        assert pii.card(card) and card[0] == "4"
        iban = pii.surrogate(f"k{n}", "iban", "GB82WEST12345698765432")
        assert iban[:2] == "GB" and pii.remainder(iban) == 1
        phone = pii.surrogate(f"k{n}", "phone", "+1 (509) 555-6973")
        assert phone[:4] == "+1 (" and phone[4] in "23456789" and phone[9] in "23456789"
        assert pii.surrogate(f"k{n}", "phone", "030 1234567")[0] == "0"
        assert pii.surrogate(f"k{n}", "street", "12 Maple Street").endswith(" Street") and pii.surrogate(f"k{n}", "street", "12 Maple Street")[0] != "0"
        assert pii.surrogate(f"k{n}", "ip", "192.168.3.4").startswith("192.168.")
        assert pii.surrogate(f"k{n}", "person", "Maria") in pii.GIVEN[1] and pii.surrogate(f"k{n}", "person", "Иванова").endswith("ова")


@pytest.mark.parametrize("text", ["ISBN 9783161484100 of a book", "number 1219538112535716 there", "version 2.0 of 1999", "DE00 3704 0044 0532 0130 00 is none", "000-12-3456", "The Street is long", "a" * 200_000, ""])
def test_what_is_left_alone(text):
    assert pii.rewrite("k", text) == (text, [])


def test_names_without_a_title():
    new, told = pii.rewrite("k", "James Smith met Maria Garcia. Then Smith left, and Maria stayed. Smithson is another.")
    names = {o: s for _, o, s in told}
    assert set(names) == {"James", "Smith", "Maria", "Garcia"} and len(set(names.values())) == 4
    assert names["James"] in pii.GIVEN[0] and names["Maria"] in pii.GIVEN[1] and "Smithson" in new
    assert new.count(names["Smith"]) == 2 and new.count(names["Maria"]) == 2


def test_long_text_keeps_all_else():
    text = " ".join(f"word{i}" if i % 500 else f"u{i}@example.org" for i in range(20_000))
    new, told = pii.rewrite("k", text)
    assert len(told) == 40 and len(new) == len(text) and [a for a, b in zip(text.split(), new.split()) if a == b] == [w for w in text.split() if "@" not in w]


def test_collisions_are_resolved(spark):
    """700 of the 65536 addresses of a private network: surrogates that are another's original get the next one."""
    docs = spark.createDataFrame([(i, f"host 192.168.{i % 256}.{i // 256} and 192.168.{(i + 1) % 256}.{(i + 1) // 256}", "x") for i in range(700)] + [(None, "host 192.168.0.0", "x"), (9999, None, "x")], "doc_id long, text string, kinds string")
    assert pii.collisions(docs, "k").count() > 0
    out = {(r["doc_id"], r["text"]): r for r in pii.checked(docs, "k", report=True).collect()}
    assert len(out) == 702 and (9999, None) in out
    plain = lambda t: re.findall(r"192[.0-9]+", t)
    made = {}
    for i in range(700):
        (r,) = [r for (d, _), r in out.items() if d == i]
        for o, s in zip((f"192.168.{i % 256}.{i // 256}", f"192.168.{(i + 1) % 256}.{(i + 1) // 256}"), plain(r["text"])):
            assert made.setdefault(o, s) == s
        assert r["n_entities"] == 2 and r["kinds"] == "ip"
    assert len(set(made.values())) == len(made) and not set(made.values()) & set(made)


def test_distinct_and_coreferent_over_the_corpus(spark, data):
    """Against a brute-force pass over all documents on the driver."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in pii.checked(docs, "secret of the test").collect()}
    made = {}
    for r in docs.collect():
        spans = pii.entities(r["text"])
        new, at, told = got[r["doc_id"]], 0, 0
        for a, b, kind in spans:
            s = pii.surrogate("secret of the test", kind, r["text"][a:b])
            assert new[told : told + a - at] == r["text"][at:a] and new[told + a - at :].startswith(s)
            told, at = told + a - at + len(s), b
            assert made.setdefault((kind, r["text"][a:b]), s) == s
        assert new is None and r["text"] is None or new[told:] == r["text"][at:]
    assert len({(k, s) for (k, _), s in made.items()}) == len(made) > 0


def test_key_is_the_sessions(spark):
    key = pii.session_key(spark)
    assert len(key) >= 16 and pii.session_key(spark) == key
    assert pii.replace(spark.createDataFrame([(1, "a@b.example")], "doc_id long, text string"), key).first()["text"] != "a@b.example"
    assert spark.range(1).select(F.lit(1)).count() == 1
