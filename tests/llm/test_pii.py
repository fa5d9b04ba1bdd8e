import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import common
from textloom.llm import pii


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("write to ann.b@mail3.example.com now", ["EMAIL"]),
        ("from öheit.23@mail7.example.com.", ["EMAIL"]),
        ("at 129.38.82.176 esnd", ["IP"]),
        ("version 1.2.3 and 300.1.1.1", []),
        ("card 2390409500648960 ok", ["CARD"]),
        ("card 4111-1111-1111-1111", ["CARD"]),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', ["SECRET"]),
        ("04dbebab91ab85687d33eeaaf9ac699e1188f962", ["SECRET"]),
        ("call +49 170 1234567 or 555-123-4567", ["PHONE", "PHONE"]),
        ("id 123-45-6789", ["ID"]),
        ("DE89 3704 0044 0532 0130 00", ["IBAN"]),
        ("card ٤١١١١١١١١١١١١١١١ ok", ["CARD"]),
        ("ask Dr. Müller Lüdenscheid or Mrs Ann Lee", ["PERSON", "PERSON"]),
        ("at 12 Old Elm Street and Hauptstraße 5b", ["ADDRESS", "ADDRESS"]),
        ("in 2024, 100 of 5,000 people and 3.14", []),
    ],
)
def test_entities(text, kinds):
    assert [e[2] for e in pii.entities(text)] == kinds
    if kinds:
        assert pii.suspect(pa.array([text]))[0]


_PARTS = ["a@b.co", "4111 1111 1111 1111", "٤١١١١١١١١١١١١١١١", "1.2.3.4", "123-45-6789", "+49 (170) 123-4567", "(030) 123 4567", "0301234567", "to\u212aen = abcdefgh", "api_key:'x y z a b c'", "DE89 3704 0044 0532 0130 00", "Dr. Who", "Hauptstr. 5", "1 Elm St", "०१२३४५६७८", "Mme Curie", "sk-", "AKIA", "é", "\n", " ", ".", "-", "+", "(", ")"]


def test_what_holds_an_entity_is_suspect():
    rng = random.Random(8)
    texts = ["".join(rng.choice(_PARTS) for _ in range(rng.randrange(1, 5))) for _ in range(20_000)]
    some = np.array([bool(pii.entities(t)) for t in texts])
    assert some.sum() > 3000 and pii.suspect(pa.array(texts))[some].all()
    assert pii.suspect(pa.array([None, ""])).tolist() == [False, False]


def test_kinds_are_tried_in_order_at_each_place():
    rng = random.Random(5)
    every = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(pii.ENTITIES)))
    for _ in range(20_000):
        text = "".join(rng.choice(_PARTS) for _ in range(rng.randrange(1, 7)))
        want = []
        for m in every.finditer(text):
            i = next(k for k in range(len(pii.ENTITIES)) if m.group(f"k{k}") is not None)
            a, b = m.span({0: "v1", 9: "v9"}.get(i, 0))
            want.append((a, b, pii.ENTITIES[i][0], text[a:b].strip("\"'").lower()))
        assert pii.entities(text) == want


def test_digits_of_any_script_are_masked_alone_and_beside_others(spark):
    docs = [(1, "card ٤١١١١١١١١١١١١١١١ ok"), (2, "card ٤١١١١١١١١١١١١١١١ and 4111111111111111")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), support=2).collect()}
    assert got[1].startswith("card [CARD]") and got[2].startswith("card [CARD]") and "[CARD]" in got[2][10:]


def _docs():
    rows = []
    for i in range(40):
        rows.append((i, f"plain words number{i} the town of Springfield is large and well known to all"))
    for i in range(40, 43):
        rows.append((i, f"the agent Zarquon lives at x{i} the town with zarq@mail.example.com and the others say hello"))
    rows += [(43, "the other one is at solo@mail.example.com with the rest"), (44, "the Zarquon alone"), (45, "Springfield the agent zarq@mail.example.com")]
    return rows


def _brute_whole(docs, support):
    """(sanitised text, number of terms) by counting sets of whole texts."""
    words = lambda t: [m for m in re.finditer(r"\w+", t) if not any(a < m.end() and m.start() < b for a, b, _, _ in pii.entities(t))]
    df = Counter(w for _, t in docs for w in set(re.findall(r"\w+", t.lower())))
    ents, pairs = Counter(), Counter()
    for _, t in docs:
        found = {e[2:] for e in pii.entities(t)}
        ents.update(found)
        pairs.update((e, w) for e in found for w in {m.group().lower() for m in words(t)})
    n = len(docs)
    terms = {w for (e, w), k in pairs.items() if k >= support and math.log2(n * k / (df[w] * ents[e])) >= 0.8 * math.log2(n / ents[e])}
    out = {}
    for i, t in docs:
        hits = [m for m in words(t) if m.group().lower() in terms]
        cuts = {(a, b): f"[{k}]" for a, b, k, _ in pii.entities(t)} | {m.span(): "[NUMBER]" if m.group().isdigit() else "[NAME]" if m.group()[0].isupper() else "" for m in hits}
        got, last = "", 0
        for (a, b), by in sorted(cuts.items()):
            got += t[last:a] + by
            last = b + (by == "" and t[b : b + 1] == " ")
        out[i] = got + t[last:], len(hits)
    return out, terms


def _far():
    far = " ".join(f"the town of Springfield is large and well known to all number{k}" for k in range(10))
    return [*_docs(), (50, f"Quuxberg Ünal {far} mail quux@mail.example.com"), (51, f"{far} quux@mail.example.com says Ünal from Quuxberg"), (52, "in the town Quuxberg and ünal")]


def test_whole_texts_against_brute_force(spark):
    docs = _far()
    want, terms = _brute_whole(docs, 2)
    assert {"zarquon", "quuxberg", "ünal"} <= terms and not {"the", "springfield"} & terms
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_terms) for r in pii.sanitise(df, support=2).collect()}
    assert got == want
    assert got[44] == ("the [NAME] alone", 1) and "Quuxberg" not in "".join(t for t, _ in got.values())
    kept, pii.TERMS_AT_ONCE = pii.TERMS_AT_ONCE, 2
    try:
        assert {r.doc_id: (r.text, r.n_terms) for r in pii.sanitise(df, support=2).collect()} == want
    finally:
        pii.TERMS_AT_ONCE = kept


@pytest.mark.parametrize("extra", [False, True])
def test_whole_odd_rows(spark, extra):
    out = pii.sanitise(common.odd_docs(spark, extra))
    by = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert out.columns == ["doc_id", "text", "n_entities", "n_terms"] and out.count() == 11
    assert by[2].text is None and by[2].n_entities is None and by[3].text == "" and by[3].n_entities == 0
    assert pii.sanitise(common.empty_docs(spark)).count() == 0


def test_entities_of_one_text_are_weighed(spark):
    docs = [*_far(), (60, "the agent Plonk is at plonk@mail.example.com and well known to all")]
    want, terms = _brute_whole(docs, 1)
    assert "plonk" in terms and "plonk" not in _brute_whole(docs, 2)[1] and not {"the", "and", "springfield"} & terms
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_terms) for r in pii.sanitise(df).collect()}
    assert got == want and "[NAME]" in got[60][0]
