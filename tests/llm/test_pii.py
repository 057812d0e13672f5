import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ANCHORS = pii.automaton()


def luhn(d):
    odd = sum(int(c) for c in d[-1::-2])
    return (odd + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])) % 10 == 0


def plain_base(text):
    """The patterns of the contract, one after the other."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def base_of(text):
    return [s for s in pii.find(text, ANCHORS) if s[2] in PATTERNS]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01259.@+- ()ab_é%", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_of(text) == plain_base(text)


def test_base_spans_of_built_cases():
    rng = random.Random(7)
    pieces = [
        "x.y@mail.example.com", "@", "a@b", "a@b..c", "x@y.z_q@w.v", "1.2.3.4", "300.1.1.1.1", "256.1.1.1",
        "1.2.3.4.5.6.7.8", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (988) 555-2485",
        "+1-", "++4 44 555 666 777", "+5 (", "123456789012", "😀", "é", " ", ",", "\n", "7" * 40, "9" * 5000, "0" * 16,
    ]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", ".", "-"]) for _ in range(rng.randint(0, 9)))
        assert base_of(text) == plain_base(text), text


def test_added_spans():
    def added(text):
        return [(text[s:e], k) for s, e, k in pii.find(text, ANCHORS) if k not in PATTERNS]

    assert added("see https://user@host.example.org:80/a?b=1.") == [("https://user@host.example.org:80/a?b=1", "url")]
    assert added("see (http://10.0.0.7/x), nothttpz://a.b and http://localhost") == [("http://10.0.0.7/x", "url")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 please") == [("DE89 3704 0044 0532 0130 00", "account")]
    assert added("IBAN: DE89 3704 0044 0532 0130 01") == []
    assert added("SSN 123-45-6789, ssn 000-12-3456") == [("123-45-6789", "account")]
    assert added("account no. 12345678, Passport number: C01234567") == [("12345678", "account"), ("C01234567", "account")]
    assert added("accountant 12345678, discount 1234567") == []
    assert added('password=e3b3ed3cc8548923d6 token = "0641917ea4e9"') == [("e3b3ed3cc8548923d6", "secret"), ("0641917ea4e9", "secret")]
    assert added("the password is nothing, a token of thanks 12345678") == []


def test_documents_with_odd_rows(spark, documents, empty):
    rows = [
        (1, "Ünï 😀 a.b@mail1.example.com +1 (988) 555-2485", "x"),
        (2, None, "x"), (3, "", None), (3, "", None), (None, "ip 45.196.222.209.", "y"),
        (4, "z" * 200_000 + " 4111111111111111 " + "4 " * 50_000, "y"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [tuple(r) for r in pii.digest(pii.detect(odd)).collect()]
    want = []
    for doc_id, text, _ in rows:
        spans = plain_base(text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        counts = [sum(k == kind for _, _, k in spans) for kind in PATTERNS]
        want.append((doc_id, *counts, hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.digest(pii.detect(empty)).count() == 0
    assert pii.digest(pii.detect(documents)).count() == documents.count()


def test_redacted_texts(spark):
    odd = spark.createDataFrame([(1, "to a@b.cd: 45.196.222.209, +1 (988) 555-2485!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(odd).orderBy("doc_id").collect()] == ["to <email>: <ip>, <phone>!", None]
