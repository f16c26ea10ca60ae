import hashlib
import re

from genoweave.llm.pii import detect, op10_pattern_checksum_context, redact

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(s):
    total = 0
    for i, c in enumerate(reversed([c for c in s if c.isdigit()])):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(s):
    return sum(c.isdigit() for c in s)


KINDS = [
    ("email", EMAIL, lambda s: True),
    ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", CARD, lambda s: 14 <= digits(s) <= 19 and luhn(s)),
    ("phone", PHONE, lambda s: 10 <= digits(s) <= 15),
]


def brute(text):
    spans, counts = [], []
    for k, (name, pattern, ok) in enumerate(KINDS):
        got = [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text or "") if ok(m.group())]
        counts.append(len(got))
        spans += got
    joined = ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def check(spark, sf, rows):
    got = {r.doc_id: r for r in op10_pattern_checksum_context(spark, sf).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want, joined = brute(text)
        r = got[doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, (doc_id, text[:200], r.spans, joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_supplied_documents(spark, sf_dir, all_docs):
    check(spark, sf_dir, all_docs)


EDGES = [
    None, "", "a", "a@b.c_d@e.f x@y.z", "a@b.c.d@e.f", "%%@x-.y.z é é+1@q.w", "@@..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.002.003.0004",
    "9" * 400 + ".1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 0", "4111  1111 1111 1111", "0" * 14, "0" * 13, "0" * 20, "+1 (988) 555-2485", "+1)))) 2", "++12 345 678 901",
    "+123456789012345678", "ñ" * 50 + "+1 (988) 555-2485é4111111111111111", "a" * 5000 + "@" + "b." * 3000 + "c", "1" * 20000, "a" * 60000, "+" + "1 " * 300,
    " ".join(f"u{i}@x.y 10.0.0.{i % 300}" for i in range(700)), "1.1.1.1\n2.2.2.2\r\n4111111111111111 4111111111111111",
]


def test_edge_texts(spark, make_docs):
    rows = list(enumerate(EDGES))
    check(spark, make_docs(rows), rows)


def test_added_kinds_and_redaction(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33 bad", "my ssn: 123-45-6789", "code 123-45-6789", "mail x@y.zz now", None, ""]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "k int, text string, pairs_of_email string")
    got = redact(detect(df)).orderBy("k").collect()
    kinds = [[s.kind for s in r.pii_spans] for r in got]
    assert kinds[0] == ["iban"] and kinds[2] == ["national_id"] and kinds[4] == ["email"]
    assert kinds[3] == [] and kinds[5] == [] and kinds[6] == [] and "iban" not in kinds[1]
    assert got[4].text == "mail <EMAIL> now" and got[5].text is None and got[6].text == ""
    assert got[0].pairs_of_email == "z"


def test_empty_table(spark, make_docs):
    assert op10_pattern_checksum_context(spark, make_docs([])).count() == 0


def test_context_of_lists_and_after_the_span(spark):
    ids = [f"{100 + i}-45-67{10 + i % 90}" for i in range(300)]
    texts = ["SSN: 123-45-6789, 987-65-4321", "SSN: " + ", ".join(ids), "123-45-6789 (SSN)", "123-45-6789, 987-65-4321 and 111-22-3333 (ssn)",
             "ssn 123-45-6789 " + "z" * 50 + " 987-65-4321", "123-45-6789 " + "z" * 50 + " ssn", "x 123-45-6789, 987-65-4321 y"]
    got = redact(detect(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))).orderBy("k").collect()
    assert [len(r.pii_national_id) for r in got] == [2, 300, 1, 3, 1, 0, 0]
    assert got[0].text == "SSN: <NATIONAL_ID>, <NATIONAL_ID>" and got[2].text == "<NATIONAL_ID> (SSN)"
    assert [texts[1][s.start : s.end] for s in got[1].pii_national_id] == ids
