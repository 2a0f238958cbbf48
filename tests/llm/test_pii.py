import hashlib
import random
import re
import time

from tests_llm_common import ODD, rows_of

from annalog.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = sorted(
        (m.start(), rank, m.end(), kind)
        for rank, kind in enumerate(BASE)
        for m in re.finditer(BASE[kind], text or "")
        if good(kind, m.group())
    )
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()
    return (*(sum(f[3] == k for f in found) for k in BASE), digest)


def random_texts():
    rng = random.Random(3)
    bits = ["a@b.co", "x.y@z", "@", ".", "a", "1.2.3.4", "300.1.1.1", "12", "+4", "+49 (30) 123-4567", " ", "-", "%", "é", "😀"]
    bits += ["4111 1111 1111 1111", "4111111111111112", "0.0.0.0", "007.08.09.255", "9" * 21, "()", "\n", "_", "+1-202-555-0143"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_like_brute_force(spark):
    texts = random_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(pii.pii_report(docs), "doc_id", *NAMES) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=repr)


def test_odd_rows_stay(odd_docs, no_docs):
    found = rows_of(pii.pii_report(odd_docs), "doc_id", *NAMES)
    assert found == sorted(((i, *brute(t)) for i, t in ODD), key=repr)
    assert pii.pii_report(no_docs).count() == 0


def one(spark, text):
    return pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_long_runs_stay_linear(spark):
    n = 300_000
    none = ["a" * n, "1" * n, "1 " * n, "+1" + " " * n, "1." * 3 + "x" + "1.a" * n, "a" * n + "@" + "b" * n]
    for text in none:
        row = one(spark, text)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, 0, 0, 0)
    assert one(spark, "a@" + "b." * n).n_email == 1
    assert one(spark, "1.2.3.4 " * 2000).n_ip == 2000


def test_checksums_and_context_add_spans(spark):
    row = one(spark, "My bank account is GB82 WEST 1234 5698 7654 32, bye")
    assert "iban:19:46" in row.spans
    assert "iban" not in one(spark, "account GB82 WEST 1234 5698 7654 33").spans
    assert "ssn:8:19" in one(spark, "his ssn 123-45-6789").spans
    assert "ssn" not in one(spark, "part no 123-45-6789").spans
    assert "ssn" not in one(spark, "ssn 9123-45-6789").spans
    calm, near = one(spark, "see 10.0.0.1"), one(spark, "server 10.0.0.1")
    assert int(calm.scores) < int(near.scores)


def test_redaction(spark, odd_docs):
    rows = [(1, "mail a.b@c.de or call +49 30 1234567 now"), (2, "nothing"), (3, None), (4, "a@b.c@d.e")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert found[1] == ("mail [EMAIL] or call [PHONE] now", 32)
    assert found[2] == ("nothing", 7) and found[3] == (None, None)
    assert found[4][0] == "[EMAIL]@d.e"
    assert pii.redact(odd_docs).columns == odd_docs.columns
    assert pii.redact(odd_docs).count() == len(ODD)


def test_context_on_both_sides_and_through_lists(spark):
    assert one(spark, "ssn 123-45-6789, 987-65-4321").spans == "ssn:4:15,ssn:17:28"
    assert one(spark, "123-45-6789 (SSN)").spans == "ssn:0:11"
    numbers = ", ".join(f"{100 + i}-45-6789" for i in range(12))
    assert one(spark, f"ssn: {numbers}").spans.count("ssn") == 12
    assert one(spark, f"{numbers} are SSN").spans.count("ssn") == 12
    assert one(spark, f"parts {numbers}").spans == ""


def test_iban_ends_where_its_country_says(spark):
    for iban in ("ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "DE89370400440532013000"):
        for after in (" Please pay", " BIC", " PAY", "", ", and"):
            assert one(spark, f"to {iban}{after}").spans == f"iban:3:{3 + len(iban)}"
    assert one(spark, "ES91 2100 0418 4502 0005 1333 Please").spans == ""


def test_many_matches_stay_linear(spark):
    """Many matches of every kind: places, lists and the redacted text, in time that grows with them."""
    def text(n):
        return "".join(f"m{i}@x.org, 10.0.{i % 256}.9; +49 30 {1000000 + i} 😀 " for i in range(n)) + "ssn " + ", ".join(["123-45-6789"] * n)

    took = []
    for n in (100, 2_000, 8_000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        start = time.time()
        row = pii.pii_report(docs).first()
        took.append(time.time() - start)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute(text(n))
        assert row.spans.count("ssn:") == n
    assert took[2] < 8 * took[1] + 5
    clean = pii.redact(docs).first().text
    assert clean == "[EMAIL], [IP]; [PHONE] 😀 " * n + "ssn " + ", ".join(["[SSN]"] * n)


def test_redaction_like_brute_force(spark):
    texts = random_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.pii for r in pii.find_pii(docs).collect()}
    for row in pii.redact(docs).collect():
        out, at = "", 0
        for s in found[row.doc_id]:
            if s["score"] < pii.ADDED_MIN:
                continue
            if s["start"] >= at:
                out += texts[row.doc_id][at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert row.text == out + texts[row.doc_id][at:]


def test_a_column_named_like_a_helper_stays(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de", "kept")], "doc_id long, text string, _pii string")
    assert tuple(pii.redact(docs).first()) == (1, "mail [EMAIL]", "kept")
