import hashlib
import re

import pytest
from tests_llm_common import ODD, prose, rows_of

from annalog.llm import decontamination as d

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    found |= ids
                    hit.update(range(s, s + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [
    (1, " ".join(prose(12, 6000).split()[500:540])),
    (2, " ".join(prose(1, 120).split()[20:31]).upper()),
    (10, " ".join(prose(1, 120).split()[25:36])),
    (3, "the the the the the the the the the the the the"),
    (4, "日本語 😀"),
    (5, prose(7, 9)),
    (6, None),
    (7, "!!"),
    (None, prose(9, 60)),
    (8, prose(99, 30)),
    (2, " ".join(prose(1, 120).split()[20:31])),
    (11, "x" * 40_000),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("limit", [None, 0])
def test_like_brute_force(odd_docs, items, monkeypatch, limit):
    if limit is not None:  # every join shuffles
        monkeypatch.setattr(d, "broadcast_if_small", lambda df, rows: df)
    assert rows_of(d.contamination(odd_docs, items), *NAMES) == brute(ODD, ITEMS)


def test_planted_at_every_offset(spark):
    docs = [(i, " ".join([*prose(200, i).split(), *ITEMS[0][1].split()[i : i + 10], *prose(300 + i, 15).split()])) for i in range(1, 31)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows_of(d.contamination(frame, spark.createDataFrame(ITEMS[:1], "item_id long, text string")), *NAMES)
    assert found == brute(docs, ITEMS[:1])
    assert all(r[-1] for r in found)


def test_no_items_and_no_docs(spark, odd_docs, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(d.contamination(odd_docs, none), *NAMES) == brute(ODD, [])
    assert d.contamination(no_docs, items).count() == 0


def test_decontaminate_keeps_the_rest(odd_docs, items):
    bad = {(r[0], r[1]) for r in brute(ODD, ITEMS) if r[-1]}
    want = sorted(((i, t) for i, t in ODD if (i, len(words(t))) not in bad), key=repr)
    left = d.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns
    assert rows_of(left, "doc_id", "text") == want
