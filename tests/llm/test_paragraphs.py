import random

import pytest
from tests_llm_common import ODD, prose, rows_of

from annalog.llm import paragraphs as p


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.randint(100, 9999)}" + ("." if i % 9 == 8 else "") for i in range(n))


def test_planted_passages(spark):
    shared = passage(1, 60)
    docs = [(i, f"{prose(500 + i, 50)}\n{shared}\n{prose(600 + i, 50)}") for i in range(3)]
    docs += [(i, f"{prose(500 + i, 23)} {shared} {prose(600 + i, 17)}") for i in range(3, 6)]
    docs += [(i, prose(700 + i, 150)) for i in range(6, 10)]
    docs += [(10, passage(2, 40) + "\n" + prose(70, 40)), (11, passage(2, 40).replace("b", "b", 1) + "\n" + prose(71, 40))]
    rows = p.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, 10, 11}
    texts = dict(docs)
    for r in rows:
        first = [t for t in rows if t.class_id == r.class_id and t.kept]
        assert len({f.doc_id for f in first}) == 1
        a, b = (p.shingle_set(texts[x.doc_id][x.start : x.stop]) for x in (r, first[0]))
        assert len(a & b) >= 0.8 * len(a | b)


def test_near_copies_meet_and_others_do_not(spark):
    base = passage(3, 39).replace(".", "").split()
    near = [*base[:-1], "changed"]  # 34 of 36 shingles are shared
    far = [*base[:20], "changed", *base[21:]]  # 30 of 40
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    rows = p.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2} and len({r.class_id for r in rows}) == 1
    assert {r.doc_id for r in rows if r.kept} == {1}


@pytest.mark.parametrize("meeting", [256, 2])
def test_components_like_brute_force(spark, monkeypatch, meeting):
    monkeypatch.setattr(p, "MEETING", meeting)
    rng = random.Random(8)
    docs = []
    for g in range(25):
        base = passage(100 + g, rng.randint(12, 38)).replace(".", "").split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.choice([0, 1, -1, -2, len(w) // 2])] = f"x{rng.randint(0, 3)}"
            docs.append((len(docs), " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    held = p.paragraphs(frame)
    keys = {r.doc_id: r.key for r in held.collect()}
    sets = {keys[i]: p.shingle_set(t) for i, t in docs}
    order = sorted(sets)
    want = [
        (a, b)
        for n, a in enumerate(order)
        for b in order[n + 1 :]
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    got = [(r.a, r.b) for r in p.links(frame, held).collect()]
    assert {tuple(sorted(x)) for x in got} <= set(want)

    def classes(links):
        group = {k: k for k in order}
        for _ in order:
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        return len(set(group.values()))

    assert classes(want) <= classes(got) <= classes(want) + 2


def test_bounds_hold_every_long_line():
    text = f"{passage(5, 100)}\n\n{passage(6, 30)}\nshort line\n" + "w " * 200
    for a, b in p.paragraph_bounds(text):
        assert "\n" not in text[a:b] and len(text[a:b].split()) >= p.SHINGLE
    assert p.paragraph_bounds("") == []


def test_odd_rows(odd_docs, no_docs):
    rows = p.repeats(odd_docs).collect()
    assert {r.doc_id for r in rows} == {1, 2}
    assert p.repeats(no_docs).count() == 0
    places = rows_of(p.paragraphs(odd_docs), "doc_id", "start", "stop")
    assert places == sorted(((i, a, b) for i, t in ODD if i is not None and t for a, b in p.paragraph_bounds(t)), key=repr)
