import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_common import ODD, prose, rows_of

from annalog.llm import language, toxicity

BAD = ["vexol", "grumf", "snarl"]


def labelled(n=240):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        w = prose(400 + i, 80).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((100 + i, " ".join(w)))
        labels.append((100 + i, 0, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    odd = [(i, t) for i, t in ODD]
    extra = [(None, 0, 1), (100, 0, None), (9999, 0, 1)]
    return (
        spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("score", F.lit("clash")),
        spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int"),
    )


def test_toxic_texts_are_found_on_held_out_rows(tables):
    docs, labels = tables
    known = {i: t for i, _, t in labelled()[1]}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.97


def test_search_is_exact():
    rng = random.Random(5)
    names = [f"t{i}" for i in range(60)]
    idf = np.array([rng.random() + 0.1 for _ in names])
    examples = []
    for _ in range(900):
        at = rng.sample(range(60), rng.randint(1, 6))
        examples.append(({t: rng.randint(1, 4) for t in at}, int(rng.random() < 0.4)))
    index = toxicity.build_index(examples, names, idf, 0.1, 25)
    dense = np.zeros((900, 60))
    for t in range(60):
        low, high = index.starts[t], index.starts[t + 1]
        dense[index.examples[low:high], t] = index.weights[low:high]
    assert np.allclose((dense**2).sum(axis=1), 1)
    for _ in range(60):
        at, weight = index.vector(Counter({names[t]: rng.randint(1, 3) for t in rng.sample(range(60), 5)}))
        scores = dense[:, at] @ weight
        best, found = index.nearest(at, weight, 25)
        assert np.allclose(np.sort(found)[::-1], np.sort(scores)[::-1][:25])
        assert np.allclose(scores[best], found)
    votes = [index.calibrated(v) for v in (0.05, 0.4, 0.9)]
    assert votes == sorted(votes)


def test_words_are_counted_as_the_pattern_finds_them():
    texts = [t for _, t in ODD] + ["\x1c\x1da b_c", "\u00c9 \u03b5 \u03a3\u0391\u03a3. x\u00b2y \u0130stanbul \ufb01", "a\u00a0b\u2003c\u200bd\u0301", "'q' 12_3\x0b\n\tQ", "_-_ caf\u00e9's \u65e5\u672c\u3001abc"]
    want = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    assert [toxicity.terms(t) for t in texts] == want
    keys = np.sort(toxicity.term_keys(sorted(set().union(*want))[::2]))
    place, at, n = toxicity.counted(texts, keys)
    named = {int(k): w for w in set().union(*want) for k in toxicity.term_keys([w]) if k in keys}
    found = [{} for _ in texts]
    for i, t, m in zip(place, at, n, strict=True):
        found[i][named[int(keys[t])]] = m
    assert found == [{w: m for w, m in c.items() if w in named.values()} for c in want]


def test_many_texts_are_searched_at_once_as_one_by_one():
    rng = random.Random(6)
    names = [f"t{i}" for i in range(400)]
    draw = lambda n: Counter(names[min(int(rng.expovariate(1 / 40)), 399)] for _ in range(n))
    examples = [draw(rng.choice([3, 12, 60])) for _ in range(5000)] + [Counter({"t1": 1, "t399": 2})] * 200  # copies: ties
    idf = np.array([0.05 + i / 400 for i in range(400)])
    index = toxicity.build_index([({int(w[1:]): m for w, m in c.items()}, i % 2) for i, c in enumerate(examples)], names, idf, 0.5, 25)
    assert 0 < len(index.top) < 400
    dense = np.zeros((len(index.labels), 400))
    for t in range(400):
        low, high = index.starts[t], index.starts[t + 1]
        dense[index.examples[low:high], t] = index.weights[low:high]
    texts = [" ".join(draw(rng.choice([1, 5, 60])).elements()) for _ in range(150)] + ["", None, "unknown", "t399 t399 t1", "t0", "t398"]
    vectors = index.vectors(texts)
    for text, (at, weight), (best, sim) in zip(texts, vectors, index.search(vectors, 25), strict=True):
        one, alone = index.vector(toxicity.terms(text))
        assert list(one) == list(at) and np.allclose(alone, weight)
        scores = dense[:, at] @ weight
        want = np.lexsort((np.arange(len(scores)), -np.round(scores, 9)))[:25]
        assert list(best) == list(want[scores[want] > 0]) or np.allclose(np.sort(scores[best]), np.sort(scores[want]), atol=1e-9)
        assert np.allclose(sim, scores[best]) and len(best) == min(25, (scores > 0).sum())
    assert len(list(index.scores(texts))) == len(texts) and index.search([], 25) == []


def test_whole_query_against_all_pairs(spark):
    docs, labels = labelled()
    docs += [(900, " ".join(["ugly", *prose(900, 30).split(), "hapaxword"])), (901, None), (902, "unheardof")]
    docs += [(i, docs[-3][1]) for i in range(1000, 1040)]
    labels += [(900, 0, 1), (901, 0, 0)]
    assert zlib.crc32(b"900") % 3 != 1
    rows = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    label = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    text = dict(docs)
    share = np.mean(list(label.values()))
    df, held, toxic = (Counter(w for i in ids for w in toxicity.terms(text[i])) for ids in (text, label, [i for i in label if label[i]]))

    def vector(t):
        out = {}
        for w, n in toxicity.terms(t).items():
            if w in held:
                z = (toxic[w] - share * held[w]) / math.sqrt(held[w] * share * (1 - share) + 1)
                out[w] = (1 + math.log(n)) * math.log((len(text) + 1) / (df[w] + 1)) * (1 + max(0, abs(z) - 3))
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {w: x / norm for w, x in out.items()}

    examples = {i: v for i in label if (v := vector(text[i]))}
    for r in rows:
        own = vector(r and text[r.doc_id])
        want = sorted(((sum(x * v.get(w, 0) for w, x in own.items()), i) for i, v in examples.items()), reverse=True)
        want = [(s, i) for s, i in want if s > 0]
        assert np.allclose(r.example_similarities, [s for s, _ in want[:25]], atol=1e-5)
        assert {i for s, i in want if s > (want[24][0] if len(want) > 24 else 0) + 1e-5} <= set(r.example_ids)
    # Copies of a toxic example are found by it, though its words stand in no other example.
    found = {r.doc_id: r for r in rows}
    rest = np.mean([r.score for r in rows if r.held_out and not label.get(r.doc_id) and r.doc_id < 900])
    for i in range(1000, 1040):
        assert found[i].example_ids[0] == 900 and found[i].example_similarities[0] > 0.999
        assert found[i].score > 0.5 > rest
    assert list(found[902].example_ids) == []


def test_without_labels_rows_or_texts(spark, tables, no_docs):
    docs, labels = tables
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    known = {i: t for i, _, t in labelled()[1]}
    assert not any(known.get(i) for i in ids)
    assert np.mean([i in ids for i, t in known.items() if not t]) > 0.97


def test_sample_is_bounded_and_deterministic(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(3, 1), (4, 1)], "doc_id long, toxic int")
    one = rows_of(toxicity.sample_labels(labels, 100), "doc_id", "toxic")
    assert len(one) == 100 and one == rows_of(toxicity.sample_labels(labels.repartition(7), 100), "doc_id", "toxic")


SYLLABLES = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "en", "ung", "ver"], "cc": ["ño", "ci", "lla", "ez"]}


def text_of(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, text_of(lang, 60, i), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000 + i, t, None) for i, (_, t) in enumerate(ODD)] + [(None, text_of("bb", 20, 1), "bb"), (5000, "12 34 !?", "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_languages(spoken, no_docs):
    rows = language.languages(spoken).collect()
    assert len(rows) == spoken.count()
    lang = {i: x for i, x in enumerate(list(SYLLABLES) * 60)}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert held and all(r.lang_pred == lang[r.doc_id] and r.score > 0.9 for r in held)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1002, 1003, 1004, 1008, 5000}
    assert language.languages(no_docs).count() == 0


def test_nothing_learned(spark, spoken):
    rows = language.predict(spoken.select("doc_id", "text"), language.fit(spoken.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_mixtures_and_slices(spoken, monkeypatch):
    model = language.fit(spoken)
    letters = language._letters()
    mixed = text_of("aa", 300, 1) + " " + text_of("bb", 100, 2)
    share = dict(zip(model.langs, model.mixtures([mixed], letters)[0], strict=True))
    sizes = {k: len(text_of(k, n, s)) for k, n, s in (("aa", 300, 1), ("bb", 100, 2))}
    assert share["cc"] == 0 and abs(share["aa"] - sizes["aa"] / sum(sizes.values())) < 0.05
    whole = model.mixtures([mixed], letters)
    monkeypatch.setattr(language, "SLICE", 500)
    assert np.abs(model.mixtures([mixed], letters) - whole).max() < 0.02


def test_proportions_maximise_the_likelihood(spoken):
    model = language.fit(spoken)
    letters = language._letters()
    text = text_of("aa", 40, 7) + " " + text_of("bb", 40, 8)
    _, bucket = language.trigrams([text], letters)
    prob = model.prob[bucket]
    found = model.mixtures([text], letters)[0]

    def likelihood(mix):
        return float(np.log(prob @ mix).sum())

    a, b = model.langs.index("aa"), model.langs.index("bb")
    for step in (-0.05, 0.05):
        other = found.copy()
        other[a] += step
        other[b] -= step
        assert likelihood(other) < likelihood(found) + 1e-6


def test_crc_fold(spark):
    rows = spark.range(50).select("id", toxicity.in_fold(F.col("id"), 4, 2).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert math.isclose(toxicity._logit(0.5), 0)
