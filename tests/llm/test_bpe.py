import hashlib
import random

import public_tokenizers
import pytest
from tests_llm_common import ODD, prose, rows_of
from tokenizers import Tokenizer

from annalog.llm import bpe
from annalog.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(PATH))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(plain, docs):
    out = []
    for i, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), digest(",".join(map(str, ids))), digest(plain.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=repr)


BITS = ["a", "th", " ", "  ", "\n", "'", "'s", "'re", "1", "23", "é", "日本", "😀", "!", "<|endoftext|>", "<|endof", "text|>"]
BITS += ["²", "_", "x" * 40, "ab" * 30, " " * 30, "=", "\u00a0", "\u3000", "\u0301"]


def odd_text(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_tree_joins_are_exact(plain, codec):
    rng = random.Random(11)
    for k in range(400):
        if k % 2:
            text = odd_text(rng, rng.randint(1, 150))
        else:
            text = "".join(rng.choice("abcdefghij日é") for _ in range(rng.randint(50, 2500)))
        part = rng.choice([7, 16, 40, 100, 300])
        n = 1
        while -(-len(text) // n) > part:
            n *= 2
        at = [len(text) * i // n for i in range(n + 1)]
        parts = []
        for low, high in zip(at, at[1:], strict=False):
            p = codec.part(text, low, high)
            parts.append((low, high, p))
        assert codec.tree(text, parts).ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("part", [bpe.PART, 50])
def test_round_trip(spark, odd_docs, plain, part):
    found = bpe.round_trip(odd_docs, bpe.load(PATH), part)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(plain, ODD)


def test_texts_with_special_tokens_and_without_rows(spark, no_docs, plain):
    rng = random.Random(2)
    docs = [(i, odd_text(rng, 60)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = bpe.round_trip(frame, bpe.load(PATH), 64)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(plain, docs)
    assert bpe.round_trip(no_docs, bpe.load(PATH)).count() == 0


def test_encode_and_decode(odd_docs):
    back = bpe.decode(bpe.encode(odd_docs, bpe.load(PATH)), bpe.load(PATH))
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in ODD), key=repr)


@pytest.fixture(scope="module")
def counts(codec):
    return tc.WordCounts(codec)


def test_counts_follow_edits(plain, counts):
    ordinary = Tokenizer.from_file(PATH)
    ordinary.encode_special_tokens = True
    rng = random.Random(4)
    for _ in range(500):
        text = odd_text(rng, rng.randint(0, 400))
        asked = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, len(text))
            asked.append((s, min(len(text), s + rng.choice([0, 1, 5, 30, 200])), odd_text(rng, rng.randint(0, 6))))
        edits = tc.clean_edits(asked, len(text))
        tree, _ = tc.build(text, counts)
        new, _ = tc.apply_edits(tree, text, edits, counts)
        assert tree.count == len(ordinary.encode(new, add_special_tokens=False).ids)
        assert tree.tokens[tree.size :].sum() == tree.count and tree.chars[1] == len(new)


def test_an_edit_encodes_its_region_only(counts):
    text = prose(5, 20_000)
    tree, words = tc.build(text, counts)
    _, encoded = tc.apply_edits(tree, text, [(50_000, 50_003, "new")], counts)
    assert words > 20_000 and encoded < 4 * tc.LEAF


def test_odd_edits_are_left_out():
    edits = [(5, 9, "a"), (0, 3, "b"), (7, 8, "c"), (3, 2, "d"), (9, 99, "e"), (None, 1, "f"), (9, 9, "g"), (-1, 0, "h")]
    assert tc.clean_edits(edits, 10) == [(0, 3, "b"), (5, 9, "a"), (9, 9, "g")]


def test_table_of_edits(spark, odd_docs, no_docs, plain):
    from pyspark.sql import functions as F

    ordinary = Tokenizer.from_file(PATH)
    ordinary.encode_special_tokens = True
    found = tc.count_edited(odd_docs, tc.redactions(F.col("text")), bpe.load(PATH))
    rows = found.collect()
    assert len(rows) == len(ODD)
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, set()).add(len(ordinary.encode(t or "", add_special_tokens=False).ids))
    assert all(r.n_tokens in texts[r.doc_id] and r.tree[1] == r.n_tokens_after for r in rows)
    assert tc.count_edited(no_docs, tc.redactions(F.col("text")), bpe.load(PATH)).count() == 0
    none = tc.count_edited(odd_docs, F.lit(None).cast("array<struct<start:int,stop:int,text:string>>"), bpe.load(PATH))
    assert all(r.n_tokens == r.n_tokens_after and r.n_encoded == 0 for r in none.collect())
