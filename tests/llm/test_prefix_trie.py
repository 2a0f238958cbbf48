import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from annalog.llm import prefix_trie as p

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
FIELDS = "conv_id long, turn long, role string, text string, depth string, words int, key string, base long"


def brute(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - abs(c) % 20 * (1 if c > 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        last = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * last + sum(saved[x] for x in kids[k])
        ends = ",".join(str(c) for c in sorted(members[k]) if len(full[c]) == len(k))
        up = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[k]), len(k), up, len(members[k]), len(kids[k]), leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def found(spark, rows, tree_turns=p.TREE_TURNS):
    frame = spark.createDataFrame([(*r, "x", 1, "k", 2) for r in rows], FIELDS).repartition(3)
    return sorted((tuple(r[n] for n in NAMES) for r in p.prefix_trie(frame, tree_turns).collect()), key=repr)


def talk(seed):
    """Conversations with long common starts, copies, and starts that are whole conversations."""
    rng = random.Random(seed)
    texts = [f"{'word ' * rng.randrange(6)}{i}" for i in range(4)]
    rows = []
    for c in range(160):
        rng = random.Random(seed * 1000 + (c // 40 if c % 2 else c))
        for t in range(rng.choice([1, 2, 3, 5, 9, 40])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("tree_turns", [1, 7, 60, 1_000_000])
def test_like_brute_force_at_any_number_of_ranges(spark, tree_turns):
    rows = talk(1)
    assert found(spark, rows, tree_turns) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "a b"), (0, 1, None, None), (0, None, "system", "first"), (0, None, "system", "first"),
        (1, 5, "user", "a b"), (1, 5, "user", "b a"), (2, 0, "", ""), (2, 1, None, None), (3, 0, "user", " \n\t"),
        (None, 0, "user", "nobody"), (-3, 1, "user", "x"), (-3, 2, "user", "y" * 50_000), (-20, 1, "user", "x"),
        (25, 0, "user", "alone"), (2**53 + 1, 0, "user", "large id"), (2**53 + 3, 0, "user", "large id"),
        (60, 0, "us", "er"), (62, 0, "user", ""), (64, 0, "us", "er"),
    ]
    rows += [(7, t, "user", f"turn {t} " * 3) for t in range(700)] + [(8, t, "user", f"turn {t} " * 3) for t in range(650)]
    for tree_turns in (3, 1_000_000):
        assert found(spark, rows, tree_turns) == brute(rows)
    assert found(spark, [(None, 0, "user", "nobody")]) == []
    assert found(spark, []) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 20]
    assert any(zlib.crc32(str(c).encode()) % 4 for c, *_ in rows)
    assert found(spark, rows) == brute(rows)


def test_a_hot_group_of_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1500) for t in range(3)] + talk(2)[:300]
    assert found(spark, rows, 200) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_tree_walks_in_order(seed):
    rng = random.Random(seed)
    keys = {bytes(rng.choice(range(rng.choice([2, 256]))) for _ in range(rng.randrange(9))) for _ in range(3000)}
    tree, order = p.Tree(), sorted(keys)
    for value in rng.sample(range(len(order)), len(order)):
        tree.add(order[value], value)
    walked = list(tree.walk())
    assert [v for v, _ in walked] == list(range(len(order)))
    assert [s for _, s in walked[1:]] == [p._common(a, b) for a, b in zip(order, order[1:], strict=False)]
    assert list(p.Tree().walk()) == []


def test_nodes_grow_with_their_children():
    tree = p.Tree()
    rooms = []
    for b in random.Random(0).sample(range(256), 256):
        tree.add(bytes([9, 9, b]), b)
        rooms.append(tree.root.room if tree.root.prefix == b"\x09\x09" else 0)
    assert [rooms[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [4, 16, 16, 48, 48, 256, 256]
    assert [v for v, _ in tree.walk()] == list(range(256))
