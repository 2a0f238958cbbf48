"""Prefix trie of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is the 16 bytes of an MD5 of its role and text, and a conversation's key the ids
of its turns one after the other. Conversations with equal keys count as one sequence. The
sequences are dealt to tasks by ranges of keys, and each task builds a radix tree of its
range: nodes of 4, 16, 48 or 256 children, paths compressed. Walking it gives the sequences in
order and the depth at which each leaves the one before; every depth that ends a turn is a
node of the trie.

All figures of a node are sums over its sequences once each sequence counts for the nodes
that it is the first to reach. So a node whose sequences lie in several ranges is the sum of its parts, but
for what two neighbouring ranges both count as reached first: the common part of the last key of
one and the first key of the next, which is taken off again. Only the paths of a range's first
and last key can be such nodes. They are merged by a hash of the path, all others are final
as the task gives them; no text and no key is shuffled once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalog.llm.common import count_words
from annalog.operators.lookup import lookup
from annalog.operators.skew import small_side
from annalog.session import cut_lineage

WIDTH = 16  # bytes of a turn id
TREE_TURNS = 200_000  # turns of sequences in one tree
SHARED = 20  # conversations that may start like the first of them
IDS = 8  # bits: ids that are joined at a time for the hash of a sequence's members
ROWS = 20_000  # of a batch that a task returns
EMPTY = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of a radix tree: up to 4 or 16 children as sorted bytes beside them, up to 48
    through an index of 256 bytes, more as a plain array."""

    __slots__ = ("index", "kids", "prefix", "room", "value")

    def __init__(self, prefix: bytes, value: int = -1):
        self.prefix, self.value = prefix, value
        self.room, self.index, self.kids = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child, or replaces the one at this byte."""
        if self.room <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.room or self._grow().room == 16:
                at = sum(b < byte for b in self.index)
                self.index.insert(at, byte)
                self.kids.insert(at, kid)
                return
        if self.room == 48:
            if self.index[byte]:
                self.kids[self.index[byte] - 1] = kid
                return
            if len(self.kids) < 48 or self._grow().room == 48:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
                return
        self.kids[byte] = kid

    def _grow(self) -> Node:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.index):
                index[byte] = at + 1
            self.room, self.index = 48, index
        else:
            self.room, self.kids = 256, [self.kids[at - 1] if at else None for at in self.index]
            self.index = bytearray()
        return self

    def ordered(self) -> list[Node]:
        if self.room <= 16:
            return self.kids
        if self.room == 48:
            return [self.kids[at - 1] for at in self.index if at]
        return [kid for kid in self.kids if kid is not None]


def _common(a: bytes, b: bytes) -> int:
    """Bytes at the start that two texts share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Tree:
    """An adaptive radix tree from distinct keys to numbers."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def add(self, key: bytes, value: int) -> None:
        node, parent, at = self.root, None, 0
        while node is not None:
            prefix = node.prefix
            if key[at : at + len(prefix)] != prefix:
                same = _common(prefix, key[at : at + len(prefix)])
                upper = Node(prefix[:same])
                upper.put(prefix[same], node)
                node.prefix = prefix[same + 1 :]
                self._hang(parent, key, at, upper)
                node, prefix = upper, upper.prefix
            at += len(prefix)
            if at == len(key):
                node.value = value
                return
            parent, node, at = node, node.find(key[at]), at + 1
        self._hang(parent, key, at, Node(key[at:], value))

    def _hang(self, parent: Node | None, key: bytes, at: int, node: Node) -> None:
        if parent is None:
            self.root = node
        else:
            parent.put(key[at - 1], node)

    def walk(self) -> Iterator[tuple[int, int]]:
        """The values in the order of their keys, each with the bytes its key shares with the
        one before."""
        waiting = [(self.root, 0, 0)] if self.root is not None else []
        while waiting:
            node, at, shared = waiting.pop()
            end = at + len(node.prefix)
            if node.value >= 0:
                yield node.value, shared
                shared = end
            kids = node.ordered()
            waiting += [(kid, end + 1, end if i else shared) for i, kid in reversed(list(enumerate(kids)))]


class _Trie:
    """The nodes of a task's sequences as columns, a number for each node in preorder."""

    def __init__(self) -> None:
        self.conv, self.depth, self.parent = [], [], []
        self.convs, self.kids, self.leaves = [], [], []
        self.every, self.once, self.words, self.ends = [], [], [], []
        self.path: list[int] = []

    def _open(self, words: int) -> None:
        self.parent.append(self.path[-1] if self.path else -1)
        self.depth.append(len(self.path))
        self.path.append(len(self.conv))
        self.conv.append(None)
        for column in (self.convs, self.kids, self.leaves, self.every):
            column.append(0)
        self.words.append(words)
        self.once.append(words)
        self.ends.append(None)

    def _close(self) -> None:
        at = self.path.pop()
        self.every[at] += self.convs[at] * self.words[at]
        self.leaves[at] = self.leaves[at] or 1
        if self.path:
            up = self.path[-1]
            self._member(up, self.conv[at], self.convs[at])
            self.kids[up] += 1
            self.leaves[up] += self.leaves[at]
            self.every[up] += self.every[at]
            self.once[up] += self.once[at]

    def _member(self, at: int, conv: int, n: int) -> None:
        self.convs[at] += n
        self.conv[at] = conv if self.conv[at] is None else min(conv, self.conv[at])

    def add(self, shared: int, words, conv: int, n: int, ends: str) -> None:
        """A sequence that shares `shared` turns with the one before it in the order."""
        while len(self.path) > shared + 1:
            self._close()
        if not self.path:
            self._open(0)
        for w in words[len(self.path) - 1 :]:
            self._open(int(w))
        self._member(self.path[-1], conv, n)
        self.ends[self.path[-1]] = ends

    def close(self) -> list[int]:
        """The numbers of the last sequence's path, when all is added up."""
        last = list(self.path)
        while self.path:
            self._close()
        return last


def _paths(key: bytes) -> list[str]:
    """A hash of each prefix of whole turns, the empty one first."""
    running = hashlib.md5(usedforsecurity=False)
    found = [running.hexdigest()]
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        found.append(running.hexdigest())
    return found


# Nodes; `path` and `parent_path` only where the node, or its parent, may go on in another
# range. A range's row (depth -1) has its first and last key and the words before each depth.
_COLUMNS = (
    "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, every long, once long, "
    "ends string, path string, parent_path string, range string, before long, first_key binary, last_key binary, words array<long>"
)
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _range_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of one range of sequences (key, words, conv_id, n, ends)."""
    tree, held, keys = Tree(), [], []
    for batch in batches:
        for key, *rest in zip(*(batch[c] for c in ("key", "words", "conv_id", "n", "ends")), strict=True):
            tree.add(key, len(held))
            held.append(rest)
            keys.append(key)
    if not held:
        return
    trie, order = _Trie(), []
    for value, shared in tree.walk():
        order.append(value)
        trie.add(shared // WIDTH, *held[value])
    last = trie.close()
    del tree
    first_key, last_key = keys[order[0]], keys[order[-1]]
    open_, first = dict(zip(last, _paths(last_key), strict=True)), _paths(first_key)
    open_ |= dict(enumerate(first))  # the first sequence's nodes were opened first, in order
    sums = [0]
    for w in held[order[0]][0]:
        sums.append(sums[-1] + int(w))
    mine = first[-1]
    yield pd.DataFrame([[None, -1, *[None] * 9, mine, None, first_key, last_key, sums]], columns=_NAMES)

    def row(i: int) -> tuple:
        up, left = trie.parent[i], i < len(first)
        return (
            trie.conv[i], trie.depth[i], None if up < 0 or up in open_ else trie.conv[up], trie.convs[i], trie.kids[i],
            trie.leaves[i], trie.every[i], trie.once[i], trie.ends[i], open_.get(i), open_.get(up),
            mine if left else None, sums[max(trie.depth[i] - 1, 0)] if left else None, None, None, None,
        )

    for start in range(0, len(trie.conv), ROWS):
        rows = [row(i) for i in range(start, min(start + ROWS, len(trie.conv)))]
        part = pd.DataFrame(rows, columns=_NAMES)
        yield part.assign(**{c: pd.array([r[_NAMES.index(c)] for r in rows], dtype="Int64") for c in ("parent_conv_id", "before")})


def _shared_turns(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None else _common(x, y) // WIDTH for x, y in zip(a, b, strict=True)], dtype="int32")

    return of(a, b)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): of each conversation the ids of its turns and their words, after
    its first turns have been replaced by those of the first conversation of its twenty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"),
        F.struct(
            F.col("turn").isNotNull().alias("given"),
            F.coalesce("turn", F.lit(0)).alias("turn"),
            F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
            count_words(text).alias("words"),
        ).alias("t"),
    )
    own = turns.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = cut_lineage(own.select("base", "conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    heads = own.where("conv_id = base").select("base", *(F.slice(c, 1, 3).alias(f"head_{c}") for c in ("ids", "words")))
    rows = own.join(heads, "base", "left")
    empty = {"ids": F.array().cast("array<string>"), "words": F.array().cast("array<bigint>")}
    joined = [
        F.concat(F.slice(F.coalesce(f"head_{c}", empty[c]), 1, h), F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)
        for c in ("ids", "words")
    ]
    return rows.select("conv_id", *joined)


def _members(sequences: DataFrame) -> DataFrame:
    """(sequence, conv_id, n, ends) from (sequence, conv_id): smallest member, members, and
    the hash of all. Ids are joined by 256 values at a time, so that a sequence of very many
    members is built in many tasks; the last one only runs the hash over the parts."""
    parts = sequences.groupBy("sequence", F.shiftright("conv_id", IDS).alias("part")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids")
    )
    parts = parts.select(
        "sequence", "part", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("conv_id"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, conv, n, running = None, 0, 0, None
        for batch in batches:
            out = []
            for sequence, count, first, ids in zip(batch["sequence"], batch["n"], batch["conv_id"], batch["ids"], strict=True):
                if sequence != now:
                    if now is not None:
                        out.append((now, conv, n, running.hexdigest()))
                    now, conv, n, running = sequence, first, count, hashlib.sha256(ids.encode())
                else:
                    n += count
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["sequence", "conv_id", "n", "ends"])
        if now is not None:
            yield pd.DataFrame([(now, conv, n, running.hexdigest())], columns=["sequence", "conv_id", "n", "ends"])

    dealt = parts.repartition("sequence").sortWithinPartitions("sequence", "part")
    return dealt.mapInPandas(run, "sequence string, conv_id long, n long, ends string")


def prefix_trie(conversations: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """One row for each node of the trie of `conversations` (conv_id, turn, role, text):
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns stand in the order of `turn`, null first; turns of one number in that of the MD5 of
    role and text, so repeated rows are repeated turns. Null role and text are empty. Rows
    without conv_id belong to no conversation. The remainder of a negative conv_id is SQL's,
    which is negative. Without conversations there is no node. A
    conversation's ids (16 bytes a turn) are held together, its texts never. Other columns
    are not read."""
    rows = rebuilt(conversations)
    key = F.unhex(F.array_join("ids", ""))
    rows = cut_lineage(rows.select("conv_id", key.alias("key"), "words", F.md5(F.array_join("ids", "")).alias("sequence")))
    named = _members(rows.select("sequence", "conv_id"))
    sequences = cut_lineage(rows.join(named.drop("sequence"), "conv_id").select("key", "words", "conv_id", "n", "ends"))
    turns = sequences.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    dealt = sequences.repartitionByRange(turns // tree_turns + 1, "key")
    nodes = cut_lineage(dealt.mapInPandas(_range_nodes, _COLUMNS))

    ranges = nodes.where("depth = -1").select("range", "first_key", "last_key", "words")
    before = F.lag("last_key").over(Window.orderBy("first_key"))  # a row for each task
    ranges = ranges.select("range", "words", before.alias("key"), "first_key")
    ranges = ranges.select(
        "range",
        _shared_turns(F.col("key"), F.col("first_key")).alias("shared"),
        (F.octet_length("key") / WIDTH).cast("int").alias("length"),
        "words",
    ).where("shared >= 0")
    ranges = cut_lineage(ranges.select("range", "shared", F.coalesce("length", F.lit(-1)).alias("length"), F.get("words", F.col("shared")).alias("up_to")))
    parts = nodes.where("path IS NOT NULL").join(small_side(ranges), "range", "left")
    twice = F.col("shared").isNotNull() & (F.col("depth") <= F.col("shared"))
    less = lambda column, by: (F.col(column) - F.when(twice, by).otherwise(0)).alias(column)
    parts = parts.select(
        "path", "parent_path", "depth", "conv_id", "n_convs", "every", "ends",
        less("n_children", (F.col("depth") < F.col("shared")).cast("long")),
        less("n_leaves", (F.col("shared") == F.col("length")).cast("long")),
        less("once", F.col("up_to") - F.col("before")),
    )
    merged = parts.groupBy("path").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_path").alias("parent_path"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "every", "once")), F.max("ends").alias("ends"),
    )
    merged = cut_lineage(merged)

    figures = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "every", "once", "ends"]
    inner = nodes.where("depth >= 0 AND path IS NULL")
    whole = inner.where("parent_path IS NULL").select(*figures, "parent_conv_id")
    top = merged.where("parent_path IS NULL").select(*figures, F.lit(None).cast("long").alias("parent_conv_id"))
    below = inner.select(*figures, "parent_path").union(merged.select(*figures, "parent_path")).where("parent_path IS NOT NULL")
    parents = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("up"))
    below = lookup(below, parents, ["parent_path"], "_of").select(*figures, F.col("_of.up").alias("parent_conv_id"))
    return whole.union(top).union(below).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("every") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
