"""Token counts that follow edits.

Each document keeps a segment tree over blocks of pre-tokens (words as the tokenizer
cuts them): a leaf has its characters and tokens, a node the sums below it. An edit finds
its leaves by descending on characters. From the start of the first of them, a little
before the edit, words are cut anew until a word start meets the start of an untouched
leaf; only these words are encoded, and the sums above the leaves are brought up to date.
No token goes over the end of a word, so the root is the count of the new text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annalog.llm.bpe import WORD, Codec, Words
from annalog.llm.pii import spans

LEAF = 64  # pre-tokens of a leaf
CONTEXT = 8  # characters ahead that a word's end may depend on, and more

class WordCounts:
    """Tokens of words."""

    def __init__(self, codec: Codec):
        self.words = Words(lambda words: [len(ids) for ids in codec.word_ids(words)])

    def of(self, words: list[str]) -> np.ndarray:
        return np.array(self.words.of(words), dtype=np.int64)


class Tree:
    """Sums of characters and tokens over leaves; node i has the children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, int(len(chars) - 1).bit_length())
        self.leaves = len(chars)
        self.chars = self._sums(chars)
        self.tokens = self._sums(tokens)

    def _sums(self, leaves: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * self.size, dtype=np.int64)
        out[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            out[level // 2 : level] = out[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2
        return out

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one at the end), and its start."""
        node, start = 1, 0
        at = min(at, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more, plus = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more
            self.tokens[node] += plus
            node //= 2

    @property
    def count(self) -> int:
        return int(self.tokens[1])


def build(text: str, counts: WordCounts) -> tuple[Tree, int]:
    """The tree of a text, and its number of words."""
    words = WORD.findall(text)
    if not words:
        return Tree(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)), 0
    tokens = counts.of(words)
    chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.arange(0, len(words), LEAF)
    return Tree(np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)), len(words)


def clean_edits(edits, length: int) -> list[tuple[int, int, str]]:
    """Edits (start, end, text) in order. One that is incomplete, out of range, or begins
    before the end of an earlier one is left out."""
    out, end = [], 0
    whole = [e for e in edits if all(x is not None for x in e)]
    for start, stop, text in sorted(whole):
        if end <= start <= stop <= length:
            out.append((int(start), int(stop), text))
            end = stop
    return out


def replaced(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, end = [], 0
    for start, stop, new in edits:
        out += [text[end:start], new]
        end = stop
    return "".join([*out, text[end:]])


def apply_edits(tree: Tree, text: str, edits: list[tuple[int, int, str]], counts: WordCounts) -> tuple[str, int]:
    """Brings the tree to the text after the edits (of `clean_edits`); returns that text and
    how many words were encoded for it."""
    new = replaced(text, edits)
    starts = np.concatenate([[0], np.cumsum(tree.chars[tree.size : tree.size + tree.leaves])])
    done, i, ahead = 0, 0, 0
    changes = []
    while i < len(edits):
        first, low = tree.find(max(0, edits[i][0] - CONTEXT)) if len(text) else (0, 0)
        shift = ahead
        after = first  # the first leaf behind what is cut anew
        words, ends_at = [], low + shift
        scan = WORD.finditer(new, ends_at)
        while True:
            # Leaves that any edit reaches, its context included, belong to the region.
            while i < len(edits) and (after >= tree.leaves or edits[i][0] - CONTEXT < starts[after] or after == first):
                ahead += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                last = int(np.searchsorted(starts, max(edits[i][1], 1), side="left"))
                after = max(after, min(last, tree.leaves), first + 1)
                i += 1
            goal = int(starts[after]) + ahead if after < tree.leaves else len(new)
            while ends_at < goal:
                m = next(scan)
                words.append(m.group())
                ends_at = m.end()
            if ends_at == goal and not (i < len(edits) and after < tree.leaves and edits[i][0] - CONTEXT < starts[after]):
                break
            after += 1
        tokens = int(counts.of(words).sum()) if words else 0
        changes.append((first, after, ends_at - (low + shift), tokens))
        done += len(words)
    for first, after, chars, tokens in changes:
        tree.put(first, chars, tokens)
        for leaf in range(first + 1, min(after, tree.leaves)):
            tree.put(leaf, 0, 0)
    return new, done


COUNTS = "n_words long, n_tokens long, n_edits int, n_encoded long, n_tokens_after long, tree array<long>"
COUNT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def count_edited(docs: DataFrame, edits: Column, spec: str, keep_tree: bool = True) -> DataFrame:
    """`docs` (doc_id, text) with `edits`, an array of (start, stop, text) in characters of the
    text, end exclusive: doc_id, n_words and n_tokens before, n_edits applied, n_encoded words
    encoded for them, n_tokens_after, and the tree's token sums after.

    A null text counts as empty, null edits as none; see `clean_edits` for odd ones. Repeated
    rows stay, other columns are not read. Special tokens count as plain text. A document's
    tree and edits are together on its row, so nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select("doc_id", "text", edits.alias("edits"))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(Codec(sent.value))
        for batch in batches:
            found = [
                _count_row(t or "", e or [], counts, keep_tree)
                for t, e in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True)
            ]
            columns = zip(*found, strict=True) if found else [[] for _ in COUNT_TYPES]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, COUNT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def _count_row(text: str, edits: list[dict], counts: WordCounts, keep_tree: bool) -> tuple:
    todo = clean_edits([(e["start"], e["stop"], e["text"]) for e in edits if e is not None], len(text))
    tree, n_words = build(text, counts)
    before = tree.count
    encoded = apply_edits(tree, text, todo, counts)[1]
    return n_words, before, len(todo), encoded, tree.count, tree.tokens if keep_tree else None


def redactions(text: Column) -> Column:
    """Edits that cut the first line, if more follow, and replace addresses by a mark."""
    body = F.coalesce(text, F.lit(""))
    kind = "array<struct<start:int,stop:int,text:string>>"
    line = F.instr(body, "\n")
    first = F.array(F.struct(F.lit(0).alias("start"), line.alias("stop"), F.lit("").alias("text")))
    marks = F.transform(
        F.filter(spans(body), lambda s: s["start"] >= line),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("stop"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("text")
        ),
    )
    return F.concat(F.when(line > 0, first).otherwise(F.array().cast(kind)), marks.cast(kind))
