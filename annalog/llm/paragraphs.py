"""Repeated paragraphs by MinHash banding.

A paragraph is a line; a line of more than `LONG` words is cut into sentences, and a
sentence of more than that at its commas, so that a passage inside a longer line has
paragraphs of its own. Equal paragraphs are one node. Bands of the MinHash of word
shingles bring nodes together, the exact Jaccard similarity decides, and classes are the
components of what is left. Classes that stand in several documents are repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annalog.llm.components import components
from annalog.session import cut_lineage

SHINGLE = 5
LONG = 40
# Four bands of two rows: a pair at similarity 0.8 meets with 98 %, one at 0.9 with 99.9 %.
BANDS, ROWS = 4, 2
SIMILARITY = 0.8
RUN_WORDS = 20
GROUP = 500_000  # characters hashed together
KNOWN_WORDS = 500_000

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?](?=\s|$)")
_MULTIPLIERS = np.array(
    [xxhash.xxh64_intdigest(f"row {i}".encode()) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64
)


def paragraph_bounds(text: str) -> list[tuple[int, int]]:
    """Characters [start, stop) of the paragraphs of at least `SHINGLE` words."""
    out = []

    def cut(start: int, stop: int, rules: list[re.Pattern]) -> None:
        n = len(text[start:stop].split())
        if n > LONG and rules:
            at = start
            for m in rules[0].finditer(text, start, stop):
                cut(at, m.end(), rules[1:])
                at = m.end()
            cut(at, stop, rules[1:])
        elif n >= SHINGLE:
            out.append((start, stop))

    at = 0
    for line in text.split("\n"):
        cut(at, at + len(line), [_SENTENCE, re.compile(",")])
        at += len(line) + 1
    return out


def shingle_set(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


class WordHashes:
    """64-bit hashes of words; up to `KNOWN_WORDS` are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out[i] = h
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def signatures(paragraphs: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """A key of each paragraph's words, and its band values (paragraph, band)."""
    sizes = np.array([len(p) for p in paragraphs])
    word = hashes.of([w for p in paragraphs for w in p])
    n = len(word) - SHINGLE + 1
    shingle = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        shingle = _mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = owner[:n] == owner[SHINGLE - 1 :]
    shingle, owner = shingle[inside], owner[:n][inside]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    rank = np.arange(len(owner), dtype=np.uint64) - starts[owner].astype(np.uint64)
    key = np.add.reduceat(_mixed(shingle + _mixed(rank * np.uint64(0xD6E8FEB86659FD93))), starts)
    least = np.stack([np.minimum.reduceat(_mixed(shingle * m), starts) for m in _MULTIPLIERS], axis=1)
    rows = least.reshape(len(sizes), BANDS, ROWS)
    band = np.zeros((len(sizes), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64), band.view(np.int64)


FIELDS = "number int, start int, stop int, n_words int, key long, " + ", ".join(f"band{i} long" for i in range(BANDS))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, number, start, stop, n_words, key, bands) of every paragraph of every text;
    `number` counts a document's paragraphs from 0."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column("doc_id")
            found, size = [], 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                at = paragraph_bounds(text)
                found += [(row, k, a, b, text[a:b].lower().split()) for k, (a, b) in enumerate(at)]
                size += len(text)
                if size >= GROUP:
                    yield from _batch(found, ids, hashes, schema.names)
                    found, size = [], 0
            yield from _batch(found, ids, hashes, schema.names)

    return rows.mapInArrow(run, schema)


def _batch(found: list[tuple], ids: pa.Array, hashes: WordHashes, names: list[str]) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    key, band = signatures([f[4] for f in found], hashes)
    row, number, start, stop = (np.array(c) for c in zip(*(f[:4] for f in found), strict=True))
    small = [number, start, stop, [len(f[4]) for f in found]]
    arrays = [ids.take(pa.array(row)), *(pa.array(c, pa.int32()) for c in small), pa.array(key)]
    yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(band[:, i].copy()) for i in range(BANDS))], names=names)


def _texts(docs: DataFrame, held: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys, each from one of its documents."""
    place = F.struct("doc_id", "start", "stop")
    one = held.join(keys, "key", "left_semi").groupBy("key").agg(F.min(place).alias("p"))
    one = one.select("key", "p.*")
    piece = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    found = docs.select("doc_id", "text").join(one, "doc_id").select("key", piece.alias("text"))
    return found.groupBy("key").agg(F.min("text").alias("text"))


def _similar(texts: list[str], sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (numbers of two texts) that join all texts at least `similarity` alike; of links
    that close a circle only the first are given. Texts of different sides are compared, or
    all if there is but one."""
    sets = [shingle_set(t) for t in texts]
    number: dict = {}
    at = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    size = np.array([len(s) for s in sets])
    has = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, x in enumerate(at):
        has[i, x] = 1
    shared = has @ has.T
    near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-6
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    group = list(range(len(texts)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = root(int(i)), root(int(j))
        if x != y:
            group[y] = x
            out.append((int(i), int(j)))
    return out


def _compare(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by `meet`; one meeting's rows are held at a time."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            meet = rows[MEET].to_numpy()
            edges = np.flatnonzero(np.r_[True, (meet[1:] != meet[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, int)
            rest = rows.iloc[edges[-1] :] if len(edges) else rows
            yield from links_of(rows.iloc[: edges[-1]], edges) if len(edges) > 1 else []
        if rest is not None and len(rest) > 1:
            yield from links_of(rest, np.array([0, len(rest)]))

    def links_of(rows: pd.DataFrame, edges: np.ndarray) -> Iterator[pd.DataFrame]:
        keys, sides, texts = rows["key"].to_numpy(), rows["side"].to_numpy(), rows["text"].to_numpy()
        found = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                found += [(keys[a + i], keys[a + j]) for i, j in _similar(list(texts[a:b]), sides[a:b], similarity)]
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


MEET = ["i", "h", "low", "high"]
MEETING = 256  # paragraphs of one side


def links(docs: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between keys that join all those whose shingle sets are at least
    `similarity` alike and that share a band.

    The paragraphs of a band value are cut into sides of about `MEETING`, and every two
    sides meet, so that a large group is compared in full by many tasks of bounded size;
    each gives only as many links as join what it has found alike."""
    nodes = held.groupBy("key").agg(*[F.min(f"band{i}").alias(f"band{i}") for i in range(BANDS)])
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"band{i}").alias("h")) for i in range(BANDS)]))
    dealt = nodes.select("key", band.alias("band")).select("key", "band.i", "band.h")
    shared = dealt.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(dealt.join(shared, ["i", "h"]))
    texts = _texts(docs, held, members.select("key").distinct())
    sides = F.ceil(F.col("n") / MEETING).cast("int")
    rows = members.join(texts, "key").withColumn("side", F.pmod(F.xxhash64("key"), sides).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    rows = rows.select(
        "i", "h", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "key", "text"
    )
    dealt_out = rows.repartition(*MEET).sortWithinPartitions(*MEET, "key")
    return dealt_out.mapInPandas(_compare(similarity), "a long, b long")


def repeats(docs: DataFrame, run_words: int = RUN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each repeated paragraph of each document: doc_id, number, start, stop,
    n_words, class_id, first_doc_id, n_copies, kept.

    A paragraph is repeated if its class stands in documents of different ids, and if the
    repeated paragraphs that follow each other with it have `run_words` words or more. The
    first document of a class, by id, keeps its copies; the others are to lose theirs.
    Rows without id or text and texts without paragraphs have none. Rows that repeat an id
    give their paragraphs each, but do not make a repeat by themselves. Other columns are
    not read."""
    held = cut_lineage(paragraphs(docs))
    roots = components(links(docs, held, similarity)).withColumnsRenamed({"node": "key"})
    # Grouped by key first, so a paragraph in a third of all documents is one row.
    by_key = held.groupBy("key").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    )
    classed = by_key.join(roots, "key", "left").withColumn("class_id", F.coalesce("root", "key"))
    classed = cut_lineage(classed.select("key", "class_id", "first", "last", "n"))
    stats = classed.groupBy("class_id").agg(
        F.min("first").alias("first_doc_id"), F.max("last").alias("last_doc_id"), F.sum("n").alias("n_copies")
    )
    wide = stats.where("first_doc_id <> last_doc_id").drop("last_doc_id")
    keys = classed.select("key", "class_id").join(wide, "class_id")
    rows = held.select("doc_id", "number", "start", "stop", "n_words", "key").join(keys, "key").drop("key")
    # Numbers that follow each other less their rank are one run's number.
    own = Window.partitionBy("doc_id").orderBy("number", "start")
    rows = rows.withColumn("run", F.col("number") - F.dense_rank().over(own))
    run = Window.partitionBy("doc_id", "run")
    rows = rows.withColumn("run_words", F.sum("n_words").over(run)).where(F.col("run_words") >= run_words)
    return rows.withColumn("kept", F.col("doc_id") == F.col("first_doc_id")).drop("run", "run_words")
