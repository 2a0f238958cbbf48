"""Toxicity by the nearest labelled examples.

Exact TF-IDF cosine over all terms of the examples, searched in a block-max inverted index.
The postings of rare terms are added up; frequent terms keep their largest weight per block
of examples, and a block is completed by them only if these can still lift one of its examples
to the k-th best score: for many texts at once, by a product of single precision. What comes near
the k-th score is computed again in double precision. The neighbours' labels vote, weighted by similarity, and the vote is
calibrated on the examples themselves, each scored without itself. The neighbours are
returned as evidence.

A term's weight is its TF-IDF times its relevance: 1, and more the further its share of
toxic examples lies from the average. No term and no example is left out of the index.

The index is fitted on a bounded sample of labelled rows (`max_examples`); document
frequencies cover all texts, and every whole text is scored. Terms are known by their
64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.common import give_back
from annalog.session import cut_lineage

MAX_EXAMPLES = 20_000
USUAL_Z = 3.0  # a term's share of toxic rows may lie so far from the average by chance
NEIGHBOURS = 25
BLOCK = 128
FREQUENT = 16  # a term in more than one of so many examples is frequent
TOGETHER = 64  # texts that are searched at once
THRESHOLD = 0.7
PRIOR_WEIGHT = 0.1

_WORD = re.compile(r"\w+")


# ASCII letters and digits lower-cased, `_` as it is, a space for all others.
_PLAIN = bytes(ord(chr(i).lower()) if i < 128 and _WORD.match(chr(i)) else 32 for i in range(256))


def _spaced(text: str | None) -> str:
    """The runs of word characters of the lower-cased text, with spaces between them."""
    text = text or ""
    if text.isascii():
        return text.encode().translate(_PLAIN).decode()
    return " ".join(x if x.isalnum() else " ".join(_WORD.findall(x)) for x in text.lower().split())


def terms(text: str | None) -> Counter:
    return Counter(_spaced(text).split())


def term_keys(words: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64).view(np.int64)


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the `wanted` keys stand in the sorted `keys`, and which of them are there."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return at[hit], hit


def counted(texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often the terms with the given sorted keys stand in each text: the text's place, the
    term's number and its count, sorted by place and number. Each word is looked up once."""
    lists = pc.ascii_split_whitespace(pa.array(map(_spaced, texts), pa.large_string()))
    found = lists.flatten().dictionary_encode()
    at, hit = _places(keys, term_keys(found.dictionary.to_numpy(zero_copy_only=False)))
    number = np.full(len(hit), -1)
    number[hit] = at
    number = number[found.indices.to_numpy()]
    place = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    known = number >= 0
    both, n = np.unique(place[known] * len(keys) + number[known], return_counts=True)
    return *np.divmod(both, max(len(keys), 1)), n


def sample_labels(labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Up to `max_examples` labelled documents, the smallest by a hash of their id; a
    document with several labels is toxic if one says so. Null ids or labels are out."""
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)


@dataclass
class Index:
    """Postings of the terms `keys`, sorted by term and example; `value` is a term's IDF times
    its relevance. A frequent term has a number in `frequent` (else -1), its largest weight in
    each block in `top`, and its weights a second time, by example, in `own_*`."""

    keys: np.ndarray
    value: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    frequent: np.ndarray
    top: np.ndarray
    own_starts: np.ndarray
    own_terms: np.ndarray
    own_weights: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    base: float
    neighbours: int
    slope: float = 1.0
    offset: float = 0.0
    sent: Broadcast | None = None

    def __post_init__(self) -> None:
        self._steps = np.arange(1 << 16)
        # Held for all searches: arrays of this size that come and go leave gaps in a worker's memory.
        self._room = np.empty((0, 0)), np.empty((0, 0), dtype=np.float32)

    def parts(self) -> dict:
        """What a task builds the index from, but for its curve."""
        return {k: v for k, v in vars(self).items() if k not in ("slope", "offset", "sent") and k[0] != "_"}

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit-length weights; empty if no term is known."""
        at, hit = _places(self.keys, term_keys(counts))
        n = np.fromiter(counts.values(), dtype=np.int64)[hit]
        return _unit(at, n, self.value)

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vector of each text."""
        place, at, n = counted(texts, self.keys)
        ends = np.searchsorted(place, np.arange(len(texts) + 1)).tolist()
        return [_unit(at[low:high], n[low:high], self.value) for low, high in zip(ends, ends[1:], strict=False)]

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search([(at, weight)], k)[0]

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of the largest cosine above 0, ties to the smaller
        number, and these cosines."""
        n = len(self.labels)
        if len(self._room[0]) < len(vectors):
            self._room = np.empty((len(vectors), n)), np.empty((len(vectors), n), dtype=np.float32)
        rare, asked = self._room[0][: len(vectors)], np.zeros((len(vectors), len(self.top)))
        for row, (at, weight) in enumerate(vectors):
            often = self.frequent[at]
            few = often < 0
            rare[row] = self._rare(at[few], weight[few])
            asked[row, often[~few]] = weight[~few]
        near = [np.arange(n)] * len(rare)
        if n > k:
            whole = self._whole(rare, asked, k)
            # Below the k-th score by the rounding of both, so that it never hides an example.
            slack, least = 4 * np.finfo(np.float32).eps * (len(self.top) + 2), np.finfo(np.float32).tiny
            near = [np.flatnonzero(x >= max(np.partition(x, n - k)[n - k] * (1 - slack), least)) for x in whole]
        step = len(near) if sum(map(len, near)) < 4 * k * len(near) else 1
        out = []
        for i in range(0, len(near), step or 1):
            out += self._best(near[i : i + step], rare[i : i + step], asked[i : i + step], k)
        return out

    def _rare(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        start = self.starts[at]
        size = self.starts[at + 1] - start
        which = np.repeat(start - np.cumsum(size) + size, size)
        if len(which) > len(self._steps):
            self._steps = np.arange(2 * len(which))
        which += self._steps[: len(which)]
        gain = np.repeat(weight, size)
        gain *= self.weights[which]
        return np.bincount(self.examples[which], gain, len(self.labels))

    def _whole(self, rare: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
        """Scores in single precision; 0 in the blocks that cannot reach the k-th score."""
        n, m = len(self.labels), len(self.top)
        lows = np.arange(0, n, BLOCK)
        high = np.maximum.reduceat(rare, lows, axis=1)
        most = asked @ self.top
        # Each of the k best blocks has an example that scores so much already.
        floor = np.partition(high, -k, axis=1)[:, -k:].min(axis=1) if len(lows) >= k else np.zeros(len(rare))
        can = high + most >= floor[:, None] * (1 - 1e-9)
        whole, asked = self._room[1][: len(rare)], asked.astype(np.float32)
        np.copyto(whole, rare, casting="same_kind")
        for block, low in enumerate(lows.tolist()):
            end = min(low + BLOCK, n)
            whole[~can[:, block], low:end] = 0
            rows = np.flatnonzero(can[:, block] & (most[:, block] > 0))
            if not len(rows):
                continue
            starts = self.own_starts[low : end + 1]
            own = slice(starts[0], starts[-1])
            weights = np.zeros((end - low) * m, dtype=np.float32)
            weights[np.repeat(np.arange(end - low) * m, np.diff(starts)) + self.own_terms[own]] = self.own_weights[own]
            weights = weights.reshape(end - low, m)
            if len(rows) == len(whole):
                whole[:, low:end] += asked @ weights.T
            else:
                whole[rows, low:end] += asked[rows] @ weights.T
        return whole

    def _best(self, near: list[np.ndarray], rare: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """In each row the k best of the `near` examples, in double precision."""
        row, which = np.repeat(np.arange(len(near)), [len(x) for x in near]), np.concatenate(near)
        start = self.own_starts[which]
        size = self.own_starts[which + 1] - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        gain = asked[np.repeat(row, size), self.own_terms[at]] * self.own_weights[at]
        whole = rare[row, which] + np.bincount(np.repeat(np.arange(len(which)), size), gain, len(which))
        order = np.lexsort((which, -whole, row))
        order = order[whole[order] > 0]
        ends = np.searchsorted(row[order], np.arange(len(near) + 1))
        best = [order[low : min(low + k, high)] for low, high in zip(ends, ends[1:], strict=False)]
        return [(which[x], whole[x]) for x in best]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: Iterable[int]) -> list[float]:
        """The votes on examples, each without itself."""
        out = []
        for (best, sim), i in zip(self.search(vectors, self.neighbours + 1), without, strict=True):
            keep = best != i
            out.append(self.vote(best[keep][: self.neighbours], sim[keep][: self.neighbours]))
        return out

    def vote(self, best: np.ndarray, sim: np.ndarray) -> float:
        share = sim**2
        return float((share @ self.labels[best] + PRIOR_WEIGHT * self.base) / (share.sum() + PRIOR_WEIGHT))

    def calibrated(self, vote: float) -> float:
        z = self.slope * _logit(vote) + self.offset
        return 1 / (1 + math.exp(-z))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the score, and the ids and similarities of the examples that vote."""
        for i in range(0, len(texts), TOGETHER):
            vectors = self.vectors(texts[i : i + TOGETHER])
            for (at, _), (best, sim) in zip(vectors, self.search(vectors, self.neighbours), strict=True):
                yield self.calibrated(self.vote(best, sim)) if len(at) else self.base, self.ids[best], sim


def _unit(at: np.ndarray, n: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term numbers and weights of unit length, of terms that occur `n` times."""
    order = np.argsort(at)
    at = at[order]
    weight = (1 + np.log(n[order])) * value[at]
    norm = math.sqrt(float(weight @ weight))
    return (at, weight / norm) if norm else (at[:0], weight[:0])


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def _platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (logit of the vote, label), by Newton
    steps with a weak pull to (1, 0). As it was if only one label is there."""
    if len(votes) < 20 or labels.min() == labels.max():
        return 1.0, 0.0
    x = np.stack([np.array([_logit(v) for v in votes]), np.ones(len(votes))], axis=1)
    beta, start, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (labels - p) - ridge * (beta - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        beta = beta + np.linalg.solve(curve, gradient)
    return max(float(beta[0]), 0.1), float(beta[1])


def assemble(
    keys: np.ndarray,
    value: np.ndarray,
    held: np.ndarray,
    examples: np.ndarray,
    weights: np.ndarray,
    labels: np.ndarray,
    ids: np.ndarray,
    base: float,
    neighbours: int,
) -> Index:
    """The index, not yet calibrated, from its postings and how many each term has."""
    n = len(labels)
    starts = np.concatenate([[0], np.cumsum(held)])
    often = np.flatnonzero(held * FREQUENT > n)
    frequent = np.full(len(keys), -1, dtype=np.int32)
    frequent[often] = np.arange(len(often))
    spans = [slice(low, high) for low, high in zip(starts[often], starts[often + 1], strict=True)]
    which = np.concatenate([examples[x] for x in spans] or [examples[:0]])
    own_weights = np.concatenate([weights[x] for x in spans] or [weights[:0]])
    own_terms = np.repeat(np.arange(len(often), dtype=np.int32), held[often])
    top = np.zeros((len(often), max(1, -(-n // BLOCK))))
    np.maximum.at(top, (own_terms, which // BLOCK), own_weights)
    order = np.argsort(which, kind="stable")
    own_starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))])
    return Index(
        keys, value, starts, examples, weights, frequent, top, own_starts, own_terms[order], own_weights[order],
        np.asarray(labels, dtype=float), ids, base, neighbours,
    )


def block_order(leads: list[int], most: list[float], names: list) -> list[int]:
    """Examples that share their weightiest term lie together, so block bounds are tight."""
    return sorted(range(len(leads)), key=lambda i: (leads[i], -most[i], names[i]))


def _lead(at: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """The weightiest term and its weight."""
    i = int(np.argmax(weight))
    return int(at[i]), float(weight[i])


def build_index(
    examples: list[tuple[dict[int, int], int]], names: list[str], idf: np.ndarray, base: float, neighbours: int
) -> Index:
    """The calibrated index of a few examples: (term number -> count, label)."""
    keys = term_keys(names)
    order = np.argsort(keys)
    keys, value, number = keys[order], idf[order], np.argsort(order)
    vectors = []
    for counts, label in examples:
        at = number[np.fromiter(counts, dtype=np.int64)]
        at, weight = _unit(at, np.fromiter(counts.values(), dtype=np.int64), value)
        if len(at):
            vectors.append((at, weight, label))
    leads = [_lead(*v[:2]) for v in vectors]
    order = block_order(*zip(*leads, strict=True), [(v[0].tobytes(), v[2]) for v in vectors]) if vectors else []
    vectors = [vectors[i] for i in order]
    labels = np.array([v[2] for v in vectors], dtype=float)
    at = np.concatenate([v[0] for v in vectors] or [np.zeros(0, dtype=np.int64)])
    weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)]).astype(np.float32)
    which = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[0]) for v in vectors])
    order = np.argsort(at, kind="stable")
    held = np.bincount(at, minlength=len(keys))
    index = assemble(keys, value, held, which[order], weight[order], labels, np.arange(len(vectors)), base, neighbours)
    if vectors:
        votes = index.votes([v[:2] for v in vectors], range(len(vectors)))
        index.slope, index.offset = _platt(np.array(votes), labels)
    return index


def _sample_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [terms(text) for text in batch["text"]]
        keys = [term_keys(f) for f in found]
        yield batch[["doc_id", "example", "toxic"]].assign(t=keys, n=[list(f.values()) for f in found])


def document_frequencies(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many of all texts each of the terms with the given sorted keys stands."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                seen += np.bincount(counted(batch["text"].iloc[i : i + TOGETHER], sent.value)[1], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"t": at.astype(np.int32), "n": seen[at]})

    rows = docs.select("text").mapInPandas(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(len(keys), dtype=np.int64)
    held[rows["t"].to_numpy()] = rows["n"].to_numpy()
    sent.destroy()
    return held


def relevance(df: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """1 for a term whose toxic examples are as many as chance may bring, more beyond it, on
    either side. The 1 below the root keeps terms of a few examples from weighing much."""
    z = (toxic - share * df) / np.sqrt(df * share * (1 - share) + 1)
    return 1 + np.maximum(0, np.abs(z) - USUAL_Z)


def _weighed(vectors: DataFrame, keys: np.ndarray, value: np.ndarray) -> DataFrame:
    """The examples with terms: term numbers `at` and weights `w` in place of counts, the
    weightiest term `lead` and its weight `most`."""
    sent = vectors.sparkSession.sparkContext.broadcast((keys, value))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_unit(_places(sent.value[0], t)[0], n, sent.value[1]) for t, n in zip(batch["t"], batch["n"], strict=True)]
            leads = [_lead(at, w) if len(at) else (-1, 0.0) for at, w in found]
            batch = batch[["doc_id", "example", "toxic"]].assign(
                at=[at for at, _ in found], w=[w for _, w in found], lead=[x for x, _ in leads], most=[x for _, x in leads]
            )
            yield batch[batch["lead"] >= 0]

    kind = vectors.schema["doc_id"].dataType.simpleString()
    out = cut_lineage(vectors.mapInPandas(run, f"doc_id {kind}, example string, toxic int, at array<int>, w array<float>, lead int, most double"))
    sent.destroy()
    return out


def _calibrate(index: Index, numbered: DataFrame) -> None:
    """Slope and offset from the votes on the examples, each without itself. The index is sent
    once, and stays for `score`."""
    sent = index.sent = numbered.sparkSession.sparkContext.broadcast(index.parts())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Index(**sent.value)
        for batch in batches:
            votes = []
            for i in range(0, len(batch), TOGETHER):
                some = batch.iloc[i : i + TOGETHER]
                vectors = [(at, w.astype(float)) for at, w in zip(some["at"], some["w"], strict=True)]
                votes += own.votes(vectors, some["number"])
            yield pd.DataFrame({"number": batch["number"], "vote": votes})

    rows = numbered.select("number", "at", "w").repartition(32, "number").mapInPandas(run, "number int, vote double").toArrow()
    order = np.argsort(rows["number"].to_numpy())
    index.slope, index.offset = _platt(rows["vote"].to_numpy()[order], index.labels)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_examples: int = MAX_EXAMPLES,
    neighbours: int = NEIGHBOURS,
) -> Index:
    """The index of a sample of labelled rows of `docs`, over all their terms. What reaches the
    driver is bounded by `max_examples`. Without labelled texts every score is 0."""
    sample = F.broadcast(sample_labels(labels, max_examples))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    example = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    rows = rows.withColumn("example", example).dropDuplicates(["example"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, example string, toxic int, t array<long>, n array<int>"
    vectors = cut_lineage(rows.mapInPandas(_sample_terms, schema))

    n, toxic = vectors.agg(F.count("*"), F.sum("toxic")).first()
    share = (toxic or 0) / max(n, 1)
    if not 0 < share < 1:
        return build_index([], [], np.zeros(0), float(share), neighbours)
    by_term = vectors.select("toxic", F.explode("t").alias("t")).groupBy("t")
    by_term = by_term.agg(F.count("*").alias("df"), F.sum("toxic").alias("dt")).orderBy("t").toArrow()
    keys, df, dt = (by_term[c].to_numpy() for c in ("t", "df", "dt"))
    idf = np.log((docs.count() + 1) / (document_frequencies(docs, keys) + 1))
    value = idf * relevance(df, dt, share)

    weighed = _weighed(vectors, keys, value)
    heads = weighed.select("doc_id", "example", "toxic", "lead", "most").toArrow()
    names = heads["example"].to_pylist()
    order = block_order(heads["lead"].to_pylist(), heads["most"].to_pylist(), names)
    toxic, ids = heads["toxic"].to_numpy()[order], heads["doc_id"].to_numpy()[order]
    numbers = docs.sparkSession.createDataFrame([(names[i], n) for n, i in enumerate(order)], "example string, number int")
    numbered = weighed.join(F.broadcast(numbers), "example")

    counts = weighed.select(F.explode("at").alias("t")).groupBy("t").count().toArrow()
    held = np.zeros(len(keys), dtype=np.int64)
    held[counts["t"].to_numpy()] = counts["count"].to_numpy()
    # Spark sorts the postings, so the driver only passes them on.
    rows = numbered.select("number", F.explode(F.arrays_zip("at", "w")).alias("x")).select("x.at", "number", "x.w")
    rows = rows.orderBy("at", "number").select("number", "w").toArrow()
    examples, weights = rows["number"].to_numpy(), rows["w"].to_numpy()
    del rows, counts, by_term, heads
    give_back()
    index = assemble(keys, value, held, examples, weights, toxic, ids, float(share), neighbours)
    if names:
        _calibrate(index, numbered)
    return index


def score(docs: DataFrame, index: Index, name: str = "score", evidence: bool = False) -> DataFrame:
    """`docs` with a score from 0 to 1 for each row; a null or empty text, or one without any
    term of the index, gets the share of toxic rows among the examples. With `evidence`, also
    `example_ids` and `example_similarities` of the examples that voted, nearest first."""
    sent = index.sent or docs.sparkSession.sparkContext.broadcast(index.parts())
    slope, offset = index.slope, index.offset
    kind = docs.schema["doc_id"].dataType.simpleString() if evidence else "long"
    fields = f"score double, example_ids array<{kind}>, example_similarities array<double>" if evidence else "score double"

    @F.pandas_udf(fields)
    def of(texts: pd.Series) -> pd.DataFrame:
        give_back()
        own = Index(**sent.value, slope=slope, offset=offset)
        codes, different = pd.factorize(texts, use_na_sentinel=False)
        found = own.scores([None if pd.isna(t) else t for t in different])
        if not evidence:
            return pd.DataFrame({"score": np.array([x for x, _, _ in found], dtype=float)[codes]})
        found = list(found)
        return pd.DataFrame([found[i] for i in codes], columns=["score", "example_ids", "example_similarities"])

    if not evidence:
        return docs.withColumn(name, of(F.col("text"))["score"])
    rows = docs.withColumn("_found", of(F.col("text"))).withColumn(name, F.col("_found.score"))
    return rows.select("*", "_found.example_ids", "_found.example_similarities").drop("_found")


def in_fold(doc_id: Column, parts: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `parts`, is `fold`; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == fold, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that score `threshold` or more, learned from all labels."""
    scored = score(docs, fit(docs, labels), "_toxic")
    return scored.where(F.col("_toxic") < threshold).drop("_toxic")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence (see `score`) for each row of `docs`;
    labels are learned from documents that are not held out."""
    learned = labels.where(~in_fold(F.col("doc_id"), 3, 1))
    index = fit(docs, learned)
    scored = score(docs.select("doc_id", "text"), index, evidence=True)
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "example_ids",
        "example_similarities",
    )
