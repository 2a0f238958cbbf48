"""Language of a text as a mixture.

Each language is a distribution over hashed letter trigrams, counted over all labelled
training texts. Expectation-maximisation estimates the proportions in which a text mixes
the languages; the set of languages grows while the log-likelihood gains more than a
penalty for one language more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.llm.toxicity import in_fold

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 30
TOLERANCE = 1e-3
PENALTY = 4.0  # times the log of the number of trigrams
SLICE = 1_000_000  # characters taken at a time
LANGS_AT_ONCE = 64


def _letters() -> np.ndarray:
    return np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every trigram of the lower-cased texts; whatever is not a
    letter counts as one space between words."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    codes = np.where(letters[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    inside = owner[2:] == owner[:-2]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(13)
    return owner[2:][inside], (mixed[inside] * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def _slices(text: str) -> list[str]:
    return [text[i : i + SLICE] for i in range(0, len(text), SLICE)] or [""]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of `docs` (text, lang)."""

    def flush(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                if lang not in sums and len(sums) >= LANGS_AT_ONCE:
                    yield from flush(sums)
                    sums = {}
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for group in _groups([s for t in texts for s in _slices(t)]):
                    total += np.bincount(trigrams(group, letters)[1], minlength=BUCKETS)
        yield from flush(sums)

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    found = rows.mapInPandas(count, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about `SLICE` characters together."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # (bucket, language)

    def mixtures(self, texts: list[str], letters: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """Proportions (text, language) in the chosen set; zeros for a text without letters."""
        out = np.zeros((len(texts), len(self.langs)))
        has = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
        if not has or not self.langs:
            return out
        short = [i for i in has if len(texts[i]) <= SLICE]
        where = {i: k for k, i in enumerate(short)}
        done = 0
        for group in _groups([texts[i] for i in short]):
            owner, bucket = trigrams(group, letters)
            key, n = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            out[short[done : done + len(group)]] = self._fit(key // BUCKETS, key % BUCKETS, n, penalty)
            done += len(group)
        for i in has:
            if i not in where:
                total = sum(np.bincount(trigrams([s], letters)[1], minlength=BUCKETS) for s in _slices(texts[i]))
                bucket = np.flatnonzero(total)
                out[i] = self._fit(np.zeros(len(bucket), dtype=np.int64), bucket, total[bucket], penalty)[0]
        return out

    def _fit(self, owner: np.ndarray, bucket: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
        """`owner` is sorted and holds every number from 0 on."""
        prob = self.prob[bucket]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total = np.add.reduceat(n, starts).astype(float)
        single = np.add.reduceat(n[:, None] * np.log(prob), starts)
        cost = penalty * np.log(total + 1)
        texts, langs = single.shape
        best = single.argmax(axis=1)
        chosen = np.zeros((texts, langs))
        chosen[np.arange(texts), best] = 1
        level = single.max(axis=1)
        full, bound = _em(owner, prob, n, starts, total, np.ones((texts, langs)))
        # No smaller set can beat the likelihood of all languages.
        order = np.argsort(-full, axis=1, kind="stable")
        left = np.flatnonzero(bound - level > cost)
        for size in range(2, langs + 1):
            if not len(left):
                break
            allowed = np.zeros((len(left), langs))
            np.put_along_axis(allowed, order[left, :size], 1, axis=1)
            rows = np.isin(owner, left)
            renumbered = np.searchsorted(left, owner[rows])
            first = np.flatnonzero(np.r_[True, renumbered[1:] != renumbered[:-1]])
            mix, reached = _em(renumbered, prob[rows], n[rows], first, total[left], allowed)
            better = reached - level[left] > cost[left] * (size - (chosen[left] > 0).sum(axis=1))
            took = left[better]
            chosen[took], level[took] = mix[better], reached[better]
            left = left[bound[left] - level[left] > cost[left]]
        return chosen


def _em(
    owner: np.ndarray, prob: np.ndarray, n: np.ndarray, starts: np.ndarray, total: np.ndarray, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the allowed languages, and the log-likelihood they reach."""
    mix = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = mix[owner] * prob
        part *= (n / part.sum(axis=1))[:, None]
        new = np.add.reduceat(part, starts) / total[:, None]
        moved = np.abs(new - mix).max()
        mix = new
        if moved < TOLERANCE:
            break
    reached = np.add.reduceat(n * np.log((mix[owner] * prob).sum(axis=1)), starts)
    return mix, reached


def fit(docs: DataFrame) -> Model:
    """A model of all labelled rows of `docs`. It has as many columns as there are
    languages, each of `BUCKETS` numbers, and reaches the driver."""
    rows = count_trigrams(docs).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.zeros((BUCKETS, len(langs)))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        n[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    return Model(langs, (n + SMOOTHING) / (n + SMOOTHING).sum(axis=0, keepdims=True))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred` (`und` for null or without letters, or if nothing was
    learned), its proportion as `score`, and all chosen `languages` with theirs."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    kind = "lang_pred string, score double, languages string"

    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.DataFrame:
        m = Model(**sent.value)
        mix = m.mixtures([t or "" for t in texts], _letters())
        rows = []
        for shares in mix:
            order = [int(i) for i in np.argsort(-shares, kind="stable") if shares[i] > 0]
            if not order:
                rows.append(("und", 0.0, ""))
                continue
            named = ",".join(f"{m.langs[i]}:{shares[i]:.4f}" for i in order)
            rows.append((m.langs[order[0]], min(float(shares[order[0]]), 1.0), named))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return docs.withColumn("_l", of(F.col("text"))).select(
        *[c for c in docs.columns if c not in ("lang_pred", "score", "languages")], "_l.*"
    )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages for each row of `docs`; learned from
    text and language of the rows that are not held out."""
    held = in_fold(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~held).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
