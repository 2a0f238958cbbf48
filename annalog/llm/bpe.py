"""Byte-pair encoding and decoding, with long texts encoded in parts.

A long text is cut into halves until the parts are short; the parts are rows, encoded in
parallel, and joined as a tree. At each join a window around it is encoded anew and grows
until it agrees with both sides:

* Words (pre-tokens) are found from left to right, looking at most a few characters
  ahead. A window that begins at a word of the left part and meets a word start of the
  right part has the words of the whole from there on.
* One word may go on over the join for very long. Inside a word, a sequence of tokens is
  the encoding if every two neighbours are; a window whose outer tokens are those of
  either side keeps all pairs right.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = 32_768  # characters of a part of a long text
PARTS_AT_ONCE = 16  # parts whose tokens a task holds together
GROUP = 1_000_000  # characters encoded in one call
MARGIN = 32  # more than a special token or the characters that a word's end depends on
AGREE = 4  # tokens on either side of a window inside a word


@dataclass
class Part:
    """Tokens of a stretch of text: ids, first characters, and whether a word starts."""

    ids: np.ndarray
    at: np.ndarray
    head: np.ndarray

    def cut(self, low: int, high: int) -> Part:
        """Tokens that start in [low, high)."""
        i, j = np.searchsorted(self.at, [low, high])
        return Part(self.ids[i:j], self.at[i:j], self.head[i:j])

    def heads(self) -> np.ndarray:
        return self.at[self.head]


def _joined(*parts: Part) -> Part:
    return Part(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "at", "head")))


# Fixed value: how the byte-level tokenizers cut a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# Characters that `regex` and the tokenizers library hold for the same kind; the versions of
# Unicode they know differ in others, and a text with one of those takes the library's words.
_OTHER = re.compile(
    "[^\\x00-\u0530\u0590-\u0880\u0900-\u0c50\u0d00-\u2080\u20a0-\ua7cd\uac00-\ud7ff\ue000-\U00010700\U0001f000-\U0002b700]"
)

KNOWN_WORDS = 50_000  # words in each of the two halves of a task's memory
WORD_CHARS = 100  # longer words are not remembered


class Words:
    """A value for each word, worked out once while it is remembered. When the newer half of
    the memory is full it becomes the older one, and words in use move over."""

    def __init__(self, work_out):
        self.work_out = work_out
        self.new: dict = {}
        self.old: dict = {}

    def of(self, words: list[str]) -> list:
        out = list(map(self.new.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        for i in missing:
            value = self.old.get(words[i])
            if value is not None:
                self.new[words[i]] = out[i] = value
        rest = [i for i in missing if out[i] is None]
        asked = list({words[i] for i in rest})
        found = dict(zip(asked, self.work_out(asked), strict=True))
        for i in rest:
            out[i] = found[words[i]]
        self.new.update((w, v) for w, v in found.items() if len(w) <= WORD_CHARS)
        if len(self.new) > KNOWN_WORDS:
            self.old, self.new = self.new, {}
        return out


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary: printable ones for themselves,
    the others, in order, from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level tokenizer of the tokenizers library, given as its JSON text."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spec = spec
        self.full = Tokenizer.from_str(spec)
        self.full.no_truncation()
        self.full.no_padding()
        size = self.full.get_vocab_size(with_added_tokens=True)
        self.numbers = [str(i) for i in range(size)]
        self.ints = list(range(size))  # one object for each id, however many words hold it
        letters = _byte_letters()
        self.bytes = [bytes(map(letters.__getitem__, self.full.id_to_token(i))) for i in range(size)]
        self.added = {t.content: i for i, t in self.full.get_added_tokens_decoder().items()}
        self.ranked = self._ranked(spec)
        self.words = Words(self.word_ids)
        self.places = Words(self._word_places)

    @cached_property
    def inner(self):
        """Takes its whole input as one word; few texts need it."""
        from tokenizers import Tokenizer, pre_tokenizers

        inner = Tokenizer.from_str(self.spec)
        inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        inner.encode_special_tokens = True
        return inner

    def word_ids(self, words: list[str]) -> list[tuple[int, ...]]:
        if self.ranked is not None:
            found = map(self.ranked.encode_ordinary, words)
        else:
            found = (e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False))
        return [tuple(map(self.ints.__getitem__, ids)) for ids in found]

    def _word_places(self, words: list[str]) -> list[tuple[tuple, tuple]]:
        """Ids of a word, and the characters in which they start."""
        out = []
        for word, ids in zip(words, self.word_ids(words), strict=True):
            raw = word.encode()
            # Byte b belongs to the character after as many first bytes as stand up to b.
            char = list(accumulate((c & 0xC0) != 0x80 for c in raw))
            at = accumulate((len(self.bytes[i]) for i in ids[:-1]), initial=0)
            out.append((ids, tuple(char[b] - 1 for b in at)))
        return out

    def _ranked(self, spec: str):
        """The same merges as ranks, which encode a word faster; None if the file's ids are not
        in the order of its merges."""
        import tiktoken

        model = json.loads(spec)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in self.added}
        if made != sorted(made) or len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def cut(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        pattern = self.special()
        if pattern is None or not pattern.search(text):
            return WORD.findall(text)
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [*WORD.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + WORD.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        for i, text in enumerate(texts):
            if not _OTHER.search(text):
                words = self.cut(text)
                ids = self.words.of(words)
                if self.added.keys() & set(words):
                    ids = [(self.added[w],) if w in self.added else v for w, v in zip(words, ids, strict=True)]
                out[i] = list(chain.from_iterable(ids))
        rest = [i for i, ids in enumerate(out) if ids is None]
        found = self.full.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            out[i] = e.ids
        return out

    def decode_batch(self, many: list[list[int]]) -> list[str]:
        """Bytes that are no character become U+FFFD, as in the library."""
        return [b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace") for ids in many]

    def digest(self, ids) -> str:
        return hashlib.sha256(",".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest()

    def part(self, text: str, low: int, high: int, word: bool = False) -> Part:
        """text[low:high] encoded by itself; `word`: as one word."""
        piece = text[low:high]
        if not word and not _OTHER.search(piece) and not any(t in piece for t in self.added):
            return self._part_of_words(piece, low)
        codec = self.inner if word else self.full
        e = codec.encode(piece, add_special_tokens=False)
        at = np.array([s for s, _ in e.offsets], dtype=np.int64) + low
        words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
        head = np.ones(len(at), dtype=bool)
        # Words are numbered anew behind a special token, so its neighbours are heads, too.
        head[1:] = (words[1:] != words[:-1]) | (words[1:] == -1)
        special = np.isin(np.array(e.ids, dtype=np.int64), self.special_ids())
        head[1:] |= special[1:] | special[:-1]
        return Part(np.array(e.ids, dtype=np.int64), at, head)

    def _part_of_words(self, piece: str, low: int) -> Part:
        words = WORD.findall(piece)
        found = self.places.of(words)
        sizes = np.fromiter((len(ids) for ids, _ in found), dtype=np.int64, count=len(found))
        n = int(sizes.sum())
        ids = np.fromiter(chain.from_iterable(ids for ids, _ in found), dtype=np.int64, count=n)
        inside = np.fromiter(chain.from_iterable(at for _, at in found), dtype=np.int64, count=n)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths + low
        head = np.zeros(n, dtype=bool)
        head[np.cumsum(sizes) - sizes] = True
        return Part(ids, np.repeat(starts, sizes) + inside, head)

    def special_ids(self) -> np.ndarray:
        return np.array(sorted(self.added.values()), dtype=np.int64)

    def join(self, text: str, left: Part, right: Part, low: int, c: int, high: int) -> Part:
        """The tokens of text[low:high] from those of text[low:c] and text[c:high]."""
        heads = left.heads()
        k = np.searchsorted(heads, c - MARGIN, side="right")
        p = int(heads[k - 1]) if k else low
        same = _word_over(text, self.special(), p, c, high)
        if same:
            # Words up to and after the one that goes over the join are as they are.
            s, e = same
            if c - s > MARGIN and e - c > MARGIN and self._is_word(left, s, c) and self._is_word(right, c, e, high):
                middle = self._inside(text, left.cut(s, c), right.cut(c, e), s, c, e)
                return _joined(left.cut(low, s), middle, right.cut(e, high))
        width = 4 * MARGIN
        while True:
            end = min(high, c + width)
            window = self.part(text, p, end)
            shared = np.intersect1d(window.heads(), right.heads())
            shared = shared[(shared > c) & (shared <= end - MARGIN)]
            if len(shared):
                q = int(shared[0])
                return _joined(left.cut(low, p), window.cut(p, q), right.cut(q, high))
            if end == high:
                return _joined(left.cut(low, p), window)
            width *= 2

    def special(self) -> re.Pattern | None:
        return re.compile("|".join(map(re.escape, self.added))) if self.added else None

    @staticmethod
    def _is_word(part: Part, low: int, high: int, end: int | None = None) -> bool:
        """[low, high) is one word of the part, and the part has a word start at its end."""
        heads = part.heads()
        inside = heads[(heads >= low) & (heads < high)]
        return len(inside) == 1 and inside[0] == low and (end is None or high == end or high in heads)

    def _inside(self, text: str, left: Part, right: Part, low: int, c: int, high: int) -> Part:
        """The tokens of one word from those of its two halves."""
        n = 8
        while True:
            i = max(0, len(left.ids) - n)
            j = min(len(right.ids), n)
            # Windows begin and end where a character does.
            while i and left.at[i] == left.at[i - 1]:
                i -= 1
            while j < len(right.ids) and right.at[j] == right.at[j - 1]:
                j += 1
            s = int(left.at[i]) if i else low
            e = int(right.at[j]) if j < len(right.ids) else high
            window = self.part(text, s, e, word=True)
            window.head[0] = s == low
            a, b = window.ids, AGREE
            starts = i == 0 or (len(a) > b and (a[:b] == left.ids[i : i + b]).all())
            ends = j == len(right.ids) or (len(a) > b and (a[-b:] == right.ids[j - b : j]).all())
            if starts and ends:
                tail = Part(right.ids[j:], right.at[j:], np.zeros(len(right.ids) - j, dtype=bool))
                return _joined(Part(left.ids[:i], left.at[:i], left.head[:i]), window, tail)
            n *= 2

    def tree(self, text: str, parts: list[tuple[int, int, Part]]) -> Part:
        """Joins neighbouring parts (low, high, tokens) until one is left."""
        while len(parts) > 1:
            pairs = zip(parts[::2], parts[1::2], strict=False)
            up = [(a, d, self.join(text, x, y, a, b, d)) for (a, b, x), (_, d, y) in pairs]
            parts = up + parts[len(up) * 2 :]
        return parts[0][2]


def _word_over(text: str, special: re.Pattern | None, p: int, c: int, high: int) -> tuple[int, int] | None:
    """A run of letters, of numbers or of other marks, with the blank before it, that goes
    over c, if there is one; the parts' own words then confirm that it is a word."""
    for kind in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"):
        if not regex.fullmatch(kind * 2, text[c - 1 : c + 1]):
            continue
        end = regex.compile(kind + "+").match(text, c, high).end()
        start = c
        while start > p:
            chunk = text[max(p, start - 1024) : start]
            run = len(regex.search(f"(?:{kind})*$", chunk).group())
            start -= run
            if run < len(chunk):
                break
        if start > p and text[start - 1] == " ":
            start -= 1
        if special is not None and special.search(text, max(p, start - MARGIN), min(high, end + MARGIN)):
            return None
        return start, end
    return None


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _cut(rows: DataFrame, part: int) -> DataFrame:
    """Each text as halves of halves, until none is longer than `part`: low, high, piece."""
    length = F.char_length("text")
    n = F.pow(2, F.ceil(F.log2(length / part))).cast("long")
    edges = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    edges = edges.withColumns({"low": F.expr("0L") + F.floor(length * F.col("i") / n), "n": n})
    edges = edges.withColumn("high", F.floor(length * (F.col("i") + 1) / F.col("n")))
    piece = F.substring(F.col("text"), F.col("low") + 1, F.col("high") - F.col("low"))
    return edges.withColumn("piece", piece).drop("text", "i", "n")


def _with_tokens(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [codec.part(t, 0, len(t)) for t in batch.column("piece").to_pylist()]
    arrays = [
        pa.array([f.ids.astype(np.int32) for f in found], pa.list_(pa.int32())),
        pa.array([f.at.astype(np.int32) for f in found], pa.list_(pa.int32())),
        pa.array([f.head for f in found], pa.list_(pa.bool_())),
    ]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "ids", "at", "head"])


def _encoded(docs: DataFrame, spec: str, part: int, schema: str, use) -> DataFrame:
    """doc_id and `use(codec, list of ids)`, rows of `schema`, for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    names = [f.split()[0] for f in schema.split(", ")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf(schema)
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(sent.value)
        for texts in batches:
            out = [row for group in _groups(list(texts)) for row in use(codec, codec.encode_batch(group))]
            yield pd.DataFrame(out, columns=names)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, PARTS_AT_ONCE):
                yield _with_tokens(codec, batch.slice(i, PARTS_AT_ONCE))

    kept: dict[str, Codec] = {}  # one a task

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        if not kept:
            kept["codec"] = Codec(sent.value)
        codec = kept["codec"]
        parts = parts.sort_values("low")
        tokens = []
        for low, piece, ids, at, head in parts[["low", "piece", "ids", "at", "head"]].itertuples(index=False):
            tokens.append((low, low + len(piece), Part(np.asarray(ids, "int64"), np.asarray(at, "int64") + low, np.asarray(head))))
        ids = codec.tree("".join(parts["piece"]), tokens).ids.tolist()
        out = pd.DataFrame(use(codec, [ids]), columns=names)
        out.insert(0, "doc_id", parts["doc_id"].to_numpy()[:1])
        return out

    is_long = F.char_length("text") > part
    done = rows.where(~is_long).select("doc_id", short(F.col("text")).alias("t")).select("doc_id", "t.*")
    # Rows may share an id or have none, so the parts of a row are held together by its number.
    numbered = rows.where(is_long).withColumn("row", F.monotonically_increasing_id())
    parts = _cut(numbered, part).select("doc_id", "row", "low", "piece").repartition("row", "low")
    encoded = StructType([*parts.schema, *StructType.fromDDL("ids array<int>, at array<int>, head array<boolean>")])
    tokens = parts.mapInArrow(encode_parts, encoded)
    out_schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(schema)])
    joined = tokens.groupBy("row").applyInPandas(whole, out_schema)
    return done.unionByName(joined)


def encode(docs: DataFrame, spec: str, part: int = PART) -> DataFrame:
    """doc_id and `ids` of each row's text; see `round_trip` for the cases."""
    return _encoded(docs, spec, part, "ids array<int>", lambda codec, many: [(ids,) for ids in many])


def decode(tokens: DataFrame, spec: str) -> DataFrame:
    """`tokens` with `text`, decoded from its column `ids`; null ids give null."""
    sent = tokens.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(sent.value)
        for ids in batches:
            yield pd.Series([None if i is None else codec.decode_batch([list(i)])[0] for i in ids], dtype=object)

    return tokens.withColumn("text", text(F.col("ids")))


def _digests(codec: Codec, many: list[list[int]]) -> list[tuple]:
    texts = codec.decode_batch(many)
    return [
        (len(ids), codec.digest(ids), hashlib.sha256(t.encode()).hexdigest())
        for ids, t in zip(many, texts, strict=True)
    ]


def round_trip(docs: DataFrame, spec: str, part: int = PART) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each
    row; null counts as empty, repeated rows and null ids stay, other columns are not read.

    A text of up to `part` characters is encoded where it is read. A longer one is cut
    into parts that are shuffled, encoded by themselves and joined as a tree."""
    return _encoded(docs, spec, part, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def load(path: str) -> str:
    """The JSON text of a tokenizer file, read on the driver and sent with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()
