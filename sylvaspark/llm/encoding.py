"""Token ids of texts by a public byte-pair tokenizer, exact and in linear time.

The encoder takes the longest token at each place (Aho-Corasick automaton over the vocabulary) and goes back whenever a pair of neighbours could not have come out of the merges; which pairs can is kept in a table. Ids come out as the merge rules give them. Decoding copies slices of one byte string by an offset table."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sylvaspark.common import spread, table

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k cuts text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in each worker: a bound on memory, not on what is encoded.
CACHED = 200_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for b, i in pairs:
        tokens[int(i)] = base64.b64decode(b)
    return tokens


def split_table(tokens: list[bytes]) -> list[tuple[int, int]]:
    """For each token the two tokens that its merge joins; single bytes have themselves twice."""
    ranks = {t: i for i, t in enumerate(tokens)}
    out = []
    for i, t in enumerate(tokens):
        parts = [bytes([b]) for b in t]
        while len(parts) > 2:
            r, k = min((ranks.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if r >= i:
                raise ValueError(f"token {i} does not come out of merges")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out.append((ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (i, i))
    return out


class Encoder:
    """`tables`: token bytes by id, and their splits."""

    def __init__(self, tokens: list[bytes], splits: list[tuple[int, int]], pattern: str = PATTERN):
        import ahocorasick

        self.tokens, self.splits = tokens, splits
        self.merged = {p: i for i, p in enumerate(splits) if p[0] != i}
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pattern = regex.compile(pattern)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.blob = b"".join(tokens)

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if (found := self.shorter.get(token)) is None:
            text = self.tokens[token].decode("latin-1")
            found = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, run over both tokens' bytes together, leave exactly these two."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit = left, right, len(self.tokens)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                good = False
                break
            # undo the later of the two merges next to the seam; what crosses it earlier would have come first
            can_a, can_b = self.splits[a][0] != a, self.splits[b][0] != b
            if can_a and (a > b or not can_b):
                limit, a = a, self.splits[a][1]
            elif can_b:
                limit, b = b + 1, self.splits[b][0]
            else:
                good = True
                break
        self.fits[left, right] = good
        return good

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        known = self.words.get(word)
        if known is not None:
            return known
        text = word.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            found = [whole]
        else:
            found = self.search(text)
        if len(self.words) >= CACHED:
            self.words.clear()
        if len(word) < 200:
            self.words[word] = found
        return found

    def search(self, text: str) -> list[int]:
        longest, size, fits = self.automaton.iter_long, self.size, self.fits
        open_ = bytearray(b"\x01") * (len(text) + 1)  # places where a token may still end
        out: list[int] = []
        at, n = 0, len(text)
        token = next(longest(text))[1]
        while True:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if open_[end]:
                    good = last < 0
                    if not good:
                        good = fits.get((last, token))
                        if good is None:
                            good = self.compatible(last, token)
                    if good:
                        out.append(token)
                        at = end
                        if at == n:
                            return out
                        token = next(longest(text, at))[1]
                        break
                token = self.prefix(token)
                if token < 0:
                    open_[at] = 0
                    out.pop()
                    at -= size[last]
                    token = last
                    break

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for w in self.pattern.findall(text):
            out += self.word(w)
        return out

    def decode(self, ids) -> str:
        o = self.offsets
        return b"".join(self.blob[o[i] : o[i + 1]] for i in ids).decode("utf-8")


def tables(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """Vocabulary and splits of a tokenizer as a broadcast of fixed size."""
    kept = spark.__dict__.setdefault("_encoders", {})
    if (name, folder) not in kept:
        tokens = load_ranks(os.path.join(folder, f"{name}.tiktoken"))
        kept[name, folder] = spark.sparkContext.broadcast((tokens, split_table(tokens)))
    return kept[name, folder]


_made: dict[tuple[str, str], Encoder] = {}


def encoder(shared, name: str, folder: str) -> Encoder:
    """The worker's encoder, built once from the broadcast."""
    if (name, folder) not in _made:
        _made[name, folder] = Encoder(*shared.value)
    return _made[name, folder]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, lengths_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with `lengths_only`. Null and empty texts have an empty list and length 0; no special token is added or recognised. Rows are kept as they are, repeated ones too; other columns are not read."""
    shared = tables(df.sparkSession, name, folder)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared, name, folder)
        for b in batches:
            values: list[int] = []
            ends = [0]
            start = 0
            texts = b.column(1)
            for i in range(b.num_rows):
                values += e.encode(texts[i].as_py())
                ends.append(len(values))
                if len(values) > 2_000_000 or i == b.num_rows - 1:
                    keys = b.column(0).slice(start, i + 1 - start)
                    if lengths_only:
                        made = pa.array(np.diff(ends).astype("int64"))
                    else:
                        made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, made], names=[key, "n_tokens" if lengths_only else "ids"])
                    values, ends, start = [], [0], i + 1

    out = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()) if lengths_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, text)).mapInArrow(run, out)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of every row of ids; an empty or null list gives ''."""
    shared = tables(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared, name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, T.StructType([df.schema[key], T.StructField("text", T.StringType())]))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
