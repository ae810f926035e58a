"""Byte-level BPE with a public vocabulary file: encode by a queue of merges, decode by joining vocabulary bytes.

A pre-token is a doubly linked list of symbols. The queue holds (rank, place) of every adjacent pair that has a
merge; the least is taken, an entry whose pair is gone is stale and skipped, and a merge queues the two new
pairs at its sides. Pre-tokens seen often are kept in a bounded store of two generations.

Defined cases. Null text: empty, no ids. Added tokens of the file (such as <|endoftext|>) are single ids wherever
their string stands. A run without a split, however long, is one pre-token, n log n in its bytes. Every row is
encoded on its own, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

#: The public pattern of byte-level BPE pre-tokens (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
KEPT = 150_000  # pre-tokens of one generation of the store, of KEPT_SIZE characters at most
KEPT_SIZE = 24


def public_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> list[str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = {c: b for b, c in enumerate(_letters())}
        vocab: dict[str, int] = file["model"]["vocab"]
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.letter = [vocab[c] for c in _letters()]
        #: left id and right id to (rank, id of the merge), all packed
        self.merge: dict[int, int] = {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            self.merge.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, word: str) -> tuple[int, ...]:
        letter, merge = self.letter, self.merge
        ids = [letter[b] for b in word.encode()]
        n = len(ids)
        if n == 1:
            return (ids[0],)
        queue = []
        for i in range(n - 1):
            m = merge.get(ids[i] << 20 | ids[i + 1])
            if m is not None:
                queue.append((m >> 20) << 32 | i)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            x = heappop(queue)
            i = x & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merge.get(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != x >> 32:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = m & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merge.get(ids[i] << 20 | ids[k])
                if m is not None:
                    heappush(queue, (m >> 20) << 32 | i)
            h = before[i]
            if h >= 0:
                m = merge.get(ids[h] << 20 | ids[i])
                if m is not None:
                    heappush(queue, (m >> 20) << 32 | h)
        return tuple([i for i in ids if i >= 0])

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token, four bytes each."""
        ids = self.old.get(word)
        if ids is None:
            ids = array("i", self.merged(word)).tobytes()
        if len(word) <= KEPT_SIZE:
            if len(self.new) >= KEPT:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if self.split is not None and any(t in text for t in self.added):
            parts = (array("i", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(self.split(text)))
            return b"".join(parts)
        return self._plain(text)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def _plain(self, text: str) -> bytes:
        known, word = self.new.get, self._word
        return b"".join([known(w) or word(w) for w in self.find(text)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(c: Codec, texts: list[str]) -> tuple[pa.Array, list[str]]:
    """The ids of texts as a list column, and what decoding them gives."""
    blobs = [c.encode_bytes(t) for t in texts]
    ids = np.frombuffer(b"".join(blobs), dtype=np.int32)
    edges = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)), [c.decode(array("i", b).tolist()) for b in blobs]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row. path: the vocabulary file on every machine; None: the public one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_file())
        for batch in slices(batches, most=2 << 20):
            ids, decoded = _encoded(c, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def with_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids and round_trip (decoding the ids gives the text, a null being empty) of its column text.

    Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "ids", "round_trip")
    names = docs.columns
    at = names.index("text")
    added = ["n_tokens", "ids", "round_trip"]
    schema = docs.select("*", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_file())
        for batch in slices(batches, most=2 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids, decoded = _encoded(c, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(np.asarray(ids.offsets)).astype(np.int64)), ids, pa.array([x == t for x, t in zip(decoded, texts)])], names=[*names, *added])

    return docs.mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(documents(spark, sf_dir))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
