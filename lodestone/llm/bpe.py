"""BPE encoding and decoding by a pair occurrence index.

All words that a batch of documents brings are laid out in one array of symbols.
An index maps the rank of each mergeable pair to all positions where the pair
stands. Active ranks are taken in ascending order; all positions of a rank are
merged at once, and the pairs that the merges make enter the lists of their
ranks. Words are independent and a merge only makes pairs of higher rank, so the
result is that of merging each word by itself, lowest rank first.

Defined results: null and empty texts have no ids (digest of the empty string,
decoded to the empty text); repeated rows give repeated rows; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, slices, tuned
from .word_codes import ChunkCodes, CodeCache, cuts_hold

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts that are encoded together, and bytes of chunks and of words whose codes a worker keeps (twice as much of chunks, in two generations).
SLICE_BYTES, CHUNK_BYTES, WORD_BYTES = 6 << 20, 12 << 20, 8 << 20
#: Positions that enter the index together.
ENTERED = 1 << 15


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        if not cuts_hold(data) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        vocabulary: dict[str, int] = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocabulary[c] for c in alphabet], np.int64)
        left, right, made = (np.array([vocabulary[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.left, self.right, self.made = left, right, made
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        byte_of = {c: b for b, c in enumerate(alphabet)}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, at in vocabulary.items():
            self.token_bytes[at] = bytes(byte_of[c] for c in token)
        for token, at in self.special.items():
            self.token_bytes[at] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.words = CodeCache(lambda words: self.merge([w.encode() for w in words]), WORD_BYTES)
        self.codes = ChunkCodes(self.encode_chunks, CHUNK_BYTES)

    def encode_chunks(self, distinct: list[str]) -> list[bytes]:
        """A code for each chunk."""
        special: dict[str, bytes] = {}
        parts: list[list[str]] = []
        for chunk in distinct:
            if self.special_pattern and self.special_pattern.search(chunk):
                words = []
                for k, piece in enumerate(self.special_pattern.split(chunk)):
                    if k % 2:
                        special[piece] = np.array([self.special[piece]], "<u4").tobytes()
                        words.append(piece)
                    else:
                        words += self.pattern.findall(piece)
            else:
                words = self.pattern.findall(chunk)
            parts.append(words)
        plain = list(dict.fromkeys(w for p in parts for w in p if w not in special))
        known = dict(zip(plain, self.words.of(plain), strict=True)) | special
        return [b"".join([known[w] for w in p]) for p in parts]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The code of each word (not empty), by the pair occurrence index over all of them."""
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = int(ends[-1])
        kind = np.dtype(np.int32 if n < 1 << 31 else np.int64)
        symbol = self.byte_id.astype(kind)[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        after[ends - 1] = -1
        before[np.r_[0, ends[:-1]]] = -1
        alive = np.ones(n, bool)
        index: dict[int, array] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Enters the pairs whose left parts stand there."""
            for first in range(0, len(at), ENTERED):
                some = at[first : first + ENTERED]
                key = symbol[some].astype(np.int64) << 32 | symbol[after[some]]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                is_pair = self.keys[found] == key
                for rank, position in zip(self.ranks[found[is_pair]].tolist(), some[is_pair].tolist(), strict=True):
                    if (positions := index.get(rank)) is None:
                        index[rank] = array(kind.char, (position,))
                        heappush(active, rank)
                    else:
                        positions.append(position)

        enter(np.flatnonzero(after >= 0))
        heapify(active)
        while active:
            rank = heappop(active)
            a, b = self.left[rank], self.right[rank]
            at = np.unique(np.frombuffer(index.pop(rank), kind))
            then = after[at]
            stands = alive[at] & (symbol[at] == a) & (then >= 0) & (symbol[then] == b)
            at, then = at[stands], then[stands]
            if a == b and len(at) > 1:
                last, keep = -1, []
                for k, (x, y) in enumerate(zip(at.tolist(), then.tolist(), strict=True)):
                    if x != last:
                        keep.append(k)
                        last = y
                at, then = at[keep], then[keep]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            alive[then] = False
            beyond = after[then]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            previous = before[at]
            enter(np.unique(np.r_[previous[previous >= 0], at[inside]]))
        kept = np.flatnonzero(alive)
        code = symbol[kept].astype("<u4").tobytes()
        cuts = (np.searchsorted(kept, ends) * 4).tolist()
        return [code[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]

    def forget(self) -> None:
        """Empties the caches; the vocabulary stays."""
        self.words.forget()
        self.codes.cache.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, bounds = self.codes.of(pa.array(texts, pa.string()))
        return [flat[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PairIndexBpe:
    """One per Python worker."""
    return PairIndexBpe(path)


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""
    source = tuned(docs).select(F.col(id_col), F.col(text_col))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(vocabulary_path)
        at_work("bpe", model.forget)
        for batch in slices(batches, SLICE_BYTES, 1):
            flat, bounds = model.codes.of(batch.column(1))
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return source.mapInArrow(encode, f"id {source.schema[0].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids."""
    source = tuned(encoded).select(F.col(id_col), F.col(ids_col))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(vocabulary_path)
        at_work("bpe", model.forget)
        for batch in batches:
            texts = [model.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(decode, f"id {source.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and its ids decoded again.

    One pass without a shuffle; the ids stay in the worker, as only digests of
    both forms are asked for.
    """
    source = tuned(docs).select(F.col(id_col), F.col(text_col))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(vocabulary_path)
        at_work("bpe", model.forget)
        for batch in slices(batches, SLICE_BYTES, 1):
            counts, encoded, decoded = [], [], []
            flat, bounds = model.codes.of(batch.column(1))
            for x, y in zip(bounds, bounds[1:], strict=False):
                ids = flat[x:y].tolist()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(model.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {source.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(digest, schema).withColumnRenamed("id", id_col)
