"""Byte-level BPE by chunks: where a text may be cut, and codes kept per distinct chunk.

The pre-tokeniser's pattern never joins what stands on both sides of a single
space or newline between two other characters, so a text's ids are the ids of
such chunks, one after the other. Each distinct chunk is encoded once per
generation of the cache; which chunks are kept changes the speed, never a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_MARK = r"[^\s\p{L}\p{N}\p{Z}\x{85}\x{1c}-\x{1f}]"
#: Texts that are not cut at each space and newline: white space beside one, one at the end, or the byte that marks the cuts.
_UNEVEN = rf"[ \n]{_SPACE}|{_SPACE}[ \n]|[ \n]\z|\x01"
#: Texts that are not cut before each full stop and comma as well: those above, and others with a mark or white space before one.
_UNEVEN_STOPS = rf"{_UNEVEN}|{_MARK}[.,]|{_SPACE}[.,]"
#: Pieces that are gathered together.
GATHERED = 1 << 16


def cuts_hold(tokenizer: dict) -> bool:
    """Whether a tokenizer's file has the pre-tokeniser that the cuts are made for: byte-level with its pattern, nothing normalised or put before, and added tokens that take no white space."""
    before = tokenizer.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = tokenizer.get("added_tokens") or []
    bare = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) and not re.search(r"[\s.,]", t["content"]) for t in added)
    return bool(plain and bare and not tokenizer.get("normalizer") and tokenizer["model"].get("type", "BPE") == "BPE")


def chunks(text: str) -> list[str]:
    """The text cut before each single space or newline that has no white space beside it."""
    return _CUT.split(text) if text else []


def gather(pool: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a pool of pieces of these lengths, in the order of index; and where each ends."""
    starts = np.cumsum(lengths) - lengths
    ends = np.cumsum(lengths[index])
    out = np.empty(int(ends[-1]) if len(ends) else 0, pool.dtype)
    at = 0
    for first in range(0, len(index), GATHERED):
        some = index[first : first + GATHERED]
        count = lengths[some]
        own = np.cumsum(count)
        to = at + int(own[-1])
        out[at:to] = pool[np.repeat(starts[some] - (own - count), count) + np.arange(to - at)]
        at = to
    return out, ends


class CodeCache:
    """Codes of keys, in two generations of about `bound` bytes (as Python holds them); encode gets the distinct keys that are not known."""

    #: What a key and its code take besides their own characters.
    ENTRY = 180

    def __init__(self, encode: Callable[[list], list[bytes]], bound: int):
        self.encode, self.bound = encode, bound
        self.forget()

    def forget(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def of(self, distinct: list) -> list[bytes]:
        """The code of each key."""
        if self.size > self.bound:
            self.old, self.young, self.size = self.young, {}, 0
        out = list(map(self.young.get, distinct))
        places = [k for k, code in enumerate(out) if code is None]
        if places and self.old:
            for k in places:
                if (code := self.old.get(distinct[k])) is not None:
                    out[k] = self.young[distinct[k]] = code
                    self.size += len(distinct[k]) + len(code) + self.ENTRY
            places = [k for k in places if out[k] is None]
        if places:
            new = [distinct[k] for k in places]
            for k, code in zip(places, codes := self.encode(new), strict=True):
                out[k] = code
            self.young.update(zip(new, codes, strict=True))
            self.size += sum(map(len, new)) + sum(map(len, codes)) + self.ENTRY * len(new)
        return out


class ChunkCodes:
    """Ids (unsigned 32-bit integers) of texts; encode gives the ids of distinct chunks (of whole texts, if they may not be cut) as little-endian bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bound: int, cut: bool = True):
        self.cache, self.cut = CodeCache(encode, bound), cut

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts (null: none), one text after the other; and the places where texts begin, with the end.

        Most texts can also be cut before full stops and commas, which leaves
        fewer distinct chunks; those that can't be cut in either way go one by one.
        """
        column = pc.fill_null(column, "")
        parts: list[np.ndarray] = [np.empty(0, "<u4")] * len(column)
        if not self.cut:
            parts = [np.frombuffer(code, "<u4") for code in self.cache.encode(column.to_pylist())]
            return np.concatenate([np.empty(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])
        rest = np.arange(len(column))
        for pattern, stops in ((_UNEVEN_STOPS, True), (_UNEVEN, False)):
            texts = column.take(pa.array(rest)) if len(rest) < len(column) else column
            uneven = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
            if not uneven.any() and len(rest) == len(column):
                return self._even(texts, stops)
            if not uneven.all():
                flat, bounds = self._even(texts.filter(pa.array(~uneven)), stops)
                for k, x, y in zip(rest[~uneven].tolist(), bounds, bounds[1:], strict=False):
                    parts[k] = flat[x:y]
            rest = rest[uneven]
        for k in rest.tolist():
            own = chunks(column[k].as_py())
            distinct = list(dict.fromkeys(own))
            codes = dict(zip(distinct, self.cache.of(distinct), strict=True))
            parts[k] = np.frombuffer(b"".join([codes[c] for c in own]), "<u4")
        return np.concatenate([np.empty(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])

    def _even(self, column: pa.Array, stops: bool) -> tuple[np.ndarray, np.ndarray]:
        """For texts that are cut at each such place: the distinct chunks alone become Python objects."""
        for mark in (" ", "\n", *(".,") * stops):
            column = pc.replace_substring(column, mark, "\x01" + mark)
        cut = pc.split_pattern(column, "\x01")
        keys = cut.flatten().dictionary_encode()
        codes = self.cache.of(keys.dictionary.to_pylist())
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        flat, ends = gather(np.frombuffer(b"".join(codes), "<u4"), lengths, keys.indices.to_numpy())
        offsets = cut.offsets.to_numpy()
        return flat, np.r_[0, ends][offsets - offsets[0]]
