"""Quality rules: counts of words, lines and symbols, and repetition by suffix arrays.

The words of many texts make one array, whose suffixes are sorted by prefix
doubling; only suffixes that still tie are sorted again, and those of different
texts never tie, as a text's number is part of its first ranks. Common prefixes of
neighbours come from the irreducible ones (Kaerkkaeinen, Manzini and Puglisi,
2009): where the words before two neighbours are equal, a prefix is one shorter
than the one a word earlier. Intervals of common prefixes that can't be extended
to the left are the maximal repeats; the union of their spans and the longest of
them decide.

That union is the union of each word's longest repeat that begins there: what can
be extended lies inside what it is extended to.

Results for hard inputs: a null text is empty and has no words, so it fails the
base rules; equal rows have equal results; a text's length is bounded by memory
only (some 100 bytes a word). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_work, slices, tuned

#: Bytes of texts that are taken up together.
SLICE_BYTES = 2 << 20
#: Base rules: the least words, words of a window, and the most words in repeated windows, in percent.
LEAST_WORDS, WINDOW, MOST_REPEAT_PERCENT = 50, 3, 50
#: Words of a repeat that counts; the most words that such repeats may cover, and the longest may have, in percent of a text's words.
LEAST_REPEAT, MOST_COVERED_PERCENT, MOST_LONGEST_PERCENT = 10, 30, 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass
class Words:
    """The words of texts by number, the text of each, and where each text's words begin (with the end); counts by text."""

    ids: np.ndarray
    text: np.ndarray
    bounds: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray


def _pieces(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the strings that begin at starts and have the bytes that are inside, equal ones alike."""
    before = np.r_[0, np.cumsum(inside, dtype=np.int32)].astype(np.int32)
    bounds = np.r_[before[starts], before[-1]]
    strings = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw[inside].tobytes())])
    return strings.dictionary_encode().indices.to_numpy()


def words_of(texts: pa.Array) -> Words:
    """texts: an array of strings without nulls."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data.slice(offsets[0], offsets[-1] - offsets[0]), np.uint8) if data and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]

    def by_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][offsets])

    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # a text of k newlines has k + 1 lines
    newlines = np.flatnonzero(raw == 10)
    lines = np.concatenate([offsets[:-1], newlines + 1])
    line_text = np.concatenate([np.arange(len(texts)), np.searchsorted(offsets, newlines, "right") - 1])
    order = np.lexsort((lines, line_text))
    lines, line_text = lines[order], line_text[order]
    kind = _pieces(raw, raw != 10, lines)
    has = np.diff(np.r_[0, np.cumsum(begins, dtype=np.int64)][np.r_[lines, len(raw)]]) > 0
    kinds = int(kind.max(initial=0)) + 1
    distinct = np.bincount(np.unique(line_text[has].astype(np.int64) * kinds + kind[has]) // kinds, minlength=len(texts))
    dup_lines = np.bincount(line_text[has], minlength=len(texts)) - distinct
    return Words(_pieces(raw, inside, starts), text, bounds, by_text(inside & (raw & 0xC0 != 0x80)), by_text(_SYMBOL[raw]), dup_lines)


def suffix_array(ids: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): the suffixes of all texts in order, text by text, and where suffixes with one text and first word begin among them."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, rank, counts = np.unique(text.astype(np.int64) * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    several, starts = counts[rank] > 1, np.cumsum(counts) - counts
    rank = starts[rank]
    first = rank.copy()
    active = np.flatnonzero(several)
    ends = bounds[1:]
    h = 1
    while len(active):
        after = active + h
        second = np.where(after < ends[text[active]], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        part = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = old + part - group
        alone = new & np.r_[new[1:], True]
        active = np.sort(active[~alone])
        h *= 2
    places = np.empty(n, np.int64)
    places[rank] = np.arange(n)
    return places, first[places]


def _agreement(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b on, at most `most`: word by word for all pairs at first, then in blocks for those that go on."""
    out = np.zeros(len(a), np.int64)
    todo = np.flatnonzero(most > 0)
    for step in range(64):
        if not len(todo):
            return out
        todo = todo[ids[a[todo] + step] == ids[b[todo] + step]]
        out[todo] += 1
        todo = todo[most[todo] > step + 1]
    for k in todo.tolist():
        done, size, top = int(out[k]), 256, int(most[k])
        while done < top:
            size = min(2 * size, 1 << 16, top - done)
            differ = ids[a[k] + done : a[k] + done + size] != ids[b[k] + done : b[k] + done + size]
            where = int(differ.argmax())
            if differ[where]:
                done += where
                break
            done += size
        out[k] = done
    return out


def common_prefixes(words: Words, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, turns): of each suffix the words in common with the one before it in order, and whether the words before the two differ."""
    n = len(places)
    lcp, turns = np.zeros(n, np.int64), np.ones(n, bool)
    if n < 2:
        return lcp, turns
    b, a = places[1:], places[:-1]
    same = first[1:] == first[:-1]
    begin = words.bounds[:-1][words.text]
    inner = same & (b > begin[b]) & (a > begin[a])
    turns[1:] = ~(inner & (words.ids[b - 1] == words.ids[a - 1]))
    ends = words.bounds[1:]
    direct = np.flatnonzero(turns[1:] & same)
    own = np.zeros(n, np.int64)  # by place
    own[b[direct]] = _agreement(words.ids, a[direct], b[direct], ends[words.text[b[direct]]] - np.maximum(a[direct], b[direct]))
    reducible = np.zeros(n, bool)
    reducible[b[~turns[1:]]] = True
    at = np.arange(n)
    base = np.maximum.accumulate(np.where(reducible, 0, at))
    lcp[1:] = (own[base] - (at - base))[b] * same
    return lcp, turns


def covered(places: np.ndarray, lcp: np.ndarray, least: int, cap: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of `least` words or more; cap: of a repeat's words only so many count."""
    n = len(places)
    reach = np.zeros(n + 1, np.int64)
    reach[places] = np.maximum(lcp, np.r_[lcp[1:], 0]) if n else 0
    at = np.flatnonzero(reach >= least)
    steps = np.bincount(at, minlength=n + 1) - np.bincount(at + (reach[at] if cap is None else cap), minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0


def maximal_repeats(places: np.ndarray, lcp: np.ndarray, turns: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, length, count): the intervals of common prefixes of `least` words or more that are extended neither to the right nor to the left; place is where the first of them in order begins."""
    before = np.cumsum(turns)
    out: list[tuple[int, int, int]] = []
    long_ = np.flatnonzero(lcp >= least)
    if not len(long_):
        return out
    firsts = long_[np.r_[True, np.diff(long_) > 1]].tolist()
    lasts = long_[np.r_[np.diff(long_) > 1, True]].tolist()
    for s, e in zip(firsts, lasts, strict=True):
        open_: list[tuple[int, int]] = []
        for r, now in zip(range(s, e + 2), [*lcp[s : e + 1].tolist(), 0], strict=True):
            low = r - 1
            while open_ and open_[-1][1] > now:
                low, length = open_.pop()
                if before[r - 1] > before[low]:
                    out.append((int(places[low]), length, r - low))
            if now and (not open_ or open_[-1][1] < now):
                open_.append((low, now))
    return out


def _checked(texts: pa.Array, least: int) -> tuple[dict[str, np.ndarray], Words, list[tuple[int, int, int]]]:
    """By text: the base counts, words covered by repeats, the longest repeat; the words; the maximal repeats."""
    w = words_of(texts)
    places, first = suffix_array(w.ids, w.text, w.bounds)
    lcp, turns = common_prefixes(w, places, first)
    count = lambda marks: np.bincount(w.text[marks], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, w.text[places], np.where(lcp >= least, lcp, 0))
    out = {
        "n_words": np.diff(w.bounds),
        "word_chars": w.chars,
        "n_symbols": w.symbols,
        "n_dup_lines": w.dup_lines,
        "n_repeat_words": count(covered(places, lcp, WINDOW, WINDOW)),
        "covered_words": count(covered(places, lcp, least)),
        "longest_repeat": longest,
    }
    return out, w, maximal_repeats(places, lcp, turns, least)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_REPEAT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, n_repeats): counts, all long.

    covered_words: in repeats of `least` words or more, all their occurrences;
    longest_repeat: 0 without such; n_repeats: how many of them are maximal.
    """
    source = tuned(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).alias("_id"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats"]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("quality rules")
        for batch in slices(batches, SLICE_BYTES):
            counts, w, repeats = _checked(batch.column(0), least)
            counts["n_repeats"] = np.bincount(w.text[np.array([p for p, _, _ in repeats], np.int64)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(counts[c], pa.int64()) for c in names)], ["_id", *names])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(measure, f"_id {kind}, " + ", ".join(f"{c} long" for c in names)).withColumnRenamed("_id", id_col)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_REPEAT) -> DataFrame:
    """(id, repeats): of each text its maximal repeats of `least` words or more, as (start, length, count) in words, longest first; start is one of its places."""
    source = tuned(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).alias("_id"))
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("count", pa.int64())])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("quality rules")
        for batch in slices(batches, SLICE_BYTES):
            _, w, found = _checked(batch.column(0), least)
            own: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for place, length, n in sorted(found, key=lambda x: (-x[1], x[0])):
                k = int(w.text[place])
                own[k].append({"start": place - int(w.bounds[k]), "length": length, "count": n})
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(entry))], ["_id", "repeats"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(find, f"_id {kind}, repeats array<struct<start: long, length: long, count: long>>").withColumnRenamed("_id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT_PERCENT)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured, with base_failed and kept: kept pass the base rules, and neither the words in repeats nor the longest repeat are too large a part of the text."""
    rows = measured(docs, id_col, text_col).withColumn("base_failed", base_failed())
    repeats_much = (F.col("covered_words") * 100 > F.col("n_words") * MOST_COVERED_PERCENT) | (F.col("longest_repeat") * 100 > F.col("n_words") * MOST_LONGEST_PERCENT)
    return rows.withColumn("kept", ~F.col("base_failed") & ~repeats_much)


def judged_sql() -> str:
    """DuckDB's SQL for the rows of judged, without longest_repeat and n_repeats: a repeat longer than the limit is a window of that many words that is there twice."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT rid, doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    greatest({LEAST_REPEAT}, len(w) * {MOST_LONGEST_PERCENT} // 100 + 1) AS beyond
  FROM (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)),
windows AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, n_words - size + 2)) AS i FROM (SELECT rid, w, n_words, unnest(list_distinct([{WINDOW}, {LEAST_REPEAT}, beyond])) AS size FROM base) WHERE n_words >= size)),
twice AS (SELECT rid, size, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, size, gram) > 1),
inside AS (SELECT DISTINCT rid, size, unnest(range(i, i + size)) AS place FROM twice WHERE size IN ({WINDOW}, {LEAST_REPEAT})),
counts AS (SELECT rid, count_if(size = {WINDOW}) AS n_repeat_words, count_if(size = {LEAST_REPEAT}) AS covered_words FROM inside GROUP BY rid),
far AS (SELECT DISTINCT rid FROM twice JOIN base USING (rid) WHERE size = beyond),
rows_ AS (
  SELECT base.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, far.rid IS NOT NULL AS too_long
  FROM base LEFT JOIN counts USING (rid) LEFT JOIN far USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEAT_PERCENT}) AND covered_words * 100 <= n_words * {MOST_COVERED_PERCENT} AND NOT too_long AS kept, covered_words
FROM rows_
"""
