"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes, white space included, are read in windows: CORE bytes with
CONTEXT bytes before and after them. The network reads a window forwards and
backwards and gives each position a distribution over the languages; the core's
positions count, so every byte of the whole text is labelled once, with at least
CONTEXT bytes (or the text's end) on either side. A document's distribution is the
mean over its positions. Gates are piecewise linear (clipped), which trains as
well as smooth ones here and costs a fraction.

The network is trained here, in numpy, by backpropagation through time, on a
bounded sample: at most SAMPLE_DOCS documents, the same number for each language,
and at most DOC_WINDOWS windows of TRAIN_BYTES bytes of each, spread over the
whole text. Each step draws the same number of windows of each language, so a
rare language counts as much as a frequent one.

Defined results: a text that is null or has no letter is `und` with score 0; so
are all texts if nothing can be learned from. Rows without an id or a language are
predicted, never learned from. Repeated rows are repeated; an empty table gives an
empty table; other columns are not read. Score ties go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_work, one_blas_thread, slices, tuned

UNDETERMINED = "und"
HIDDEN = 8
CORE, CONTEXT = 96, 8
SAMPLE_DOCS, DOC_WINDOWS, TRAIN_BYTES = 2_000, 24, 64
STEPS, BATCH, RATE, SEED = 500, 192, 0.01, 5
#: Windows that go through the network together, and bytes of texts that are taken up together; both bound a worker's memory.
BLOCK, SLICE_BYTES = 2_048, 2 << 20
#: A byte that no UTF-8 text has: what stands before and after a text.
PAD = 255
#: What a letter is, for Arrow's and for Java's regular expressions.
LETTER = r"\p{L}"


class ByteGru:
    """Parameters by name: for each direction the bytes' inputs X (256 x 3H, biases included), the recurrence U (H x 3H) and the outputs V (H x C); and C's bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.p = {"c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"X{d}": draw(256, 3 * hidden), f"U{d}": draw(hidden, 3 * hidden), f"V{d}": draw(hidden, len(languages))}

    def _step(self, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(reset, update, candidate, the recurrence's part of the candidate, new state) for the bytes x after the states h."""
        H, U = self.hidden, self.p[f"U{d}"]
        a, g = self.p[f"X{d}"].take(x, axis=0), h @ U
        gates = a[:, : 2 * H] + g[:, : 2 * H]
        gates *= gates.dtype.type(0.25)
        gates += gates.dtype.type(0.5)
        np.clip(gates, 0, 1, out=gates)
        r, z, own = gates[:, :H], gates[:, H:], g[:, 2 * H :]
        n = r * own
        n += a[:, 2 * H :]
        np.clip(n, -1, 1, out=n)
        new = h - n
        new *= z
        new += n
        return r, z, n, own, new

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distributions (T x N x C) of the positions of N windows of T bytes (x: T x N)."""
        p = self.p
        logits = np.empty((*x.shape, len(self.languages)), p["c"].dtype)
        logits[:] = p["c"]
        for d, read, out in (("f", x, logits), ("b", x[::-1], logits[::-1])):
            h = np.zeros((x.shape[1], self.hidden), p["c"].dtype)
            for t in range(len(x)):
                h = self._step(d, read[t], h)[-1]
                out[t] += h @ p[f"V{d}"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions but padding, and its gradients, by backpropagation through time."""
        H, T, N = self.hidden, *x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        read = {"f": x, "b": x[::-1]}
        for d in "fb":
            h = np.zeros((N, H), self.p["c"].dtype)
            for t in range(T):
                parts = self._step(d, read[d][t], h)
                kept[d].append((h, *parts))
                h = parts[-1]
        states = {d: np.stack([k[-1] for k in kept[d]]) for d in "fb"}
        p = states["f"] @ self.p["Vf"] + states["b"][::-1] @ self.p["Vb"] + self.p["c"]
        p = np.exp(p - p.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        columns, counts = np.arange(N), x != PAD
        total = max(1, counts.sum())
        loss = float((-np.log(p[:, columns, label] + 1e-9) * counts).sum() / total)
        p[:, columns, label] -= 1
        p *= (counts / total)[:, :, None].astype(p.dtype)
        grads = {"c": p.sum(axis=(0, 1))}
        for d in "fb":
            dp = p if d == "f" else p[::-1]
            grads[f"V{d}"] = np.einsum("tnh,tnc->hc", states[d], dp)
            from_output, U = dp @ self.p[f"V{d}"].T, self.p[f"U{d}"]
            dU, da = np.zeros_like(U), np.empty((T, N, 3 * H), U.dtype)
            dh = np.zeros_like(from_output[0])
            for t in range(T - 1, -1, -1):
                h, r, z, n, own, _ = kept[d][t]
                dh = dh + from_output[t]
                dn = dh * (1 - z) * (np.abs(n) < 1)
                dz = dh * (h - n) * ((z > 0) & (z < 1)) / 4
                dr = dn * own * ((r > 0) & (r < 1)) / 4
                to_state = np.concatenate([dr, dz, dn * r], axis=1)
                dU += h.T @ to_state
                da[t, :, : 2 * H], da[t, :, 2 * H :] = to_state[:, : 2 * H], dn
                dh = dh * z + to_state @ U.T
            grads |= {f"U{d}": dU, f"X{d}": _sums_by_byte(read[d], da)}
        return loss, grads

    @one_blas_thread()
    def text_sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text (N x C) the sum over all its bytes of their distributions."""
        out = np.zeros((len(texts), len(self.languages)))
        for owner, bytes_, p in self._labelled(texts):
            p *= (bytes_ != PAD)[:, :, None]
            sums = p.sum(axis=0)
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(owner, sums[:, c], len(texts))
        return out

    @one_blas_thread()
    def position_labels(self, text: bytes) -> np.ndarray:
        """The number of the language of each byte of the text."""
        parts = [p.argmax(axis=-1).T.ravel() for _, _, p in self._labelled([text])]
        return np.concatenate(parts)[: len(text)]

    def _labelled(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(the texts' numbers, the cores' bytes, their distributions) of blocks of windows, in order."""
        length = np.array([len(t) for t in texts], np.int64)
        windows = -(-length // CORE)
        sizes = windows * CORE + 2 * CONTEXT
        begins = np.cumsum(sizes) - sizes
        laid = np.full(int(sizes.sum()), PAD, np.uint8)
        for at, n, text in zip(begins.tolist(), length.tolist(), texts, strict=True):
            laid[at + CONTEXT : at + CONTEXT + n] = np.frombuffer(text, np.uint8)
        owner = np.repeat(np.arange(len(texts)), windows)
        first = begins[owner] + (np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]) * CORE
        steps = np.arange(CORE + 2 * CONTEXT)[:, None]
        for at in range(0, len(owner), BLOCK):
            x = laid[first[at : at + BLOCK] + steps]
            yield owner[at : at + BLOCK], x[CONTEXT:-CONTEXT], self.positions(x)[CONTEXT:-CONTEXT]


def _sums_by_byte(read: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums (256 x K) of the values (T x N x K) that stand at each byte."""
    flat = read.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    out = np.zeros((256, values.shape[2]), values.dtype)
    out[flat[order][first]] = np.add.reduceat(values.reshape(len(flat), -1)[order], first, axis=0)
    return out


@one_blas_thread()
def train(sample: list[tuple[str, bytes]], steps: int = STEPS, seed: int = SEED) -> ByteGru | None:
    """The network for (language, window) pairs; None if there is none. A window may be shorter than TRAIN_BYTES, not longer."""
    sample = sorted((lang, w) for lang, w in sample if w)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    model = ByteGru(languages, seed=seed)
    random = np.random.default_rng(seed)
    x = np.full((len(sample), TRAIN_BYTES), PAD, np.uint8)
    for k, (_, w) in enumerate(sample):
        x[k, : len(w)] = np.frombuffer(w, np.uint8)
    label = np.searchsorted(languages, [lang for lang, _ in sample])
    begins, ends = np.searchsorted(label, np.arange(len(languages))), np.searchsorted(label, np.arange(len(languages)), "right")
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        turn = (np.arange(BATCH) + step) % len(languages)
        at = random.integers(begins[turn], ends[turn])
        _, grads = model.gradients(np.ascontiguousarray(x[at].T), label[at])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.p[k] = (model.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """The training pairs (language, window): for each language the documents with the least hashes of id and text, windows spread over each.

    A share of the hashes that holds three times the wanted documents comes to
    the driver, one number each, so no language is ranked in one task. Rows that
    repeat id and text are one document.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.filter(F.col("text").rlike(LETTER) & F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id")).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text", "lang"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}  # one row a language, as the network has one output a language
    if not counts:
        return []
    wanted = max(1, SAMPLE_DOCS // len(counts))
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(2**63 * (2 * min(1.0, 3 * wanted / n) - 1)) - 1)])
    few = usable.select("lang", "key").filter(F.col("key") <= bound[F.col("lang")]).distinct().collect()
    by_lang: dict[str, list[int]] = {}
    for r in sorted(few, key=lambda r: r.key):
        if len(chosen := by_lang.setdefault(r.lang, [])) < wanted:
            chosen.append(r.key)
    keys = [k for chosen in by_lang.values() for k in chosen]
    found = usable.filter(F.col("key").isin(keys)).groupBy("key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    data = F.col("text").cast("binary")
    bytes_ = F.octet_length("text")
    n = F.least(F.lit(DOC_WINDOWS), F.greatest(F.lit(1), F.floor(bytes_ / TRAIN_BYTES)))
    begin = lambda i: F.floor(i * F.greatest(F.lit(0), bytes_ - TRAIN_BYTES) / F.greatest(F.lit(1), n - 1)).cast("int")
    windows = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(data, begin(i) + 1, F.lit(TRAIN_BYTES)))
    return [(r.lang, bytes(w)) for r in found.select("lang", windows.alias("windows")).collect() for w in r.windows]


def _predicted(docs: DataFrame, model: ByteGru | None, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(_id, _0, _1 ..., lang_pred, score): the columns in keep go by number, so that none can clash."""
    source = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)))
    names = ["_id", *(f"_{k}" for k in range(len(keep)))]
    kinds = [f.dataType.simpleString() for f in source.schema][1:]
    languages = model.languages if model else []

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language_id")
        for batch in slices(batches, SLICE_BYTES):
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if model is not None:
                lettered = pc.match_substring_regex(pc.fill_null(batch.column(0), ""), LETTER).to_numpy(zero_copy_only=False)
                sums = model.text_sums(batch.column(0).filter(pa.array(lettered)).cast(pa.binary()).to_pylist())
                best[lettered] = sums.argmax(axis=1)
                score[lettered] = np.minimum(1, sums.max(axis=1, initial=0) / sums.sum(axis=1))
            langs = pa.array([languages[k] if k >= 0 else UNDETERMINED for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], langs, pa.array(np.round(score, 6))], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), "lang_pred string, score double"])
    return source.mapInArrow(label, schema)


def predict(docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): every whole text."""
    return _predicted(docs, model, id_col, text_col, []).withColumnRenamed("_id", id_col)


def label_positions(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs): the label of every byte of each whole text, neighbours with one label as a run (start, end in bytes, lang)."""
    source = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language_id")
        for batch in slices(batches, SLICE_BYTES):
            runs = []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                best = model.position_labels(text) if text else np.empty(0, np.int64)
                begins = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(best) else best
                ends = np.r_[begins[1:], len(best)]
                runs.append([{"start": s, "end": e, "lang": model.languages[k]} for s, e, k in zip(begins.tolist(), ends.tolist(), best[begins].tolist(), strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))], ["_id", "runs"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(label, f"_id {kind}, runs array<struct<start: long, end: long, lang: string>>").withColumnRenamed("_id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, by a network that learned from those not held out."""
    docs = tuned(docs)
    model = train(sample_windows(docs, id_col))
    return predict(docs, model, id_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """docs without those whose language can't be told: no text or letter, or a score below least_score. lang is the predicted one."""
    docs = tuned(docs)
    model = train(sample_windows(docs))
    others = [c for c in docs.columns if c not in ("doc_id", "lang")]
    found = _predicted(docs, model, "doc_id", "text", others).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    of = {"doc_id": "_id", "lang": "lang_pred"} | {c: f"_{k}" for k, c in enumerate(others)}
    return found.select(*(F.col(of[c]).alias(c) for c in docs.columns))
