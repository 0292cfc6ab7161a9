"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in NumPy.

A text's subwords are the byte 2-, 3- and 4-grams of its lowered letters (all else counts as space). Its embedding is
the mean of their rows in a hashed table; a linear softmax gives the language. As both are linear, prediction adds up
rows of (table x weights), so a text of any length is one pass over its bytes. A temperature fitted on labelled rows
kept out of training calibrates the score, and scores under nearly all correct ones there are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import STEP_BYTES, slices, text_buffer

GRAMS, BUCKETS, DIM, VIEW = (2, 3, 4), 1 << 16, 16, 400
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """table is (grams * BUCKETS, langs), embeddings x weights; of more languages than DIM it is the embeddings, and weights stand apart."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    weights: np.ndarray | None = None


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-gram ids of a byte run, without the table's offset."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    key = data[:m].astype(np.uint32)
    for i in range(1, n):
        key |= data[i : m + i].astype(np.uint32) << np.uint32(8 * i)
    key *= np.uint32(2654435761)
    return (key >> np.uint32(16)).astype(np.int64)


def _fold(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(pc.utf8_lower(column.fill_null("")))
    return _FOLD[data], offsets


def _sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of its subwords' rows, and their number. Works on bounded runs of bytes."""
    docs, width = len(offsets) - 1, table.shape[1]
    sums, counts = np.zeros((docs, width)), np.zeros(docs)
    step = max(1 << 14, STEP_BYTES * 4 // max(4, width))
    for g, n in enumerate(GRAMS):
        part = table[g * BUCKETS : (g + 1) * BUCKETS]
        for at in range(0, len(data), step):
            to = min(len(data), at + step)
            rows = part[_grams(data[at : min(len(data), to + n - 1)], n)]
            if not len(rows):
                continue
            a, b = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, to, "left"))
            lo = np.clip(np.maximum(offsets[a:b], at) - at, 0, len(rows))
            hi = np.clip(np.minimum(offsets[a + 1 : b + 1] - n + 1, to) - at, 0, len(rows))
            hi = np.maximum(hi, lo)
            full = np.flatnonzero(hi > lo)
            if len(full):
                edges = np.stack([lo[full], hi[full]], 1).ravel()
                padded = np.concatenate([rows, np.zeros((1, width), rows.dtype)]) if edges[-1] == len(rows) else rows
                sums[a + full] += np.add.reduceat(padded, edges, axis=0)[::2]
                counts[a + full] += hi[full] - lo[full]
    return sums, counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logits(model: Model, column: pa.Array) -> np.ndarray:
    sums, counts = _sums(*_fold(column), model.table)
    mean = sums / np.maximum(counts, 1)[:, None]
    return (mean if model.weights is None else mean @ model.weights) + model.bias


def train(texts: pa.Array, langs: list[str], *, updates: int = 900, rate: float = 4.0, seed: int = 7, tail: float = 0.001) -> Model | None:
    """Fit on labelled texts, with about `updates` steps of 32 texts; every tenth text only calibrates. None without any label.

    A step sees a random VIEW of the distinct subwords of each of its texts, drawn anew each time from the whole text.
    """
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(seed).permutation(len(y))
    held, fit = (order[::10], np.delete(order, np.s_[::10])) if len(y) >= 20 else (order, order)
    bags, rng = [], np.random.default_rng(seed)
    for i in range(len(texts)):
        own, _ = _fold(texts.slice(i, 1))
        ids, n = np.unique(np.concatenate([_grams(own, k) + g * BUCKETS for g, k in enumerate(GRAMS)]).astype(np.int32), return_counts=True)
        mixed = rng.permutation(len(ids))
        bags.append((ids[mixed], n[mixed].astype(np.float32)))
    emb = rng.normal(0, 0.3, (len(GRAMS) * BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    onehot = np.eye(len(names), dtype=np.float32)
    epochs = max(4, -(-updates * 32 // max(1, len(fit))))
    seen, place = np.zeros(len(emb), bool), np.zeros(len(emb), np.int64)
    for epoch in range(epochs):
        lr, shuffled = np.float32(rate * (1 - epoch / epochs)), rng.permutation(fit)
        for at in range(0, len(shuffled), 32):
            own = shuffled[at : at + 32]
            views = []
            for i in own:
                ids, n = bags[i]
                from_ = int(rng.integers(max(1, len(ids) - VIEW + 1)))
                n = n[from_ : from_ + VIEW]
                views.append((ids[from_ : from_ + VIEW], n / max(1.0, float(n.sum()))))
            ids = np.concatenate([v[0] for v in views])
            seen[ids] = True
            used = np.flatnonzero(seen)
            seen[used] = False
            place[used] = np.arange(len(used))
            shares = np.zeros((len(own), len(used)), np.float32)  # of each text's subwords, over those of the step
            shares[np.repeat(np.arange(len(own)), [len(v[0]) for v in views]), place[ids]] = np.concatenate([v[1] for v in views])
            x = shares @ emb[used]
            err = (_softmax(x @ w + b) - onehot[y[own]]) / np.float32(len(own))
            back = err @ w.T
            w -= lr * (x.T @ err)
            b -= lr * np.float32(0.1) * err.sum(0)
            emb[used] -= lr * 8 * (shares.T @ back)
    model = Model(names, emb @ w, b.astype(float), 1.0, 0.0) if len(names) <= DIM else Model(names, emb, b.astype(float), 1.0, 0.0, w)
    z = np.concatenate([_logits(model, texts.slice(int(i), 1)) for i in held])
    grid = np.geomspace(0.02, 5, 60)
    # one more text is taken to be wrong than are: without it, no error among those held would mean certainty on any text
    goal = np.full(z.shape, 1.0 / (len(held) + 1) / max(1, len(names) - 1))
    goal[np.arange(len(held)), y[held]] = len(held) / (len(held) + 1) if len(names) > 1 else 1.0
    loss = [-(goal * np.log(np.maximum(_softmax(z / t), 1e-12))).sum(1).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = p.max(1)[p.argmax(1) == y[held]]
    chance = 1.0 / len(names)
    cut = float(min(chance + 0.2 * (1 - chance), np.quantile(right, tail) * 0.9)) if len(right) else 0.0
    return replace(model, temperature=t, threshold=cut)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script; ASCII letters are looked for first."""
    data, offsets = text_buffer(column)
    seen = np.concatenate([[0], np.cumsum((data | 32) - np.uint8(97) < 26)])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in (column[int(i)].as_py() or ""))
    return found


def sample(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1000, max_chars: int = 20_000, most_chars: int = 16_000_000) -> DataFrame:
    """(_key, _lang, _text): a bounded sample of labelled rows whose crc32(key as text) mod 3 is not 1, of every language.

    Bounds: about per_language rows of a language, and about most_chars characters in all, shared evenly between the
    languages; texts over max_chars characters are left out of training, not shortened. Rows are drawn by a 62-bit hash
    of key and text, so reruns agree and no language is too common to be drawn; the row with a language's least hash is
    always in. Repeated rows count once.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.shiftrightunsigned(F.xxhash64(key, text), 2).alias("_h"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.crc32(F.col("_key").cast("string")) % 3 != 1) & (F.length("_text").between(1, max_chars)))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("chars"), F.min("_h").alias("least")).collect()  # a row per language, of which the model keeps weights
    share = most_chars / max(1, len(counts))
    below = [(r["_lang"], max(r["least"] + 1, int(2.0**62 * min(1.0, per_language / r["n"], share / r["chars"])))) for r in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(below, "_lang string, _below long"))  # the same rows
    return rows.join(limits, "_lang").where("_h < _below").select("_key", "_lang", "_text").dropDuplicates()


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample (_key, _lang, _text), all in one task, as one row: the model's parts as bytes."""
    got = [b for b in batches if b.num_rows]
    if got:
        rows = pa.Table.from_batches(got).sort_by([("_key", "ascending"), ("_lang", "ascending"), ("_text", "ascending")]).combine_chunks()
        model = train(rows.column("_text").combine_chunks(), rows.column("_lang").to_pylist())
        arrays = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in (model.table, model.bias, model.weights)]
        yield pa.record_batch([pa.array([model.langs], pa.list_(pa.string())), pa.array([model.temperature]), pa.array([model.threshold]), *arrays], names=["langs", "temperature", "threshold", "table", "bias", "weights"])


def fit(docs: DataFrame, **how) -> Model | None:
    """Train in one task on the sample() of docs, which takes the same parameters. None without a labelled row."""
    parts = "langs array<string>, temperature double, threshold double, table binary, bias binary, weights binary"
    row = sample(docs, **how).repartition(1).mapInArrow(_trained, parts).first()
    if row is None:
        return None
    matrix = lambda raw: np.frombuffer(bytes(raw), np.float32).reshape(-1, len(row["langs"]))
    if row["weights"] is None:
        return Model(tuple(row["langs"]), matrix(row["table"]), np.frombuffer(bytes(row["bias"])), row["temperature"], row["threshold"])
    return Model(tuple(row["langs"]), np.frombuffer(bytes(row["table"]), np.float32).reshape(-1, DIM), np.frombuffer(bytes(row["bias"])), row["temperature"], row["threshold"], matrix(row["weights"]))


def predictor(model: Model | None):
    """An Arrow function of the text: struct(lang_pred, score, rejected)."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pa.Array) -> pa.Array:
        known, best, score = np.zeros(len(text), bool), np.zeros(len(text), int), np.zeros(len(text))
        at = 0
        for part in slices(pa.record_batch([text.cast(pa.string())], ["text"]), 0) if model is not None else ():
            own, column = slice(at, at + part.num_rows), part.column(0)
            p = _softmax(_logits(model, column) / model.temperature)
            known[own], best[own], score[own] = has_letter(column), p.argmax(1), p.max(1)
            at += part.num_rows
        names = [model.langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)] if model else [UNKNOWN] * len(text)
        score = np.where(known, score, 0.0)
        low = ~known | (score < (model.threshold if model else 1))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, held_out, lang_pred, score, rejected and the columns in carry.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text when no row is labelled.
    A null key is neither held out nor trained on. Repeated rows are predicted alike; an empty table gives no rows.
    """
    model = model or fit(docs, key=key, text=text, lang=lang)
    out = docs.select(F.col(key).alias("_key"), predictor(model)(F.col(text)).alias("_p"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    return out.select(F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "_p.lang_pred", "_p.score", "_p.rejected", *[F.col(f"_carry_{c}").alias(c) for c in carry])
