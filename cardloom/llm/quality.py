"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions
in time linear in the number of features, by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.arrays import RangeHash, Words, mix, normal
from cardloom.llm.samples import bounded_rows, fold
from cardloom.llm.shared import sub_batches, texts

#: Slots of hashed words, rank of the interactions, bins of each statistic, and most training rows of each label.
SLOTS, RANK, BINS, SAMPLE = 1 << 15, 8, 12, 1_500
THRESHOLD = 0.3
_U = np.uint64
STATISTICS = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "symbols", "exclamation", "pipes", "not_ascii",
    "lines_per_word", "symbol_ends", "capital_words", "distinct_words", "sentence_ends", "word_runs",
)
_KIND = {k: np.zeros(256, bool) for k in ("upper", "digits", "symbols", "exclamation", "pipes", "not_ascii", "letters", "ends")}
_KIND["upper"][65:91] = True
_KIND["digits"][48:58] = True
_KIND["symbols"][[*b"#$%&*@~^_=+<>\\{}[]|!?/"]] = True
_KIND["exclamation"][33] = True
_KIND["pipes"][124] = True
_KIND["not_ascii"][128:] = True
_KIND["letters"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND["ends"][[*b".!?"]] = True


def features(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: (text, slot, value) of the hashed words, and the statistics, a row each. Metadata is the text's size and shape; no label, source or language."""
    w = Words([normal(t) for t in batch])
    n = np.diff(w.first)
    docs = w.doc
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask[w.bytes])])
    by_doc = lambda x: np.bincount(docs, x, len(batch))
    within = {k: (c := sums(m))[w.ends] - c[w.starts] for k, m in _KIND.items()}
    size = w.ends - w.starts
    total = np.maximum(by_doc(size), 1)
    words = np.maximum(n, 1)
    code = RangeHash(w.bytes)(w.starts, w.ends)
    key = (docs.astype(_U) << _U(32)) | (mix(code) % _U(SLOTS))
    pairs, count = np.unique(key, return_counts=True)
    owner, slot = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
    norm = np.sqrt(np.maximum(np.bincount(owner, count.astype(np.float64) ** 2, len(batch)), 1))
    value = count / norm[owner]
    last = w.bytes[w.ends - 1] if len(docs) else np.empty(0, np.uint8)
    again = np.zeros(len(docs))
    again[1:] = (code[1:] == code[:-1]) & (docs[1:] == docs[:-1])
    stats = np.stack([
        np.log1p([len(t) for t in batch]), np.log1p(n), total / words,
        *(by_doc(within[k]) / total for k in ("upper", "digits", "symbols", "exclamation", "pipes", "not_ascii")),
        np.array([t.count(b"\n") for t in batch]) / words,
        by_doc(_KIND["symbols"][last]) / words,
        by_doc((within["upper"] > 1) & (within["upper"] + within["not_ascii"] >= within["letters"])) / words,
        np.bincount(owner, minlength=len(batch)) / words,
        by_doc(_KIND["ends"][last]) / words,
        by_doc(again) / words,
    ], axis=1)
    return owner, slot, value, stats


@dataclass
class Machine:
    """Weights: `bias`, linear `w` and factors `v` of the slots of words and of binned statistics; `edges` bound the bins."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def rows(self, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, slot, value) of all features of a batch, those of `features` and the binned statistics, in order of texts."""
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(stats.shape[1])], axis=1)
        place = SLOTS + np.arange(stats.shape[1]) * (BINS + 1) + bins
        owners = np.concatenate([owner, np.repeat(np.arange(len(stats)), stats.shape[1])])
        order = np.argsort(owners, kind="stable")
        return owners[order], np.concatenate([slot, place.ravel()])[order], np.concatenate([value, np.full(place.size, 0.5)])[order]

    def raw(self, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The machine's sums before the sigmoid; every text has features, its statistics."""
        start = np.searchsorted(owner, np.arange(n))
        vx = self.v[slot] * value[:, None]
        first = np.add.reduceat(vx, start, axis=0)
        square = np.add.reduceat(vx * vx, start, axis=0)
        return self.bias + np.add.reduceat(self.w[slot] * value, start) + 0.5 * (first * first - square).sum(axis=1)

    def score(self, batch: list[bytes]) -> np.ndarray:
        return sigmoid(self.raw(*self.rows(*features(batch)), len(batch))) if batch else np.empty(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[str | None, int]], *, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """A machine fitted by AdaGrad on the logistic loss; the same rows give the same machine."""
    n_stats = len(STATISTICS)
    size = SLOTS + n_stats * (BINS + 1)
    random = np.random.default_rng(7)
    data, y = [(t or "").encode() for t, _ in rows], np.array([float(bool(q)) for _, q in rows])
    m = Machine(0.0, np.zeros(size), random.normal(0, 0.01, (size, RANK)), np.zeros((n_stats, BINS)))
    if not len(y) or y.min() == y.max():
        m.bias = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        m.v[:] = 0
        return m
    # A few texts at a time, so that the word-wise arrays stay small.
    parts = [features(data[i : i + 200]) for i in range(0, len(data), 200)]
    stats = np.concatenate([p[3] for p in parts])
    owner = np.concatenate([p[0].astype(np.int32) + 200 * i for i, p in enumerate(parts)])
    slot, value = np.concatenate([p[1].astype(np.int32) for p in parts]), np.concatenate([p[2].astype(np.float32) for p in parts])
    del parts
    m.edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T.copy()
    owner, slot, value = m.rows(owner, slot, value, stats)
    edge = np.searchsorted(owner, np.arange(len(data) + 1))
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(data))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            count = edge[docs + 1] - edge[docs]
            pick = np.repeat(edge[docs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            own, s, x = np.repeat(np.arange(len(docs)), count), slot[pick], value[pick]
            start = np.cumsum(count) - count
            vx = m.v[s] * x[:, None]
            first = np.add.reduceat(vx, start, axis=0)
            square = np.add.reduceat(vx * vx, start, axis=0)
            raw = m.bias + np.add.reduceat(m.w[s] * x, start) + 0.5 * (first * first - square).sum(axis=1)
            error = (sigmoid(raw) - y[docs]) / len(docs)
            used, where = np.unique(s, return_inverse=True)
            e = error[own] * x
            dw = np.bincount(where, e, len(used)) + decay * m.w[used]
            dv = np.zeros((len(used), RANK))
            for f in range(RANK):
                dv[:, f] = np.bincount(where, e * (first[own, f] - vx[:, f]), len(used))
            dv += decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            db = error.sum()
            gb += db * db
            m.bias -= rate * db / np.sqrt(gb)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine of at most `sample` rows of each label, of those whose fold (crc32 of the id modulo 5) is not 0. Rows without a label are left out."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IS NOT NULL")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(fold("_id", 5) != 0)
    return train(bounded_rows(rows, "_y", sample, labels=y, id_col="_id", text_col="_t"))


def scored(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row, repeats and null ids included; a null id isn't held out.

    Null texts score as empty ones, by their statistics. An empty table gives an empty result, and without labels of
    both kinds every row has the same score. Columns other than the two named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text", 3 << 20):
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.score(texts(b, "text")).astype(np.float64))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
