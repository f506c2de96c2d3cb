"""Language identification of whole texts and of spans in mixed ones.

Script ranges narrow a word's candidate languages to those seen with its script; a character n-gram model scores the
word in each candidate; Viterbi with a penalty for switching labels the words, and equal neighbours form spans.

Most texts are of one language. A constant labelling is the best one if no stretch of words gains more than the
penalty by another language, which prefix sums show for a whole batch at once; other texts run in lockstep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.arrays import RangeHash, mix
from cardloom.llm.samples import bounded_rows, fold
from cardloom.llm.shared import sub_batches

# First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
NAMES = tuple(dict.fromkeys(s for s, _, _ in SCRIPTS)) + ("other",)
TABLE = 1 << 17
GRAMS = (1, 2, 3, 4)
#: Most training documents of each language, the switching penalty, and the most a word can count against a language.
SAMPLE, PENALTY, CLIP = 700, 12.0, 6.0
_U = np.uint64
# Letters are ASCII letters and every byte of a longer character.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER[128:] = True


class Tokens:
    """The words (runs of letters) of lower-cased texts, each distinct one once."""

    def __init__(self, texts: list[str]):
        self.data = b" " + b" ".join([t.lower().encode() for t in texts]) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        letter = _LETTER[raw]
        step = np.diff(letter.view(np.int8))
        self.starts = np.flatnonzero(step == 1) + 1
        self.ends = np.flatnonzero(step == -1) + 1
        sizes = np.array([len(t.lower().encode()) for t in texts], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
        self.first = np.searchsorted(self.starts, edges)
        code = RangeHash(raw)(self.starts, self.ends)
        _, at, self.which = np.unique(code, return_index=True, return_inverse=True)
        self.distinct = [self.data[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def scripts_of(words: list[bytes]) -> np.ndarray:
    """The script of every word by its first letter outside ASCII that isn't Latin, or Latin."""
    out = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        if not w.isascii():
            out[i] = _script(w.decode("utf-8", "replace"))
    return out


def _script(word: str) -> int:
    latin = any(c < "\x80" for c in word)
    for c in word:
        if c >= "\x80" and c.isalpha():
            p = ord(c)
            name = next((s for s, a, b in SCRIPTS if a <= p <= b), "other")
            if name != "latin":
                return NAMES.index(name)
            latin = True
    return 0 if latin else len(NAMES) - 1


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all byte n-grams of the words, with their ends marked, and the number of slots of each word."""
    data = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(len(data))
    h = RangeHash(data)
    slots, owner = [], np.repeat(np.arange(len(words)), size)
    keys, owners = [], []
    for n in GRAMS:
        ok = np.flatnonzero(at + n <= ends)
        keys.append((mix(h(ok, ok + n) + _U(n)) % _U(TABLE)).astype(np.int64))
        owners.append(owner[ok])
    slots, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.bincount(owner, minlength=len(words))


@dataclass
class Model:
    """`table` has the log-probability of each n-gram slot in each language; `scripts` the languages seen with each script."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of distinct words, languages across; the best is 0 and none is under -CLIP. Words of unseen scripts have only zeros."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        slots, count = gram_slots(words)
        starts = np.cumsum(count) - count
        score = np.add.reduceat(self.table[slots], starts, axis=0) / len(GRAMS)
        allowed = self.scripts[scripts_of(words)]
        score = np.where(allowed, score, -np.inf)
        top = score.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(top), np.maximum(score - top, -CLIP), 0).astype(np.float32)


def train(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows."""
    langs = sorted({y for _, y in rows})
    table = np.full((TABLE, len(langs)), 0.02)
    scripts = np.zeros((len(NAMES), len(langs)), bool)
    for j, lang in enumerate(langs):
        tokens = Tokens([t for t, y in rows if y == lang and t])
        if not tokens.distinct:
            continue
        n = np.bincount(tokens.which, minlength=len(tokens.distinct))
        slots, count = gram_slots(tokens.distinct)
        table[:, j] += np.bincount(slots, np.repeat(n, count), TABLE)
        seen = np.bincount(scripts_of(tokens.distinct), n, len(NAMES))
        scripts[:, j] = seen >= 0.02 * seen.sum()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), scripts)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; `score` has words down and labels across, text d has words first[d]..first[d+1]-1.

    All texts advance together, longest first. Of equal paths the one that switches later, to the smaller label, wins.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    begin, size = first[:-1][order], n[order]
    path = np.zeros(len(score), np.int64)
    if not len(order):
        return path
    labels = score.shape[1]
    came = np.zeros(score.shape, np.int32)
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    own = np.arange(labels)
    total = score[begin].astype(np.float64)
    last = np.zeros((len(order), labels))
    for t in range(1, size[0]):
        a = active[t]
        last[a : len(total)] = total[a:]
        total = total[:a]
        best = total.argmax(axis=1)
        switched = total[np.arange(a), best] - penalty
        stay = total >= switched[:, None]
        came[begin[:a] + t] = np.where(stay, own, best[:, None])
        total = np.where(stay, total, switched[:, None]) + score[begin[:a] + t]
    last[: len(total)] = total
    at = last.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        words = begin[:a] + t
        path[words] = at[:a]
        if t:
            at[:a] = came[words, at[:a]]
    return path


def label_words(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi's labels, and each text's total score by label. Texts that no switch can better keep one label."""
    n = np.diff(first)
    docs = np.repeat(np.arange(len(n)), n)
    total = np.zeros((len(n), score.shape[1]))
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros(0, np.int64), total
    total[full] = np.add.reduceat(score.astype(np.float64), first[:-1][full], axis=0)
    best = total.argmax(axis=1)
    path = best[docs]
    gain = np.zeros(len(full))
    apart = 4.0 * CLIP * (len(score) + 1)
    lead = score[np.arange(len(score)), path].astype(np.float64)
    for j in range(score.shape[1]):
        run = np.cumsum(score[:, j] - lead)
        before = run - (score[:, j] - lead)
        low = np.minimum.accumulate(before - apart * docs) + apart * docs
        gain = np.maximum(gain, np.maximum.reduceat(run - low, first[:-1][full]))
    mixed = full[gain > penalty - 1e-3]
    if len(mixed):
        words = np.concatenate([np.arange(first[d], first[d + 1]) for d in mixed.tolist()])
        path[words] = viterbi(score[words], np.concatenate([[0], np.cumsum(n[mixed])]), penalty)
    return path, total


def predict(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text the language of most letters, a score, and the spans (first word, word after the last, language).

    The score is the language's share of the letters, times 1 - exp(-e) for the evidence e of its words.
    """
    tokens = Tokens(texts)
    emitted = model.emissions(tokens.distinct)[tokens.which]
    path, _ = label_words(emitted, tokens.first)
    size = tokens.ends - tokens.starts
    labels = len(model.langs)
    n = np.diff(tokens.first)
    docs = np.repeat(np.arange(len(texts)), n)
    share = np.bincount(docs * labels + path, size, len(texts) * labels).reshape(-1, labels)
    best = share.argmax(axis=1)
    rows = np.arange(len(texts))
    # Evidence: by how much the words of that language favour it over each word's next language.
    if labels > 1:
        sorted_two = np.partition(emitted, labels - 2, axis=1)[:, labels - 2]
        lead = np.where(path == best[docs], emitted[np.arange(len(path)), path] - sorted_two, 0)
        evidence = np.bincount(docs, np.maximum(lead, 0), len(texts))
    else:
        evidence = np.full(len(texts), 50.0)
    score = share[rows, best] / np.maximum(share.sum(axis=1), 1) * -np.expm1(-evidence)
    edge = np.ones(len(path), bool)
    edge[1:] = (np.diff(path) != 0) | (np.diff(docs) != 0)
    heads = np.flatnonzero(edge)
    tails = np.append(heads, len(path))[1:]
    spans: list[list] = [[] for _ in texts]
    for h, t, d, p in zip(heads.tolist(), tails.tolist(), docs[heads].tolist(), path[heads].tolist(), strict=True):
        spans[d].append((h - int(tokens.first[d]), t - int(tokens.first[d]), model.langs[p]))
    out = []
    for i, text in enumerate(texts):
        letters = n[i] and (any(map(str.isalpha, text[:50])) or any(map(str.isalpha, text)))
        out.append((model.langs[best[i]], float(score[i]), spans[i]) if letters else ("und", 0.0, []))
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` documents of each language, of those whose fold (crc32 of the id modulo 4) is not 2."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) != 2))
    return train(bounded_rows(rows, lang_col, sample, id_col=id_col, text_col=text_col))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): one row per input row, repeats and null ids included.

    `spans` is an array of (first, past, lang) over the text's words, runs of letters. Null texts and texts without
    letters are `und` with score 0 and no spans; without any language to learn every text is. Ties go to the language
    that sorts first. Columns other than the two named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kind = shared.value, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))
        for b in sub_batches(batches, "text", 3 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = predict(m, texts) if m.langs else [("und", 0.0, [])] * len(texts)
            spans = [[dict(zip(("first", "past", "lang"), s, strict=True)) for s in r[2]] for r in rows]
            yield pa.record_batch([b.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first int, past int, lang string>>")


def identified(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, lang_pred, score and the number of spans."""
    rows = identify(docs, fit(docs))
    return rows.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def identified_share(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text, the share of its letters in words of a learned script whose span has any evidence for its language.

    Spans are Viterbi's, so each of several languages counts by its own words, and a short text as much as a long one.
    """
    tokens = Tokens(texts)
    emitted = model.emissions(tokens.distinct)[tokens.which]
    path, _ = label_words(emitted, tokens.first)
    docs = np.repeat(np.arange(len(texts)), np.diff(tokens.first))
    known = model.scripts[scripts_of(tokens.distinct)].any(axis=1)[tokens.which]
    if len(model.langs) > 1 and len(path):
        other = emitted.copy()
        other[np.arange(len(path)), path] = -np.inf
        lead = emitted[np.arange(len(path)), path] - other.max(axis=1)
        edge = np.ones(len(path), bool)
        edge[1:] = (np.diff(path) != 0) | (np.diff(docs) != 0)
        span = np.cumsum(edge) - 1
        known &= (np.bincount(span, np.maximum(lead, 0)) > 0)[span]
    size = tokens.ends - tokens.starts
    return np.bincount(docs, size * known, len(texts)) / np.maximum(np.bincount(docs, size, len(texts)), 1)


def confident(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` of whose letters a share of at least `least` is in identified languages, all columns as they were; no shuffle.

    Null texts and texts without letters go, as all do without any language to learn.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sub_batches(batches, text_col, 1 << 20):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            share = identified_share(m, texts) if m.langs else np.zeros(len(texts))
            letters = [s > 0 and (any(map(str.isalpha, t[:50])) or any(map(str.isalpha, t))) for s, t in zip(share.tolist(), texts, strict=True)]
            yield b.filter(pa.array((share >= least) & np.array(letters, bool)))

    return docs.mapInArrow(run, docs.schema)
