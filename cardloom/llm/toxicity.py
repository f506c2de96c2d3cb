"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context of what they find.

The lexicon (terms, and stems that begin many terms) is learned from labelled rows. Its trie is intersected with the
Levenshtein automata of its terms; the product is determinised on demand, so that a word costs one table step a
character once its states are known. A term may be misspelled by one edit from five characters on and by two from
nine on; stems are matched as they are. What is found counts apart by its context window: in quotation, addressed to
someone, or neither; a logistic model over these sums gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.quality import sigmoid
from cardloom.llm.samples import bounded_rows, fold
from cardloom.llm.shared import sub_batches

#: Most training rows of each label, cached words of a Python worker, transitions of an automaton, and the context's reach in words.
SAMPLE, CACHE, TRANSITIONS, REACH = 1_500, 400_000, 400_000, 6
THRESHOLD = 0.5
#: How a word can match.
TERM, NEAR, FAR, STEM = 1, 2, 3, 4
#: The context of a match.
PLAIN, QUOTED, ADDRESSED = 0, 1, 2
_STRIP = ".,;:!?\"'()[]{}«»“”„‘’|#$%&*…–—-"
_MARK = re.compile("[\"'«»“”„‘’]")
# Quotation marks that only open or only close when they stand alone; others may do either.
_OPENS, _CLOSES = "«„‘", "»”’"
# Words that report speech, and words that address someone, in the languages learned.
REPORTING = frozenset("said says quote quoted quoting called term word wrote dit cite citation mot terme sagte zitat zitiert wort begriff dijo cita palabra llamado".split())
ADDRESSING = frozenset("you your you're yours u tu toi vous votre ton du dich dir dein ihr euch usted ustedes tú ti vosotros".split())


def allowance(length: int) -> int:
    """Edits that a term of so many characters may be off."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The lexicon's trie times the Levenshtein automata of its terms, determinised on demand.

    A state is a set of (trie node, edits so far); `accept` gives the best term of a word read to its end.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = terms, stems
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem = [-1], [-1]
        self.slack = [0]
        for entries, ends, loose in ((terms, self.term, True), (stems, self.stem, False)):
            for k, text in enumerate(entries):
                at = 0
                spare = allowance(len(text)) if loose else 0
                self.slack[0] = max(self.slack[0], spare)
                for c in text:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.term.append(-1)
                        self.stem.append(-1)
                        self.slack.append(0)
                    at = self.next[at][c]
                    self.slack[at] = max(self.slack[at], spare)
                ends[at] = k
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.step: list[dict[str, int]] = []
        self.size = 0
        self.start = self._state({0: 0}, -1)

    def _state(self, nodes: dict[int, int], stem: int) -> int:
        todo = list(nodes.items())
        while todo:  # a character of the term may be missing from the word
            node, edits = todo.pop()
            for child in self.next[node].values():
                if edits + 1 <= self.slack[child] and edits + 1 < nodes.get(child, 9):
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return self.index[key]

    def _advance(self, state: int, c: str) -> int:
        items, stem = self.states[state]
        nodes: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.slack[node] and edits < nodes.get(node, 9):
                nodes[node] = edits

        for node, edits in items:
            put(node, edits + 1) if edits + 1 <= self.slack[node] else None
            for char, child in self.next[node].items():
                if char == c:
                    put(child, edits)
                    if edits == 0 and self.stem[child] >= 0:
                        stem = self.stem[child]
                elif edits + 1 <= self.slack[child]:
                    put(child, edits + 1)
        to = self.step[state][c] = self._state(nodes, stem)
        self.size += 1
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(kind, entry) of a word's best match: a term of the fewest edits, else the longest stem; (0, -1) for none."""
        if self.size > TRANSITIONS:
            self.reset()
        at = self.start
        for c in word:
            to = self.step[at].get(c)
            at = self._advance(at, c) if to is None else to
            if not self.states[at][0] and self.states[at][1] < 0:
                return 0, -1
        items, stem = self.states[at]
        best = min(((e, self.term[n]) for n, e in items if self.term[n] >= 0 and e <= allowance(len(self.terms[self.term[n]]))), default=None)
        if best:
            return TERM + best[0], best[1]
        return (STEM, stem) if stem >= 0 else (0, -1)


def _edges(word: str) -> tuple[bool, bool, bool]:
    """Whether a word has a quotation mark that opens (before its first letter or digit), one that closes (after its last), and whether it is nothing but marks."""
    core = word.strip(_STRIP)
    if not core:
        marks = _MARK.findall(word)
        return any(m not in _CLOSES for m in marks), any(m not in _OPENS for m in marks), True
    at = word.index(core)
    return bool(_MARK.search(word[:at])), bool(_MARK.search(word[at + len(core) :])), False


def quoted(words: list[str], i: int) -> bool:
    """Whether the nearest quotation marks within reach of word i, on its left one that opens and on its right one that closes, enclose it.

    Marks of an earlier, closed quotation or of a later one don't count, nor does a stray mark such as that of inches.
    """
    opened = False
    for j in range(i, max(-1, i - REACH - 1), -1):
        opens, closes, alone = _edges(words[j])
        if j < i and closes and not (alone and opens):
            break
        if opens:
            opened = True
            break
    if not opened:
        return False
    for j in range(i, min(len(words), i + REACH + 1)):
        opens, closes, alone = _edges(words[j])
        if j > i and opens and not (alone and closes):
            break
        if closes:
            return True
    return False


@dataclass
class Model:
    """The lexicon with its log-odds, and the logistic weights of the context sums."""

    terms: list[str]
    stems: list[str]
    term_odds: list[float]
    stem_odds: list[float]
    weights: np.ndarray
    automaton: Automaton = field(default=None, repr=False)
    known: dict[str, tuple[int, int]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None, "known": {}}

    def found(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, kind, entry) of the words that match."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms, self.stems)
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > CACHE:
                self.known.clear()
            for i, w in enumerate(words):
                if got[i] is None:
                    if (hit := self.known.get(w)) is None:
                        hit = self.known[w] = self.automaton.match(w.strip(_STRIP))
                    got[i] = hit
        return [(i, *hit) for i, hit in enumerate(got) if hit[0]]

    def features(self, text: str) -> np.ndarray:
        """The sums of log-odds by kind and context, squashed, and the share and the number of matches."""
        words = text.lower().split()
        out = np.zeros(4 * 3 + 3)
        hits = self.found(words)
        if not hits:
            return out
        marked = bool(_MARK.search(text))
        seen = set()
        for i, kind, entry in hits:
            odds = (self.stem_odds if kind == STEM else self.term_odds)[entry]
            out[(kind - 1) * 3 + self.context(words, marked, i)] += odds
            seen.add((kind == STEM, entry))
        out[:12] = np.log1p(out[:12])
        out[12] = np.log1p(len(hits))
        out[13] = np.log1p(len(seen))
        out[14] = np.log1p(100 * len(hits) / len(words))
        return out

    def context(self, words: list[str], marked: bool, i: int) -> int:
        """Whether the window around a match quotes it, addresses someone, or neither; `marked` if the text has quotation marks."""
        if marked and quoted(words, i):
            return QUOTED
        bare = {w.strip(_STRIP) for w in words[max(0, i - REACH) : i + REACH + 1]}
        if bare & ADDRESSING:
            return ADDRESSED
        return QUOTED if bare & REPORTING else PLAIN

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return sigmoid(self.weights[0] + x @ self.weights[1:]) if len(texts) else np.empty(0)


def _chosen(pos: Counter, neg: Counter, n_pos: int, n_neg: int, least: float, odds: float) -> dict[str, float]:
    out = {}
    for key, a in pos.items():
        if a < least:
            continue
        b = neg.get(key, 0)
        p, q = (a + 0.5) / (n_pos + 1), (b + 0.5) / (n_neg + 1)
        pool = (a + b) / (n_pos + n_neg)
        z = (a / n_pos - b / n_neg) / np.sqrt(pool * (1 - pool) * (1 / n_pos + 1 / n_neg) + 1e-12)
        if np.log(p / q) >= odds and z >= 4:
            out[key] = float(np.log(p / q))
    return out


def learn_lexicon(rows: list[tuple[str | None, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems (of three to eight characters, the beginning of five words at least) that mark toxic rows, with their log-odds."""
    one: dict[str, str] = {}  # equal words of all rows are one object
    bags = [({one.setdefault(w, w) for w in (w.strip(_STRIP) for w in (text or "").lower().split()) if w}, y) for text, y in rows]
    n_pos = max(1, sum(y for _, y in bags))
    n_neg = max(1, len(bags) - n_pos)
    count, stem_count, heads = (Counter(), Counter()), (Counter(), Counter()), {}
    for words, y in bags:
        count[y].update(words)
    least = max(3, 0.004 * n_pos)
    terms = _chosen(count[1], count[0], n_pos, n_neg, least, 2.0)
    for words, y in bags:
        rest = words - terms.keys()  # a stem has to mark rows by words that aren't terms themselves
        stem_count[y].update({w[:n] for w in rest for n in range(3, min(9, len(w)))})
        for w in rest if y else ():
            for n in range(3, min(9, len(w))):
                heads.setdefault(w[:n], set()).add(w)
    stems = _chosen(Counter({s: n for s, n in stem_count[1].items() if len(heads[s]) >= 5}), stem_count[0], n_pos, n_neg, 3 * least, 1.0)
    # Of stems that begin one another, the one of the highest odds for its coverage.
    best = {}
    for s in sorted(stems, key=lambda s: -stems[s] * np.sqrt(stem_count[1][s])):
        if not any(s.startswith(t) or t.startswith(s) for t in best):
            best[s] = stems[s]
    return terms, best


def train(rows: list[tuple[str | None, int]], *, ridge: float = 0.3) -> Model:
    """A model from (text, toxic) rows; without rows of both kinds it has an empty lexicon."""
    rows = [(t, int(bool(y))) for t, y in rows]
    y = np.array([y for _, y in rows], float)
    width = 4 * 3 + 3
    # Where the rows say nothing, a quotation counts little and an address counts more.
    prior = np.zeros(width + 1)
    prior[1:13] = np.tile([1.0, 0.2, 1.2], 4) * np.repeat([1.0, 0.7, 0.3, 0.2], 3)
    prior[0] = -2.5
    if not len(y) or y.min() == y.max():
        return Model([], [], [], [], prior)
    terms, stems = learn_lexicon(rows)
    m = Model(list(terms), list(stems), list(terms.values()), list(stems.values()), prior)
    x = np.array([m.features(t or "") for t, _ in rows])
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    penalty = np.full(width + 1, ridge)
    penalty[0] = 1e-3
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # the sample holds more toxic rows than the corpus
    for _ in range(30):  # Newton's method
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    m.weights = w
    return m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` rows of each label, of those whose fold (crc32 of the id modulo 5) is not 0. Rows without a label are left out."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y IS NOT NULL")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(fold("_id", 5) != 0)
    return train(bounded_rows(rows, "_y", sample, labels=y, id_col="_id", text_col="_t"))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row, repeats and null ids included; a null id isn't held out.

    Null, empty and wordless texts score as texts without a match. Columns other than the two named are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), pa.array(shared.value.score([t or "" for t in b.column("text").to_pylist()]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
