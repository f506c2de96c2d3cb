"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf holds ``rank * width + position`` of the pair that starts there; the root then is the leftmost pair of the
lowest rank. A merge changes at most three leaves, each in logarithmic time, until the root is empty. Short words run
through `MergeForest`, one tree a word in the rows of one array; long ones through the scalar `SegmentTree`.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import sub_batches

_NONE = np.iinfo(np.int64).max
SHORT = 64
#: Cached chunks of text between white space, per Python worker.
CACHE = 250_000
# The white space that the normaliser's \s stands for.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def _class(major: str) -> str:
    """The characters of a general category (L or N) as ranges of a character class."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == major
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@cache
def _pieces() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")


@cache
def _byte_chars() -> list[str]:
    """The printable stand-in of every byte, by the rule of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Minimum of `leaves` at `root`; `set` replaces one leaf in logarithmic time."""

    def __init__(self, leaves: list[int]):
        self.width = w = 1 << max(0, len(leaves) - 1).bit_length()
        self.nodes = [_NONE] * w + leaves + [_NONE] * (w - len(leaves))
        for i in range(w - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    @property
    def root(self) -> int:
        return self.nodes[1]

    def set(self, at: int, value: int) -> None:
        nodes, i = self.nodes, at + self.width
        nodes[i] = value
        while i > 1:
            i >>= 1
            nodes[i] = min(nodes[2 * i], nodes[2 * i + 1])


# The only normaliser, splitter and model options that `Encoder` follows, as a tokenizer file states them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_PLAIN = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "fuse_unk")
_ADDED = ("single_word", "lstrip", "rstrip", "normalized")


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that `Encoder` doesn't do; its ids would differ without a sign."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None, None]
    levels = {k: v for k, v in (split[-1] or {}).items() if k != "trim_offsets"}
    wrong = [] if spec["model"].get("type") == "BPE" else ["model"]
    wrong += [] if spec.get("normalizer") == _NORMALIZER else ["normalizer"]
    wrong += [] if split[:-1] == [_SPLIT] and levels == _BYTES else ["pre_tokenizer"]
    wrong += ["decoder"] if spec.get("decoder") else []
    wrong += [k for k in _PLAIN if spec["model"].get(k)]
    return wrong + [f"added token {t['content']!r}" for t in spec["added_tokens"] if any(t.get(k) for k in _ADDED)]


class Vocabulary:
    """A tokenizer file's vocabulary, merges and added tokens. Raises ValueError for a file that asks for something else than `Encoder` does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if wrong := unsupported(spec):
            raise ValueError(f"{path}: not supported: {', '.join(wrong)}")
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _NONE)
        self.pair_ranks = np.append(np.array([r for r, _ in self.ranks.values()], np.int64)[order], -1)
        self.merged = np.zeros(len(pairs) + 1, np.int64)
        for r, new in self.ranks.values():
            self.merged[r] = new
        chars = _byte_chars()
        self.byte_ids = np.array([self.ids[c] for c in chars], np.int64)
        self.last_ids = np.array([self.ids[c + self.end] for c in chars], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' ranks, -1 for pairs that don't merge."""
        key = (left << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)


def encode_long(vocab: Vocabulary, symbols: list[int]) -> list[int]:
    """The ids of one word through a scalar segment tree."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, ranks = list(symbols), vocab.ranks
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def leaf(i: int) -> int:
        j = after[i]
        got = ranks.get((symbols[i], symbols[j])) if j < n else None
        return _NONE if got is None else got[0] * n + i

    tree = SegmentTree([leaf(i) for i in range(n)])
    while (best := tree.root) != _NONE:
        rank, i = divmod(best, n)
        j = after[i]
        symbols[i], alive[j] = int(vocab.merged[rank]), False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        tree.set(j, _NONE)
        tree.set(i, leaf(i))
        if before[i] >= 0:
            tree.set(before[i], leaf(before[i]))
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def encode_forest(vocab: Vocabulary, symbols: np.ndarray, count: np.ndarray) -> list[list[int]]:
    """The ids of many words, a row of `symbols` (padded with -1) each; every word has its own segment tree in a row."""
    n, width = symbols.shape
    w = 1 << max(0, width - 1).bit_length()
    if w != width:
        symbols = np.pad(symbols, ((0, 0), (0, w - width)), constant_values=-1)
    symbols = np.pad(symbols, ((0, 0), (0, 1)), constant_values=-1)  # column w: nothing
    position = np.arange(w)
    after = np.where(position + 1 < count[:, None], position + 1, w)
    after = np.pad(after, ((0, 0), (0, 1)), constant_values=w)
    before = np.pad(np.broadcast_to(np.append(position, w) - 1, (n, w + 1)).copy(), ((0, 0), (0, 0)))
    before[:, 0] = w
    tree = np.full((n, 2 * w), _NONE, np.int64)
    right = np.take_along_axis(symbols, after[:, :w], 1)
    has = (right >= 0) & (symbols[:, :w] >= 0)
    ranks = np.full((n, w), -1, np.int64)
    ranks[has] = vocab.rank(symbols[:, :w][has], right[has])
    tree[:, w:] = np.where(ranks >= 0, ranks * w + position, _NONE)
    for i in range(w - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        i = at + w
        tree[rows, i] = value
        for _ in range(w.bit_length() - 1):
            i = i >> 1
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[rows, at]
        rank = vocab.rank(symbols[rows, at], symbols[rows, nxt])
        return np.where((rank >= 0) & (nxt < w), rank * w + at, _NONE)

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        rank, i = np.divmod(tree[rows, 1], w)
        j = after[rows, i]
        symbols[rows, i] = vocab.merged[rank]
        symbols[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        before[rows, k] = i  # of column w this is never read
        put(rows, j, _NONE)
        put(rows, i, leaf(rows, i))
        p = before[rows, i]
        some = (p < w) & (i > 0)
        put(rows[some], p[some], leaf(rows[some], p[some]))
        rows = rows[tree[rows, 1] != _NONE]
    flat = symbols[:, :w]
    keep = flat >= 0
    ids, ends = flat[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts as the tokenizer file's own library does, without special tokens being added."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.vocab.added, key=len, reverse=True)) or "(?!)")
        self.odd = re.compile("[\x1c-\x1f]")
        self.split = re.compile(f"[{_SPACE}]+").split
        #: Of each chunk between white space its number of tokens, ids and tokens, the last two joined by spaces.
        self.known: dict[str, tuple[int, str, str]] = {}

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def chunks(self, text: str) -> list[str]:
        """The text's chunks between white space; an added token is a chunk of its own, marked by its first character."""
        if not self.special.search(text):
            text = self.normal(text)
            return [c for c in self.split(text) if c] if self.odd.search(text) else text.split()
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append("\n" + m[0])
            at = m.end()
        return out + self.chunks(text[at:])

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of pre-tokenised words."""
        v, out = self.vocab, {}
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        for low, high in ((1, 1), (2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, SHORT)):
            at = np.flatnonzero((sizes >= low) & (sizes <= high))
            for part in np.array_split(at, len(at) // 20_000 + 1):
                if not len(part):
                    continue
                n = sizes[part]
                table = np.zeros((len(part), high), np.uint8)
                table[np.arange(high) < n[:, None]] = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                symbols = np.where(np.arange(high) < n[:, None], v.byte_ids[table], -1)
                rows = np.arange(len(part))
                symbols[rows, n - 1] = v.last_ids[table[rows, n - 1]]
                for i, ids in zip(part.tolist(), encode_forest(v, symbols, n), strict=True):
                    out[words[i]] = ids
        for i in np.flatnonzero(sizes > SHORT).tolist():
            b = np.frombuffer(raw[i], np.uint8)
            out[words[i]] = encode_long(v, [*v.byte_ids[b[:-1]].tolist(), int(v.last_ids[b[-1]])])
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes chunks that the cache doesn't have."""
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
        find, tokens = _pieces().findall, self.vocab.tokens
        pieces = {c: find(c) for c in new if c[0] != "\n"}
        known = self.words(list({p for ps in pieces.values() for p in ps}))
        for c in new:
            ids = [i for p in pieces[c] for i in known[p]] if c[0] != "\n" else [self.vocab.added[c[1:]]]
            self.known[c] = len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of every text the number of tokens, the ids joined by spaces and the decoded text."""
        split = [self.chunks(t) for t in texts]
        found = [list(map(self.known.get, cs)) for cs in split]
        if new := {c for cs, es in zip(split, found, strict=True) if None in es for c, e in zip(cs, es, strict=True) if e is None}:
            self.learn(list(new))
            get = self.known.get
            for cs, es in zip(split, found, strict=True):
                if None in es:
                    es[:] = [e or get(c) for c, e in zip(cs, es, strict=True)]
        return [(sum([e[0] for e in es]), " ".join([e[1] for e in es]), " ".join([e[2] for e in es])) for es in found]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.run([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as for a tokenizer file that names no decoder; unknown ids are left out."""
        return " ".join(self.vocab.tokens[i] for i in ids if i in self.vocab.tokens)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _map(docs: DataFrame, path: str, schema: str, row, id_col: str, text_col: str) -> DataFrame:
    kind = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names, kinds = zip(*((n, kind[t]) for n, t in (f.split() for f in schema.split(", "))), strict=True)
        for b in sub_batches(batches, "text", 4 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            cols = list(zip(*(row(x) for x in enc.run(texts)), strict=True)) or [[]] * (len(names) - 1)
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, map(list, cols), kinds[1:])], list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def encode_table(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): one row per input row. Null counts as the empty text, which has no ids."""
    return _map(docs, path, "doc_id long, ids array<int>, decoded string", lambda x: ([int(i) for i in x[1].split()], x[2]), id_col, text_col)


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): one row per input row, repeats and null ids included.

    Null and empty texts have no tokens and the digests of the empty text. Columns other than the two named are ignored.
    """
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _map(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda x: (x[0], sha(x[1]), sha(x[2])), id_col, text_col)
