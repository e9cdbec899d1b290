"""Byte-level BPE encoding with a pair occurrence index, and decoding.

The distinct pieces of a task's texts lie end to end in one array of symbols. An index gives, for
each mergeable pair, all its positions there. Ranks that occur are applied in ascending order, each to
all its positions at once; the pairs that arise left and right of a merge join their own lists.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from clausegrid.llm.common import bound_batches

# How published byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Pieces and distinct pieces gathered before they are encoded together; both bound a task's memory.
BATCH_PIECES = 2_000_000
KNOWN_PIECES = 120_000


def byte_characters() -> dict[str, int]:
    """The visible character that stands for each byte in a vocabulary file, and its byte.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, for U+0100 onwards.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _newer_letters() -> str:
    """Letters and numbers of the regex module that the published splitter does not know as such.

    Both follow Unicode, in different versions. Only characters that this Python leaves unassigned can
    differ; the splitter of the tokenizers library is asked about each of them.
    """
    known = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    everything = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    ranges: list[list[int]] = []
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        for char in regex.findall(kind, everything):
            if unicodedata.category(char) != "Cn" or len(known(before + char)) == 1:
                continue
            c = ord(char)
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Vocabulary:
    """Tables of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or spec["normalizer"] or split.get("add_prefix_space") or any(model.get(o) for o in options):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens of an unknown kind")
        chars, vocab = byte_characters(), model["vocab"]
        to_bytes = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        to_bytes |= {i: token.encode() for token, i in self.specials.items()}
        self.bytes_of = [to_bytes.get(i, b"") for i in range(max(to_bytes) + 1)]
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        made = np.full(len(self.bytes_of), -1)
        made[self.product] = np.arange(len(pairs))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} merges a token before it can arise; ranks can't be applied in turn")
        self.doubled = left == right
        order = np.argsort(left << 32 | right)
        self.keys, self.rank_of_key = (left << 32 | right)[order], order.astype(np.int32)
        self.pieces = regex.compile(PIECES)
        newer = _newer_letters()
        self.newer = regex.compile(f"[{newer}]") if newer else None
        older = PIECES.replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{newer}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{newer}]]+")
        older = older.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        self.older_pieces = regex.compile(older, regex.V1) if newer else self.pieces
        special = sorted(map(regex.escape, self.specials), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(special) + ")") if special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def split(self, text: str) -> list[str]:
        """The pieces of a text; a special token is a piece of its own."""
        if self.special and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self._ordinary(part))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[str]:
        if text.isascii() or self.newer is None or not self.newer.search(text):
            return self.pieces.findall(text)
        return self.older_pieces.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(pieces) else 0
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        # Position n stands for "none": after a piece's last symbol, and before its first.
        symbol = np.append(self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - lengths] = n, n
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, NONE)
        inner = np.flatnonzero(after[:n] < n).astype(np.int32)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        listed = inner[rank[inner] != NONE]
        listed = listed[np.argsort(rank[listed], kind="stable")]
        present, starts = np.unique(rank[listed], return_index=True)
        index: dict[int, list[np.ndarray]] = {}
        for r, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(listed)]):
            index[r] = [listed[a:b]]
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == r]
            if self.doubled[r]:
                at = self._apart(np.unique(at), after)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.product[r]
            after[at], before[beyond] = beyond, at
            rank[gone], alive[gone] = NONE, False
            touched = np.unique(np.concatenate((at, before[at])))
            touched = touched[: np.searchsorted(touched, n)]
            right = after[touched]
            new = self.ranks(symbol[touched], symbol[right])
            rank[touched] = new
            some = new != NONE
            if some.any():
                new, touched = new[some], touched[some]
                order = np.argsort(new, kind="stable")
                new, touched = new[order], touched[order]
                cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
                for a, b in zip(cuts, cuts[1:]):
                    k = int(new[a])
                    if k in index:
                        index[k].append(touched[a:b])
                    else:
                        index[k] = [touched[a:b]]
                        heapq.heappush(active, k)
        counts = np.add.reduceat(alive[:n].astype(np.int64), ends - lengths)
        return symbol[:n][alive[:n]], counts

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences of a pair of equal symbols, those that a pass from the left takes."""
        kept, taken = [], -1
        for p, q in zip(at.tolist(), after[at].tolist()):
            if p != taken:
                kept.append(p)
                taken = q
        return np.array(kept, np.int32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Encoder:
    """Numbers the pieces of texts and keeps the ids of those it has met, up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        pieces = self.vocab.split(text)
        number = self.number
        for p in set(pieces).difference(number):
            number[p] = len(number)
            self.new.append(p)
        return np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces))

    def _learn(self):
        special = self.vocab.specials
        ids, counts = self.vocab.encode_pieces([p.encode() for p in self.new if p not in special])
        if any(p in special for p in self.new):  # rare: put them in their places among the others
            ids_of = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            lists = [np.array([special[p]], np.int32) if p in special else next(ids_of) for p in self.new]
            ids, counts = np.concatenate(lists), np.array([len(x) for x in lists])
        self.start = np.append(self.start, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.ids = np.append(self.ids, ids.astype(np.int32))
        self.new = []

    def flush(self, waiting: list[np.ndarray]) -> list[bytes]:
        if self.new:
            self._learn()
        out = []
        for numbers in waiting:
            counts = self.count[numbers]
            shift = self.start[numbers] - (np.cumsum(counts) - counts)
            out.append(self.ids[np.repeat(shift, counts) + np.arange(counts.sum())].astype("<u4").tobytes())
        if len(self.number) > KNOWN_PIECES:
            self._forget()
        return out


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Stretches of rows: their columns but the last, the text, and the packed ids of each text."""
    encoder = _Encoder(vocabulary(path))
    waiting, rows, pieces = [], [], 0

    def done():
        table = pa.Table.from_batches(rows).combine_chunks()
        return [c.chunk(0) for c in table.columns], encoder.flush(waiting)

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            for text in part.column(part.num_columns - 1).to_pylist():
                waiting.append(encoder.numbers(text or ""))
                pieces += len(waiting[-1])
            # A copy, so that the texts of the whole batch are not held along.
            rows.append(part.select(list(range(part.num_columns - 1))).take(pa.array(range(part.num_rows))))
            if pieces >= BATCH_PIECES or len(encoder.number) > KNOWN_PIECES:
                yield done()
                waiting, rows, pieces = [], [], 0
    if rows:
        yield done()


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: token ids of ``text``, packed as little-endian unsigned 32-bit.

    As the tokenizers library encodes without adding special tokens; their strings in a text are the
    special tokens. Null or empty text: no ids. One row per row of ``docs``, repeated rows included;
    other columns are not read. ``path`` must be readable on every executor. A task holds the distinct
    pieces of its texts up to ``KNOWN_PIECES`` (then it forgets them) and one very long text at a time.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*(F.col(c) for c in keep), F.col("text").alias("__text"))
    schema = kept.drop("__text").withColumn("ids", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, packed in _encoded(batches, path):
            out = pa.Table.from_arrays([*columns, pa.array(packed, pa.binary())], names=schema.names)
            yield from out.to_batches(max_chunksize=1000)

    return kept.mapInArrow(run, schema)


def decoded(vocab: Vocabulary, packed: bytes) -> str:
    ids = np.frombuffer(packed, "<u4")
    known = vocab.bytes_of
    return b"".join(map(known.__getitem__, ids[ids < len(known)].tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its packed ``ids``; special tokens become their strings.

    Bytes that are no UTF-8 become U+FFFD. Null ids, or none: the empty text. Ids the vocabulary
    lacks stand for nothing.
    """
    schema = encoded.withColumn("decoded", F.lit("")).schema
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decoded(vocab, packed.as_py() or b"") for packed in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens``, and SHA-256 of the packed ids and of the text decoded from them.

    ``encode`` and ``decode`` in one pass over the texts: neither ids nor decoded texts leave the task.
    Rows as in ``encode``.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*(F.col(c) for c in keep), F.col("text").alias("__text"))
    schema = kept.drop("__text").select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for columns, packed in _encoded(batches, path):
            new = [
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([sha256(decoded(vocab, p).encode()).hexdigest() for p in packed], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=schema.names)

    return kept.mapInArrow(run, schema)
