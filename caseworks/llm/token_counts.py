"""Token counts by rank-synchronous merging of ragged arrays.

All new pre-tokens of a batch lie end to end in one array of symbols. Each round finds the lowest-ranked pair of every
sequence and merges it in all sequences at once; the symbols that survive are the tokens.

Behaviour at the edges: null text counts as empty; strings of special tokens inside a text are special tokens, as is the
library's default; repeated rows each give a row; texts of any length are counted whole; equal ranks merge from the left; columns beside doc_id and
text are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from caseworks.llm.memory import BUDGET, SLOT, held
from caseworks.llm.workspace import ship

_NONE = np.int64(1) << 40


class WordBpe:
    """Counts tokens under a word-ending BPE given as a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, model = path, spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # Printable stand-ins of bytes: those that print as themselves, then the others in order from U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        stand = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.inner = np.array([vocab[stand[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[stand[b] + suffix] for b in range(256)], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        rules = [(vocab[a] * int(self.base) + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        rules.sort()
        self.keys, self.rank, self.into = (np.array(x, np.int64) for x in zip(*rules, strict=True))
        # Merging all places of a pair at once is the same as one at a time if no rule with a token comes before the rule that makes it.
        made: dict[int, int] = {}
        for _, rank, new in rules:
            made[new] = max(rank, made.get(new, 0))
        self.ordered = all(made.get(int(k // self.base), -1) < r and made.get(int(k % self.base), -1) < r for k, r in zip(self.keys, self.rank, strict=True))
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        self.unusual = regex.compile(r"[^\u0000-ӿ]")
        self.space = regex.compile(r"\s+")
        self._library = None
        self.spent = 0

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Normalised pre-tokens, and the number of special tokens."""
        found = [*self.special.finditer(text)]
        if found:
            edges = [0, *(e for m in found for e in m.span()), len(text)]
            parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            return [p for part in parts for p in self._pieces(part)], len(found)
        return self._pieces(text), 0

    def _pieces(self, text: str) -> list[str]:
        if self.unusual.search(text):  # scripts for which Unicode versions differ: normalise and split by the library's own tables
            if self._library is None:
                from tokenizers import Regex, Tokenizer, pre_tokenizers

                self._library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.split.pattern), "removed", invert=True)
            normal, split = self._library
            return [p for p, _ in split.pre_tokenize_str(normal.normalize_str(text))]
        return self.split.findall(self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower())

    def _ranks(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = sym[:-1] * self.base + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], _NONE), self.into[at]

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        counts = np.array([len(p) for p in pieces], np.int64)
        rows = np.flatnonzero(counts)
        if not len(rows):
            return counts
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = counts[rows]
        sym = self.inner[flat]
        ends = np.cumsum(lengths)
        sym[ends - 1] = self.final[flat[ends - 1]]
        while len(rows):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
            if len(sym) > 1:
                rank[:-1], into[:-1] = self._ranks(sym)
            rank[starts + lengths - 1] = _NONE  # the next symbol belongs to another sequence
            least = np.minimum.reduceat(rank, starts)
            counts[rows] = lengths
            going = least < _NONE
            if not going.any():
                break
            owner = np.repeat(np.arange(len(rows)), lengths)
            hit = (rank == least[owner]) & going[owner]
            if self.ordered:
                # In a run of neighbouring hits (the same symbol again and again) every second one merges, from the left.
                place = np.flatnonzero(hit)
                first = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(owner[place]) > 0)])
                run = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
                place = place[(place - run) % 2 == 0]
            else:
                place = np.flatnonzero(hit)
                place = place[np.concatenate([[True], np.diff(owner[place]) > 0])]
            sym[place] = into[place]
            stay = going[owner]
            stay[place + 1] = False
            lengths = lengths - np.bincount(owner[place], minlength=len(rows))
            counts[rows] = lengths
            sym, rows, lengths = sym[stay], rows[going], lengths[going]
        return counts

    def count(self, texts: list[str], known: dict[str, int]) -> list[int]:
        """Token counts of texts; known holds counts of pre-tokens seen before and is added to."""
        split = [self.pieces(t) for t in texts]
        new = [*{p for pieces, _ in split for p in pieces if p not in known}]
        here = dict(zip(new, self.survivors([p.encode() for p in new]).tolist(), strict=True))
        known.update(here)
        counts = [sum(map(known.__getitem__, pieces)) + extra for pieces, extra in split]
        self.spent += sum(SLOT + sys.getsizeof(p) for p in new)
        if self.spent > BUDGET:  # begin anew: what is frequent comes back at once
            known.clear()
            self.spent = 0
        return counts


def _model(path: str) -> tuple[WordBpe, dict[str, int]]:
    return held(f"token counts {path}", lambda: (WordBpe(path), {}))


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens above the limit) of each whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(vocabulary_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = model.count(texts, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
