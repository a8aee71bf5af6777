"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can stand last in the encoding of that prefix. The table of these
last tokens is all that encoding needs: following it back from the end gives the ids, appending bytes only
extends it, and after an edit only the pieces near the edit are done again.

Behaviour at the edges: null text counts as empty and gives no ids; ties between merges of the same rank go to the
leftmost, as in the reference library; repeated rows each give their own result row; texts of any length are encoded whole; empty tables give no
rows; other columns pass through encode_documents, but one that bears the name of a result is an error, and are ignored by digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from caseworks.llm.memory import Memo, held, until_idle
from caseworks.llm.workspace import ship

#: Token pairs judged that a worker keeps. It bounds memory only; results do not depend on it.
PAIRS_KEPT = 200_000
#: Bytes for stretches, and for other pieces, that a worker remembers.
STRETCH_BYTES, PIECE_BYTES = 64_000_000, 8_000_000
#: Tables of the first bytes of pieces are kept, and extended: so many bytes, and so much memory.
BEGIN, BEGIN_MEMORY = 7, 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of text, each on its own, by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self._endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._endings.add_word(token.decode("latin-1"), (len(token), rank))
        self._endings.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._stands: dict[int, bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._begun = Memo(lambda begin: self.extend(begin, []), BEGIN_MEMORY)

    def merged(self, piece: bytes) -> list[int]:
        """Ids by repeated merging of the lowest-ranked neighbours: the definition that validity of tokens and pairs refers to."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        known = self._stands.get(token)
        if known is None:
            known = self._stands[token] = self.merged(self.tokens[token]) == [token]
        return known

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merging gives this one, (token, token) for a single byte; None if merging doesn't give it or a part ranks behind it."""
        if token in self._splits:
            return self._splits[token]
        bytes_, found = self.tokens[token], None
        if len(bytes_) == 1:
            found = (token, token)
        elif self._reachable(token):
            for at in range(1, len(bytes_)):
                left, right = self.ranks.get(bytes_[:at], self.size), self.ranks.get(bytes_[at:], self.size)
                if left < token and right < token and self.merged(bytes_[:at]) == [left] and self.merged(bytes_[at:]) == [right] and self._parted(left, right, token):
                    found = (left, right)
                    break
        self._splits[token] = found
        return found

    def _parted(self, left: int, right: int, limit: int) -> bool | None:
        """Whether nothing ranked before limit merges across the border of two tokens while they come about; None if a split is unknown.

        The inner tokens at the border are taken apart in the reverse order of their merging, and each pair that met there is looked up.
        """
        tokens, get, a, b = self.tokens, self.ranks.get, left, right
        while True:
            if get(tokens[a] + tokens[b], self.size) < limit:
                return False
            of_a, of_b = self._split(a), self._split(b)
            if of_a is None or of_b is None:
                return None
            if of_a[1] == a and of_b[0] == b:
                return True
            if of_b[0] == b or (of_a[1] != a and a > b):
                limit, a = a, of_a[1]
            else:  # of equal rank the one across the border comes first, as the leftmost
                limit, b = b + 1, of_b[0]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives back just these two."""
        good = self._parted(left, right, self.size)
        if good is None:
            good = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]  # so both tokens can be reached, too
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        self._pairs[left * self.size + right] = good
        return good

    def extend(self, piece: bytes, table: list[int]) -> list[int]:
        """Add to the table the last tokens of the prefixes that it lacks; entry i is for the first i + 1 bytes."""
        known, size, done = self._pairs.get, self.size, len(table)
        for last, (length, token) in self._endings.iter(piece.decode("latin-1")):  # every token that ends at each byte
            if last != done:
                if last < done:  # this prefix has its token
                    continue
                break
            if length > last:
                good = self._reachable(token)
            else:
                left = table[last - length]
                good = known(left * size + token)
                if good is None:
                    good = self._adjacent(left, token)
            if good:
                table.append(token)
                done += 1
        if len(table) != len(piece):
            raise ValueError("the vocabulary lacks a single byte")
        return table

    def ids_from(self, table: list[int]) -> list[int]:
        """Follow the last tokens back from the end."""
        out, end = [], len(table)
        while end:
            out.append(table[end - 1])
            end -= len(self.tokens[table[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is a token stays one, reachable or not
        if whole is not None:
            return [whole]
        return self.ids_from(self.extend(piece, self._begun[piece[:BEGIN]].copy() if len(piece) > BEGIN else []))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """A text with its prefix tables, which can be appended to and edited; ids() always equals a fresh encoding."""

    #: A match can depend on so many characters after its end: an apostrophe and two letters, or the space and the next character after a run of spaces.
    LOOKAHEAD = 3

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.tables: list[list[int]] = []
        self.redone = 0
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put new for text[start:stop]; only pieces that may see the change are encoded again."""
        old_ends, old_tables, old = self.ends, self.tables, self.text
        keep = 0
        while keep < len(old_ends) and old_ends[keep] + self.LOOKAHEAD <= start:
            keep += 1
        self.text = old[:start] + new + old[stop:]
        shift = len(self.text) - len(old)
        later = {end + shift: k for k, end in enumerate(old_ends) if end >= stop}
        self.ends, self.tables, self.redone = old_ends[:keep], old_tables[:keep], 0
        at = self.ends[-1] if keep else 0
        # The piece that holds the change may only have grown: its table is then extended, not made anew.
        grown = (old[at : old_ends[keep]].encode(), old_tables[keep]) if keep < len(old_ends) else (b"", [])
        for match in self.encoder.pattern.finditer(self.text, at):
            piece = match.group().encode()
            table = list(grown[1]) if match.start() == at and grown[0] and piece.startswith(grown[0]) else []
            self.tables.append(self.encoder.extend(piece, table))
            self.ends.append(match.end())
            self.redone += 1
            if match.end() >= start + len(new) and match.end() in later:  # from here on the old pieces hold
                k = later[match.end()] + 1
                self.ends += [end + shift for end in old_ends[k:]]
                self.tables += old_tables[k:]
                break

    def ids(self) -> list[int]:
        out, begin = [], 0
        for end, table in zip(self.ends, self.tables, strict=True):
            whole = self.encoder.ranks.get(self.text[begin:end].encode())
            out += [whole] if whole is not None else self.encoder.ids_from(table)
            begin = end
        return out


class TextEncoder:
    """Encodes whole texts to ids as little-endian 32-bit bytes; remembers pieces, and stretches between single spaces, that it has seen."""

    #: A space with white space beside it, or white space other than space and line feed: such texts are split by the pattern alone.
    IRREGULAR = regex.compile(r" \s|\n |[^\S \n]")

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        self.pieces = Memo(self._piece, PIECE_BYTES)
        self.stretches = Memo(self._stretch, STRETCH_BYTES)

    def _piece(self, piece: str) -> bytes:
        ids = self.encoder.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, stretch: str) -> bytes:
        """Of a stretch that a single space precedes; the space belongs to its first piece. A stretch that is one piece is remembered as that only."""
        spaced = " " + stretch
        if stretch.isascii() and stretch.isalpha():  # one piece by the pattern
            return self._piece(spaced)
        first, *rest = self.encoder.pattern.findall(spaced)
        if not rest:
            return self._piece(spaced)
        return b"".join([self.stretches[first[1:]], *map(self.pieces.__getitem__, rest)])

    def __call__(self, text: str) -> bytes:
        if self.IRREGULAR.search(text):
            return b"".join(map(self.pieces.__getitem__, self.encoder.pattern.findall(text)))
        first, *rest = text.split(" ")
        head = b"".join(map(self.pieces.__getitem__, self.encoder.pattern.findall(first)))
        return head + b"".join(map(self.stretches.__getitem__, rest))


def _packed(path: str, pattern: str) -> TextEncoder:
    return held(f"bpe {path} {pattern}", lambda: TextEncoder(PrefixEncoder(read_ranks(path), pattern)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with ids (packed little-endian unsigned 32-bit), n_tokens and round_trip (the decoded ids are the text) in place of text."""
    ship(docs.sparkSession)
    if clash := {"ids", "n_tokens", "round_trip"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(clash)} would be overwritten; rename them first")
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _packed(ranks_path, pattern)
        token_of = known.encoder.tokens.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                ids = [known(t) for t in texts]
                same = [b"".join(map(token_of, memoryview(x).cast("I"))) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=[*rest, "ids", "n_tokens", "round_trip"])

    kept = docs.select(*rest, "text")
    schema = StructType([*kept.schema.fields[:-1], StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])
    return kept.mapInArrow(until_idle(run), schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As encode_decode, with counts and digests in place of ids and bytes, so that these do not leave the worker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _packed(ranks_path, pattern)
        token_of = known.encoder.tokens.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = known(text.as_py() or "")
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids))
                of_bytes.append(sha(b"".join(map(token_of, memoryview(ids).cast("I")))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(until_idle(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
