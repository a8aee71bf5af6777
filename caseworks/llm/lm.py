"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

A text is its words, A-Z in lower case, each led by a space and encoded by the lowest ranks of a public byte-level vocabulary; an end
mark begins and ends the sequence. A subword enters the model as its own vector and hashed vectors of the last two and three subwords. One
attention layer looks back over a window: queries meet keys, distances are a learned bias, what lies ahead is masked. The output is a
two-level softmax (group, then member). Windows overlap by half: each token is scored once, with at least a stride of context where there
is as much. The score of a text is the sum of these logarithms and nothing else.

Every window of every training text trains the model. Texts are dealt over rounds by hash; in a round each task trains on its share from
common weights, and the weights are then averaged, rows of the tables by how much each task has learned about them. Texts are read again
each round, so that no table of windows is written. The same passes count the words. Beside the score stands a smoothed unigram score from
exact counts of all words in all training documents: the counts of the FREQUENT commonest words (a bounded list) are sent to all tasks, the
other words meet their counts in a join. The list is a matter of speed: no result depends on it.

Behaviour at the edges: null text counts as empty and has the end mark only; rows without identifier are training rows; rows that repeat
are counted and scored each; texts of any length are cut into windows and never shortened; equal counts at the edge of the list go in or
stay out together; columns other than doc_id and text are ignored, whatever their names; without training rows the counts are 0 and the model is its initial one; empty
tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseworks.llm.bpe import read_ranks
from caseworks.llm.memory import held, reuse_freed, trim
from caseworks.llm.workspace import drop, settle, ship

#: So many ranks and the end mark fill the groups of the output.
RANKS = 2047
GROUPS, MEMBERS, WIDTH, KEY, STRIDE = 32, 64, 16, 8, 8
VOCAB = GROUPS * MEMBERS
#: Rows for hashed pairs and triples of subwords.
PAIRS, TRIPLES = 1 << 15, 1 << 16
#: Commonest words whose counts are sent to every task; words of which a task remembers the subwords.
FREQUENT, WORDS_KEPT = 200_000, 400_000
#: Windows of a step, at most and at least; windows that a task holds to mix them; times that windows which all fit there are gone through.
BATCH, SMALL_BATCH, MIXED, PASSES = 1024, 64, 65_536, 3
#: Learning rate of each round; rates of tables relative to it.
RATES, TABLE_RATE = (0.02, 0.015, 0.008, 0.003), 20.0
#: Bytes of text for each training task, over all rounds.
TASK_BYTES = 16_000_000
FAN_IN = 16
#: Texts handled, and windows scored, in one go: as many as caches hold.
TEXTS, CHUNK = 128, 512
END, PAD = 0, VOCAB
#: Rows of a group that the output handles in one go, all of whose numbers stay in a core's cache.
ROWS = 1024
#: Bounds on products and on biases: sums of exponentials of as much stay finite in single precision.
LARGEST, LARGEST_BIAS = np.float32(60), 20.0
DENSE = {"r": (2 * STRIDE,), "wg": (WIDTH, GROUPS), "bg": (GROUPS,), "wm": (GROUPS, WIDTH, MEMBERS), "bm": (GROUPS, MEMBERS)}
#: Tables of vectors; own and context end with a query and a key.
TABLES = {"own": (VOCAB + 1, WIDTH + KEY), "context": (VOCAB + 1, WIDTH + KEY), "two": (PAIRS, WIDTH), "three": (TRIPLES, WIDTH)}
_BACK, _AT = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
DISTANCE, CAUSAL = np.clip(_BACK - _AT, 0, None), _AT <= _BACK


def word_hashes(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


END_HASH = word_hashes([b"\n end"])[0]
#: White space that is no plain space: words may hold what Unicode counts as such.
OTHER_SPACE = re.compile(r"[^\S ]")


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoder of words by the lowest ranks. Ids are ranks; the model's are one more, as the end mark is the first."""
    return held(f"lm {path}", lambda: tiktoken.Encoding("lowest", pat_str=pattern, mergeable_ranks={t: r for t, r in read_ranks(path).items() if r < RANKS}, special_tokens={}))


def sums_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (16 bits), and for each the sum of its rows."""
    order = np.argsort(key, kind="stable")
    sorted_key, rows = key.take(order), rows.take(order, axis=0)
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    if len(key) > 8 * len(first):  # most keys have many rows: sums along memory
        return sorted_key[first], np.ascontiguousarray(np.add.reduceat(np.ascontiguousarray(rows.T), first, axis=1).T)
    count = np.diff(np.append(first, len(key)))
    total = rows.take(first, axis=0)
    for k in range(1, 4):  # most keys have few rows
        more = np.flatnonzero(count > k)
        total[more] += rows.take(first[more] + k, axis=0)
    many = np.flatnonzero(count > 4)
    if len(many):
        edges = np.stack([first[many] + 4, first[many] + count[many]], axis=1).ravel()
        total[many] += np.add.reduceat(rows, edges if edges[-1] < len(rows) else edges[:-1], axis=0)[::2]
    return sorted_key[first], total


class Weights:
    """Arrays of the model: DENSE ones, TABLES, and for each row of a table what adaptive steps have added up (`seen`)."""

    def __init__(self, dense: dict[str, np.ndarray], tables: dict[str, np.ndarray], seen: dict[str, np.ndarray]):
        self.dense, self.tables, self.seen = dense, tables, seen

    @classmethod
    def initial(cls, seed: int = 5) -> Weights:
        rng = np.random.default_rng(seed)
        draw = lambda shape, spread: rng.normal(0, spread, shape).astype(np.float32)
        dense = {k: draw(s, 0.1) if k[0] == "w" else np.zeros(s, np.float32) for k, s in DENSE.items()}
        tables = {k: draw(s, 0.3) if k in ("own", "context") else np.zeros(s, np.float32) for k, s in TABLES.items()}
        return cls(dense, tables, {k: np.zeros(s[0], np.float32) for k, s in TABLES.items()})

    def pack(self) -> bytes:
        """Tables in half precision, the rest in single."""
        return b"".join([*(self.dense[k].astype("<f4").tobytes() for k in DENSE), *(self.seen[k].astype("<f4").tobytes() for k in TABLES), *(np.clip(self.tables[k], -6e4, 6e4).astype("<f2").tobytes() for k in TABLES)])

    @classmethod
    def unpack(cls, packed: bytes) -> Weights:
        at = 0

        def some(shape: tuple[int, ...], kind: str) -> np.ndarray:
            nonlocal at
            size = int(np.prod(shape))
            found = np.frombuffer(packed, kind, size, at).reshape(shape).astype(np.float32)
            at += found.size * np.dtype(kind).itemsize
            return found

        dense = {k: some(s, "<f4") for k, s in DENSE.items()}
        seen = {k: some(s[:1], "<f4") for k, s in TABLES.items()}
        return cls(dense, {k: some(s, "<f2") for k, s in TABLES.items()}, seen)


class Mean:
    """Mean of weights: dense arrays by tokens, rows of tables by what was seen of them since `start`."""

    def __init__(self, start: Weights):
        self.start, self.n = start, 0.0
        self.dense = {k: np.zeros(s) for k, s in DENSE.items()}
        self.tables, self.seen, self.gain = ({k: np.zeros(s if wide else s[0]) for k, s in TABLES.items()} for wide in (True, False, False))

    def add(self, n: float, of: Weights, gains: dict[str, np.ndarray]) -> None:
        self.n += n
        for k in DENSE:
            self.dense[k] += n * of.dense[k]
        for k in TABLES:
            self.tables[k] += gains[k][:, None] * of.tables[k]
            self.seen[k] += gains[k] * of.seen[k]
            self.gain[k] += gains[k]

    def result(self) -> Weights:
        seen, tables = {}, {}
        for k in TABLES:
            some = self.gain[k] > 0
            by = np.where(some, self.gain[k], 1)
            tables[k] = np.where(some[:, None], self.tables[k] / by[:, None], self.start.tables[k]).astype(np.float32)
            seen[k] = np.where(some, self.seen[k] / by, self.start.seen[k]).astype(np.float32)
        return Weights({k: (v / self.n).astype(np.float32) for k, v in self.dense.items()}, tables, seen)


def hashed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `two` and `three` for each of the last STRIDE inputs of the windows."""
    last, before, third = (windows[:, STRIDE - k : 2 * STRIDE - k].astype(np.uint32) for k in range(3))
    pair = last * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA6B)
    pair ^= pair >> np.uint32(15)
    pair *= np.uint32(0x2C1B3C6D)
    triple = pair + third * np.uint32(0xC2B2AE35)
    triple ^= triple >> np.uint32(16)
    triple *= np.uint32(0x297A2D39)
    return (pair >> np.uint32(17)).astype(np.uint16).ravel(), (triple >> np.uint32(16)).astype(np.uint16).ravel()


class Attention:
    """The model over windows (n, 2 * STRIDE) whose last STRIDE inputs are asked for what follows them."""

    def __init__(self, weights: Weights):
        self.w = weights
        self.blank = np.zeros(VOCAB + 1, np.float32)
        self.blank[PAD] = -1e9
        self.starts = np.arange(ROWS) * (MEMBERS + GROUPS)

    def states(self, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """State after the layer for each asking input, one after another, and what led to it."""
        tables, asks = self.w.tables, windows[:, STRIDE:]
        own, context = tables["own"].take(asks, axis=0), tables["context"].take(windows, axis=0)
        two, three = hashed(windows)
        share = own[:, :, WIDTH:] @ context[:, :, WIDTH:].transpose(0, 2, 1)
        share += np.where(CAUSAL, self.w.dense["r"][DISTANCE], np.float32(-1e9))
        share += self.blank.take(windows)[:, None, :]
        if share.max(initial=0) > LARGEST:
            np.minimum(share, LARGEST, out=share)
        np.exp(share, out=share)
        flat = share.reshape(-1, 2 * STRIDE)
        flat *= (1 / (flat @ np.ones(2 * STRIDE, share.dtype) + np.float32(1e-30)))[:, None]
        state = share @ context[:, :, :WIDTH]
        state += own[:, :, :WIDTH]
        state = state.reshape(-1, WIDTH)
        state += tables["two"].take(two, axis=0)
        state += tables["three"].take(three, axis=0)
        return state, own, context, share, two, three

    def head(self, state: np.ndarray, targets: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, dict[str, np.ndarray]]:
        """Natural logarithm of each target's probability, in order of the targets' groups, and that order; to learn, also the slopes of the
        negative sum of these logarithms: of states, in that order, and of dense arrays.

        A target's group and member come out of one product, some ROWS rows of a group at a time. Only the products are raised: biases are
        factors in the sums of exponentials, which leaves no pass over all outputs for them.
        """
        dense, n, kind, wide = self.w.dense, len(targets), state.dtype, MEMBERS + GROUPS
        order = np.argsort((targets // MEMBERS).astype(np.uint16), kind="stable")
        state, targets = state.take(order, axis=0), targets.take(order)
        group, member = targets // MEMBERS, targets % MEMBERS
        both = np.concatenate([dense["wm"], np.broadcast_to(dense["wg"], (GROUPS, WIDTH, GROUPS))], axis=2)
        of_member, of_group = (np.exp(np.clip(dense[k], -LARGEST, LARGEST_BIAS)) for k in ("bm", "bg"))
        factor = np.zeros((GROUPS, wide, 2), kind)
        factor[:, :MEMBERS, 0], factor[:, MEMBERS:, 1] = of_member, of_group
        by_member, by_group = of_member.ravel().take(targets), of_group.take(group)
        edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        found, sums = np.empty((2, n), kind), np.empty((n, 2), kind)
        room = np.empty((min(n, ROWS), wide), kind)
        flat = room.ravel()
        if learn:
            back, slopes = np.empty_like(state), np.zeros((GROUPS, WIDTH + 1, wide), kind)
            states = np.concatenate([state, np.ones((n, 1), kind)], axis=1)
            turned = np.ascontiguousarray((both * factor.sum(axis=2)[:, None, :]).transpose(0, 2, 1))
            less_member, less_group = 1 / by_member, 1 / of_group
        for g in range(GROUPS):
            for a in range(edges[g], edges[g + 1], ROWS):
                b = min(a + ROWS, edges[g + 1])
                out = room[: b - a]
                np.matmul(state[a:b], both[g], out=out)
                if out.max() > LARGEST:
                    np.minimum(out, LARGEST, out=out)
                np.exp(out, out=out)
                total = np.matmul(out, factor[g], out=sums[a:b])
                place = member[a:b] + self.starts[: b - a]
                found[0, a:b] = flat.take(place)
                found[1, a:b] = out[:, MEMBERS + g]
                if learn:
                    total = 1 / total
                    out[:, :MEMBERS] *= total[:, :1]
                    out[:, MEMBERS:] *= total[:, 1:]
                    flat[place] -= less_member[a:b]
                    out[:, MEMBERS + g] -= less_group[g]
                    slopes[g] += states[a:b].T @ out
                    np.matmul(out, turned[g], out=back[a:b])
        logs = np.log(found[1] * by_group / sums[:, 1]) + np.log(found[0] * by_member / sums[:, 0] + np.float32(1e-35))
        if not learn:
            return logs, order, None, {}
        inner, outer = slopes[:, :, :MEMBERS] * of_member[:, None, :], slopes[:, :, MEMBERS:].sum(axis=0) * of_group
        return logs, order, back, {"wg": outer[:WIDTH], "bg": outer[WIDTH], "wm": inner[:, :WIDTH], "bm": inner[:, WIDTH]}

    def log_probabilities(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Of each target (n, STRIDE), one after another; 0 where there is none."""
        targets, out = targets.ravel(), np.zeros(targets.size)
        live = np.flatnonzero(targets != PAD)
        logs, order, *_ = self.head(self.states(windows)[0].take(live, axis=0), targets.take(live))
        out[live[order]] = logs
        return out

    def gradient(self, windows: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Mean loss, the slopes of dense arrays, and for each table the rows that matter with their slopes."""
        state, own, context, share, two, three = self.states(windows)
        targets = targets.ravel()
        live = np.flatnonzero(targets != PAD)
        logs, order, back, slope = self.head(state.take(live, axis=0), targets.take(live), learn=True)
        n = np.float32(max(1, len(live)))
        slope = {k: v / n for k, v in slope.items()}
        of_state = np.zeros_like(state)
        of_state[live.take(order)] = np.divide(back, n, out=back)
        by_window = of_state.reshape(-1, STRIDE, WIDTH)
        of_share = by_window @ context[:, :, :WIDTH].transpose(0, 2, 1)
        of_share *= share
        flat = of_share.reshape(-1, 2 * STRIDE)
        of_share -= share * (flat @ np.ones(2 * STRIDE, flat.dtype)).reshape(-1, STRIDE, 1)
        slope["r"] = np.bincount(DISTANCE[CAUSAL], of_share.sum(axis=0)[CAUSAL], 2 * STRIDE).astype(np.float32)
        of_own, of_context = np.empty_like(own), np.empty_like(context)
        of_own[:, :, :WIDTH] = by_window
        np.matmul(of_share, context[:, :, WIDTH:], out=of_own[:, :, WIDTH:])
        np.matmul(share.transpose(0, 2, 1), by_window, out=of_context[:, :, :WIDTH])
        np.matmul(of_share.transpose(0, 2, 1), own[:, :, WIDTH:], out=of_context[:, :, WIDTH:])
        wide = WIDTH + KEY
        touched = {
            "own": sums_by(windows[:, STRIDE:].astype(np.uint16).ravel(), of_own.reshape(-1, wide)), "context": sums_by(windows.astype(np.uint16).ravel(), of_context.reshape(-1, wide)),
            "two": sums_by(two, of_state), "three": sums_by(three, of_state),
        }
        return -float(logs.mean()) if len(live) else 0.0, slope, touched


class Learner:
    """Trains on windows (n, 3 * STRIDE: inputs, then targets) as they come: Adam for dense arrays, AdaGrad by rows for tables."""

    def __init__(self, weights: Weights, rate: float, seed: int):
        self.model, self.rate, self.rng = Attention(weights), rate, np.random.default_rng(seed)
        self.before = {k: v.copy() for k, v in weights.seen.items()}
        self.first, self.second, self.room = ({k: np.zeros_like(v) for k, v in weights.dense.items()} for _ in range(3))
        self.steps, self.windows, self.waiting, self.ready, self.losses = 0, 0, [], 0, []

    def add(self, windows: np.ndarray) -> None:
        self.waiting.append(windows)
        self.ready += len(windows)
        if self.ready >= MIXED:
            self._go_through(1)

    def finish(self) -> None:
        if self.ready:
            self._go_through(1 if self.steps else PASSES)

    def _go_through(self, passes: int) -> None:
        held = np.concatenate(self.waiting)
        self.waiting, self.ready, self.windows = [], 0, self.windows + len(held)
        size = int(np.clip(len(held) // 32, SMALL_BATCH, BATCH))
        for _ in range(passes):
            order = self.rng.permutation(len(held))
            for start in range(0, len(order), size):
                part = held.take(order[start : start + size], axis=0).astype(np.int32)
                self._step(part[:, : 2 * STRIDE], part[:, 2 * STRIDE :])

    def _step(self, windows: np.ndarray, targets: np.ndarray) -> None:
        weights = self.model.w
        loss, slope, touched = self.model.gradient(windows, targets)
        self.steps += 1
        self.losses.append(loss)
        for k, g in slope.items():
            first, second, room = self.first[k], self.second[k], self.room[k]
            first *= np.float32(0.9)
            first += np.multiply(g, np.float32(0.1), out=room)
            second *= np.float32(0.98)
            g *= g
            second += np.multiply(g, np.float32(0.02), out=room)
            np.sqrt(np.multiply(second, np.float32(1 / (1 - 0.98**self.steps)), out=room), out=room)
            room += np.float32(1e-8)
            np.divide(first, room, out=room)
            room *= np.float32(self.rate / (1 - 0.9**self.steps))
            weights.dense[k] -= room
        n = np.float32((targets != PAD).sum())
        for k, (rows, g) in touched.items():
            g *= n
            seen, table = weights.seen[k], weights.tables[k]
            now = seen.take(rows) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
            seen[rows] = now
            g *= (np.float32(-TABLE_RATE * self.rate) / np.sqrt(now + np.float32(0.01)))[:, None]
            g += table.take(rows, axis=0)
            table[rows] = g

    def gains(self) -> dict[str, np.ndarray]:
        return {k: self.model.w.seen[k] - self.before[k] for k in TABLES}


def blocks(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, 2 * STRIDE), overlapping by half, and the targets that each scores (n, STRIDE; PAD where there is none).

    tokens holds the targets of all texts one after another, each text's end mark last, lengths how many each text has. The
    inputs of a text are the end mark and its targets but the last.
    """
    parts = -(-lengths // STRIDE)
    first = np.cumsum(parts) - parts
    place = np.repeat(first * STRIDE - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(tokens))
    goals, inputs = (np.full(parts.sum() * STRIDE, PAD, np.int32) for _ in range(2))
    goals[place] = tokens
    inputs[place[1:]] = tokens[:-1]
    inputs[first * STRIDE] = END
    inputs = inputs.reshape(-1, STRIDE)
    before = np.concatenate([np.full((1, STRIDE), PAD, np.int32), inputs[:-1]])
    before[first] = PAD
    return np.concatenate([before, inputs], axis=1), goals.reshape(-1, STRIDE)


class Numbers(dict):
    """Numbers of words by when they first came, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class Words:
    """Words by number, with arrays of what is looked up for each; number 0 is the end mark."""

    def __init__(self, encoder: tiktoken.Encoding, listed: np.ndarray | None = None, times: np.ndarray | None = None):
        """listed: sorted hashes of words whose counts are known, times: these counts."""
        self.encoder, self.listed, self.times = encoder, listed, times
        self.of = Numbers()
        #: Whether an id's bytes begin with a space, as the first one of each word and no other does.
        self.leads = np.array([encoder.decode_single_token_bytes(k)[:1] == b" " for k in range(encoder.n_vocab)])
        self.hash, self.size, self.start = np.array([END_HASH]), np.ones(1, np.int64), np.zeros(1, np.int64)
        self.pool, self.used = np.array([END], np.uint16), 1
        self.count = self._counts(self.hash)

    def _counts(self, hashes: np.ndarray) -> np.ndarray:
        if self.listed is None or not len(self.listed):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.listed, hashes), len(self.listed) - 1)
        return np.where(self.listed[at] == hashes, self.times[at], 0)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        text = (b" " + b" ".join(words)).decode(errors="replace")
        if not OTHER_SPACE.search(text):  # pieces end where a plain space leads the next word, so that all words may be encoded as one text
            found = self.encoder.encode_ordinary(text)
            ids = np.fromiter(found, np.uint16, len(found))
            first = np.flatnonzero(self.leads[ids])
            if len(first) == len(words):
                return ids, np.diff(first, append=len(ids))
        lists = [self.encoder.encode_ordinary(" " + w.decode(errors="replace")) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint16, sizes.sum()), sizes

    def _add(self, words: list[bytes]) -> None:
        """words: the last ones that were given a number."""
        ids, sizes = self._encoded(words)
        ids += np.uint16(1)
        last = len(self.of) + 1
        first = last - len(words)
        if last > len(self.hash):  # grow by doubling
            self.hash, self.size, self.start, self.count = (np.concatenate([x, np.zeros(last + len(x), x.dtype)]) for x in (self.hash, self.size, self.start, self.count))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.used + 2 * len(ids), np.uint16)])
        self.hash[first:last] = word_hashes(words)
        self.count[first:last] = self._counts(self.hash[first:last])
        self.size[first:last] = sizes
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words one after another, an end mark behind each text, and the number of each text's words and mark."""
        known, before, lengths = self.of, len(self.of), np.array([len(words) + 1 for words in texts])
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], np.int64)
        is_word = np.ones(len(out), bool)
        is_word[ends - 1] = False
        out[ends - 1] = 0
        out[is_word] = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, len(out) - len(texts))
        if len(known) > before:
            self._add(list(islice(reversed(known), len(known) - before))[::-1])
        return out, lengths

    def tokens(self, numbers: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of the texts one after another, and how many each text has."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        tokens = self.pool[np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(sizes.sum())].astype(np.int32)
        return tokens, np.add.reduceat(sizes, np.cumsum(words) - words)

    @property
    def full(self) -> bool:
        return len(self.of) >= WORDS_KEPT


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: Column, parts: int = 10, part: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


LEARNED = "hash long, n long, tokens double, weights binary, gains binary"


def _learned(hashes: list[int] | np.ndarray = (), n: list[int] | np.ndarray = (), tokens: float | None = None, weights: bytes = b"", gains: bytes = b"") -> pa.RecordBatch:
    if tokens is None:
        blank = len(hashes)
        columns = [pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.nulls(blank, pa.float64()), pa.nulls(blank, pa.binary()), pa.nulls(blank, pa.binary())]
    else:
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tokens]), pa.array([weights], pa.binary()), pa.array([gains], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["hash", "n", "tokens", "weights", "gains"])


def _pack_gains(gains: dict[str, np.ndarray]) -> bytes:
    return b"".join(gains[k].astype("<f4").tobytes() for k in TABLES)


def _unpack_gains(packed: bytes) -> dict[str, np.ndarray]:
    edges = np.cumsum([0, *(s[0] for s in TABLES.values())])
    flat = np.frombuffer(packed, "<f4")
    return {k: flat[a:b] for k, a, b in zip(TABLES, edges, edges[1:], strict=False)}


def learn(docs: DataFrame, start: bytes, rate: float, path: str, pattern: str) -> DataFrame:
    """One pass over training texts: rows (hash, n) of word counts, several for a word, and from each task (tokens, weights, gains)."""
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed()
        encoder = encoding(path, pattern)
        learner, words = Learner(Weights.unpack(shared.value), rate, 11), Words(encoder)
        counts, tokens_seen = np.zeros(1, np.int64), 0

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(counts)
            return _learned(words.hash[at], counts[at])

        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                texts = [words_of(t.as_py()) for t in batch.column(0).slice(first, TEXTS)]
                if words.full:
                    yield told()
                    words, counts = Words(encoder), np.zeros(1, np.int64)
                numbers, lengths = words.numbers(texts)
                here = np.bincount(numbers, minlength=len(counts))
                here[: len(counts)] += counts
                counts = here
                tokens, sizes = words.tokens(numbers, lengths)
                tokens_seen += len(tokens)
                windows, goals = blocks(tokens, sizes)
                learner.add(np.concatenate([windows, goals], axis=1).astype(np.uint16))
        if tokens_seen:
            yield told()
            learner.finish()
            yield _learned(tokens=float(tokens_seen), weights=learner.model.w.pack(), gains=_pack_gains(learner.gains()))
        del learner, words
        trim()

    return docs.select("text").mapInArrow(run, LEARNED)


def averaged(spark: SparkSession, trained: DataFrame, start: bytes, tasks: int) -> bytes:
    """Mean of the weights in a settled table, by a tree of means: no task sees more than some FAN_IN of them."""
    shared = spark.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, packed, gains in zip(*(batch.column(k) for k in range(3)), strict=True):
                total = total or Mean(Weights.unpack(shared.value))
                total.add(n.as_py(), Weights.unpack(packed.as_py()), _unpack_gains(gains.as_py()))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([total.result().pack()], pa.binary()), pa.array([_pack_gains(total.gain)], pa.binary())], names=["tokens", "weights", "gains"])

    left, now = tasks, trained.filter("weights IS NOT NULL").select("tokens", "weights", "gains")
    made = None
    while left > 1:
        left = -(-left // FAN_IN)
        after = settle(now.repartition(left).mapInArrow(run, "tokens double, weights binary, gains binary"), "weights")
        if made is not None:
            drop(made)
        now = made = after
    found = now.select("weights").first()
    if made is not None:
        drop(made)
    return bytes(found["weights"]) if found else start


def train(docs: DataFrame, path: str, pattern: str) -> tuple[bytes, DataFrame]:
    """Packed weights after all rounds, and a settled table (hash, c) of the counts of all words, from training texts."""
    spark = docs.sparkSession
    ship(spark)
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(1, -(-volume // TASK_BYTES))
    weights, tables = Weights.initial().pack(), []
    for turn, rate in enumerate(RATES):
        share = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(RATES))) == turn).select("text")
        found = settle(learn(share.coalesce(tasks), weights, rate, path, pattern), "learned")
        tables.append(found)
        weights = averaged(spark, found, weights, tasks)
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    counts = settle(every.filter("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("c")), "word-counts")
    drop(*tables)
    return weights, counts


def score(docs: DataFrame, weights: bytes, frequent: dict[int, int], path: str, pattern: str) -> DataFrame:
    """For each row (doc_id, held_out, text): a row number, n_tokens, what frequent words add to n_known and the base score, the other words with their numbers, and the score."""
    ship(docs.sparkSession)
    order = np.array(sorted(frequent), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((weights, order, np.array([frequent[h] for h in order.tolist()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed()
        packed, order, number = shared.value
        encoder, model = encoding(path, pattern), Attention(Weights.unpack(packed))
        words = Words(encoder, order, number)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                if words.full:
                    words = Words(encoder, order, number)
                numbers, lengths = words.numbers([words_of(t.as_py()) for t in part.column(2)])
                begin = np.cumsum(lengths) - lengths
                tokens, sizes = words.tokens(numbers, lengths)
                windows, goals = blocks(tokens, sizes)
                logs = np.concatenate([model.log_probabilities(windows[k : k + CHUNK], goals[k : k + CHUNK]) for k in range(0, len(windows), CHUNK)])
                scores = np.add.reduceat(logs[goals.ravel() != PAD], np.cumsum(sizes) - sizes) / np.log(10)
                # The base: counts of words in the list, and the other words of each text with how often they stand there.
                counts = words.count[numbers]
                often = counts > 0
                base = np.add.reduceat(np.where(often, np.log10(counts + 0.1), 0.0), begin)
                rare = np.flatnonzero(~often)
                pairs, n = np.unique((np.repeat(np.arange(len(lengths)), lengths)[rare] << 32) | numbers[rare], return_counts=True)
                edges = np.searchsorted(pairs >> 32, np.arange(len(lengths) + 1)).astype(np.int32)
                others = pa.StructArray.from_arrays([pa.array(words.hash[pairs & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], names=["hash", "n"])
                known = np.add.reduceat(often.astype(np.int64), begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(lengths))), part.column(0), part.column(1), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(base), pa.ListArray.from_arrays(pa.array(edges), others), pa.array(scores)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "score"],
                )
                row += len(lengths)
        del words, model
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, rare array<struct<hash:long,n:long>>, score double")


def commonest(counts: DataFrame, most: int) -> dict[int, int]:
    """Counts of the commonest words, at most so many: all whose count reaches a level, eight levels to each doubling. No sort, and no task sees all words."""
    leveled = counts.withColumn("level", F.floor(8 * F.log2("c")))
    sizes = sorted(((r["level"], r["n"]) for r in leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held_in = None, 0
    for level, n in sizes:
        if held_in + n > most:
            break
        least, held_in = level, held_in + n
    if least is None:
        return {}
    found = leveled.filter(F.col("level") >= least).select("hash", "c").toArrow()
    return dict(zip(found["hash"].to_pylist(), found["c"].to_pylist(), strict=True))


def score_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability) of each row."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    weights, counts = train(marked.filter("NOT held_out").select("doc_id", "text"), ranks_path, pattern)
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    scored = settle(score(marked, weights, commonest(counts, FREQUENT), ranks_path, pattern), "scored")
    # Words outside the bounded list meet their counts here; a word that was never counted has c = 0.
    others = scored.select("row", F.explode("rare").alias("w")).select("row", F.col("w.hash").alias("hash"), F.col("w.n").alias("n"))
    met = others.join(counts, "hash", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("add")
    )
    base = F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.1 * (distinct + 1))))
    known = F.col("n_known") + F.coalesce("more", F.lit(0))
    out = scored.join(met, "row", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
    out = settle(out, "scores")
    drop(scored, counts)
    return out
