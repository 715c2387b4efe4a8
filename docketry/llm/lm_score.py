"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens, coded bit by bit. A token among the most frequent ones has a
code word; any other is an escape, followed by its spelling. Each bit of a code word is predicted
from hashed contexts across tokens: none, the kind of text so far, the token before, the two
tokens before, and what this text itself has done. Counts of all training tokens, summed by
Spark into tables of a fixed size, give each predictor's log odds; a gate, set by how much the
tables have seen, picks the weights that mix them; a second, interpolated table refines the
mixed probability. Weights and refinement are learnt online inside each text, from the same
start. (Starting from what training texts teach was tried: their copies teach too much trust in
rare contexts, and held-out texts lose.) Texts go side by side, a segment of each at a time.

Spellings are mixed in the same manner from contexts inside the word and the kind of text, with
weights learnt online on distinct training tokens; a word's spelling costs the same wherever the
kind is the same.

A whole segment may also be a copy: other texts of the corpus may go on so after the same
segment. Spark counts segments over the corpus for this, and a text's own occurrence is no
evidence of copying.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import crc_remainder, join_skewed, materialise, slices_by_bytes, text_bytes

END = b"\n"
#: Kinds of texts, the one more for a text's beginning, and the places of byte-pair profiles.
CLASSES, PROFILE = 8, 1024
KINDS = CLASSES + 1
#: Tokens with a code word at most; the others are spelled.
CODE_WORDS = 1 << 16
#: Segments of a text end after so many tokens, and then every SEGMENT ones.
FIRST_CUTS, SEGMENT = (16,), 64
#: Hashed slots, as powers of two, of the contexts of one and two tokens before; a text's own slots.
PAST_BITS, OWN_BITS = (20, 20), 12
#: Predictors of a code bit (none, kind, one before, two before, own) and a bias; gates of the weights; gates and cells of the refinement.
INPUTS, GATES, FINE, CELLS = 6, 32, 4, 33
PRIOR = 0.4
#: The share given to a copied segment.
COPY = 0.05

_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB), np.uint32(0x9E3779B1)
_E = np.uint32(0x85EBCA6B)
#: Texts that are mixed side by side, so that a step's arrays stay in a core's cache; bits for the place of a bit in its text's segment.
BESIDE, PLACE_BITS = 64, 13


def _chunks(n: int, size: int = 20_000) -> Iterator[tuple[int, int]]:
    yield from ((a, min(n, a + size)) for a in range(0, n, size))


def _log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + PRIOR) / (n0 + PRIOR)), -8, 8)


#: log(n + PRIOR) of every 16-bit count, and how much a count is worth as a gate.
LOG = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)
ONE = np.uint32(1)
GRADE = np.searchsorted([1, 4, 31], np.arange(1 << 17), side="right").astype(np.int8)


# ---- kinds of texts


def profile(lowered: bytes) -> np.ndarray:
    """Square roots of hashed byte-pair counts, of length one."""
    data = np.frombuffer(lowered, np.uint8)
    v = np.sqrt(np.bincount(_pairs(data), minlength=PROFILE)) if len(data) > 1 else np.zeros(PROFILE)
    return (v / np.sqrt(max(1.0, float(v @ v)))).astype(np.float32)


_PLACE = ((np.arange(1 << 16) // 256 * 257 + np.arange(1 << 16) % 256) * 2654435761 % (1 << 32) >> 22).astype(np.int32)


def _pairs(data: np.ndarray) -> np.ndarray:
    return _PLACE.take((data[:-1].astype(np.uint16) << 8) | data[1:])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's profile as the places that are not zero and their values, in 255ths."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows: list[list[bytes]] = [[], []]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = np.rint(profile(data[a:b].tobytes().lower()) * 255).astype(np.uint8)
            at = np.flatnonzero(found)
            rows[0].append(at.astype("<u2").tobytes())
            rows[1].append(found[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in rows], names=["places", "values"])


def _class_sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums of profiles by nearest centre.

    Profiles, centres and sums are whole numbers below 2^53 in doubles, so no order of adding and
    no dealing out of rows changes them.
    """
    sums = np.zeros((len(centres), PROFILE), np.int64)
    whole = np.rint(centres.astype(np.float64) * (1 << 20)).T
    for batch in batches:
        for lo, hi in _chunks(batch.num_rows, 2000):
            values = [np.frombuffer(x, np.uint8) for x in batch.column("values").slice(lo, hi - lo).to_pylist()]
            places = np.frombuffer(b"".join(batch.column("places").slice(lo, hi - lo).to_pylist()), "<u2")
            x = np.zeros((hi - lo, PROFILE))
            x[np.repeat(np.arange(hi - lo), [len(v) for v in values]), places] = np.concatenate(values)
            nearest = (x @ whole).argmax(axis=1)
            for k in range(len(centres)):
                sums[k] += x[nearest == k].sum(axis=0, dtype=np.float64).astype(np.int64)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["place", "n"])


def fit_classes(texts: DataFrame, rounds: int = 5) -> np.ndarray:
    """Centres of `CLASSES` groups of the profiles of all training documents.

    Starts from the mean of all; each centre is split in two and `rounds` rounds of k-means
    follow, until there are enough. Tasks sum the profiles by centre, so that only the sums
    reach the driver.
    """
    profiles = materialise(texts.filter("not held_out").select("text").mapInArrow(_profiles, "places binary, values binary"), "lm-profiles")
    rng = np.random.default_rng(0)

    def moved(centres: np.ndarray) -> np.ndarray:
        found = profiles.mapInArrow(partial(_class_sums, centres=centres), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(centres.size)
        sums[found["place"].to_numpy()] = found["n"].to_numpy()
        sums = sums.reshape(centres.shape)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.where(norm > 0, sums / np.maximum(norm, 1), centres).astype(np.float32)

    centres = moved(np.zeros((1, PROFILE), np.float32))
    while len(centres) < CLASSES:
        # Apart from the centre by a hundredth of it, place by place at random.
        apart = centres * rng.choice([-0.01, 0.01], centres.shape).astype(np.float32)
        apart -= (apart * centres).sum(axis=1, keepdims=True) * centres
        centres = np.stack([centres + apart, centres - apart], axis=1).reshape(-1, PROFILE)
        for _ in range(rounds):
            before, centres = centres, moved(centres)
            if np.array_equal(before, centres):
                break
    return centres


def votes_of(centres: np.ndarray) -> np.ndarray:
    """What one byte pair adds to the log likelihood of each kind, by place and kind, in 256ths: whole numbers, whose sums are exact."""
    share = centres.astype(np.float64) ** 2 + 1e-5
    return np.rint(256 * np.log(share / share.sum(axis=1, keepdims=True))).T.astype(np.float32)


# ---- texts as tokens and segments


def cuts_of(n: int) -> list[int]:
    """Where the segments of a text of n tokens begin, and n."""
    return [0, *(c for c in FIRST_CUTS if c < n), *range(SEGMENT, n, SEGMENT), n]


class Texts:
    """Some texts as tokens, cut into segments, each with the kind that the segments before it suggest."""

    def __init__(self, column: pa.Array, votes: np.ndarray):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
        flat, offsets = lists.flatten(), np.asarray(lists.offsets)
        kept = np.asarray(pc.binary_length(flat)) > 0  # blanks at either end leave an empty one
        ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
        n = len(column)
        self.first = ends + np.arange(n + 1)
        spot = np.full(int(self.first[-1]), len(flat))
        inside = np.ones(len(spot), bool)
        inside[self.first[1:] - 1] = False
        spot[inside] = np.flatnonzero(kept)
        words = pa.concat_arrays([flat, pa.array([END.decode()], flat.type)]).take(pa.array(spot)).cast(pa.binary())
        coded = words.dictionary_encode()
        #: The distinct tokens of these texts, and which of them each token is.
        self.distinct, self.ids = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        self.sizes = np.diff(self.first)
        parts = [cuts_of(m) for m in self.sizes.tolist()]
        per_text = np.array([len(x) - 1 for x in parts], np.int64)
        self.segments = np.concatenate([[0], np.cumsum(per_text)])
        cuts = np.array([c for x in parts for c in x[:-1]], np.int64) + np.repeat(self.first[:-1], per_text)
        self.cuts = np.concatenate([cuts, [len(words)]])
        self.joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.cuts, pa.int32()), words), b" ")
        self.kind = self._kinds(votes)

    def _kinds(self, votes: np.ndarray) -> np.ndarray:
        data, ends = text_bytes(self.joined)
        sums = np.zeros((len(ends) - 1, votes.shape[1]))
        exact = np.float32 if np.diff(ends).max(initial=0) < 4096 else np.float64  # 4096 pairs of 12 * 256 each stay below 2^24
        votes = votes.astype(exact)
        for lo, hi in _chunks(len(sums), 512):
            sizes = np.diff(ends[lo : hi + 1])
            pairs = _pairs(data[ends[lo] : ends[hi]])
            # A pair across two segments goes to a place of its own.
            spot = np.repeat(np.arange(0, (hi - lo) * PROFILE, PROFILE), sizes)[:-1] + pairs
            spot[np.cumsum(sizes)[:-1] - 1] = (hi - lo) * PROFILE
            counts = np.bincount(spot, minlength=(hi - lo) * PROFILE)[: (hi - lo) * PROFILE]
            sums[lo:hi] = counts.reshape(-1, PROFILE).astype(exact) @ votes
        before = np.concatenate([np.zeros((1, votes.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        start = np.repeat(self.segments[:-1], np.diff(self.segments))
        at = np.arange(len(sums))
        return np.where(at > start, (before[at] - before[start]).argmax(axis=1), CLASSES)


def _read(batches: Iterator[pa.RecordBatch], votes: np.ndarray, size: int = 4_000_000, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of rows of (text, ...) with their tokens; a long text stands alone."""
    for batch in batches:
        _, offsets = text_bytes(batch.column("text"))
        for a, b in slices_by_bytes(offsets, size):
            for lo, hi in ((a + i, min(b, a + j)) for i, j in _chunks(b - a, rows)):
                yield batch.slice(lo, hi - lo), Texts(batch.column("text").slice(lo, hi - lo), votes)


def _count_tokens(batches: Iterator[pa.RecordBatch], votes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tokens of some texts at a time with their number, and a bit for each kind of text they stood in."""
    for _, texts in _read(batches, votes):
        kinds = np.repeat(texts.kind, np.diff(texts.cuts))
        n = np.bincount(texts.ids * KINDS + kinds, minlength=len(texts.distinct) * KINDS).reshape(-1, KINDS)
        masks = ((n > 0) @ (1 << np.arange(KINDS))).astype(np.int32)
        for a, b in _chunks(len(n), 50_000):
            yield pa.RecordBatch.from_arrays([texts.distinct.slice(a, b - a), pa.array(n[a:b].sum(axis=1)), pa.array(masks[a:b])], names=["token", "n", "kinds"])


# ---- code words


class _Symbols(dict):
    def __missing__(self, token: bytes) -> int:
        return 0


@dataclass
class Code:
    """Huffman code of the most frequent training tokens; symbol 0 is the escape.

    Tokens that training has once tell how often a token is new: there they count as an escape
    beside themselves, and with their own occurrence taken out they are one.
    """

    tokens: list[bytes]
    counts: np.ndarray  # by symbol; the escape's is what all other tokens have
    first: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)
    nodes: np.ndarray = field(init=False)
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.tokens) + 1
        heap = [(int(c), i) for i, c in enumerate(np.maximum(self.counts, 1))]
        heapq.heapify(heap)
        up, side, serial = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8), n
        while len(heap) > 1:
            (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a] = up[b] = serial
            side[b] = 1
            heapq.heappush(heap, (c0 + c1, serial))
            serial += 1
        root = serial - 1
        # From the leaves up, all symbols at once; node numbers count inner nodes from 0.
        at, levels = np.arange(n), []
        while (live := at != root).any():
            levels.append((np.where(live, up[at] - n, -1), np.where(live, side[at], 0)))
            at = np.where(live, up[at], at)
        nodes = np.array([x for x, _ in reversed(levels)], np.int32).reshape(len(levels), n).T
        bits = np.array([x for _, x in reversed(levels)], np.int8).reshape(len(levels), n).T
        used = nodes >= 0
        self.sizes = used.sum(axis=1)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.nodes, self.bits = nodes[used].astype(np.int64), bits[used].astype(np.int64)

    @property
    def inner(self) -> int:
        return len(self.tokens)

    @cached_property
    def once(self) -> np.ndarray:
        """Symbols of tokens that training has once."""
        return np.concatenate([[False], self.counts[1:] == 1])

    @cached_property
    def symbol(self) -> dict[bytes, int]:
        return _Symbols({t: i + 1 for i, t in enumerate(self.tokens)})

    @cached_property
    def steps(self) -> np.ndarray:
        """All code words one after the other: each bit's node and, in the last place, the bit."""
        return (2 * self.nodes + self.bits).astype(np.uint32)


class Coded:
    """The code words of some texts: symbols and contexts. Texts marked `learnt` are coded as if training did not have them."""

    def __init__(self, texts: Texts, code: Code, learnt: np.ndarray | None = None):
        distinct, known = texts.distinct.to_numpy(zero_copy_only=False).tolist(), code.symbol.get
        self.symbols = np.array([known(t, 0) for t in distinct], np.int64)[texts.ids]
        own = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[texts.ids]
        self.learnt = np.ones(len(texts.sizes), bool) if learnt is None else learnt
        self.once = code.once[self.symbols] & np.repeat(self.learnt, texts.sizes)
        self.own = self.symbols.copy()  # with those that count as new
        self.symbols[self.once] = 0
        self.spelled = np.flatnonzero(self.symbols == 0)
        start = texts.first[:-1]
        one = np.concatenate([own[:1], own[:-1]])
        one[start] = np.uint64(1)
        two = np.concatenate([one[:1], one[:-1]])
        two[start] = np.uint64(1)
        self.past = [(x * _C >> np.uint64(32)).astype(np.uint32) for x in ((one * _A) ^ (one >> np.uint64(7)), ((one * _B) ^ two) * _A)]


class Bits:
    """Bits of code words with their nodes, and the slots of the hashed predictors, each from 0."""

    def __init__(self, code: Code, symbols: np.ndarray, past: list[np.ndarray]):
        self.sizes = sizes = code.sizes[symbols]
        spot = np.repeat(code.first[symbols] - (np.cumsum(sizes) - sizes), sizes)
        spot += np.arange(len(spot))
        self.node = code.steps.take(spot, mode="wrap")  # the quickest mode; all are inside
        self.bit = self.node & ONE
        self.node >>= ONE
        mixed = (self.node + ONE) * _E
        self.hashed = []
        for context, b in zip(past, PAST_BITS, strict=True):
            x = np.repeat(context, sizes)
            x ^= mixed
            x *= _D
            x >>= np.uint32(32 - b)
            self.hashed.append(x)


def slots_of(code: Code) -> int:
    return (1 + KINDS) * code.inner + sum(1 << b for b in PAST_BITS)


#: Slots of the tables that travel as one row.
BLOCK = 1 << 16


def _rows_of(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of an array of counts, but for empty ones, in as few bytes as they need."""
    for a in range(0, len(counts), 2 * BLOCK):
        part = counts[a : a + 2 * BLOCK]
        if part.any():
            wide = part.astype("<u4") if part.max() > 65535 else part.astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([a // (2 * BLOCK)]), pa.array([wide.itemsize], pa.int32()), pa.array([wide.tobytes()], pa.binary())], names=["block", "width", "counts"])


def _tally(counts: np.ndarray, tables: list[np.ndarray], sizes: tuple[int, ...], bit: np.ndarray) -> None:
    """Adds the zeros and ones of each table's slots, which count from 0, to `counts`."""
    base = 0
    for slots, size in zip(tables, sizes, strict=True):
        part = counts[base : base + (2 << size)]
        np.add(part, np.bincount(2 * slots + bit, minlength=2 << size), out=part, casting="unsafe")
        base += 2 << size


def _count_bits(batches: Iterator[pa.RecordBatch], code, votes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each hashed slot's bit was zero and one in a task's texts; in the last blocks, how often each symbol stood in each kind of text."""
    book: Code = code.value
    counts = np.zeros(2 * sum(1 << b for b in PAST_BITS), np.uint32)
    symbols = np.zeros(KINDS * (book.inner + 1), np.uint32)
    for _, texts in _read(batches, votes):
        coded = Coded(texts, book)
        kinds = np.repeat(texts.kind, np.diff(texts.cuts))
        again = np.flatnonzero(coded.once)
        for found, at in ((coded.symbols, np.arange(len(kinds))), (coded.own, again)):
            np.add.at(symbols, kinds[at] * (book.inner + 1) + found[at], ONE)
            for a, b in _chunks(len(at), 100_000):
                bits = Bits(book, found[at[a:b]], [x[at[a:b]] for x in coded.past])
                _tally(counts, bits.hashed, PAST_BITS, bits.bit)
    yield from _rows_of(np.concatenate([counts, symbols]))


def halved(total: np.ndarray) -> np.ndarray:
    """(slots, 2) counts in 16 bits: both of a slot are halved until they fit."""
    total = total.reshape(-1, 2).copy()
    while len(over := np.flatnonzero(total.max(axis=1) > 65535)):
        total[over] >>= np.uint64(1)
    return total.astype(np.uint16)


def _merge_blocks(table: pa.Table, pairs: int) -> pa.Table:
    """The sum of one block's rows; the first `pairs` blocks hold pairs, which are halved to 16 bits."""
    block = table["block"][0].as_py()
    total = sum(np.frombuffer(x, f"<u{w}").astype(np.uint64) for x, w in zip(table["counts"].to_pylist(), table["width"].to_pylist(), strict=True))
    return pa.table({"block": pa.array([block], pa.int64()), "counts": pa.array([(halved(total) if block < pairs else total).tobytes()], pa.binary())})


def gathered(counted: DataFrame, slots: int, others: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The merged blocks as (slots, 2) counts in 16 bits and `others` whole ones; their fixed number bounds what reaches the driver."""
    pairs, whole = np.zeros(2 * slots, np.uint16), np.zeros(others, np.uint64)
    merged = counted.groupBy("block").applyInArrow(lambda table: _merge_blocks(table, slots // BLOCK), "block long, counts binary")
    for r in merged.toLocalIterator():
        at = r["block"] * 2 * BLOCK
        if at < 2 * slots:
            part = np.frombuffer(r["counts"], np.uint16)
            pairs[at : at + len(part)] = part
        else:
            part = np.frombuffer(r["counts"], np.uint64)
            whole[at - 2 * slots : at - 2 * slots + len(part)] = part
    return pairs.reshape(-1, 2), whole


def count_tables(training: DataFrame, code, votes: np.ndarray) -> np.ndarray:
    """(slots, 2) counts of zeros and ones over all training texts: by node, by kind and node, and by hashed context and node."""
    book: Code = code.value
    counted = training.mapInArrow(partial(_count_bits, code=code, votes=votes), "block long, width int, counts binary")
    pairs, symbols = gathered(counted, sum(1 << b for b in PAST_BITS), KINDS * (book.inner + 1))
    return np.concatenate([halved(by_node(book, symbols)), pairs])


def by_node(code: Code, symbols: np.ndarray) -> np.ndarray:
    """Zeros and ones of each node, in all and then by kind, from how often each symbol stood in each kind of text."""
    each = symbols.reshape(KINDS, code.inner + 1).astype(np.float64)
    spot = 2 * code.nodes + code.bits
    return np.concatenate([np.bincount(spot, np.repeat(n, code.sizes), 2 * code.inner) for n in (each.sum(axis=0), *each)]).astype(np.uint64)


# ---- mixing


#: The weights that every text starts from, by input; the refinement starts as no change.
START = np.array([0.2, 0.6, 0.2, 0.2, 0.3, 0.0], np.float32)
#: How fast weights and refinement follow a text.
RATES = (0.2, 0.02)


class Tables:
    """Log odds, in STEPth parts, and below them two bits of grade, of all slots: with a zero of its own taken out, with a one, and as counted."""

    STEP = 1000

    def __init__(self, counts: np.ndarray):
        self.packed = np.empty((3, len(counts)), np.int16)
        for lo, hi in _chunks(len(counts), 1 << 18):
            n0, n1 = counts[lo:hi].astype(np.int32).T
            for i, (a, b) in enumerate(((np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0)), (n0, n1))):
                odds = np.rint(np.clip(LOG[b] - LOG[a], -8, 8) * self.STEP).astype(np.int16)
                self.packed[i, lo:hi] = odds * 4 + GRADE[a + b]


class Mixer:
    """Predicts the bits of texts side by side, with counts, weights and a refinement of its own for each, learnt as it goes.

    A text's own counts follow every bit; weights and refinement take one step for a segment.

    In texts that the tables have counted, each bit's own count is taken out first.
    """

    def __init__(self, code: Code, counts: np.ndarray, start: np.ndarray = START, rates: tuple[float, float] = RATES):
        self.code, self.tables, self.start, self.rates = code, Tables(counts), start, rates

    def run(self, texts: Texts, coded: Coded) -> np.ndarray:
        """The log10 probability of each token's code word."""
        out = np.zeros(len(texts.ids))
        # Texts of like length go together, longest first: those still going on are always the first ones.
        per_text = np.diff(texts.segments)
        order = np.lexsort((-per_text, coded.learnt))
        learnt = int(np.count_nonzero(~coded.learnt))
        for lo, hi in (0, learnt), (learnt, len(order)):
            for a, b in _chunks(hi - lo, BESIDE):
                self._beside(texts, coded, order[lo + a : lo + b], lo > 0 or learnt == 0, out)
        return out

    def _beside(self, texts: Texts, coded: Coded, chosen: np.ndarray, learnt: bool, out: np.ndarray) -> None:
        """Mixes the chosen texts, all learnt or none, segment after segment; fills in their part of `out`."""
        weights = np.repeat(self.start[:, None], len(chosen) * GATES, axis=1)
        refined = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))).astype(np.float32), len(chosen) * FINE)
        own = np.zeros(len(chosen) << OWN_BITS, np.uint32)
        first_segment = texts.segments[chosen]
        falling = first_segment - texts.segments[chosen + 1]
        for step in range(-int(falling.min(initial=0))):
            live = int(np.searchsorted(falling, -step, side="left"))
            segment = first_segment[:live] + step
            lo, sizes = texts.cuts[segment], texts.cuts[segment + 1] - texts.cuts[segment]
            ends = np.cumsum(sizes)
            tokens = np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)
            bits = Bits(self.code, coded.symbols[tokens], [x[tokens] for x in coded.past])
            if not len(bits.node):
                continue
            starts = np.concatenate([[0], np.cumsum(bits.sizes)])
            per_text = np.diff(starts[np.concatenate([[0], ends])])
            logs = self._step(bits, per_text, texts.kind[segment], learnt, own, weights, refined)
            have = bits.sizes > 0
            out[tokens[have]] = np.add.reduceat(logs, starts[:-1][have], dtype=np.float64) / np.log(10)
            if step % 256 == 255:  # a node is met at most SEGMENT times a step, so counts stay below 2 ** 16
                halves = own.view(np.uint16).reshape(-1, 2)
                halves[halves.max(axis=1) > 40_000] >>= 1

    @staticmethod
    def _seen(bits: Bits, per_text: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How often a bit's slot was zero, and how often one, in its text before it.

        Sorting by text, slot and place brings the bits of a slot together, in order; running
        sums since the first of them, and what the slot had before this segment, give the counts:
        zeros in the lower 16 bits, ones in the upper. (Sums of both may run over; differences do not.)
        """
        texts, starts = np.arange(len(per_text)), np.cumsum(per_text) - per_text
        keys = bits.node * np.uint32(2654435761)
        keys >>= np.uint32(8)
        keys &= np.uint32((1 << OWN_BITS) - 1)
        keys <<= np.uint32(PLACE_BITS + 1)
        keys += bits.bit
        keys += np.repeat(((texts << (OWN_BITS + PLACE_BITS + 1)) - 2 * starts).astype(np.uint32), per_text)
        keys += np.arange(0, 2 * len(keys), 2, np.uint32)
        keys.sort()
        slots = keys >> np.uint32(PLACE_BITS + 1)
        first = np.concatenate([[0], np.flatnonzero(slots[1:] != slots[:-1]) + 1])
        gained = (keys & ONE) * np.uint32(65535)
        gained += ONE
        sums = np.cumsum(gained, dtype=np.uint32)
        upto = np.concatenate([sums[first[1:] - 1], sums[-1:]])
        before = np.concatenate([upto[:1] * np.uint32(0), upto[:-1]])
        slots = slots[first].astype(np.int64)
        had = own[slots]
        own[slots] = had + (upto - before)
        sums -= gained
        sums += np.repeat(had - before, np.diff(first, append=len(keys)))
        place = starts.take(keys >> np.uint32(OWN_BITS + PLACE_BITS + 1), mode="wrap")
        keys &= np.uint32((2 << PLACE_BITS) - 1)
        keys >>= ONE
        place += keys
        out = np.empty_like(sums)
        out[place] = sums
        return out

    def _step(self, bits: Bits, per_text: np.ndarray, kind: np.ndarray, learnt: bool, own: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
        packed, live, slots = self.tables.packed.ravel(), len(per_text), self.tables.packed.shape[1]
        # Which of the three tables: by the bit where it is among the counts.
        plane = bits.bit * np.uint32(slots) if learnt else np.uint32(2 * slots)
        base, x, grades = (1 + KINDS) * self.code.inner, [], []
        for i in range(4):
            if i == 0:
                spot = bits.node + plane
            elif i == 1:
                spot += np.repeat((self.code.inner * (1 + kind)).astype(np.uint32), per_text)
            else:
                spot = bits.hashed[i - 2] + (plane + np.uint32(base))
                base += 1 << PAST_BITS[i - 2]
            found = packed.take(spot, mode="wrap")
            if i >= 2:
                grades.append((found & np.int16(3)).astype(np.int8))
            found >>= np.int16(2)
            x.append(found * np.float32(1 / Tables.STEP))
        seen = self._seen(bits, per_text, own)
        x.append(LOG.take(seen >> np.uint32(16), mode="wrap"))
        x[-1] -= LOG.take(seen & np.uint32(65535), mode="wrap")
        met = seen > 0
        place = grades[1] * np.int8(4)
        place += grades[0]
        place *= np.int8(2)
        place += met
        place = place + np.repeat(np.arange(0, live * GATES, GATES), per_text)
        sets, cells = live * GATES, live * FINE * CELLS
        odds = weights[-1].take(place, mode="wrap")
        for w, value in zip(weights[:-1], x, strict=True):
            part = w.take(place, mode="wrap")
            part *= value
            odds += part
        np.clip(odds, np.float32(-8), np.float32(8), out=odds)
        p = np.negative(odds)
        np.exp(p, out=p)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        odds += np.float32(8)
        odds *= np.float32((CELLS - 1) / 16)
        cell = np.minimum(odds.astype(np.int16), np.int16(CELLS - 2))
        odds -= cell
        cell += ((grades[0] > 0) * np.int8(2) + met) * np.int16(CELLS)
        cell = cell + np.repeat(np.arange(0, cells, FINE * CELLS), per_text)
        fine = refined.take(cell, mode="wrap")
        above = refined[1:].take(cell, mode="wrap")
        above -= fine
        above *= odds
        fine += above
        fine += p
        fine *= np.float32(0.5)
        right = bits.bit.astype(np.float32)
        fine -= 1 - right  # the probability of the bit that came, but for the sign
        np.abs(fine, out=fine)
        logs = np.log(np.maximum(fine, np.float32(1e-4), out=fine), out=fine)
        # Learn from this segment.
        error = np.subtract(right, p).astype(np.float64)
        rate = self.rates[0] / np.maximum(np.bincount(place, minlength=sets), 1)
        for w, value in zip(weights[:-1], x, strict=True):
            w[:sets] += rate * np.bincount(place, error * value, sets)
        weights[-1][:sets] += rate * np.bincount(place, error, sets)
        cell += odds > np.float32(0.5)
        hits = np.bincount(cell, minlength=cells)
        ones = np.bincount(cell, right, cells)
        refined[:cells] += self.rates[1] * (ones - hits * refined[:cells]) / (1 + self.rates[1] * hits)
        return logs


# ---- spelling

#: Hashed slots of each spelling predictor, as powers of two: one to three bytes back with the kind, four bytes back, the token so far.
TABLES = (16, 18, 20, 19, 21)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLES])])
#: Inputs: the predictors and a bias. Gates: the whole token's table, the three-byte table, the place in the token.
SPELL_INPUTS, SPELL_GATES = len(TABLES) + 1, 4 * 4 * 3


class Letters:
    """All bits of some spelled tokens, each followed by a blank: slots, the bit, its token and its place."""

    def __init__(self, tokens: list[bytes], kinds: np.ndarray):
        raw = [t + b" " for t in tokens]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(t) for t in raw], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        at = np.arange(len(data)) - np.repeat(first, sizes)
        wide = data.astype(np.uint64) + np.uint64(1)
        kind = np.repeat(np.asarray(kinds).astype(np.uint64) + np.uint64(1), sizes) * _A
        zero = np.zeros(1, np.uint64)
        contexts, running = [], np.zeros(len(data), np.uint64)
        for n in range(1, 5):
            back = np.concatenate([np.repeat(zero, n), wide[:-n]]) if len(data) > n else np.zeros(len(data), np.uint64)
            running = running * np.uint64(257) + np.where(at >= n, back, np.uint64(0))
            contexts.append((running * _A) ^ kind if n < 4 else running * _A)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(data) - 1), 0x100000001B3, np.uint64)]), dtype=np.uint64)
        inverse = np.uint64(pow(0x100000001B3, -1, 1 << 64))
        lows = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(data) - 1), inverse, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([zero, np.cumsum(wide * powers, dtype=np.uint64)])[: len(data)]
        so_far = (sums - sums[np.repeat(first, sizes)]) * lows[np.repeat(first, sizes)] if len(data) else zero[:0]
        contexts.append((so_far ^ (so_far >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        shift = np.arange(7, -1, -1, dtype=np.uint8)
        self.bit = ((data[:, None] >> shift) & 1).ravel()
        mixed = ((256 | data.astype(np.uint32))[:, None] >> (shift + 1)) * _E
        self.hashed = []  # slots of each table, from 0
        for context, b in zip(contexts, TABLES, strict=True):
            x = (context * _C >> np.uint64(32)).astype(np.uint32)[:, None] ^ mixed
            x *= _D
            x >>= np.uint32(32 - b)
            self.hashed.append(x.ravel())
        self.place = np.repeat(np.minimum(at, 2), 8)
        self.first = 8 * first  # of each token's bits

    @property
    def slots(self) -> np.ndarray:
        """The slots in one array of counts, table after table."""
        return np.stack([x + start for x, start in zip(self.hashed, OFFSETS[:-1], strict=True)])


@dataclass
class Speller:
    """Counts of all tables, mixing weights by gate, refinement by gate."""

    counts: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Speller:
        weights = np.full((SPELL_GATES, SPELL_INPUTS), 0.3)
        weights[:, -1] = 0
        return cls(counts, weights, np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, CELLS))), (SPELL_GATES, 1)))

    def inputs(self, letters: Letters, without_own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by predictor and bit, and the gate of each bit."""
        x = np.empty((SPELL_INPUTS, letters.bit.size), np.float32)
        seen, pairs = [], self.counts.reshape(-1).view(np.uint32)  # zeros in the lower half, ones in the upper
        for i, (slots, start, b) in enumerate(zip(letters.hashed, OFFSETS, TABLES, strict=False)):
            both = pairs[start : start + (1 << b)].take(slots, mode="wrap")
            n0, n1 = both & np.uint32(65535), both >> np.uint32(16)
            if without_own:
                n1 -= letters.bit & (n1 > 0)
                n0 -= (1 - letters.bit) & (n0 > 0)
            np.subtract(LOG.take(n1, mode="wrap"), LOG.take(n0, mode="wrap"), out=x[i])
            if i in (2, len(TABLES) - 1):
                seen.append(GRADE.take(n0 + n1, mode="wrap").astype(np.int64))
        x[-1] = 1
        return np.clip(x, np.float32(-8), np.float32(8), out=x), (seen[1] * 4 + seen[0]) * 3 + letters.place

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log odds of a one after mixing."""
        odds = np.zeros(len(gate), np.float32)
        for w, value in zip(self.weights.T.astype(np.float32), x, strict=True):
            part = w.take(gate, mode="wrap")
            part *= value
            odds += part
        return np.clip(odds, np.float32(-8), np.float32(8), out=odds)

    def probability(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixed probability averaged with its refinement."""
        spot = (odds + np.float32(8)) * np.float32((CELLS - 1) / 16)
        low = np.minimum(spot.astype(np.int16), np.int16(CELLS - 2))
        spot -= low
        flat, refined = gate * CELLS + low, self.refined.astype(np.float32).ravel()
        fine = refined.take(flat, mode="wrap")
        fine += (refined[1:].take(flat, mode="wrap") - fine) * spot
        fine += 1 / (1 + np.exp(-odds))
        fine *= np.float32(0.5)
        return np.clip(fine, np.float32(1e-5), np.float32(1 - 1e-5), out=fine)

    def learn(self, tokens: list[bytes], kinds: np.ndarray, rate: float, step: int = 512) -> Speller:
        """Online gradient steps over tokens that the tables have counted, `step` tokens at a time."""
        for a, b in _chunks(len(tokens), step):
            letters = Letters(tokens[a:b], kinds[a:b])
            x, gate = self.inputs(letters, without_own=True)
            odds = self.mixed(x, gate)
            error = (letters.bit - 1 / (1 + np.exp(-odds))).astype(np.float64)
            sums = np.stack([np.bincount(gate, error * value, SPELL_GATES) for value in x], axis=1)
            self.weights += rate * sums / np.maximum(1, np.bincount(gate, minlength=SPELL_GATES))[:, None]
            cell = np.rint((odds + 8) * np.float32((CELLS - 1) / 16)).astype(np.int64) + gate * CELLS
            hits = np.bincount(cell, minlength=SPELL_GATES * CELLS)
            drift = np.bincount(cell, letters.bit - self.refined.ravel()[cell], SPELL_GATES * CELLS)
            self.refined += (0.02 * drift / (1 + 0.02 * hits)).reshape(SPELL_GATES, CELLS)
        return self

    def log10(self, tokens: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """The log10 probability of each token's spelling."""
        out = np.zeros(len(tokens))
        for a, b in _chunks(len(tokens), 512):
            letters = Letters(tokens[a:b], kinds[a:b])
            x, gate = self.inputs(letters)
            p = self.probability(self.mixed(x, gate), gate)
            out[a:b] = np.add.reduceat(np.log10(np.where(letters.bit == 1, p, 1 - p)), letters.first, dtype=np.float64)
        return out


def _in_kinds(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """A batch's tokens, once for each kind of text they stand in, and the kinds."""
    at, kind = np.nonzero((batch.column("kinds").to_numpy()[:, None] >> np.arange(KINDS)) & 1)
    return batch.column("token").to_numpy(zero_copy_only=False)[at].tolist(), kind


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * int(OFFSETS[-1]), np.uint32)
    for batch in batches:
        tokens, kinds = _in_kinds(batch)
        for a, b in _chunks(len(tokens), 40_000):
            letters = Letters(tokens[a:b], kinds[a:b])
            _tally(counts, letters.hashed, TABLES, letters.bit)
    yield from _rows_of(counts)


def _learn_letters(batches: Iterator[pa.RecordBatch], counts, rate: float, every: int) -> Iterator[pa.RecordBatch]:
    """One task's learner of spelling; tokens come in the order of their hashes."""
    speller, seen = Speller.fresh(counts.value), 0
    for batch in batches:
        tokens, kinds = _in_kinds(batch)
        for i, (a, b) in enumerate(_chunks(len(tokens), 512)):
            if i % every == 0:
                speller.learn(tokens[a:b], kinds[a:b], rate)
                seen += b - a
    flat = np.concatenate([speller.weights.ravel(), speller.refined.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))], names=["place", "value", "seen"])


# ---- scoring

SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, base double, known long, "
    "segments array<struct<at:int,past:long,self:long,coded:double>>, spelled array<struct<at:int,token:binary,kind:int>>"
)


def _lists(ends: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _score(batches: Iterator[pa.RecordBatch], code, counts, votes: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The base score of a text's tokens of the code, what each segment's code words cost, the hashes of the segment and the one before, and what is to be spelled."""
    book: Code = code.value
    mixer = Mixer(book, counts.value)
    for batch, texts in _read(batches, votes):
        coded = Coded(texts, book, ~batch.column("held_out").to_numpy(zero_copy_only=False))
        logs, begin = mixer.run(texts, coded), texts.cuts[:-1]
        own = np.array([xxhash.xxh64_intdigest(x) for x in texts.joined.to_pylist()], np.uint64).view(np.int64)
        past = np.concatenate([own[:1], own[:-1]])
        past[texts.segments[:-1]] = 0
        at = (np.arange(len(begin)) - np.repeat(texts.segments[:-1], np.diff(texts.segments))).astype(np.int32)
        where = np.repeat(np.arange(len(begin)), np.diff(texts.cuts))[coded.spelled]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in ("row", "doc_id", "held_out")),
                pa.array(texts.sizes, pa.int64()),
                batch.column("n_bytes"),
                pa.array(np.add.reduceat(base[coded.symbols], texts.first[:-1])),
                pa.array(np.add.reduceat((coded.symbols > 0).astype(np.int64), texts.first[:-1])),
                _lists(texts.segments, {"at": pa.array(at), "past": pa.array(past), "self": pa.array(own), "coded": pa.array(np.add.reduceat(logs, begin))}),
                _lists(np.searchsorted(coded.spelled, texts.first), {
                    "at": pa.array(at[where]), "token": texts.distinct.take(pa.array(texts.ids[coded.spelled])), "kind": pa.array(texts.kind[where], pa.int32()),
                }),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "n_bytes", "base", "known", "segments", "spelled"],
        )


def _spell(batches: Iterator[pa.RecordBatch], speller) -> Iterator[pa.RecordBatch]:
    """The log10 probability of spelled tokens; one that stands there again in the same kind is computed once a batch."""
    for batch in batches:
        tokens = batch.column("token").dictionary_encode()
        pairs, spot = np.unique(tokens.indices.to_numpy().astype(np.int64) * KINDS + batch.column("kind").to_numpy(), return_inverse=True)
        distinct = tokens.dictionary.to_numpy(zero_copy_only=False)[pairs // KINDS].tolist()
        logs = speller.value.log10(distinct, pairs % KINDS).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array(logs[spot]), batch.column("n")], names=["row", "at", "coded", "n"])


def score_texts(docs: DataFrame, code_words: int = CODE_WORDS, learn_every: int = 1) -> DataFrame:
    """Score every row of docs(doc_id, text); learns from rows that are not held out.

    Held out are rows whose crc32 of doc_id, written as text, is 2 modulo 7 (a null id counts as
    the empty text). Tokens are words between blanks after lower-casing A-Z, and one end; null is
    the empty text, which is the end alone. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (log10 of the add-one unigram probability), score (log10
    probability by the model), bits_per_byte (of the text and its end).
    Repeated rows and ids are learnt and scored as they stand; other columns are ignored.

    `code_words` bounds the code; rarer tokens are spelled, none is left out. The driver gets
    the code's tokens and tables of a fixed number of slots. One in `learn_every`
    distinct training tokens teaches the weights of spelling.
    A training text is scored with its own bits taken out of the counts, one at a time, so that
    its score compares with a held-out one's.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("held_out", crc_remainder(F.col("doc_id"), 7) == 2)
    training = texts.filter("not held_out").select("text")
    votes = votes_of(fit_classes(texts))
    listed = training.mapInArrow(partial(_count_tokens, votes=votes), "token binary, n long, kinds int")
    vocabulary = materialise(listed.groupBy("token").agg(F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds")), "lm-vocabulary")
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = vocabulary.select("token", "n").orderBy(F.desc("n"), "token").limit(code_words).toArrow()
    n_top = top["n"].to_numpy() if len(top) else np.zeros(0, np.int64)
    escapes = total - n_top.sum() + (n_top == 1).sum() + 1
    code = spark.sparkContext.broadcast(Code([bytes(t) for t in top["token"].to_pylist()], np.concatenate([[escapes], n_top])))
    base = np.log10((np.concatenate([[0], n_top]) + 1) / (total + distinct + 1))
    base[0] = 0.0
    counts = spark.sparkContext.broadcast(count_tables(training, code, votes))
    # Spelling is counted and learnt on distinct training tokens, by kind of text.
    letters = np.zeros((int(OFFSETS[-1]), 2), np.uint16)
    words = vocabulary.select("token", "kinds")
    if distinct:
        counted = words.coalesce(1 + distinct // 1_000_000).mapInArrow(_count_letters, "block long, width int, counts binary")
        letters, _ = gathered(counted, int(OFFSETS[-1]))
    speller = Speller.fresh(letters)
    if distinct:
        sent = spark.sparkContext.broadcast(letters)
        ordered = words.repartition(1 + distinct // 250_000, "token").sortWithinPartitions(F.xxhash64("token"), "token")
        learners = ordered.mapInArrow(partial(_learn_letters, counts=sent, rate=0.5, every=learn_every), "place long, value double, seen long")
        means = learners.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("mean")).toArrow().sort_by("place")["mean"].to_numpy()
        speller.weights, speller.refined = means[: SPELL_GATES * SPELL_INPUTS].reshape(SPELL_GATES, -1), means[SPELL_GATES * SPELL_INPUTS :].reshape(SPELL_GATES, -1)
    rows = texts.withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long")})
    scored = materialise(rows.mapInArrow(partial(_score, code=code, counts=counts, votes=votes, base=base), SCORED), "lm-scored")
    # Each spelled token meets its count in training; tokens of the code are not among them.
    rare = scored.select("row", F.explode("spelled").alias("x")).select("row", "x.at", "x.token", "x.kind")
    met = rare.join(vocabulary.select("token", "n"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spelled = met.mapInArrow(partial(_spell, speller=spark.sparkContext.broadcast(speller)), "row long, at int, coded float, n long")
    parts = scored.select("row", "held_out", F.explode("segments").alias("x")).select("row", "held_out", "x.*").withColumn("pair", F.xxhash64("past", "self"))
    pairs = parts.filter("not held_out").groupBy("pair").agg(F.first("past").alias("past"), F.count("*").alias("n"))
    pairs = materialise(pairs, "lm-segments")
    after = pairs.groupBy("past").agg(F.sum("n").alias("n_past"), F.count("*").alias("pairs"))
    pairs = materialise(join_skewed(pairs, after, "past", "pairs").select("pair", "n", "n_past", F.col("n").alias("rows")), "lm-copies")
    copied = join_skewed(parts, pairs, "pair", "rows", "left")
    others = F.col("n") - F.when(F.col("held_out"), 0).otherwise(1)
    copied = copied.withColumn("copy", F.when(others > 0, others / (F.col("n_past") - F.col("n") + others)))
    # What is shuffled of a spelled token is its logarithm and its count; a segment has neither copy nor count where the other has.
    none = {k: F.lit(None).cast(t) for k, t in (("n", "long"), ("copy", "double"))}
    both = copied.select("row", "at", "coded", "copy", none["n"].alias("n")).unionByName(spelled.select("row", "at", "coded", none["copy"].alias("copy"), "n"))
    by_segment = both.repartition("row").groupBy("row", "at").agg(
        F.sum("coded").alias("coded"), F.max("copy").alias("copy"),
        F.coalesce(F.sum(F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))), F.lit(0.0)).alias("base"), F.count_if(F.col("n") > 0).alias("known"),
    )
    # A segment is a copy or it is coded: the sum of both, by its larger part.
    plain, copy = F.col("coded") + F.log10(F.lit(1 - COPY)), F.log10(F.col("copy") * COPY)
    more, less = F.greatest(plain, copy), F.least(plain, copy)
    score = F.when(F.col("copy").isNull(), plain).otherwise(more + F.log10(1 + F.pow(F.lit(10.0), F.greatest(less - more, F.lit(-300.0)))))
    by_row = by_segment.groupBy("row").agg(F.sum(score).alias("score"), F.sum("base").alias("rare"), F.sum("known").alias("met"))
    heads = scored.select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "base", "known")
    return heads.join(by_row, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("met")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare")).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
