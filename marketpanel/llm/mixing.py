"""Context mixing over the bits of a byte stream: hashed counts, gated weights and a refinement table, in numpy.

A text's stream is its words with a blank after each and an end mark. Each bit of a symbol is predicted by the
last 1, 2, 3 and 4 symbols, across words, and by the word so far. Counts of the orders lie in hashed tables that
are sized by the different sequences of the corpus; counts of the word so far are exact, from sorted words. A
logistic mixer combines the logits with the weights of a gate, chosen by how often the longer contexts were seen.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

END = b"\n"
ORDERS = 4
CONTEXTS = ORDERS + 1
HEAD = 3  # symbols of a word whose order-4 context begins before its blank
GATES = 64
RANGE = 8.0  # logits lie between -RANGE and RANGE
BUCKETS = 33
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones as 16-bit codes: 12 bits of logit, 4 of the logarithm of the count."""
    logit = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -RANGE, RANGE)
    seen = np.minimum(15, np.floor(np.log2(n0 + n1 + 1))).astype(np.uint16)
    return np.round((logit + RANGE) / (2 * RANGE) * 4094).astype(np.uint16) << 4 | seen


@dataclass
class Positions:
    """Symbols to predict: the symbol, the four before it as a number, and the word's own codes of each bit, or how
    many symbols back its word's blank lies, when the word so far is an order itself."""

    symbols: np.ndarray
    before: np.ndarray
    words: np.ndarray | None = None
    back: np.ndarray | None = None

    def take(self, rows) -> Positions:
        return Positions(self.symbols[rows], self.before[rows], *(None if x is None else x[rows] for x in (self.words, self.back)))

    def sequences(self) -> np.ndarray:
        return (self.before << np.uint64(8) | self.symbols).astype(np.int64)


def word_positions(words: list[bytes]) -> tuple[Positions, np.ndarray]:
    """(positions of all symbols of the words and their blanks beyond the first HEAD, how many each word has)."""
    parts = [b" " + w + b" " for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    held = np.flatnonzero(np.arange(len(flat)) - np.repeat(starts, sizes) > HEAD)
    before = sum((flat[held - k] << np.uint64(8 * (k - 1)) for k in range(1, 5)), np.zeros(len(held), np.uint64))
    return Positions(flat[held], before), np.maximum(sizes - 1 - HEAD, 0)


def edge_codes(stream: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The beginning of each word as a number: how many symbols, the three before its blank, its first ones."""
    out = counts.astype(np.uint64) << np.uint64(56)
    for k, at in enumerate((-4, -3, -2, 0, 1, 2)):
        own = stream[np.minimum(starts + at, len(stream) - 1)].astype(np.uint64)
        out |= np.where(at < counts, own, np.uint64(0)) << np.uint64(40 - 8 * k)
    return out


def edge_positions(edges: np.ndarray) -> tuple[Positions, np.ndarray]:
    """(positions of the first symbols of words, the edge of each)."""
    edges = edges.astype(np.uint64)
    counts = edges >> np.uint64(56)
    head, tail = edges >> np.uint64(24) & np.uint64(0xFFFFFF), edges & np.uint64(0xFFFFFF)
    stream = head << np.uint64(32) | np.uint64(0x20) << np.uint64(24) | tail
    parts = []
    for k in range(HEAD):
        rows = np.flatnonzero(counts > k)
        own = stream[rows] >> np.uint64(8 * (HEAD - 1 - k))
        parts.append((rows, own & np.uint64(0xFF), own >> np.uint64(8) & np.uint64(0xFFFFFFFF), np.full(len(rows), k + 1)))
    rows, symbols, before, back = (np.concatenate(x) for x in zip(*parts))
    return Positions(symbols, before, back=back), rows


@dataclass
class Tables:
    """Codes of the orders' contexts, one table behind the other."""

    bits: tuple[int, ...]
    codes: np.ndarray

    def read(self, rows: Positions, j: int):
        """(node of the symbol's tree, its bit, codes in each context) of the j-th bit."""
        node, bit = _node(rows.symbols, j)
        codes, start = [], 0
        for order, size in enumerate(self.bits, 1):
            codes.append(self.codes[start:start + (1 << size)][_slot(order, size, rows.before, node)])
            start += 1 << size
        codes.append(rows.words[:, j] if rows.words is not None else np.choose(rows.back - 1, codes[:HEAD]))
        return node, bit, codes


def _node(symbols: np.ndarray, j: int):
    symbols = symbols.astype(np.uint64)
    return symbols >> np.uint64(8 - j) | np.uint64(1 << j), (symbols >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64)


def _slot(order: int, size: int, before: np.ndarray, node: np.ndarray) -> np.ndarray:
    context = ((before & np.uint64((1 << 8 * order) - 1)) + np.uint64(order << 40)) * _A
    return (((context ^ (node * _B)) * _A) >> np.uint64(64 - size)).astype(np.int64)


def order_tables(sequences: np.ndarray, weights: list[np.ndarray]) -> list[Tables]:
    """Tables for each of the weights of the different sequences of five symbols. There are at least as many slots
    as bits of the different sequences of an order."""
    sequences = sequences.astype(np.uint64)
    symbols, before = sequences & np.uint64(0xFF), sequences >> np.uint64(8)
    bits = tuple(
        max(12, int(np.ceil(np.log2(8 * max(1, len(np.unique(sequences & np.uint64((1 << 8 * (k + 1)) - 1)))))))) for k in range(1, ORDERS + 1)
    )
    out = [np.empty(sum(1 << b for b in bits), np.uint16) for _ in weights]
    start = 0
    for order, size in enumerate(bits, 1):
        cells = np.zeros((len(weights), 2 << size))
        for j in range(8):
            node, bit = _node(symbols, j)
            cell = _slot(order, size, before, node) * 2 + bit
            for own, w in zip(cells, weights):
                np.add.at(own, cell, w)
        for codes, own in zip(out, cells):
            codes[start:start + (1 << size)] = packed(own[0::2], own[1::2])
        start += 1 << size
    return [Tables(bits, codes) for codes in out]


def word_codes(words: list[bytes], weights: list[np.ndarray], spanning: dict[bytes, np.ndarray]) -> list[np.ndarray]:
    """For each of the weights, codes (position, bit) of the word so far, of different words sorted with their blanks.

    Words with one beginning stand together, so that a bit's counts are sums over runs. `spanning` has, for
    beginnings that words elsewhere share, the sums (weight, symbol) over all words.
    """
    parts = [w + b" " for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - HEAD, 0)
    firsts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(parts)), counts)
    own = flat[np.arange(len(owner)) - firsts[owner] + starts[owner] + HEAD]
    ones = (own[:, None] >> np.arange(7, -1, -1) & 1).astype(bool)
    # A beginning that no other word has predicts the word itself.
    out = [np.where(ones, packed(np.zeros(len(w)), w)[owner][:, None], packed(w, np.zeros(len(w)))[owner][:, None]) for w in weights]
    active = np.flatnonzero(sizes > HEAD)
    heads = np.zeros(len(active), np.int64)
    for k in range(HEAD):
        heads = heads << 8 | flat[starts[active] + k]
    group = np.cumsum(np.r_[True, heads[1:] != heads[:-1]][:len(heads)]) - 1
    by_size: dict[int, list[bytes]] = {}
    for beginning in spanning:
        by_size.setdefault(len(beginning), []).append(beginning)
    at = HEAD
    while len(active):
        symbol = flat[starts[active] + at].astype(np.int64)
        shared = []
        for beginning in by_size.get(at, ()):
            lo, hi = (bisect_left(parts, x) for x in (beginning, beginning + b"\xff" * 2))
            lo, hi = np.searchsorted(active, (lo, hi))
            if hi > lo:
                shared.append((lo, hi, spanning[beginning]))
        for j in range(8):
            run = group << 8 | (symbol | 256) >> (8 - j)
            run = np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1
            bit = symbol >> (7 - j) & 1
            for k, w in enumerate(weights):
                total, one = np.bincount(run, w[active]), np.bincount(run, w[active] * bit)
                code = packed(total - one, one)[run]
                for lo, hi, sums in shared:
                    tree = sums[k].reshape(1 << j, 2, -1).sum(axis=2)
                    node = symbol[lo:hi] >> (8 - j)
                    code[lo:hi] = packed(tree[node, 0], tree[node, 1])
                out[k][firsts[active] + at - HEAD, j] = code
        follow = group << 8 | symbol
        change = np.r_[True, follow[1:] != follow[:-1]]
        alone = change & np.r_[change[1:], True]
        at += 1
        for beginning in by_size.get(at, ()):
            lo, hi = (bisect_left(parts, x) for x in (beginning, beginning + b"\xff" * 2))
            alone[slice(*np.searchsorted(active, (lo, hi)))] = False
        stay = ~alone & (sizes[active] > at)
        group = (np.cumsum(change) - 1)[stay]
        active = active[stay]
    return out


@dataclass
class Mixer:
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS + 1), 0.25))
    # Refinement: counts of ones and of bits by node and bucket of the mixed logit.
    ones: np.ndarray = field(default_factory=lambda: np.zeros(256 * BUCKETS))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(256 * BUCKETS))
    gate_seen: np.ndarray = field(default_factory=lambda: np.zeros(GATES))

    def _mixed(self, codes: list[np.ndarray], node: np.ndarray):
        logits = np.stack([(c >> 4) * (2 * RANGE / 4094) - RANGE for c in codes] + [np.full(len(node), 0.3)], axis=1)
        for k, c in enumerate(codes):
            logits[(c & 15) == 0, k] = 0.0
        gate = (codes[-1] & 15).astype(np.int64) * 4 + ((codes[3] & 15) >> 2)
        total = np.clip(np.einsum("ij,ij->i", logits, self.weights[gate]), -12, 12)
        bucket = np.clip(np.rint((total + RANGE) * 2), 0, BUCKETS - 1).astype(np.int64) + node.astype(np.int64) * BUCKETS
        return logits, gate, total, bucket

    def learn(self, rows: Positions, w: np.ndarray, tables: Tables, rate: float) -> None:
        """One step on a batch of symbols: gates take a damped Newton step along each weight. The curvature has
        a floor, so that sure mistakes don't make a step unbounded."""
        gradient, curve = np.zeros_like(self.weights), np.full_like(self.weights, 1e-9)
        seen = np.zeros(GATES)
        for j in range(8):
            node, bit, codes = tables.read(rows, j)
            logits, gate, total, bucket = self._mixed(codes, node)
            p = 1 / (1 + np.exp(-total))
            error, slope = w * (p - bit), w * np.maximum(p * (1 - p), 0.03)
            for k in range(CONTEXTS + 1):
                gradient[:, k] += np.bincount(gate, error * logits[:, k], GATES)
                curve[:, k] += np.bincount(gate, slope * logits[:, k] ** 2, GATES)
            seen += np.bincount(gate, w, GATES)
            self.ones += np.bincount(bucket, w * bit, 256 * BUCKETS)
            self.seen += np.bincount(bucket, w, 256 * BUCKETS)
        trust = seen / (seen + 50)
        self.weights -= rate * trust[:, None] * gradient / (curve * CONTEXTS)
        self.gate_seen += seen

    def log10(self, rows: Positions, tables: Tables) -> np.ndarray:
        """log10 probability of each symbol."""
        out = np.zeros(len(rows.symbols))
        for j in range(8):
            node, bit, codes = tables.read(rows, j)
            _, _, total, bucket = self._mixed(codes, node)
            p = 1 / (1 + np.exp(-total))
            refined = (self.ones[bucket] + 30 * p) / (self.seen[bucket] + 30)
            p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def merged(parts: list[Mixer]) -> Mixer:
    """Weights averaged by what each part has seen of a gate, refinement counts added."""
    out = Mixer()
    for m in parts:
        out.ones += m.ones
        out.seen += m.seen
        out.gate_seen += m.gate_seen
    if parts:
        shares = np.stack([m.gate_seen for m in parts])
        total = shares.sum(axis=0)
        mean = np.einsum("pg,pgk->gk", shares, np.stack([m.weights for m in parts])) / np.maximum(total, 1e-9)[:, None]
        out.weights = np.where(total[:, None] > 0, mean, out.weights)
    return out
