"""Words of a document in their order, as bits that a mixer of hashed contexts predicts.

A word's path is four bits of its class and eight of its hash. Classes are steps of four in the share that the word has
of the training words (the rarest share the last step); two further classes are the end and a word that training lacks,
and have no hash bits. Each bit of a path is predicted in four contexts: none, the word before, the two words before, and
the second word before. A predictor is a table of how often 0 and 1 followed its context and the path so far; slots are
picked by a hash. A gate (the bit's place and how much two predictors have seen) picks the weights by which the
predictors' log-odds are added; a refinement table corrects the sum by what it was worth at that place of the path.

The contexts of each four bits lie side by side in a table. Counts are taken over all training words. A training word is learned as the word it would be without this occurrence: one
met once teaches what an unknown word looks like. Tables have 2^14 to 2^MOST_BITS slots, by the number of training words:
they are sent to all executors, so they are bounded, and beyond that contexts share slots.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np

CLASS_BITS, HASH_BITS = 4, 8
DEPTH = CLASS_BITS + HASH_BITS
PATHS = 1 << DEPTH
LAST_CLASS, END, NEW = 13, 14, 15
MOST_BITS = 22
CONTEXTS = 4
GATES = DEPTH * 4 * 4
STEPS, LIMIT = 24, 8.0
RATE, FIRST_WEIGHT = 0.02, 0.3
BLOCK = 1 << 14
#: Tokens that are scored at a time: few, so that their lines stay in the processor's cache.
SCORED = 1 << 13
#: Log-odds are held in 1/1024, with two bits below them for how much has been seen.
ODDS_UNIT, PRIOR = 1024, 0.05
_SALTS = np.array([0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def table_bits(n_words: int) -> int:
    return min(MOST_BITS, max(14, int(n_words).bit_length() + 1))


def paths(hashes: np.ndarray, counts: np.ndarray, n_words: int) -> np.ndarray:
    """The path of each word by its 32-bit hash and its count in n_words training words."""
    steps = np.log2(max(1, n_words) / np.maximum(counts, 1)) / 2
    known = np.clip(steps, 0, LAST_CLASS).astype(np.uint32) << HASH_BITS | hashes.astype(np.uint32) >> np.uint32(32 - HASH_BITS)
    return np.where(counts > 0, known, np.uint32(NEW << HASH_BITS)).astype(np.uint32)


class Tokens:
    """The words and ends of some documents in order: word number, path, and a hash of each context."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, codes: np.ndarray, starts: np.ndarray, n_words: int):
        k, v = len(starts) - 1, len(hashes)
        self.first = starts[:-1] + np.arange(k)
        self.ends = starts[1:] + np.arange(k)
        is_word = np.ones(len(codes) + k, bool)
        is_word[self.ends] = False
        self.words = np.full(len(is_word), v, np.int32)
        self.words[is_word] = codes
        self.is_word = is_word
        self.paths = np.append(paths(hashes, counts, n_words), np.uint32(END << HASH_BITS))[self.words]
        known = np.append(hashes.astype(np.uint32), np.uint32(0))[self.words] | np.uint32(1)
        one, two = np.zeros(len(known), np.uint32), np.zeros(len(known), np.uint32)
        one[1:], two[2:] = known[:-1], known[:-2]
        one[self.first] = two[self.first] = 0
        if k:
            two[np.minimum(self.first + 1, len(two) - 1)] = 0  # of an empty document: the next one's first, 0 as well
        keys = [one, one * np.uint32(0x2C1B3C6D) ^ (two << np.uint32(13) | two >> np.uint32(19)), two]
        self.keys = []
        for i, key in enumerate(keys, 1):
            x = (key + np.uint32(i)) * _SALTS[i]
            self.keys.append((x ^ x >> np.uint32(15)) * np.uint32(0x297A2D39))

    def __len__(self) -> int:
        return len(self.words)

    def groups(self, size: int, kept: np.ndarray | None = None, block: int = BLOCK):
        """For each four bits and block of tokens (kept ones): first depth, tokens, their paths, and a line for each context.

        All blocks of the first four bits come first; a block of the others has those of its tokens that have hash bits.
        """
        chosen = np.arange(len(self)) if kept is None else np.flatnonzero(kept)
        cuts = np.append(np.arange(0, len(chosen), block), len(chosen))
        shift = np.uint32(32 - size + 4)
        for part in range(0, DEPTH, 4):
            if part == CLASS_BITS:
                deep = self.paths[chosen] < END << HASH_BITS
                cuts, chosen = np.append(0, np.cumsum(deep))[cuts], chosen[deep]
            if part <= CLASS_BITS:
                paths, keys = self.paths[chosen], [k[chosen] for k in self.keys]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z > a:
                    path = paths[a:z]
                    node = np.uint32(1 << part) | path >> np.uint32(DEPTH - part)
                    mark = node * np.uint32(0x7FEB352D)
                    lines = [((k[a:z] ^ mark) * np.uint32(0x846CA68B) >> shift).astype(np.int64) for k in keys]
                    yield part, chosen[a:z], path.astype(np.int64), [node.astype(np.int64), *lines]


def count_leaves(tokens: Tokens, kept: np.ndarray, leaves: np.ndarray) -> None:
    """Add the kept tokens to leaves[context, 16 * line + four bits]; `nodes` tells what that means for each bit."""
    size, ones = leaves.shape[1].bit_length() - 1, np.ones(BLOCK, leaves.dtype)
    for part, _, path, lines in tokens.groups(size, kept):
        four = path >> DEPTH - 4 - part & 15
        for table, line in zip(leaves, lines, strict=True):
            np.add.at(table, line << 4 | four, ones[: len(four)])


def nodes(leaves: np.ndarray) -> np.ndarray:
    """How often 0 and 1 followed in each slot (a line and the bits so far after a leading 1), from counts of four bits."""
    level, out = leaves.reshape(-1, 16), np.zeros((leaves.size // 16, 16, 2), leaves.dtype)
    for k in (8, 4, 2, 1):
        out[:, k : 2 * k] = level.reshape(-1, k, 2)
        level = out[:, k : 2 * k].sum(axis=2, dtype=leaves.dtype)
    return out.reshape(*leaves.shape, 2)


def count(tokens: Tokens, kept: np.ndarray, tables: np.ndarray) -> None:
    """Add the kept tokens' bits to tables[context, slot, bit]."""
    leaves = np.zeros(tables.shape[:2], tables.dtype)
    count_leaves(tokens, kept, leaves)
    tables += nodes(leaves)


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log-odds by counts, and in the lowest two bits whether they are at least 1, 3, 16."""
    odds = np.clip(np.log((one + PRIOR) / (zero + PRIOR)), -LIMIT + 0.01, LIMIT - 0.01)
    return (np.rint(odds * ODDS_UNIT).astype(np.int16) << 2 | np.digitize(zero + one, (1, 3, 16)).astype(np.int16)).astype(np.int16)


def predictors(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From pairs of counts: what each slot predicts, and what it would without one 0, and without one 1."""
    zero, one = sums[..., 0], sums[..., 1]
    without = np.stack([log_odds(np.maximum(zero - 1, 0), one), log_odds(zero, np.maximum(one - 1, 0))], axis=-1)
    return log_odds(zero, one), without


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Gated weights and the refinement table; `state` is a row of sums that can be added up over tasks."""

    def __init__(self):
        self.weights = np.full((GATES, CONTEXTS), FIRST_WEIGHT)
        self.moved = np.zeros(GATES)
        self.refined = np.zeros((STEPS + 1, PATHS, 2))

    def learn(self, tokens: Tokens, kept: np.ndarray, tables: np.ndarray) -> None:
        """From the kept tokens, by tables[context, slot * 2 + bit] without one such bit.

        A block's bits are brought together by gate, so that a gate's sums are products of a matrix and a vector.
        """
        size = (tables.shape[1] // 2).bit_length() - 1
        for part, blocks in groupby(tokens.groups(size, kept), key=itemgetter(0)):
            places: list[list[np.ndarray]] = [[] for _ in range(4)]
            for _, _, path, lines in blocks:
                starts = [line << 5 for line in lines]
                odds, squares = np.empty((CONTEXTS, len(path)), np.float32), np.empty((CONTEXTS, len(path)), np.float32)
                mixed = np.empty(len(path), np.float32)
                for b in range(part, part + 4):
                    inside = path >> DEPTH - 1 - b & (2 << b - part) - 1 | 2 << b - part  # the bits so far and this one
                    found = [np.take(table, start + inside) for table, start in zip(tables, starts, strict=True)]
                    gates = ((found[1] & 3) << 2 | found[2] & 3).astype(np.uint8)
                    order = np.argsort(gates, kind="stable")
                    for x, into in zip(found, odds, strict=True):
                        np.multiply(np.take(x, order) >> 2, np.float32(1 / ODDS_UNIT), out=into)
                    np.multiply(odds, odds, out=squares)
                    weights, sizes = self.weights[b * 16 : b * 16 + 16], np.bincount(gates, minlength=16)
                    ends = np.cumsum(sizes)
                    met = [(g, slice(ends[g] - sizes[g], ends[g])) for g in np.flatnonzero(sizes).tolist()]
                    for g, own in met:
                        mixed[own] = weights[g].astype(np.float32) @ odds[:, own]
                    np.clip(mixed, -LIMIT, LIMIT, out=mixed)
                    place = np.take(path >> DEPTH - 1 - b | 2 << b, order)
                    p = _squash(mixed)
                    miss, spread = (place & 1).astype(np.float32) - p, p * (1 - p)
                    for g, own in met:  # a damped Newton step for each weight of a gate
                        weights[g] += RATE * (odds[:, own] @ miss[own]) / (squares[:, own] @ spread[own] + 1)
                    self.moved[b * 16 : b * 16 + 16] += sizes
                    at = np.rint((mixed + np.float32(LIMIT)) * np.float32(STEPS / (2 * LIMIT))).astype(np.int64)
                    places[b - part].append(((at << b + 1) + place - (2 << b)).astype(np.int32))
            for b, found in enumerate(places, part):
                sums = np.bincount(np.concatenate(found), minlength=STEPS + 1 << b + 1)
                self.refined[:, 1 << b : 2 << b] += sums.reshape(STEPS + 1, 1 << b, 2)

    def state(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.moved[:, None]).ravel(), self.moved, self.refined.ravel()])

    @staticmethod
    def prepared(sums: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and refined log-odds for each step of mixed log-odds and path so far, from summed states."""
        out = Mixer()
        if sums is not None:
            moved = sums[GATES * CONTEXTS :][:GATES]
            met = moved > 0
            out.weights[met] = sums[: GATES * CONTEXTS].reshape(GATES, CONTEXTS)[met] / moved[met, None]
            out.refined = sums[GATES * (CONTEXTS + 1) :].reshape(out.refined.shape)
        grid, trust = np.linspace(-LIMIT, LIMIT, STEPS + 1)[:, None], 20.0
        p = (out.refined[:, :, 1] + trust * _squash(grid)) / (out.refined.sum(axis=2) + trust)
        return out.weights.astype(np.float32), np.log(p / (1 - p)).astype(np.float32)


def path_bits(tokens: Tokens, tables: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Bits that coding the path of each token takes, by tables[context, slot]."""
    size = tables.shape[1].bit_length() - 1
    cost, scale = np.zeros(len(tokens)), np.float32(1 / ODDS_UNIT)
    pairs = np.empty((STEPS, PATHS), np.complex64)  # what is refined at a step, and how far it is to the next one
    pairs.real, pairs.imag = refined[:-1], refined[1:] - refined[:-1]
    pairs = pairs.reshape(-1)
    first = (tables[0, :PATHS * 2].reshape(-1, 16) >> 2).astype(np.float32) * scale  # the lines of the context of nothing
    for part, group, path, lines in tokens.groups(size, None, SCORED):
        line = [x << 4 for x in lines]
        total = np.zeros(len(path)) if part == 0 else cost[group]
        for b in range(part, part + 4):
            own = weights[b * 16 : b * 16 + 16].T
            inside = path >> DEPTH - b & (1 << b - part) - 1 | 1 << b - part
            found = [np.take(table, start + inside) for table, start in zip(tables[1:], line[1:], strict=True)]
            gates = ((found[0] & 3) << 2 | found[1] & 3).astype(np.int64)
            plain = np.multiply.outer(first[1 << part : 2 << part, 1 << b - part : 2 << b - part].reshape(-1), own[0])
            prefix = path >> DEPTH - b
            mixed = np.take(plain.reshape(-1), prefix << 4 | gates)
            for x, w in zip(found, own[1:] * scale, strict=True):
                mixed += (x >> 2) * np.take(w, gates)
            np.clip(mixed, -LIMIT, LIMIT, out=mixed)
            at = (mixed + np.float32(LIMIT)) * np.float32(STEPS / (2 * LIMIT))
            low = np.minimum(at.astype(np.int64), STEPS - 1)
            near = np.take(pairs, low * PATHS + (prefix | 1 << b))
            at -= low.astype(np.float32)
            at *= near.imag
            at += near.real + mixed
            at *= (path >> DEPTH - 1 - b & 1).astype(np.float32) * np.float32(-1) + np.float32(0.5)
            total += np.log(np.exp(at) + 1)
        cost[group] = total
    return cost / np.log(2)
