"""op10's kernels against plain ones that go bit by bit: same counts, same weights, much less CPU."""

import time

import numpy as np
import pytest

from quillspar.llm import context_mixing, word_paths

SIZE = 18


def made(n_words=60_000, seed=7):
    r = np.random.RandomState(seed)
    starts = np.append(np.arange(0, n_words, 37), n_words)
    codes = np.minimum(r.zipf(1.3, n_words), 5000) - 1
    counts, hashes = np.bincount(codes, minlength=5000), r.randint(0, 1 << 32, 5000, np.uint32)
    tokens = word_paths.Tokens(hashes, np.maximum(counts - 1, 0), codes, starts, n_words)
    return tokens, r.rand(len(tokens)) < 0.9


def bits(tokens, kept):
    """Per block and depth: depth, the slots (line and bits so far) in each context, the bits so far, and the bit."""
    chosen, shift = np.flatnonzero(kept), np.uint32(32 - SIZE + 4)
    for a in range(0, len(chosen), word_paths.BLOCK):
        at = chosen[a : a + word_paths.BLOCK]
        for b in range(word_paths.DEPTH):
            group = at if b < 4 else at[tokens.paths[at] < word_paths.END << 8]
            path, part = tokens.paths[group], b // 4 * 4
            mark = np.uint32(1 << part) | path >> np.uint32(12 - part)
            lines = [mark.astype(np.int64), *(((k[group] ^ mark * np.uint32(0x7FEB352D)) * np.uint32(0x846CA68B) >> shift).astype(np.int64) for k in tokens.keys)]
            node = (np.uint32(1 << b) | path >> np.uint32(12 - b)).astype(np.int64)
            inside = node & (1 << b - part) - 1 | 1 << b - part
            yield b, [line << 4 | inside for line in lines], node, (path >> np.uint32(11 - b) & np.uint32(1)).astype(np.int64)


def plain_count(tokens, kept):
    tables = np.zeros((word_paths.CONTEXTS, 1 << SIZE, 2), np.int32)
    for _, slots, _, y in bits(tokens, kept):
        for table, slot in zip(tables, slots, strict=True):
            np.add.at(table.reshape(-1), slot * 2 + y, np.ones(len(y), np.int32))
    return tables


def plain_learn(tokens, kept, tables):
    mixer, limit, steps = word_paths.Mixer(), word_paths.LIMIT, word_paths.STEPS
    for b, slots, node, y in bits(tokens, kept):
        found = [table[slot * 2 + y] for table, slot in zip(tables, slots, strict=True)]
        odds = [(x >> 2) / word_paths.ODDS_UNIT for x in found]
        gates = (b * 16 + (found[1] & 3) * 4 + (found[2] & 3)).astype(np.int64)
        mixed = np.clip(sum(x * mixer.weights[gates, i] for i, x in enumerate(odds)), -limit, limit)
        p = 1 / (1 + np.exp(-mixed))
        for i, x in enumerate(odds):
            pull, spread = (np.bincount(gates, v, word_paths.GATES) for v in ((y - p) * x, p * (1 - p) * x * x))
            mixer.weights[:, i] += word_paths.RATE * pull / (spread + 1)
        mixer.moved += np.bincount(gates, minlength=word_paths.GATES)
        np.add.at(mixer.refined, (np.rint((mixed + limit) * (steps / (2 * limit))).astype(np.int64), node, y), 1)
    return mixer


def fast_count(tokens, kept):
    leaves = np.zeros((word_paths.CONTEXTS, 1 << SIZE), np.int32)
    word_paths.count_leaves(tokens, kept, leaves)
    return word_paths.nodes(leaves)


def fast_learn(tokens, kept, tables):
    mixer = word_paths.Mixer()
    mixer.learn(tokens, kept, tables)
    return mixer


def cpu(run, *args):
    best = None
    for _ in range(3):
        begun = time.process_time()
        out = run(*args)
        best = min(best or 1e9, time.process_time() - begun)
    return out, best


def test_tokens_are_counted_and_learned_as_by_plain_loops_in_less_cpu():
    tokens, kept = made()
    (sums, count_s), (want, plain_count_s) = cpu(fast_count, tokens, kept), cpu(plain_count, tokens, kept)
    assert np.array_equal(sums, want)
    less = word_paths.predictors(sums)[1].reshape(word_paths.CONTEXTS, -1)
    (got, learn_s), (plain, plain_learn_s) = cpu(fast_learn, tokens, kept, less), cpu(plain_learn, tokens, kept, less)
    assert got.weights == pytest.approx(plain.weights, abs=1e-5)
    assert np.array_equal(got.moved, plain.moved) and got.refined.sum() == plain.refined.sum()
    assert abs(got.refined - plain.refined).sum() <= 20  # log-odds halfway between two steps
    assert count_s + learn_s < 0.75 * (plain_count_s + plain_learn_s)


@pytest.mark.parametrize("without", [False, True])
def test_spelling_odds_are_those_of_the_counts(without):
    r = np.random.RandomState(5)
    tables = r.choice([0, 0, 1, 2, 5, 40, 9000], (context_mixing.ORDERS, 1 << 10, 2)).astype(np.float32)
    slots, y = [r.randint(0, 1 << 10, 500) for _ in range(context_mixing.ORDERS)], r.randint(0, 2, 500)
    odds, gates = context_mixing.Odds(tables, without).at(slots, y)
    seen = []
    for table, slot, got in zip(tables, slots, odds, strict=True):
        zero, one = table[slot].T
        if without:
            zero, one = np.maximum(zero - (1 - y), 0), np.maximum(one - y, 0)
        seen.append(zero + one)
        assert got == pytest.approx(np.clip(np.log((one + 0.02) / (zero + 0.02)), -8, 8), abs=1e-5)
    assert np.array_equal(gates, np.digitize(seen[5], (0.5, 2, 4, 8, 32, 256, 4096)) * 4 + np.digitize(seen[3], (0.5, 8, 512)))


def test_earlier_counts_of_interleaved_words():
    codes, owner = np.array([3, 1, 3, 3, 1, 3, 0]), np.array([0, 0, 0, 1, 1, 1, 2])
    assert context_mixing.earlier_counts(codes, owner).tolist() == [0, 0, 1, 0, 0, 1, 0]
    assert context_mixing.earlier_counts(codes[:0], owner[:0]).tolist() == []
