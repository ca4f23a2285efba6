"""Language-model scores by logistic context mixing.

A document is coded token by token in its order (lower-cased A-Z, words between ASCII white space, then an end), as bits.
The bits of a token's path (its class and part of its hash, `word_paths`) are predicted in hashed contexts that reach over
the two tokens before it; gated weights, learned online over all training documents, mix the predictors' log-odds, and a
refinement table corrects the mix. Words that share a path share its probability by their training counts. A word that
training lacks is spelled after its path, as the bits of its bytes and of a space, by a second mixer of the same kind:
its contexts are none, the last one to four bytes of the word, and all of it so far, and it learns from each distinct
training word once. In both, an occurrence is taken out of the counts before the mixer learns from it. Last the model
adapts to the document: the counts of its words so far are joined by some number of words of the mixed probability; each
number in `ADAPT` is tried on the document, and the results are averaged as probabilities, so the one that suits the
document decides. The log10 probability of all tokens is the score; bits_per_byte is its other form.

The base score is the smoothed unigram score of the same tokens.

Word counts are gathered as distinct words, dealt out by the words' hashes, and grow with the corpus. The predictors'
tables have a bounded size, as they are sent to all executors: at most 4 x 2^22 slots of 6 bytes for tokens, and
6 x 2^20 of 8 for spelling; contexts beyond that share slots. Null or empty text: just the end. Null doc_id counts as the
text "null". Repeated rows are scored, and learned from, each. Memory: about 8 MB of text (or the longest text) as
arrays, or one share of the vocabulary, and the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm import word_paths
from quillspar.llm.common import U64, Words, column, hash_strings, located, sized_batches, whole_groups
from quillspar.session import drop_table, write_table

BATCH_BYTES = 8 << 20
#: About this many bytes of text give one share of the vocabulary.
SHARE_BYTES = 48 << 20
#: About this many bytes of text for each task that counts or learns in sequence.
TRAINER_BYTES = 96 << 20
TABLE_BITS, BLOCK = 20, 1 << 14
ORDERS = 6
GATES = 8 * 8 * 4
RATE, FIRST_WEIGHT, STEP = 0.01, 0.2, 16384
STEPS, LIMIT = 24, 8.0
ADAPT = (100.0, 1000.0, 10_000.0, 100_000.0)
#: How much has been seen in the contexts of four bytes and of all of the word picks the gate.
SEEN = {3: (0.5, 8, 512), 5: (0.5, 2, 4, 8, 32, 256, 4096)}
_SALTS = np.array([0x1B873593, 0xCC9E2D51, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)
#: Words at a time, where that decides steps of learning, and where it doesn't.
CHUNK_WORDS, FEW_WORDS = 16384, 1024


class Coded:
    """The bits of some words: the contexts of each byte, and for each bit position the slots and outcomes."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.bytes = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = len(self.bytes)
        place = np.arange(n) - np.repeat(self.starts, self.lengths)
        before = []
        for k in range(1, 5):
            x = np.zeros(n, np.uint32)
            x[k:] = self.bytes[:-k] if n > k else x[k:]
            x[place < k] = 0
            before.append(x)
        with np.errstate(over="ignore"):
            root = U64(0x9E3779B97F4A7C15)
            powers = np.cumprod(np.full(n, root, U64))
            inverse = np.cumprod(np.full(n, U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), U64))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum((self.bytes.astype(U64) + U64(1)) * powers)])
            first = np.repeat(self.starts, self.lengths)
            prefix = (sums[:-1] - sums[first]) * inverse[first]
            prefix = ((prefix ^ (prefix >> U64(29))) * root >> U64(32)).astype(np.uint32)
            two = before[0] | before[1] << 8
            four = two | before[2] << 16 | before[3] << 24
            self.contexts = [np.minimum(place, 3).astype(np.uint32), before[0], two, two | before[2] << 16, four, prefix]
            for i, salt in enumerate(_SALTS):
                c = (self.contexts[i] + np.uint32(i + 1)) * salt
                self.contexts[i] = c ^ (c >> np.uint32(15))

    def bit(self, b: int, part: slice = slice(None)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots (of each predictor), outcomes, and the part of the byte known so far, at bit b of some bytes."""
        own = self.bytes[part]
        node = (np.uint32(1 << b) | own >> np.uint32(8 - b)) if b else np.ones(len(own), np.uint32)
        mixed = node * np.uint32(0x9E3779B1)
        slots = [((c[part] + mixed) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TABLE_BITS)).astype(np.int64) for c in self.contexts]
        return slots, (own >> np.uint32(7 - b) & np.uint32(1)).astype(np.int64), node.astype(np.int64)


def count_bits(words: list[bytes], weights: np.ndarray, tables: np.ndarray) -> None:
    """Add the words' bits, times their counts, to tables[predictor, slot, bit]."""
    for a in range(0, len(words), CHUNK_WORDS):
        coded = Coded(words[a : a + CHUNK_WORDS])
        each = np.repeat(weights[a : a + CHUNK_WORDS].astype(np.float32), coded.lengths)
        for b in range(8):
            slots, bits, _ = coded.bit(b)
            for i in range(ORDERS):
                np.add.at(tables[i].reshape(-1), slots[i] * 2 + bits, each)


class Odds:
    """What the spelling predictors say in each slot, worked out once; with `without`, also less one 0 and less one 1."""

    def __init__(self, tables: np.ndarray, without: bool):
        kinds, self.gates = (0, 1) if without else (None,), []
        self.wide, self.odds = len(kinds), np.empty((ORDERS, tables.shape[1], len(kinds)), np.float32)
        for i in range(ORDERS):
            seen = np.empty((tables.shape[1], len(kinds)), np.float32)
            for k, own in enumerate(kinds):
                zero, one = (np.maximum(tables[i, :, bit] - 1, 0) if own == bit else tables[i, :, bit] for bit in (0, 1))
                self.odds[i, :, k] = np.log((one + 0.02) / (zero + 0.02))
                seen[:, k] = zero + one
            if i in SEEN:
                self.gates.append(sum((seen >= x).astype(np.uint8) for x in SEEN[i]).reshape(-1))
        np.clip(self.odds, -LIMIT, LIMIT, out=self.odds)
        self.odds = self.odds.reshape(ORDERS, -1)

    def at(self, slots: list[np.ndarray], bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds of each predictor, and gates within the bit's place."""
        slots = [(x << 1) + bits for x in slots] if self.wide == 2 else slots
        rough, fine = (np.take(g, slots[i]) for g, i in zip(self.gates, sorted(SEEN), strict=True))
        return [np.take(o, at) for o, at in zip(self.odds, slots, strict=True)], fine * np.uint8(4) + rough


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


class Mixer:
    """Gated weights and the refinement table; both are sums that can be added up over tasks."""

    def __init__(self):
        self.weights = np.full((GATES, ORDERS), FIRST_WEIGHT)
        self.moved = np.zeros(GATES)
        self.refined = np.zeros((STEPS + 1, 256, 2))

    def learn(self, words: list[bytes], counts: np.ndarray, tables: np.ndarray | Odds) -> None:
        """From words and their counts; bits are brought together by gate, as in `word_paths`."""
        known = tables if isinstance(tables, Odds) else Odds(tables, True)
        order = np.random.RandomState(len(words)).permutation(len(words))  # neighbours in order share their contexts
        words, counts = [words[i] for i in order.tolist()], counts[order]
        for a in range(0, len(words), CHUNK_WORDS):
            coded = Coded(words[a : a + CHUNK_WORDS])
            each = np.repeat(counts[a : a + CHUNK_WORDS].astype(np.float64), coded.lengths)
            for b in range(8):
                weights, places, placed = self.weights[b * 32 : b * 32 + 32], [], []
                for x in range(0, len(each), STEP):
                    slots, bits, node = coded.bit(b, slice(x, x + STEP))
                    found, gates = known.at(slots, bits)
                    order = np.argsort(gates, kind="stable")
                    odds = np.stack([np.take(s, order) for s in found])
                    w = np.take(each[x : x + STEP], order)
                    place = np.take((node << 1) + bits, order)
                    sizes, mixed = np.bincount(gates, minlength=32), np.empty(len(order), np.float32)
                    ends = np.cumsum(sizes)
                    met = [(g, slice(ends[g] - sizes[g], ends[g])) for g in np.flatnonzero(sizes).tolist()]
                    for g, own in met:
                        mixed[own] = weights[g].astype(np.float32) @ odds[:, own]
                    p = squash(mixed)
                    light = w.astype(np.float32)
                    miss, spread = ((place & 1).astype(np.float32) - p) * light, p * (1 - p) * light
                    squares = odds * odds
                    for g, own in met:  # a damped Newton step for each weight of a gate
                        weights[g] += RATE * (odds[:, own] @ miss[own]) / (squares[:, own] @ spread[own] + 1)
                        self.moved[b * 32 + g] += w[own].sum()
                    at = np.rint((np.clip(mixed, -LIMIT, LIMIT) + np.float32(LIMIT)) * np.float32(STEPS / (2 * LIMIT))).astype(np.int64)
                    places.append(at * 512 + place)
                    placed.append(w)
                self.refined += np.bincount(np.concatenate(places), np.concatenate(placed), self.refined.size).reshape(self.refined.shape)

    def prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and the refined log-odds for each step of mixed log-odds and known part of the byte."""
        grid = np.linspace(-LIMIT, LIMIT, STEPS + 1)[:, None]
        trust = 20.0
        p = (self.refined[:, :, 1] + trust * squash(grid)) / (self.refined.sum(axis=2) + trust)
        return self.weights, np.log(p / (1 - p))


def word_bits(words: list[bytes], tables: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Bits that coding each word takes."""
    out, known = [], Odds(tables, False) if words else None
    for a in range(0, len(words), FEW_WORDS):
        coded = Coded(words[a : a + FEW_WORDS])
        cost = np.zeros(len(coded.bytes))
        for b in range(8):
            slots, bits, node = coded.bit(b)
            odds, gates = known.at(slots, bits)
            mixed = np.zeros(len(bits))
            for x, w in zip(odds, weights[b * 32 : b * 32 + 32].T, strict=True):
                mixed += x * np.take(w, gates)
            mixed = np.clip(mixed, -LIMIT, LIMIT)
            at = (mixed + LIMIT) * (STEPS / (2 * LIMIT))
            low = np.minimum(at.astype(np.int64), STEPS - 1)
            share = at - low
            final = (mixed + refined[low, node] * (1 - share) + refined[low + 1, node] * share) / 2
            cost += np.log2(1 + np.exp(np.where(bits == 1, -final, final)))
        out.append(np.add.reduceat(cost, coded.starts))
    return np.concatenate(out) if out else np.zeros(0)


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as a compressed blob, like bytes of theirs side by side."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def opened(blob: bytes, kind: type | str) -> np.ndarray:
    kind, size = np.dtype(kind), int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _joined(words: pa.Array, cuts: np.ndarray) -> list[bytes]:
    """The words between any two cuts, as one blob."""
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), b" ")
    return [squeezed(np.frombuffer(x.as_buffer(), np.uint8)) for x in texts]


def _split(blob: bytes) -> list[bytes]:
    text = opened(blob, np.uint8).tobytes()
    return text.split(b" ") if text else []


def _gathered(shares: int, kind: pa.DataType):
    """Rows of two kinds: a batch's documents as word codes (part -1), and its distinct words of each share."""
    fields = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary()), ("doc_ids", pa.list_(kind)), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            words = Words(column(table, "text"))
            held = column(table, "held_out").to_numpy(zero_copy_only=False)
            vocabulary = words.vocabulary.cast(pa.binary())
            hashes = (hash_strings(vocabulary) >> U64(32)).astype(np.uint32)
            part = (hashes % np.uint32(shares)).astype(np.int64)
            learned = np.repeat(~held, np.diff(words.starts))
            counts = np.bincount(words.codes[learned], minlength=len(part)).astype(np.int32)
            number = table.column("_file")[0].as_py() ^ (table.column("_row")[0].as_py() * 0x9E3779B97F4A7C15 & (1 << 63) - 1)
            rows = [{"batch": number, "part": -1, "codes": squeezed(words.codes.astype(np.uint32)), "starts": squeezed(words.starts.astype(np.int64)), "hashes": squeezed(hashes), "doc_ids": column(table, "doc_id").to_pylist(), "held": held.tolist(), "sizes": pc.binary_length(pc.fill_null(column(table, "text"), "")).to_numpy().astype(np.int64).tobytes()}]
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(shares + 1))
            texts = _joined(vocabulary.take(pa.array(order)), cuts)
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append({"batch": number, "part": p, "words": texts[p], "counts": squeezed(counts[order[cuts[p] : cuts[p + 1]]])})
            yield from pa.Table.from_pylist(rows, fields).to_batches(32)

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each share: its distinct words with counts (batch null), and for each batch where its words are among them."""
    for several in whole_groups(batches, "part"):
        numbers = column(several, "part").to_numpy()
        for part in np.unique(numbers).tolist():
            table = several.filter(pa.array(numbers == part))
            split = pc.split_pattern(pa.array([opened(x, np.uint8).tobytes() for x in column(table, "words").to_pylist()], pa.binary()), " ")
            coded = pc.list_flatten(split).dictionary_encode()
            counts = np.concatenate([opened(x, np.int32) for x in column(table, "counts").to_pylist()])
            order = pc.array_sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int32)
            place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
            places, words = place[coded.indices.to_numpy()], coded.dictionary.take(order)
            sums = np.bincount(places, counts, len(order)).astype(np.int64)
            rows = [{"part": part, "batch": None, "words": _joined(words, np.array([0, len(words)]))[0], "counts": squeezed(sums), "n": int(sums.sum()), "v": int((sums > 0).sum())}]
            cuts = split.offsets.to_numpy()
            for batch, a, b in zip(column(table, "batch").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append({"part": part, "batch": batch, "words": squeezed(places[a:b]), "counts": None, "n": 0, "v": 0})
            fields = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
            yield from pa.Table.from_pylist(rows, fields).to_batches(64)


def _learned(words: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words met in training, each once."""
    found = [w for w, c in zip(_split(words), opened(counts, np.int64).tolist(), strict=True) if c > 0]
    return found, np.ones(len(found))


def added(rows: DataFrame, kind: str = "f8", finish: Callable[[np.ndarray], np.ndarray] = np.asarray, tasks: int = 16) -> Iterator[tuple[int, bytes]]:
    """The sums of blobs (numbers of `kind`) by block, from rows of block, task, sums; added up and finished in tasks.

    The tasks reach the driver one after the other, so there are few; a single one is for sums of one block.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                if block != last and last is not None:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([last]), "sums": pa.array([finish(total).tobytes()], pa.binary())})
                part = opened(blob, kind).astype(np.float64)
                last, total = block, part if block != last else total + part
        if last is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([last]), "sums": pa.array([finish(total).tobytes()], pa.binary())})

    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "task").mapInArrow(summed, "block long, sums binary")
    for row in dealt.toLocalIterator(prefetchPartitions=True):
        yield row.block, row.sums


_BLOCKS = "block long, task long, sums binary"


def _blocks(flat: np.ndarray, task: int, size: int, offset: int = 0) -> Iterator[pa.RecordBatch]:
    """The parts of an array that aren't zero throughout, as rows for `added`."""
    for k in range(0, len(flat), size):
        if (part := flat[k : k + size]).any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([offset + k // size]), "task": pa.array([task]), "sums": pa.array([squeezed(part)], pa.binary())})


def count_tables(shares: DataFrame) -> np.ndarray:
    """The spelling predictors' tables over all training words: summed in tasks, then by block of slots; of a fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, task = np.zeros((ORDERS, 1 << TABLE_BITS, 2), np.float32), 0
        for batch in batches:
            for part, w, c in zip(*(batch.column(x).to_pylist() for x in ("part", "words", "counts")), strict=True):
                count_bits(*_learned(w, c), tables)
                task = max(task, part)
        yield from _blocks(tables.reshape(-1), task, 2 * BLOCK)

    tables = np.zeros(ORDERS * 2 << TABLE_BITS, np.float32)
    for block, blob in added(shares.mapInArrow(counted, _BLOCKS), "f4", lambda x: x.astype(np.float32)):
        sums = np.frombuffer(blob, np.float32)
        tables[block * 2 * BLOCK :][: len(sums)] = sums
    return tables.reshape(ORDERS, 1 << TABLE_BITS, 2)


def train_mixer(shares: DataFrame, shared) -> Mixer:
    """Each task learns online over its words in order; the tasks' weights are averaged by what they saw of a gate."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, task, known = Mixer(), 0, Odds(shared.value, True)
        for batch in batches:
            for part, w, c in zip(*(batch.column(x).to_pylist() for x in ("part", "words", "counts")), strict=True):
                mixer.learn(*_learned(w, c), known)
                task = max(task, part)
        state = np.concatenate([(mixer.weights * mixer.moved[:, None]).ravel(), mixer.moved, mixer.refined.ravel()])
        yield from _blocks(state, task, 1 << 20)

    out = Mixer()
    for _, blob in added(shares.mapInArrow(learned, _BLOCKS), tasks=1):
        sums = np.frombuffer(blob)
        moved = sums[GATES * ORDERS :][:GATES]
        seen = moved > 0
        out.weights[seen] = sums[: GATES * ORDERS].reshape(GATES, ORDERS)[seen] / moved[seen, None]
        out.refined = sums[GATES * (ORDERS + 1) :].reshape(out.refined.shape)
    return out


def path_sums(vocabulary: DataFrame, n_words: int) -> np.ndarray:
    """How many training words have each path."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, task = np.zeros(word_paths.PATHS, np.int64), 0
        for batch in batches:
            for part, w, c in zip(*(batch.column(x).to_pylist() for x in ("part", "words", "counts")), strict=True):
                counts, words = opened(c, np.int64), _split(w)
                hashes = (hash_strings(pa.array(words, pa.binary())) >> U64(32)).astype(np.uint32)
                at = word_paths.paths(hashes, counts, n_words)
                np.add.at(sums, at.astype(np.int64), counts)
                task = max(task, part)
        yield from _blocks(sums, task, word_paths.PATHS)

    out = np.zeros(word_paths.PATHS)
    for _, blob in added(vocabulary.filter("batch IS NULL").select("part", "words", "counts").mapInArrow(summed, _BLOCKS), "i8", tasks=1):
        out = np.frombuffer(blob)
    return out


def _tokens(row: dict, n_words: int, training: bool) -> tuple[word_paths.Tokens, np.ndarray]:
    """The tokens of a batch's documents, and which of them belong to training documents.

    For training, each word counts as often as it is met elsewhere.
    """
    counts, starts = opened(row["counts"], np.int64), opened(row["starts"], np.int64)
    codes = opened(row["codes"], np.uint32).astype(np.int64)
    tokens = word_paths.Tokens(opened(row["hashes"], np.uint32), np.maximum(counts - 1, 0) if training else counts, codes, starts, n_words)
    return tokens, np.repeat(~np.array(row["held"], bool), np.diff(starts) + 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One batch of documents at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def sequence_tables(sequences: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The token predictors over all training documents, and without one bit each; of a bounded size."""
    size = word_paths.table_bits(n_words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, task = np.zeros((word_paths.CONTEXTS, 1 << size), np.int32), 0
        for row in _rows(batches):
            word_paths.count_leaves(*_tokens(row, n_words, True), leaves)
            task = max(task, row["batch"])
        yield from _blocks(leaves.reshape(-1), task, BLOCK)

    out, without = np.zeros(word_paths.CONTEXTS << size, np.int16), np.zeros(word_paths.CONTEXTS << size + 1, np.int16)
    def finished(sums: np.ndarray) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in word_paths.predictors(word_paths.nodes(sums))])

    for block, blob in added(sequences.mapInArrow(counted, _BLOCKS), "i4", finished):
        now, *less = np.split(np.frombuffer(blob, np.int16), 3)
        out[block * BLOCK :][: len(now)] = now
        without[block * 2 * BLOCK :][: 2 * len(now)] = np.concatenate(less)
    return out.reshape(word_paths.CONTEXTS, -1), without.reshape(word_paths.CONTEXTS, -1)


def train_sequences(sequences: DataFrame, n_words: int, shared) -> tuple[np.ndarray, np.ndarray]:
    """Each task learns online over its training documents; the tasks' weights are averaged by what they saw of a gate."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, task = word_paths.Mixer(), 0
        for row in _rows(batches):
            mixer.learn(*_tokens(row, n_words, True), shared.value)
            task = max(task, row["batch"])
        yield from _blocks(mixer.state(), task, 1 << 20)

    found = [np.frombuffer(blob) for _, blob in added(sequences.mapInArrow(learned, _BLOCKS), tasks=1)]  # one block of 210 000 numbers
    return word_paths.Mixer.prepared(found[0] if found else None)


def earlier_counts(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each token's word occurred before it in its document."""
    order = np.argsort(owner * (codes.max(initial=0) + 1) + codes, kind="stable")
    c, o = codes[order], owner[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    out = np.empty(len(c), np.int64)
    out[order] = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate([first, [len(c)]])))
    return out


def score(docs: DataFrame, holdout: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = located(docs, ["doc_id", "text"]).drop("_block").withColumn("held_out", F.pmod(F.crc32(key), F.lit(holdout)) == 0)
    total, n_ends = docs.select(F.sum(F.octet_length("text")), F.count_if(F.pmod(F.crc32(key), F.lit(holdout)) != 0)).first()
    shares = max(8, (total or 0) // SHARE_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()
    if kind not in ("bigint", "string"):
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    listed = f"array<{'bigint' if kind == 'bigint' else 'string'}>"
    schema = f"batch long, part long, words binary, counts binary, codes binary, starts binary, hashes binary, doc_ids {listed}, held array<boolean>, sizes binary"
    gathered = write_table(rows.mapInArrow(_gathered(shares, arrow), schema), "gathered")
    dealt = gathered.filter("part >= 0").select("batch", "part", "words", "counts").repartition(shares, "part").sortWithinPartitions("part")
    vocabulary = write_table(dealt.mapInArrow(_vocabulary, "part long, batch long, words binary, counts binary, n long, v long"), "vocabulary")
    n_words, v = (x or 0 for x in vocabulary.agg(F.sum("n"), F.sum("v")).first())
    n, v = n_words + n_ends, v + (n_ends > 0)
    trainers = vocabulary.filter("batch IS NULL").select("part", "words", "counts").coalesce(max(4, (total or 0) // TRAINER_BYTES))
    spelling = spark.sparkContext.broadcast(count_tables(trainers))
    speller = spark.sparkContext.broadcast(train_mixer(trainers, spelling).prepared())
    alike = path_sums(vocabulary, n_words)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and share: counts of the batch's words, and the bits that spell those not met in training."""
        for several in whole_groups(batches, "part"):
            numbers = column(several, "part").to_numpy()
            for part in np.unique(numbers).tolist():
                rows = several.filter(pa.array(numbers == part)).to_pylist()
                whole = next(r for r in rows if r["batch"] is None)
                counts, words = opened(whole["counts"], np.int64), _split(whole["words"])
                cost, unknown = np.zeros(len(words), np.float32), np.flatnonzero(counts == 0)
                cost[unknown] = word_bits([words[i] for i in unknown.tolist()], spelling.value, *speller.value)
                for r in rows:
                    if r["batch"] is not None:
                        at = opened(r["words"], np.int32)
                        yield pa.RecordBatch.from_pydict({"batch": pa.array([r["batch"]]), "part": pa.array([part]), "counts": pa.array([squeezed(counts[at])], pa.binary()), "bits": pa.array([squeezed(cost[at])], pa.binary())})

    answers = vocabulary.select("part", "batch", "words", "counts").repartition(shares, "part").sortWithinPartitions("part")
    answers = answers.mapInArrow(coded, "batch long, part long, counts binary, bits binary")
    fields = pa.schema([("batch", pa.int64()), ("codes", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("doc_ids", pa.list_(arrow)), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch of documents with what is known of its words."""
        for several in whole_groups(batches, "batch"):
            numbers = column(several, "batch").to_numpy()
            for batch in np.unique(numbers):
                rows = several.filter(pa.array(numbers == batch)).to_pylist()
                whole = next(r for r in rows if r["part"] < 0)
                part = opened(whole["hashes"], np.uint32) % np.uint32(shares)
                counts, bits = np.zeros(len(part), np.int64), np.zeros(len(part), np.float32)
                order = np.argsort(part, kind="stable")
                cuts = dict(zip(*np.unique(part[order], return_index=True), strict=True))
                for r in rows:
                    if r["part"] >= 0:
                        c = opened(r["counts"], np.int64)
                        at = order[cuts[r["part"]] : cuts[r["part"]] + len(c)]
                        counts[at], bits[at] = c, opened(r["bits"], np.float32)
                yield from pa.Table.from_pylist([whole | {"counts": squeezed(counts), "bits": squeezed(bits)}], fields).to_batches()

    waiting = gathered.filter("part < 0").select("batch", "part", "codes", "starts", "hashes", "doc_ids", "held", "sizes").unionByName(answers, allowMissingColumns=True)
    waiting = waiting.repartition("batch").sortWithinPartitions("batch", "part")
    sequences = write_table(waiting.mapInArrow(joined, f"batch long, codes binary, starts binary, hashes binary, counts binary, bits binary, doc_ids {listed}, held array<boolean>, sizes binary"), "sequences")
    drop_table(gathered)
    drop_table(vocabulary)
    learners = sequences.select("batch", "codes", "starts", "hashes", "counts", "held").coalesce(max(4, (total or 0) // TRAINER_BYTES))
    now, less = sequence_tables(learners, n_words)
    tables, without = spark.sparkContext.broadcast(now), spark.sparkContext.broadcast(less)
    mixer = spark.sparkContext.broadcast(train_sequences(learners, n_words, without))
    without.destroy()
    low = float(n + 0.1 * (v + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            counts, spelled = opened(row["counts"], np.int64), opened(row["bits"], np.float32)
            codes, starts = opened(row["codes"], np.uint32).astype(np.int64), opened(row["starts"], np.int64)
            k, length = len(starts) - 1, np.diff(starts)
            owner = np.repeat(np.arange(k), length)
            sums = np.bincount(owner, np.log10((counts + 0.1) / low)[codes], k) + np.log10((n_ends + 0.1) / low)
            known = np.bincount(owner, (counts > 0)[codes], k).astype(np.int64) + int(n_ends > 0)
            tokens, _ = _tokens(row, n_words, False)
            cost = word_paths.path_bits(tokens, tables.value, *mixer.value)
            path = word_paths.paths(opened(row["hashes"], np.uint32), counts, n_words).astype(np.int64)
            after = np.where(counts > 0, np.log2(np.maximum(alike[path], 1) / np.maximum(counts, 1)), spelled)
            mixed, end = np.exp2(-cost[tokens.is_word] - after[codes]), np.exp2(-cost[tokens.ends])
            place = np.arange(len(codes)) - np.repeat(starts[:-1], length)
            earlier = earlier_counts(codes, owner)
            tried = np.stack([np.bincount(owner, np.log10((earlier + a * mixed) / (place + a)), k) + np.log10(a * end / (length + a)) for a in ADAPT])
            top = tried.max(axis=0)
            model = top + np.log10(np.mean(10.0 ** (tried - top), axis=0))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], arrow), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(length + 1), "n_known": pa.array(known), "base_score": pa.array(sums), "score": pa.array(model), "n_bytes": pa.array(np.frombuffer(row["sizes"], np.int64))})

    out = sequences.mapInArrow(scored, f"doc_id {'bigint' if kind == 'bigint' else 'string'}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") * float(np.log2(10.0)) / F.greatest("n_bytes", F.lit(1))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
