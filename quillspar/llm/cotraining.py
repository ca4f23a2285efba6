"""Quality and toxicity scores by co-training.

Two classifiers see a document by different views: its text (words, their first four and five letters, and binned
measures such as the share of symbols) and its metadata (source, language, length and their pairs). Each is a logistic
regression over hashed features. In each round both score all unlabelled documents, in tasks, and the surest of each
verdict, by rank, become pseudo-labels for the other view, more of them from round to round; those of an earlier round that
are no longer among the surest are withdrawn. What a pseudo-label weighs is what the view's surest verdicts were worth on
labelled documents that neither view was fitted on: the square of their precision, as the share of the way from the
verdict's own frequency to 1. A verdict that is no better than chance there isn't passed on.

Of the labelled documents a fifth weighs the verdicts, another fifth, used for nothing else, calibrates each view (Platt)
and then joins the calibrated views; the rest is fitted on. Then all documents are scored.

Fitted on at most MAX_LABELLED labelled documents, the smallest by the MD5 of their ids, and on the pseudo-labels: of a
verdict's share of the unlabelled rows a sixth for each round passed, at most MAX_GIVEN a round, chosen among all unlabelled
rows; scoring covers all rows. Null text, source or language: features of their own. Repeated labels of a document: the
larger counts. Repeated rows of an id: scored each, and its label is fitted to the row with the smallest features. No labels
at all: every score is the prior 0.5 and all are kept. Empty tables give none. Memory: about 3 MB of text, or the longest
text; on the driver the feature numbers of what is fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspar.llm.common import U64, Words, column, hash_strings, located, mix64, narrow_join, release, sized_batches
from quillspar.session import drop_table, write_table

MAX_LABELLED, MAX_GIVEN = 12_000, 8_000 // 6
ROUNDS, MIN_HELD = 3, 5
DIM, EPOCHS, STEP, DECAY, RARE, TELLING = 1 << 18, 12, 0.1, 1e-4, 3, 3.0
#: A document is dropped from this probability of being toxic on.
TOXIC_CUT = 0.3
BATCH_BYTES = 3 << 20
SKIP = 65535
#: Rows unpacked at a time, and parts in which they come to the driver.
UNPACKED, PARTS = 256, 48
TARGETS = ("quality", "toxic")
_COUNTED = (("upper", "[A-Z]"), ("pipe", "[|]"), ("shout", "[!]"), ("digit", "[0-9]"), ("symbol", "[#*$%&<>]"), ("other", r"[{}\[\]=;/\\@_~^]"))


def _hashed(kind: int, values: np.ndarray) -> np.ndarray:
    return (mix64(values.astype(U64) + mix64(np.full(1, kind, U64))) >> U64(46)).astype(np.int64)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of each text's distinct features, sorted."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    letters = pc.replace_substring_regex(texts, r"[^\pL\pN\s]+", " ")
    words = Words(pc.utf8_lower(letters), lower=False)
    counts = np.diff(words.starts)
    owner = np.repeat(np.arange(n), counts)
    held = np.unique(owner * max(1, len(words.vocabulary)) + words.codes)
    who, code = np.divmod(held, max(1, len(words.vocabulary)))
    columns = [_hashed(1, hash_strings(words.vocabulary))]
    columns += [_hashed(k, hash_strings(pc.utf8_slice_codeunits(words.vocabulary, 0, k))) for k in (4, 5)]
    pairs = [(who, c[code]) for c in columns]
    raw = np.diff(Words(texts, lower=False).starts)
    size = np.maximum(pc.utf8_length(texts).to_numpy(), 1)
    again = np.zeros(n)
    if len(owner) > 1:
        again = np.bincount(owner[1:], (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1]), n)
    binned = {"words": np.log2(1 + raw), "again": 20 * again / np.maximum(counts, 1), "distinct": 20 * np.bincount(who, minlength=n) / np.maximum(counts, 1), "length": 2 * size / np.maximum(raw, 1)}
    lines = 1 + pc.count_substring(texts, "\n").to_numpy()
    binned["line"] = np.log2(1 + size / lines)
    for name, pattern in _COUNTED:
        binned[name] = np.log2(1 + 1000 * pc.count_substring_regex(texts, pattern).to_numpy() / size)
    for k, x in enumerate(binned.values()):
        pairs.append((np.arange(n), _hashed(100 + k, np.minimum(x, 60).astype(np.int64))))
    keys = np.unique(np.concatenate([o * DIM + f for o, f in pairs]))
    return np.divmod(keys, DIM)


def meta_features(sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    names = []
    for s, g, c in zip(sources, langs, sizes, strict=True):
        b = "null" if c is None else str(int(np.log2(1 + max(0, c)) * 2))
        names += [f"s={s}", f"l={g}", f"n={b}", f"s={s}|l={g}", f"l={g}|n={b}"]
    owner = np.repeat(np.arange(len(sources)), 5)
    keys = np.unique(owner * DIM + _hashed(200, hash_strings(pa.array(names, pa.string()))))
    return np.divmod(keys, DIM)


def _views(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [text_features(column(table, "text")), meta_features(*(column(table, c).to_pylist() for c in ("source", "lang", "n_chars")))]


def packed(owner: np.ndarray, feature: np.ndarray, n: int) -> pa.Array:
    """Each row's sorted features as two-byte gaps; a gap from SKIP on takes several."""
    first = np.searchsorted(owner, np.arange(n + 1))
    begins = first[:-1][np.diff(first) > 0]
    gap = np.diff(feature, prepend=0)
    gap[begins] = feature[begins]
    skips, rest = np.divmod(gap, SKIP)
    ends = np.concatenate([[0], np.cumsum(skips + 1)])
    coded = np.full(ends[-1], SKIP, np.uint16)
    coded[ends[1:] - 1] = rest
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * ends[first]).astype(np.int32)), pa.py_buffer(coded)])


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of packed rows."""
    coded = np.frombuffer(b"".join(blobs), np.uint16)
    owner = np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs])
    sums = np.concatenate([[0], np.cumsum(coded, dtype=np.int64)])
    starts = np.cumsum([0, *(len(x) // 2 for x in blobs)])[:-1]
    keep = coded != SKIP
    return owner[keep], (sums[1:] - sums[starts][owner])[keep]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ("doc_id", "_file", "_row", *TARGETS, *(f"has_{t}" for t in TARGETS))
    for table in sized_batches(batches, "text", BATCH_BYTES):
        blobs = [packed(*view, table.num_rows) for view in _views(table)]
        yield from pa.table([*(column(table, c) for c in kept), *blobs], names=[*kept, "v0", "v1"]).to_batches()


class Rows:
    """Sparse 0/1 rows, held packed and unpacked some hundred at a time."""

    def __init__(self):
        self.each: list[bytes] = []

    def add(self, blob: bytes) -> None:
        self.each.append(blob)

    def features(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """The features of each of the given rows."""
        for a in range(0, len(which), UNPACKED):
            blobs = [self.each[i] for i in which[a : a + UNPACKED].tolist()]
            owner, feature = unpacked(blobs)
            ends = np.searchsorted(owner, np.arange(len(blobs) + 1))
            yield from (feature[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def scores(self, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
        return weights[-1] + np.array([weights[at].sum() for at in self.features(which)])

    def often(self, which: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """What the rows with each feature are worth."""
        out = np.zeros(DIM)
        for at, w in zip(self.features(which), worth.tolist(), strict=True):
            out[at] += w
        return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, which: np.ndarray, y: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Logistic weights (the last is the bias) by AdaGrad over rows[which] with labels y of some worth.

    Features that are rare, or as frequent in both classes as chance has it (by TELLING standard deviations), stay at zero.
    """
    weights, squares = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    total, mass = rows.often(which, worth), max(worth.sum(), 1e-9)
    rate = (worth * y).sum() / mass
    spread = np.sqrt(np.maximum(total * rate * (1 - rate) * np.maximum(1 - total / mass, 0), 1e-9))
    apart = np.abs(rows.often(which, worth * y) - total * rate) / spread
    common = (total >= min(RARE, max(1, len(which) // 100))) & (apart >= TELLING)
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    weights[-1] = np.log(share / (1 - share))
    told = [at[common[at]].astype(np.int32) for at in rows.features(which)]
    random = np.random.RandomState(7)
    for _ in range(EPOCHS):
        order = random.permutation(len(which))
        for a in range(0, len(order), 256):
            batch = order[a : a + 256]
            at = [told[r] for r in batch.tolist()]
            owner, flat = np.repeat(np.arange(len(batch)), [len(x) for x in at]), np.concatenate(at)
            miss = (squash(weights[-1] + np.bincount(owner, weights[flat], len(batch))) - y[batch]) * worth[batch]
            used, place = np.unique(flat, return_inverse=True)
            slope = np.bincount(place, miss[owner], len(used)) / len(batch) + DECAY * weights[used]
            squares[used] += slope**2
            weights[used] -= STEP * slope / np.sqrt(squares[used])
            squares[-1] += miss.mean() ** 2
            weights[-1] -= STEP * miss.mean() / np.sqrt(squares[-1])
    return weights


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """A small dense logistic regression by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = squash(x @ w)
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - w * 1e-2)
    return w


class Exchange:
    """The two views of one target: their models and the pseudo-labels that each was given, with their worth."""

    def __init__(self, views: list[Rows], y: np.ndarray):
        self.views, self.y = views, y
        known = np.flatnonzero(~np.isnan(y))
        self.held, self.last = known[::5], known[1::5]
        self.used = np.setdiff1d(known, np.concatenate([self.held, self.last]))
        self.given: list[dict[int, tuple[float, float]]] = [{} for _ in views]
        self.share = np.clip(np.nanmean(y) if len(known) else 0.5, 0.01, 0.99)
        self.models, self.scale = [np.zeros(DIM + 1) for _ in views], [np.array([1.0, 0.0]) for _ in views]
        self.joint = np.array([0.0] * len(views) + [np.log(self.share / (1 - self.share))])
        self.able = len(self.used) >= 10 and len(np.unique(y[self.used])) == 2 and len(self.last) > 0

    def fit(self) -> None:
        for k, rows in enumerate(self.views):
            extra = sorted(self.given[k].items())
            which = np.concatenate([self.used, np.array([i for i, _ in extra], np.int64)])
            y, worth = np.array([v for _, v in extra]).reshape(-1, 2).T
            self.models[k] = fit(rows, which, np.concatenate([self.y[self.used], y]), np.concatenate([np.ones(len(self.used)), worth]))

    def verdicts(self) -> Iterator[tuple[int, bool, float, float]]:
        """(view, verdict, its frequency, worth) of the verdicts whose surest were better than chance on held-out rows."""
        for k, rows in enumerate(self.views):
            on_held, y = rows.scores(self.models[k], self.held), self.y[self.held]
            for positive in (True, False):
                often = self.share if positive else 1 - self.share
                n = min(len(y), max(MIN_HELD, int(len(y) * often / 2)))  # the surer half of this verdict
                top = np.argsort(-on_held if positive else on_held, kind="stable")[:n]
                worth = ((y[top] == positive).mean() - often) / (1 - often) if n else 0.0
                if worth > 0:
                    yield k, positive, float(often), float(worth**2)

    def calibrated(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The views' scores as log-odds."""
        return [a * x + b for x, (a, b) in zip(scores, self.scale, strict=True)]

    def join(self) -> None:
        scores, y = [rows.scores(m, self.last) for rows, m in zip(self.views, self.models, strict=True)], self.y[self.last]
        self.scale = [logistic(x[:, None], y) for x in scores]
        self.joint = logistic(np.column_stack(self.calibrated(scores)), y)


def features(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Per row of docs: its identity, both views' features, which labels its document has, and those of the sample."""
    chosen = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    sampled = write_table(chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled), "sampled")
    has = chosen.select("doc_id", *[F.col(t).isNotNull().alias(f"has_{t}") for t in TARGETS])
    labelled = write_table(has.join(F.broadcast(sampled), "doc_id", "left"), "labelled")
    rows = located(docs, ["doc_id", "text", "source", "lang", "n_chars"]).drop("_block")
    rows = rows.withColumns({"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long")})
    rows = narrow_join(rows, labelled, ["doc_id"], "left").withColumns({f"has_{t}": F.coalesce(f"has_{t}", F.lit(False)) for t in TARGETS})
    kind = dict(docs.dtypes)["doc_id"]
    return write_table(rows.mapInArrow(_featured, f"doc_id {kind}, _file long, _row long, {', '.join(f'{t} int' for t in TARGETS)}, {', '.join(f'has_{t} boolean' for t in TARGETS)}, v0 binary, v1 binary"), "features")


def view_scores(batch: pa.RecordBatch, weights: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """For each view, the scores by each of its models."""
    for k, models in enumerate(weights):
        owner, feature = unpacked(batch.column(f"v{k}").to_pylist())
        yield [w[-1] + np.bincount(owner, w[feature], batch.num_rows) for w in models]


def pool_scores(rows: DataFrame, exchanges: dict[str, Exchange]) -> DataFrame:
    """Of every row without a label of some target: its identity, and the views' scores."""
    shared = rows.sparkSession.sparkContext.broadcast([[x.models[k].astype(np.float32) for x in exchanges.values()] for k in range(2)])
    kept = ["doc_id", "_file", "_row", *(f"has_{t}" for t in TARGETS)]
    names = [f"{t}_{k}" for k in range(2) for t in exchanges]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(x) for view in view_scores(batch, shared.value) for x in view]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *names])

    free = rows.filter(" OR ".join(f"NOT has_{t}" for t in TARGETS)).select(*kept, "v0", "v1")
    held = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept)
    return write_table(free.mapInArrow(scored, f"{held}, {', '.join(f'{n} double' for n in names)}"), "pool")


def pass_on(rows: DataFrame, views: list[Rows], exchanges: dict[str, Exchange], places: dict[tuple[int, int], int], turn: int, max_given: int) -> None:
    """One round: the surest verdicts of each view on all unlabelled rows are the other's pseudo-labels from now on."""
    asked = [(t, *x) for t, e in exchanges.items() if e.able for x in e.verdicts()]
    if not asked:
        return
    pool = pool_scores(rows, exchanges)
    free = pool.agg(*[F.count_if(~F.col(f"has_{t}")).alias(t) for t in TARGETS]).first()
    order = (F.md5(F.col("doc_id").cast("string")), F.col("_file"), F.col("_row"))
    found = []
    for t, k, positive, often, worth in asked:
        most = min(max_given, max(1, int(free[t] * often / (2 * ROUNDS)))) * (turn + 1)
        sure = F.col(f"{t}_{k}") if positive else -F.col(f"{t}_{k}")
        best = pool.filter(~F.col(f"has_{t}")).orderBy(F.desc(sure), *order).limit(most).select("_file", "_row").collect()  # some thousand rows
        found.append((t, 1 - k, float(positive), worth, [(r._file, r._row) for r in best]))
    drop_table(pool)
    fresh = sorted({i for *_, ids in found for i in ids if i not in places})
    if fresh:
        wanted = rows.sparkSession.createDataFrame(fresh, "_file long, _row long")
        picked = write_table(rows.join(F.broadcast(wanted), ["_file", "_row"]).select("_file", "_row", "v0", "v1"), "picked")
        for row in in_parts(picked, "_file", "_row"):
            places[row._file, row._row] = len(views[0].each)
            for k in range(2):
                views[k].add(bytes(row[f"v{k}"]))
        drop_table(picked)
    release()
    for e in exchanges.values():
        e.given = [{} for _ in e.given]
    for t, k, verdict, worth, ids in found:
        for i in ids:
            exchanges[t].given[k].setdefault(places[i], (verdict, worth))


def in_parts(rows: DataFrame, *order: str) -> Iterator[Row]:
    """Rows in their order, a part at a time: neither the JVM nor Python holds all of them."""
    return rows.repartitionByRange(PARTS, *order).sortWithinPartitions(*order).toLocalIterator()


def learned(rows: DataFrame, max_given: int) -> tuple[dict[str, Exchange], bool]:
    """The exchange of each target after its rounds, and whether there was any label."""
    views, y = [Rows(), Rows()], {t: [] for t in TARGETS}
    sampled = rows.filter(" OR ".join(f"{t} IS NOT NULL" for t in TARGETS))
    sampled = sampled.groupBy("doc_id").agg(F.min(F.struct("v0", "v1", "_file", "_row", *TARGETS)).alias("x")).select("doc_id", "x.*")
    places: dict[tuple[int, int], int] = {}
    for row in in_parts(write_table(sampled, "fitted").withColumn("_md5", F.md5(F.col("doc_id").cast("string"))), "_md5", "doc_id"):
        places[row._file, row._row] = len(places)
        for k in range(2):
            views[k].add(bytes(row[f"v{k}"]))
        for t in TARGETS:
            y[t].append(np.nan if row[t] is None else float(row[t] > 0))
    exchanges = {t: Exchange(views, np.array(v, float)) for t, v in y.items()}
    able = [x for x in exchanges.values() if x.able]
    for turn in range(ROUNDS + 1):
        for x in able:
            x.fit()
        if turn < ROUNDS and able:
            pass_on(rows, views, exchanges, places, turn, max_given)
    for x in able:
        x.join()
    return exchanges, bool(places)


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_given: int = MAX_GIVEN) -> DataFrame:
    """Per row: doc_id, the views' calibrated and the combined quality and toxic scores (probabilities), and kept: good and not toxic."""
    rows = features(docs, labels, max_labelled)
    exchanges, labelled = learned(rows, max_given)
    shared = docs.sparkSession.sparkContext.broadcast(([[x.models[k].astype(np.float32) for x in exchanges.values()] for k in range(2)], [(x.scale, x.joint) for x in exchanges.values()]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, joints = shared.value
            out, n, final = [batch.column("doc_id")], batch.num_rows, {}
            for t, (scale, joint), *each in zip(TARGETS, joints, *view_scores(batch, weights), strict=True):
                each = [a * x + b for x, (a, b) in zip(each, scale, strict=True)]
                final[t] = squash(np.column_stack([*each, np.ones(n)]) @ joint)
                out += [pa.array(np.round(x, 6)) for x in (squash(each[0]), squash(each[1]), final[t])]
            out.append(pa.array((final["quality"] >= 0.5) & (final["toxic"] < TOXIC_CUT) if labelled else np.ones(n, bool)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *[f"{t}_{v}" for t in TARGETS for v in ("text", "meta", "score")], "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    fields = ", ".join(f"{t}_{v} double" for t in TARGETS for v in ("text", "meta", "score"))
    return rows.select("doc_id", "v0", "v1").mapInArrow(scored, f"doc_id {kind}, {fields}, kept boolean")
