"""License scan: ordered signature rules behind a keyword prefilter.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII characters; a rule is a regex over
the words joined by single spaces. A rule runs only on texts that hold its keyword, which each of its matches contains as
a word or with the version joined on (gplv3, apache2). Detections are ordered by priority (full grants, then references,
then names, then hints), longer first; one that lies inside the interval of a detection ranked before it is dropped. The
base labels are found by plain phrases and always stay.

Null or empty text: no words, no labels, score 0. Repeated rows give repeated rows. Whole texts are scanned; memory is a
batch of about 3 MB of text, or the longest text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillspar.llm.common import Words, column, light_batches, plain_words, sized_batches
from quillspar.llm.license_rules import SIGNATURES, WEIGHTS

BATCH_BYTES = 3 << 20
#: Fixed values of the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    weight: float
    pattern: re.Pattern


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All signature rules, in the order in which they rank."""
    found = []
    for line in SIGNATURES.strip().split("\n"):
        label, keyword, priority, regex = line.split(" ", 3)
        regex = re.sub(r"\blicense\b", "licen[cs]e", regex).replace(r"\S", "[^ ]")
        found.append(Rule(label, keyword, int(priority), WEIGHTS[int(priority)], re.compile(rf"(?<![^ ])(?:{regex})(?![^ ])")))
    return tuple(sorted(found, key=lambda r: r.priority))


@functools.cache
def rules_by_keyword() -> dict[str, tuple[int, ...]]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        out.setdefault(r.keyword, []).append(i)
    return {k: tuple(v) for k, v in out.items()}


#: What may follow a keyword in its word: the patterns' versions, or the v of one.
JOINED = re.compile(r"v?[0-9]*")


def gates(word: str, keyword: str) -> bool:
    """Whether the word is the keyword, alone or with a version joined on."""
    return word.startswith(keyword) and JOINED.fullmatch(word, len(keyword)) is not None


#: Words to each side of a keyword that any match can reach; no pattern is longer.
REACH = 80


def windows(words: list[str], keyword: str) -> list[tuple[int, int]]:
    """Merged character ranges, in the joined text, of REACH words around each place of the keyword."""
    ends = np.cumsum([len(w) + 1 for w in words])
    out: list[list[int]] = []
    for i in (i for i, w in enumerate(words) if gates(w, keyword)):
        lo, hi = max(0, i - REACH), min(len(words), i + REACH + 1)
        a, b = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1]) - 1
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def detect(words: list[str], keywords: set[str]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the detections that stay, by rank; positions in the words joined by single spaces."""
    text, ranked = " ".join(words), []
    for keyword in sorted(keywords & rules_by_keyword().keys()):
        for a, b in windows(words, keyword):
            for i in rules_by_keyword()[keyword]:
                rule = rules()[i]
                ranked += [(rule.priority, m.start() - m.end(), m.start(), m.end(), i) for m in rule.pattern.finditer(text, a, b)]
    kept: list[tuple[int, int, Rule]] = []
    last: dict[int, list[tuple[int, int]]] = {}
    for _, _, a, b, i in sorted(ranked):
        # intervals by blocks of characters, so that many detections don't meet each other
        if not any(x <= a and b <= y for x, y in last.get(a // 4096, ())):
            kept.append((a, b, rules()[i]))
            for block in range(a // 4096, b // 4096 + 1):
                last.setdefault(block, []).append((a, b))
    return kept


def places(text: str, phrase: str) -> np.ndarray:
    """Character positions where the phrase's words stand consecutively in normalised text; places may overlap."""
    return np.array([m.start() for m in re.finditer(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))", text)], np.int64)


def scan_batch(texts: pa.Array) -> dict[str, list]:
    plain = plain_words(texts)
    words = Words(plain, lower=False)
    plain_gates = "|".join(sorted({w for phrase, _ in BASE for w in phrase.split()}))
    opening = rf"^(?:{plain_gates}|(?:{'|'.join(sorted(rules_by_keyword()))}){JOINED.pattern})$"
    flagged = np.flatnonzero(pc.match_substring_regex(words.vocabulary, opening).to_numpy(zero_copy_only=False))
    mark = np.zeros(len(words.vocabulary) + 1, bool)
    mark[flagged] = True
    at = np.flatnonzero(mark[words.codes])
    owners = np.searchsorted(words.starts, at, "right") - 1
    n = len(texts)
    out: dict[str, list] = {"n_words": np.diff(words.starts).tolist(), "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [[] for _ in range(n)]}
    vocabulary = {int(i): words.vocabulary[int(i)].as_py() for i in flagged}
    docs, cuts = np.unique(owners, return_index=True)
    for doc, lo, hi in zip(docs.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(owners)], strict=True):
        listed = [w for w in plain[doc].as_py().split(" ") if w]
        text = " ".join(listed)
        begins = np.cumsum([0, *(len(w) + 1 for w in listed)])
        held = {vocabulary[int(c)] for c in np.unique(words.codes[at[lo:hi]])}
        starts, base = [], set()
        for phrase, label in BASE:
            if held.issuperset(phrase.split()):
                found = np.searchsorted(begins, places(text, phrase)).tolist()
                starts += found
                base |= {label} if found else set()
        hits = detect(listed, {k for k in rules_by_keyword() if any(gates(w, k) for w in held)})
        if starts:
            out["n_base"][doc], out["first_word"][doc], out["last_word"][doc] = len(starts), min(starts), max(starts)
        out["base_labels"][doc] = ",".join(sorted(base))
        out["labels"][doc] = ",".join(sorted(base | {r.label for _, _, r in hits}))
        miss = 1.0
        for _, _, r in hits:
            miss *= 1 - r.weight
        out["score"][doc] = round(1 - miss * 0.4 ** len(base), 6)
        out["spans"][doc] = [{"label": r.label, "first_word": int(np.searchsorted(begins, a)), "last_word": int(np.searchsorted(begins, b)) - 1, "weight": r.weight} for a, b, r in sorted(hits, key=lambda x: x[:2])]
    return out


SPAN = "array<struct<label:string,first_word:long,last_word:long,weight:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections' spans."""
    fields = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("weight", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            found = scan_batch(column(table, "text"))
            yield from pa.table([column(table, "doc_id"), *(pa.array(found[f.name], f.type) for f in fields)], names=["doc_id", *fields.names]).to_batches()

    light_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}")
