"""Personal data: a semi-Markov conditional random field over candidate segments, beside fixed base patterns.

A text is cut into runs of digits and single marks; any run of at most ENTITY marks and GROUPS groups (addresses: ADDRESS
characters) that could be an address, a number of a card or of a phone is a candidate segment, and a segment is scored as
a whole (checksum, octets, grouping, brackets, marks around it, words before it). Labels are O, email, ip, card and
phone; dynamic programming over all segmentations picks boundaries and kinds together. Places that no candidate covers are O, so a text falls into short lattices and long
texts cost in proportion. What the base patterns find always stays, and nothing is added across it; the method adds forms
they miss: written-out or bracketed addresses, phones without a plus, cards with dots, neighbours run together.

The weights are learned here by maximum likelihood: SAMPLE snippets of the corpus (those with the smallest hashes, from the
documents with the SAMPLE smallest hashes of their ids) give the surroundings and the base spans; seeded entities and
decoys (dates, book numbers, versions, sums) are written into them. Everything else covers whole texts of all documents.

Null or empty text: no spans. Repeated rows give repeated rows, null ids stay. Without documents the weights come from
the seeded entities alone. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import column, light_batches, sized_batches

KINDS = ("email", "ip", "card", "phone")
BATCH_BYTES, SAMPLE, SNIPPET = 3 << 20, 400, 90
#: The longest entities: marks and groups of digits of a number, characters of an address.
ENTITY, GROUPS, ADDRESS = 40, 7, 254

#: Fixed values of the contract. The possessive forms match the same places, in time in proportion to the text.
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Runs in which every base number and every candidate number lies.
_NUMERIC = re.compile(r"[+(]{0,3}[0-9][0-9 ()./+\[\]-]*")
_SIX = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
_MARKS = re.compile(r"[0-9]+|[^0-9]")
_OPENING = r"[0-9@]|\b[dD][oO][tT]\b|[\[({<]\s{0,2}[aA][tT]"


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def octet(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 4 and int(bare or 0) < 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind as listed, then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    numbers: dict[str, list[tuple[str, int, int]]] = {"ip": [], "card": [], "phone": []}
    for run in _NUMERIC.finditer(text):
        a, b = run.span()
        for m in _IP.finditer(text, a, b):
            if all(map(octet, m.group().split("."))):
                numbers["ip"].append(("ip", *m.span()))
        for m in _CARD.finditer(text, a, b):
            bare = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(bare) <= 19 and luhn(bare):
                numbers["card"].append(("card", *m.span()))
        for m in _PHONE.finditer(text, a, b):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                numbers["phone"].append(("phone", *m.span()))
    return out + numbers["ip"] + numbers["card"] + numbers["phone"]


#: Words before a number or an address that speak for a kind, and those that speak for none.
HINTS = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "ruf", "tél"),
    "decoy": ("isbn", "order", "invoice", "ref", "version", "date", "no.", "nr", "id", "sum", "chapter", "release"),
}
ENDINGS = frozenset("com org net edu gov info io dev de fr es uk it nl eu ch at us ca co me".split())


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def _around(text: str, start: int, end: int) -> list[str]:
    before = text[max(0, start - 24) : start].casefold()
    out = [f"hint {k}" for k, words in HINTS.items() if any(w in before for w in words)]
    left, right = text[start - 1 : start], text[end : end + 1]
    out += ["after mark"] * (left in tuple("$€£#=_/.-:")) + ["before mark"] * (right in tuple("%€$/_-:="))
    return out


def _numbers(text: str, a: int, b: int) -> Iterator[Segment]:
    """Candidates in one run of digits and marks."""
    marks = [(m.start(), m.end()) for m in _MARKS.finditer(text, a, b)]
    for i, (start, first_end) in enumerate(marks):
        lead = text[start]
        if not ("0" <= lead <= "9" or lead in "+(") or text[start - 1 : start].isalnum():
            continue
        groups: list[str] = []
        gaps: list[str] = []
        gap, size = "", 0
        for s, e in marks[i : i + ENTITY]:
            piece = text[s:e]
            if not "0" <= piece[0] <= "9":
                gap += piece
                if len(gap) > 4:
                    break
                continue
            size += len(piece)
            if size > 19 or len(groups) == GROUPS:
                break
            gaps.append(gap)
            groups.append(piece)
            gap = ""
            if size >= 4 and not text[e : e + 1].isalnum():
                yield from _number(text, start, e, groups, gaps, size)


def _number(text: str, start: int, end: int, groups: list[str], gaps: list[str], size: int) -> Iterator[Segment]:
    lead, inner = gaps[0], gaps[1:]
    shape = [len(g) for g in groups]
    styles = {g.strip() or g[:1] for g in inner}
    number = "".join(groups)
    dotted = len(groups) == 4 and all(map(octet, groups)) and {re.sub(r"[ \[\]()]", "", g) for g in inner} == {"."}
    checked = 13 <= size <= 19 and luhn(number)
    shared = _around(text, start, end)
    if dotted and not lead:
        fs = ["plain" if set(inner) == {"."} else "spaced" if not any("[" in g or "(" in g for g in inner) else "bracketed"]
        fs += ["leading zero"] * any(len(g) > 1 and g[0] == "0" for g in groups) + ["chained"] * (text[start - 1 : start] == "." or re.match(r"\.[0-9]", text[end : end + 2]) is not None)
        fs += ["small"] * all(int(g) < 20 for g in groups)
        yield Segment(start, end, "ip", ("ip", *(f"ip {f}" for f in fs + shared)))
    if checked and not lead and all(len(g) < 3 and set(g) <= set(" -./") for g in inner):
        fs = [f"size {size}" if size < 17 else "size 17-19", f"style {''.join(sorted(styles)) or 'none'}" if len(styles) < 2 else "mixed"]
        fs += ["fours"] * (all(n == 4 for n in shape[:-1]) and shape[-1] <= 4 and len(shape) > 1) + ["4-6"] * (shape[:2] == [4, 6]) + ["odd groups"] * (len(shape) > 1 and shape[0] != 4 and max(shape) > 1)
        issuer = {16: "23456", 15: "3", 14: "3", 13: "4"}.get(size, "56")
        fs += ["issuer"] * (number[0] in issuer and (size != 15 or number[1] in "47") and (size != 14 or number[1] in "0689")) + ["all one digit"] * (len(set(number)) == 1)
        yield Segment(start, end, "card", ("card", *(f"card {f}" for f in fs + shared)))
    marks = lead + "".join(inner)
    if 7 <= size <= 15 and marks.count("+") <= 1 and ("+" not in marks or lead.startswith("+")) and marks.count("(") == marks.count(")") <= 1 and not set(marks) & set("[]") and ("(" not in marks or marks.index("(") < marks.index(")")) and len(lead) < 3:
        plain = not marks
        if plain and not number.startswith("00"):
            return
        fs = ["plus"] * ("+" in lead) + ["bracket"] * ("(" in marks) + ["zeros"] * number.startswith("00") + ["zero"] * (number[0] == "0" and number[1] != "0")
        fs += [f"groups {min(len(groups), 6)}", f"size {size}", f"last {min(shape[-1], 5)}", f"first {min(shape[0], 5)}"]
        fs += ["3-4"] * (shape[-2:] == [3, 4]) + ["3-3-4"] * (shape[-3:] == [3, 3, 4]) + ["date"] * (sorted(shape) in ([2, 2, 4], [1, 2, 4], [1, 1, 4], [4, 4]) and max(shape) == 4)
        fs += ["year"] * (re.match("19|20", groups[0]) is not None and shape[0] == 4) + ["dotted"] * dotted + ["checked"] * checked + ["ones"] * (shape.count(1) > 2)
        fs += [f"style {s}" for s in sorted({re.sub("[() ]", "", s) or "space" for s in styles})] + ["thousands"] * (len(shape) > 1 and set(shape[1:]) == {3}) + ["wide gap"] * any(len(g) > 2 for g in inner)
        yield Segment(start, end, "phone", ("phone", *(f"phone {f}" for f in fs + shared)))


_AT = re.compile(r"\s{0,2}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,2}|\s{1,3}at\s{1,3}(?=[^\W_][\w-]*(?:\s{1,3}dot\s|\s{0,2}[\[({<]\s{0,2}(?:dot|\.)))|\s{0,2}@\s{0,2}", re.I)
_DOT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,2}|\s{1,3}dot\s{1,3}|\.)"
_NEXT = re.compile(rf"({_DOT})([^\W_](?:[\w-]{{0,61}}[^\W_])?)(?![\w-])", re.I)
_PIECE = re.compile(r"[^\W_](?:[\w-]{0,61}[^\W_])?(?![\w-])")
_BACK = re.compile(rf"(?<![\w%+-])([\w%+-]{{1,64}})({_DOT})?\Z", re.I)


def _addresses(text: str) -> Iterator[Segment]:
    """Candidates around each mark that may stand for @."""
    for m in _AT.finditer(text):
        lefts: list[tuple[int, int]] = []
        at, marks = m.start(), 0
        while at > 0 and m.start() - at < 64 and len(lefts) < 6:
            low = max(0, at - 80)
            found = _BACK.search(text[low:at])
            if not found or lefts and not found.group(2) or not lefts and found.group(2):
                break
            marks += bool(lefts and found.group(2).strip() != ".")
            at = low + found.start()
            lefts.append((at, marks))
        host = _PIECE.match(text, m.end())
        if not lefts or not host:
            continue
        kind = "word" if m.group().strip().casefold() == "at" else "bracketed" if len(m.group().strip()) > 1 else "spaced" if m.group() != "@" else "plain"
        end, tail, written, names = host.end(), "", 0, 1
        while end - m.end() < ADDRESS and (step := _NEXT.match(text, end)):
            end, tail, names = step.end(), step.group(2), names + 1
            written += step.group(1).strip() != "."
            for k, (start, marks) in enumerate(lefts):
                if end - start > ADDRESS:
                    continue
                fs = [f"at {kind}", f"locals {min(k + 1, 4)}", f"names {min(names, 5)}"] + ["ending"] * (tail.casefold() in ENDINGS) + ["digits end"] * tail.isdigit()
                fs += ["more"] * (_NEXT.match(text, end) is not None) + ["more left"] * (k + 1 < len(lefts)) + ["written dots"] * (written > 0) + ["all written"] * (written == names - 1) + ["written left"] * (marks > 0)
                fs += ["foreign"] * (not text[start:end].isascii()) + ["spaced dots"] * (written > 0 and kind == "plain")
                yield Segment(start, end, "email", ("email", *(f"email {f}" for f in fs + _around(text, start, end))))


def candidates(text: str) -> list[Segment]:
    out = [s for run in _NUMERIC.finditer(text) for s in _numbers(text, *run.span())]
    out += _addresses(text)
    for m in _SIX.finditer(text) if "::" in text or text.count(":") > 6 else ():
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        fs = ["six", "six long"] if m.end() - m.start() > 6 else ["six"]
        out.append(Segment(*m.span(), "ip", ("ip", *(f"ip {f}" for f in fs + _around(text, *m.span())))))
    return sorted(out, key=lambda s: (s.start, s.end, KINDS.index(s.kind)))


# --- the field -------------------------------------------------------------------------------------------------------


class Lattice:
    """Candidate segments of a text between the places where they begin and end; label 0 is O."""

    def __init__(self, segments: list[Segment]):
        self.places = sorted({p for s in segments for p in (s.start, s.end)})
        index = {p: n for n, p in enumerate(self.places)}
        self.arcs: list[list[tuple[int, int, int]]] = [[] for _ in self.places]  # by end: (from, label, segment)
        for i, s in enumerate(segments):
            self.arcs[index[s.end]].append((index[s.start], KINDS.index(s.kind) + 1, i))

    def best(self, scores: np.ndarray, turns: np.ndarray) -> list[int]:
        """The segments of the segmentation with the highest score; `turns` scores a label right after another."""
        labels = len(KINDS) + 1
        value = np.full((len(self.places), labels), -np.inf)
        came: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in range(len(self.places)):
            if n:
                last = int(np.argmax(value[n - 1]))
                value[n, 0], came[n, 0] = value[n - 1, last], (n - 1, last, -1)
            else:
                value[0, 0] = 0
            for m, label, i in self.arcs[n]:
                reach = value[m] + turns[:, label]
                last = int(np.argmax(reach))
                if reach[last] + scores[i] > value[n, label]:
                    value[n, label], came[n, label] = reach[last] + scores[i], (m, last, i)
        out: list[int] = []
        if self.places:
            at = (len(self.places) - 1, int(np.argmax(value[-1])))
            while at in came:
                *back, i = came[at]
                if i >= 0:
                    out.append(i)
                at = (back[0], back[1])
        return out[::-1]

    def expect(self, scores: np.ndarray, turns: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log of the sum over all segmentations, chance of each segment, expected turns)."""
        labels = len(KINDS) + 1
        ahead = np.full((len(self.places), labels), -np.inf)
        ahead[0, 0] = 0
        for n in range(len(self.places)):
            if n:
                ahead[n, 0] = np.logaddexp.reduce(ahead[n - 1])
            for m, label, i in self.arcs[n]:
                ahead[n, label] = np.logaddexp(ahead[n, label], np.logaddexp.reduce(ahead[m] + turns[:, label]) + scores[i])
        total = float(np.logaddexp.reduce(ahead[-1]))
        behind = np.full((len(self.places), labels), -np.inf)
        behind[-1] = 0
        chance, turned = np.zeros(len(scores)), np.zeros_like(turns)
        for n in range(len(self.places) - 1, -1, -1):
            if n + 1 < len(self.places):
                behind[n] = np.logaddexp(behind[n], behind[n + 1, 0])
            for m, label, i in self.arcs[n]:
                onward = turns[:, label] + scores[i] + behind[n, label]
                share = np.exp(ahead[m] + onward - total)
                chance[i] = share.sum()
                turned[:, label] += share
                behind[m] = np.logaddexp(behind[m], onward)
        return total, chance, turned


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    turns: np.ndarray

    def scores(self, segments: list[Segment]) -> np.ndarray:
        return np.array([math.fsum(self.weights.get(f, 0.0) for f in s.features) for s in segments])

    def find(self, text: str, held: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the best segmentation of what `held` spans leave free."""
        taken = sorted((a, b) for _, a, b in held)
        starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
        free: list[Segment] = []
        for s in candidates(text):
            k = bisect.bisect_left(starts, s.end) - 1
            if k < 0 or ends[k] <= s.start:
                free.append(s)
        out: list[tuple[str, int, int]] = []
        for group in clusters(free):
            out += [(group[i].kind, group[i].start, group[i].end) for i in Lattice(group).best(self.scores(group), self.turns)]
        return out


def clusters(segments: list[Segment]) -> Iterator[list[Segment]]:
    """Segments (by start) in groups that touch no others: between groups every label is O."""
    group: list[Segment] = []
    end = -1
    for s in segments:
        if group and s.start > end:
            yield group
            group = []
        group.append(s)
        end = max(end, s.end)
    if group:
        yield group


# --- what it learns from ---------------------------------------------------------------------------------------------


def _digits(rng: random.Random, n: int, first: str = "0123456789") -> str:
    return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _card(rng: random.Random) -> str:
    size, first = rng.choice([(16, "4"), (16, "5"), (16, "2"), (16, "6"), (15, "34"), (15, "37"), (14, "36"), (13, "4"), (19, "6")])
    body = first + _digits(rng, size - 1 - len(first))
    number = next(body + d for d in "0123456789" if luhn(body + d))
    gap = rng.choice(["", "", " ", "-", "."])
    sizes = [4, 6, 5] if size == 15 else [4] * 5
    parts, at = [], 0
    for n in sizes:
        parts.append(number[at : at + n])
        at += n
    return gap.join(p for p in parts if p)


def _phone(rng: random.Random) -> str:
    area, mid, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    gap = rng.choice(" -.")
    return rng.choice([f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}{gap}{mid}{gap}{last}", f"1{gap}{area}{gap}{mid}{gap}{last}", f"+{_digits(rng, 2, '123456789')} {area} {mid}{last}", f"+1 ({area}) {mid}-{last}", f"00{_digits(rng, 2, '3456')} {area} {mid} {last}", f"0{_digits(rng, 3)}/{_digits(rng, 6)}", f"+{_digits(rng, 2, '3456')}/{area}/{mid}{last}", f"0{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}"])


def _ip(rng: random.Random) -> str:
    parts = [str(rng.randrange(1, 256)) for _ in range(4)]
    if rng.random() < 0.12:
        return ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.5 else f"2001:db8::{rng.randrange(65536):x}"
    return rng.choice([".", ".", "[.]", "(.)", " . "]).join(parts)


def _email(rng: random.Random, words: list[str]) -> str:
    word = lambda: rng.choice(words)
    at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", "[.]"), (" @ ", "."), (" [at] ", ".")])
    local = rng.choice([word(), f"{word()}{rng.choice('._-') if at == '@' else '_'}{rng.randrange(99)}", f"{word()}{dot if at != ' @ ' else '.'}{word()}"])
    host = [word()] + ([rng.choice(["example", "mail", word()])] if rng.random() < 0.6 else [])
    return local + at + dot.join([*host, rng.choice(sorted(ENDINGS - {"at"}))])


def _decoy(rng: random.Random, words: list[str]) -> str:
    year, month, day = rng.randrange(1900, 2100), rng.randrange(1, 13), rng.randrange(1, 29)
    bad = _digits(rng, rng.choice([13, 14, 15, 16, 17]))
    if rng.random() < 0.15:
        a, b, c, d = (rng.choice(words) for _ in range(4))
        return rng.choice([f"{a} at {b} dot {c} {d}", f"{a} at {b} dot", f"{a} @ {b}", f"{a} (at) {b}", f"{a} at {b} dot {c} dot {d}"])
    return rng.choice([
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day}/{month}/{year}", f"{year}-{year + 5}", f"{day:02}-{month:02}-{year} {day:02}", f"978-{rng.randrange(10)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{rng.randrange(10)}",
        f"{rng.randrange(1, 999)} {_digits(rng, 3)} {_digits(rng, 3)}", f"{rng.randrange(1, 999)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(300)}",
        bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10), f"{_digits(rng, 3)}-{_digits(rng, 2)}-{_digits(rng, 4)}", f"{_digits(rng, 4)} {_digits(rng, 4)}", f"{rng.randrange(256)}.{rng.randrange(300, 999)}.{rng.randrange(256)}.{rng.randrange(256)}",
        f"{rng.randrange(99)} {rng.randrange(99)} {rng.randrange(99)} {rng.randrange(99)} {rng.randrange(99)}", f"{_digits(rng, 5)}-{_digits(rng, 5)}", f"meet at {rng.randrange(12)}.30", f"{_digits(rng, 8)}", f"{rng.randrange(12)}:{month:02}:{day:02}", f"({year}) {rng.randrange(1, 99)}-{rng.randrange(100, 200)}", f"{_digits(rng, 2)}-{_digits(rng, 7)}",
    ])


def write_in(rng: random.Random, snippet: str, words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A snippet with seeded entities and decoys among its words, and the spans that are there to find."""
    kinds = {"email": lambda: _email(rng, words), "ip": lambda: _ip(rng), "card": lambda: _card(rng), "phone": lambda: _phone(rng), "decoy": lambda: _decoy(rng, words)}
    spaces = [m.end() for m in re.finditer(" ", snippet)] or [0]
    cut = rng.choice(spaces)
    text, spans = snippet[:cut], []
    for _ in range(rng.choice([1, 1, 2, 3])):
        kind = rng.choice([*KINDS, "decoy", "decoy"])
        if rng.random() < 0.4:
            text += rng.choice(HINTS[kind]) + rng.choice([" ", ": "])
        piece = kinds[kind]()
        if kind != "decoy":
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece + rng.choice([" ", " ", ", ", ". ", " and ", "; "])
    return text + snippet[cut:], spans


def learn(snippets: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 40, decay: float = 0.02) -> Model:
    """Weights of greatest likelihood, less decay * weights^2, by gradient steps scaled by their history.

    A snippet whose own spans are no candidates teaches nothing and is left out.
    """
    names: dict[str, int] = {}
    lattices: list[tuple[Lattice, np.ndarray, int, int, np.ndarray]] = []
    rows: list[list[int]] = []
    for text, spans in snippets:
        wanted, known = set(spans), candidates(text)
        if not wanted <= {(s.kind, s.start, s.end) for s in known}:
            continue
        for group in clusters(known):
            gold = np.array([(s.kind, s.start, s.end) in wanted for s in group])
            lattices.append((Lattice(group), gold, len(rows), len(rows) + len(group), np.zeros((len(KINDS) + 1,) * 2)))
            ordered = [s for s, g in zip(group, gold, strict=True) if g]
            for a, b in zip(ordered, ordered[1:], strict=False):
                if a.end == b.start:
                    lattices[-1][4][KINDS.index(a.kind) + 1, KINDS.index(b.kind) + 1] += 1
            rows += [[names.setdefault(f, len(names)) for f in s.features] for s in group]
    matrix = np.zeros((len(rows), len(names)))
    for r, at in zip(matrix, rows, strict=True):
        r[at] = 1
    weights, turns = np.zeros(len(names)), np.zeros((len(KINDS) + 1,) * 2)
    past_w, past_t = np.full(len(names), 1e-6), np.full(turns.shape, 1e-6)
    for _ in range(rounds if rows else 0):
        scores, chances, slope_t = matrix @ weights, np.zeros(len(rows)), -decay * turns
        for lattice, gold, a, b, turned in lattices:
            _, chance, expected = lattice.expect(scores[a:b], turns)
            chances[a:b] = gold - chance
            slope_t = slope_t + turned - expected
        slope_w = matrix.T @ chances - decay * weights
        slope_t[0] = 0  # from O the segment's own weights say it all
        past_w += slope_w**2
        past_t += slope_t**2
        weights += 0.7 * slope_w / np.sqrt(past_w)
        turns += 0.7 * slope_t / np.sqrt(past_t)
    return Model({f: float(weights[i]) for f, i in names.items()}, turns)


def snippets_of(text: str) -> list[str]:
    """Pieces of a text to learn from: around its first base spans, and one from its middle."""
    cuts = [(max(0, a - SNIPPET // 2), b + SNIPPET // 2) for _, a, b in base_spans(text)[:4]]
    half = len(text) // 2
    return [text[a:b] for a, b in [*cuts, (half, half + SNIPPET)] if b - a <= 4 * SNIPPET]


#: Surroundings where a corpus gives none.
_PLAIN = ("the note says that we may ask for more on this page before the end of the day", "sie finden mehr dazu auf der Seite und im Brief vom letzten Jahr")


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 13) -> Model:
    """A model for this corpus: at most `sample` of its snippets are brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            found = [s for t in column(table, "text").to_pylist() if t for s in snippets_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["snippet"])

    light_batches(docs.sparkSession)
    place = F.xxhash64(F.col("doc_id").cast("string"))
    last = docs.select(place.alias("place")).orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    got: list[str] = []
    if last is not None:
        pieces = docs.filter(place <= last).select("text").mapInArrow(run, "snippet string").distinct()
        got = [r.snippet for r in pieces.orderBy(F.xxhash64("snippet"), "snippet").limit(sample).collect()]
    return learn(lessons(got, seed))


def lessons(got: list[str], seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Snippets with the spans to find: base spans where nothing else could be one, and seeded entities in plain ones."""
    rng = random.Random(seed)
    out, plain = [], list(_PLAIN)
    for s in got:
        spans = base_spans(s)
        possible = candidates(s)
        if not possible:
            plain.append(s)
        elif spans and all(any(c.start >= a and c.end <= b for _, a, b in spans) for c in possible):
            out.append((s, spans))
    words = sorted({w.lower() for s in plain for w in re.findall(r"[A-Za-z]{2,}", s)} - ENDINGS)
    for i in range(2 * max(len(got), SAMPLE // 2)):
        out.append(write_in(rng, plain[i % len(plain)], words))
    return out


# --- over documents --------------------------------------------------------------------------------------------------

SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def spans_of(text: str, model: Model) -> list[dict]:
    """All spans of a text, by kind as listed, then start; base spans are marked."""
    held = base_spans(text)
    both = [(k, a, b, True) for k, a, b in held] + [(k, a, b, False) for k, a, b in model.find(text, held)]
    return [{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))]


def locate(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id and `found`, its spans; the model is trained on docs unless it is given."""
    model = train(docs) if model is None else model
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            texts = column(table, "text")
            maybe = pc.fill_null(pc.match_substring_regex(texts, _OPENING), False)
            maybe = pc.or_(maybe, pc.fill_null(pc.match_substring(texts, "::"), False)).to_numpy(zero_copy_only=False)
            found = [spans_of(texts[i].as_py(), model) if m else [] for i, m in enumerate(maybe.tolist())]
            yield from pa.table([column(table, "doc_id"), pa.array(found, _SPAN)], names=["doc_id", "found"]).to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found {SPAN}")


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, text with each span replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    model = train(docs) if model is None else model

    def masked(text: str) -> str:
        out, at = [], 0
        for s in sorted(spans_of(text, model), key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            texts = [None if t is None else masked(t) for t in column(table, "text").to_pylist()]
            yield from pa.table([column(table, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]).to_batches()

    light_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of `locate`: counts of base spans by kind, the hash of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def digest_of(text: str, model: Model) -> tuple[str, str]:
    """base_sha256 and spans of one text: the plain form of `digest`, for tests and spot checks."""
    spans = spans_of(text, model)
    said = lambda some: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in some)
    return hashlib.sha256(said([s for s in spans if s["base"]]).encode()).hexdigest(), said(spans)
