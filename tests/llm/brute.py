"""Plain counterparts of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return re.findall(WORD, (text or "").translate(LOWER) if lower else text or "")


def shingles(text, k):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_duplicates(docs, k, percent):
    """doc_id -> (set size, component, kept)."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return {i: (len(s), least[root(x)], i == least[root(x)]) for x, (i, s) in enumerate(sets)}


def repeats(docs, length=200):
    """doc_id -> (bytes, removed, runs, sha256 of what is left)."""
    data = {i: (t or "").encode() for i, t in docs}
    counts = collections.Counter(b[p : p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def base_measures(text):
    w = words(text, lower=False)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), failed


def line_verdicts(rows, least, share, depleted):
    """(doc_id, words in removed lines, kept) of rows (doc_id, text, host); a document is the set of its lines."""
    cut = [[re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ") for x in (t or "").split("\n")] for _, t, _ in rows]
    distinct = collections.defaultdict(set)
    for (_, _, host), lines in zip(rows, cut):
        if any(lines):
            distinct[host].add(frozenset(x for x in lines if x))
    common = {}
    for host, docs in distinct.items():
        counts = collections.Counter(x for d in docs for x in d)
        common[host] = {x for x, c in counts.items() if c > max(least, share * len(docs))}
    out = []
    for (i, t, host), lines in zip(rows, cut):
        gone = sum(len(x.split(" ")) for x in lines if x and x in common[host])
        n, *_, failed = base_measures(t)
        out.append((i, gone, not failed and gone * 100 <= n * depleted))
    return out


def unigram(docs):
    """doc_id -> (held out, tokens, known, training tokens, base score)."""
    rows = [(i, zlib.crc32(str(i).encode()) % 10 == 0, [*words(t), None]) for i, t in docs]
    c = collections.Counter(w for _, held, ws in rows if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, h, ws in rows}


def coverage(item, text, min_tile=3):
    """Words of the item that greedy tiling covers: the longest unmarked common run first."""
    p, t = item.split(), text.split()
    mp, mt = [False] * len(p), [False] * len(t)
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < min(min_tile, len(p)) or not best[0]:
            return sum(mp)
        k, i, j = best[0], -best[1], -best[2]
        mp[i : i + k] = mt[j : j + k] = [True] * k


def path_costs(documents, path_of, contexts_of):
    """Bits of each token's path by counts in plain dictionaries, mixed by equal weights of 0.3, one token at a time."""
    met = {}
    steps = []
    for document in documents:
        for t, word in enumerate(document):
            path, depth = path_of(word)
            for b in range(depth):
                node, bit = 1 << b | path >> 12 - b, path >> 11 - b & 1
                keys = [(i, c, node) for i, c in enumerate(contexts_of(document, t))]
                steps.append((len(steps) and steps[-1][0] + (b == 0), bit, keys))
                for k in keys:
                    met.setdefault(k, [0, 0])[bit] += 1
    costs = {}
    for token, bit, keys in steps:
        odds = sum(0.3 * math.log((met[k][1] + 0.05) / (met[k][0] + 0.05)) for k in keys)
        costs[token] = costs.get(token, 0) + math.log2(1 + math.exp(-odds if bit else odds))
    return list(costs.values())
