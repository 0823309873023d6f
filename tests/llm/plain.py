"""Plain Python versions of the text operators, written from their descriptions."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_lines(texts):
    """doc -> (text, lines, dropped)"""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    owners = defaultdict(set)
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(owners[key(x)]) > 1 and min(owners[key(x)]) < d)]
        out[d] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def shingles(text, width, words=None):
    w = WORD.findall((text or "").translate(LOWER)) if words is None else words
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def classes(ids, links):
    """Smallest reachable id of each id."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def similar(a, b, percent=80):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(texts, width):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    return classes(texts, [(a, b) for a, b in combinations(texts, 2) if similar(sets[a], sets[b])])


def alphanumeric(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def contained(texts, items):
    """(doc, item) -> (common, size)"""
    own = {i: shingles(None, 5, alphanumeric(t)) for i, t in items.items() if len(alphanumeric(t)) >= 5}
    out = {}
    for d, t in texts.items():
        words = alphanumeric(t)
        mine = shingles(None, 5, words) if len(words) >= 5 else set()
        for i, s in own.items():
            if 100 * len(mine & s) >= 80 * len(s):
                out[d, i] = (len(mine & s), len(s))
    return out


def units(text, reach):
    """(words, first character, place where the next unit or the end of the text follows) of every unit of a text."""
    import hashlib

    found = list(WORD.finditer(text or ""))
    words = [m[0].translate(LOWER) for m in found]
    value = [hashlib.md5(w.encode()).digest()[:8] for w in words]
    blank_line = [k == 0 or (text[found[k - 1].end():found[k].start()].count("\n") > 1) for k in range(len(found))]
    starts = []
    for k in range(len(found)):
        near = [j for j in range(k - reach, k + reach + 1) if 0 <= j < len(found)]
        whole = len(near) == 2 * reach + 1 and not any(blank_line[j] for j in near[1:])
        if blank_line[k] or whole and all(value[k] < value[j] for j in near if j < k) and all(value[k] <= value[j] for j in near if j > k):
            starts.append(k)
    ends = [*starts[1:], len(found)]
    return [(words[a:b], found[a].start(), found[b].start() if b < len(found) else len(text)) for a, b in zip(starts, ends)]


def dedup_units(texts, reach=9, least=10, run=15, width=5, percent=80):
    """doc -> (text, places of the units that go)"""
    every = {d: units(t, reach) for d, t in texts.items()}
    sets = {(d, k): shingles(None, width, u[0]) for d, own in every.items() for k, u in enumerate(own) if len(u[0]) >= least}
    holders = defaultdict(set)
    for place, s in sets.items():
        for x in s:
            holders[x].add(place)
    pairs = {(a, b) for own in holders.values() for a, b in combinations(sorted(own), 2)}
    head = classes(sorted(sets), [p for p in pairs if similar(sets[p[0]], sets[p[1]], percent)])
    out = {}
    for d, own in every.items():
        again = [k for k in range(len(own)) if head.get((d, k), (d, k)) != (d, k)]
        gone = []
        for k in again:
            left, right = k, k
            while left - 1 in again:
                left -= 1
            while right + 1 in again:
                right += 1
            if sum(len(own[j][0]) for j in range(left, right + 1)) >= run:
                gone.append(k)
        text = texts[d]
        for k in reversed(gone):
            text = text[:own[k][1]] + text[own[k][2]:]
        out[d] = (text, gone)
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i:i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def check_packing(rows, ids, window=4096):
    """Every id in one piece, right checksums, gapless sequences, and no padding: full windows or powers of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for parts, total in [*((p, len(ids[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= window and at & (at - 1) == 0


def spelling_variants(rows, least=5, occurrences=3, ratio=2, misspelt=97):
    """word -> (form, root, n, near words, occurrences of the form), from (doc, text) rows."""
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def clusters(vectors, k=8, rounds=10, scale=1024, salt="3:"):
    """Rows (id, cluster, distance, inertia of the cluster, inertia, sha256 of the centroid) from (id, components) rows."""
    import hashlib
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centres = [list(v) for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: min((distance(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[assign(v)[1]].append(v)
        for n, own in members.items():
            centres[n] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *assign(v)) for i, v in kept]
    total = Counter()
    for _, d, n in last:
        total[n] += d
    return [(i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
            for i, d, n in last]
