"""Plain brute-force versions that the tests compare with."""

import re
from collections import defaultdict


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(w) >= words:
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    return {tuple(w)} if w else set()


def near_duplicates(rows, words, percent):
    sets = {key: shingles(text, words) for key, text in rows}
    holders = defaultdict(list)
    for key, own in sets.items():
        for s in own:
            holders[s].append(key)
    shared = defaultdict(int)
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    parts = smallest_reachable(list(sets), links)
    return {key: (len(sets[key]), parts[key], parts[key] == key) for key in sets}


def vector_links(rows, threshold):
    """rows of (id, vector, label): pairs of row numbers that link."""
    import math

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        top = max(map(abs, v))
        v = [x / top for x in v]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    units = [unit(v) if key is not None and label is not None else None for key, v, label in rows]
    return [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if units[i] and units[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and sum(a * b for a, b in zip(units[i], units[j])) >= threshold
    ]


def without_repeats(rows, min_chars, ends=r"(?<=\n)|(?<=[.!?] )|(?<=[。！？])"):
    """rows of (id, text), ids distinct: {id: (text, number of units, removed (start, length))}, by a plain walk in id order."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        at, kept, spans, run = 0, [], [], []
        pieces = re.split(ends, text)

        def settle():
            long = sum(len(f) for _, _, f in run) >= min_chars
            for start, piece, _ in run:
                spans.append((start, len(piece))) if long else kept.append((start, piece))
            run.clear()

        for piece in pieces:
            folded = re.sub(r"[ \t\n\v\f\r]+", " ", piece.lower()).strip(" ")
            if folded in seen and folded:
                run.append((at, piece, folded))
            elif folded:
                settle()
                seen.add(folded)
                kept.append((at, piece))
            else:
                kept.append((at, piece))
            at += len(piece)
        settle()
        out[key] = ("".join(p for _, p in sorted(kept)), len(pieces), spans)
    return out
