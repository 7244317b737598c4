"""What the tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    """Smallest member reachable from each of 0 .. n - 1."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def shingles(text, size):
    ws = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def brute_groups(rows, size, percent):
    """doc_id -> (set size, smallest doc_id reachable) of (doc_id, text) rows, ids being unique."""
    rows = sorted(rows)
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    roots = components(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[roots[i]][0]) for i in range(len(rows))}
