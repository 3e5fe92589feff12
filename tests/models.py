"""Sequential models of the order-dependent operators, for small random inputs."""

from __future__ import annotations

import math
from collections import defaultdict


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, start=1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else (1.0 - (total - 2 * lcs(a, b)) / total) * 100.0


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def greedy_fuzzy(left, right, threshold=96.0, gap=3.0):
    """left, right: (id, venue, year, title) in id order -> (accepted pairs, review rows)."""
    accepted, review, used = [], [], set()
    for ia, va, ya, ta in sorted(left):
        scored = sorted(((-ratio(ta, tb), ib) for ib, vb, yb, tb in right if (va, ya) == (vb, yb)))
        if not scored:
            continue
        best, ib = -scored[0][0], scored[0][1]
        second = -scored[1][0] if len(scored) > 1 else -999.0
        if best >= threshold and best - second >= gap and ib not in used:
            used.add(ib)
            accepted.append((ia, ib, best))
        else:
            review.append((ia, ib, best, second))
    return accepted, review


def record_score(a: dict, b: dict) -> float:
    doi = int(bool(a["doi"]) and a["doi"] == b["doi"])
    slot = int(bool(a["year"]) and a["year"] == b["year"] and a["slot"] == b["slot"])
    return (
        50 * doi + 25 * similarity(a["title"], b["title"]) + 10 * similarity(a["author"], b["author"])
        + 10 * similarity(a["venue"], b["venue"]) + 5 * slot
    )


def leader_scan(records: list[dict], threshold=30.0):
    """For every record: (position of its canonical record, score or None)."""
    canonical: list[int] = []
    out = []
    for i, rec in enumerate(records):
        best, best_score = None, 0.0
        for j in canonical:
            score = record_score(rec, records[j])
            if score > best_score:
                best, best_score = j, score
        if best is not None and best_score > threshold:
            out.append((best, best_score))
        else:
            canonical.append(i)
            out.append((i, None))
    return out


def tau_b(pairs):
    n = len(pairs)
    if n < 2:
        return None
    conc = disc = tx = ty = 0
    for i in range(n):
        for j in range(i):
            dx, dy = pairs[i][0] - pairs[j][0], pairs[i][1] - pairs[j][1]
            tx += dx == 0
            ty += dy == 0
            conc += dx * dy > 0
            disc += dx * dy < 0
    total = n * (n - 1) / 2
    if total == tx or total == ty:
        return None
    return (conc - disc) / math.sqrt((total - tx) * (total - ty))


def pearson(pairs):
    n = len(pairs)
    if n < 2:
        return None
    mx, my = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    sx = math.sqrt(sum((x - mx) ** 2 for x, _ in pairs))
    sy = math.sqrt(sum((y - my) ** 2 for _, y in pairs))
    if sx == 0 or sy == 0:
        return None
    return sum((x - mx) * (y - my) for x, y in pairs) / (sx * sy)


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def spearman(pairs):
    return pearson(list(zip(ranks([x for x, _ in pairs]), ranks([y for _, y in pairs]))))


def pagerank(edges, alpha=0.85, rounds=300):
    nodes = sorted({n for e in edges for n in e})
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    p = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        dangling = sum(p[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, (1 - alpha) / len(nodes) + alpha * dangling / len(nodes))
        for a in nodes:
            for b in out[a]:
                new[b] += alpha * p[a] / len(out[a])
        p = new
    return p


def hits(edges, rounds=500):
    nodes = {n for e in edges for n in e}
    h = dict.fromkeys(nodes, 1.0)
    a = {}
    for _ in range(rounds):
        a = dict.fromkeys(nodes, 0.0)
        for x, y in edges:
            a[y] += h[x]
        h = dict.fromkeys(nodes, 0.0)
        for x, y in edges:
            h[x] += a[y]
        s = sum(h.values())
        h = {n: v / s for n, v in h.items()}
    s = sum(a.values())
    return h, {n: v / s for n, v in a.items()}


def core_numbers(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        low = min(near, key=lambda n: len(near[n]))
        k = max(k, len(near[low]))
        core[low] = k
        for other in near.pop(low):
            near[other].discard(low)
    return core


def components(edges):
    parent = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in list(parent)}


def profile(values):
    """The metrics of one group, by their definitions."""
    x = sorted(values)
    n, total = len(x), sum(x)
    mean = total / n

    def quantile(p):
        pos = (n - 1) * p
        low = math.floor(pos)
        high = min(low + 1, n - 1)
        return x[low] + (x[high] - x[low]) * (pos - low)

    std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1)) if n > 1 else None
    cv = (None if std else 0.0) if mean == 0 else (None if std is None else std / mean)
    top = max(1, -(-n // 10))
    positive = [v / mean * math.log(v / mean) for v in x if v > 0] if mean else []
    return {
        "n_articles": n, "total_citations": total, "mean_citations": mean, "median_citations": quantile(0.5),
        "mean_median_gap": mean - quantile(0.5), "share_uncited": sum(v == 0 for v in x) / n,
        "share_ge_1": sum(v >= 1 for v in x) / n, "share_ge_2": sum(v >= 2 for v in x) / n,
        "share_ge_5": sum(v >= 5 for v in x) / n, "share_ge_10": sum(v >= 10 for v in x) / n,
        "p95_citations": quantile(0.95), "p99_citations": quantile(0.99), "std_citations": std, "cv_citations": cv,
        "gini_citations": 0.0 if total == 0 else 2 * sum(i * v for i, v in enumerate(x, 1)) / (n * total) - (n + 1) / n,
        "theil_citations": 0.0 if total == 0 else sum(positive) / len(positive),
        "top_10pct_citation_share": 0.0 if total == 0 else sum(x[::-1][:top]) / total,
    }
