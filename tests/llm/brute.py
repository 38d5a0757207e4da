"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, runs, digest of what stays) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (size of its set, smallest id that links reach)."""
    rows = sorted(rows)
    sets = [shingles(t, size) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {rows[i][0]: (len(sets[i]), rows[r][0]) for i, r in enumerate(groups(len(rows), links))}


SECRETS = (
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(digits[::-1]):
        total += int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))
    return total % 10 == 0


def only(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(only(m[0])) <= 19 and luhn(only(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(only(m[0])) <= 15),
)


def spans(text: str | None, kinds) -> tuple[dict[str, int], str]:
    """Counts by kind, and the list of spans."""
    found = sorted((m.start(), n, m.end(), kind) for n, (kind, pattern, fine) in enumerate(kinds) for m in pattern.finditer(text or "") if fine(m))
    return Counter(f[3] for f in found), ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def targets(sizes: dict, most: float = 3) -> dict:
    """Targets by source: the excess of capped sources is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def near_vectors(rows: list[tuple[int, list | None, int | None]], cosine: float) -> dict[int, tuple[int, int]]:
    """id -> (links, smallest id that links reach)."""
    rows = sorted(rows, key=lambda r: r[0])
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine(v) and lab is not None else None for _, v, lab in rows]
    links, degree = [], defaultdict(int)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
    return {rows[i][0]: (degree[i], rows[r][0]) for i, r in enumerate(groups(len(rows), links))}


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, computed from dictionaries."""

    def __init__(self, lines: list[str], order: int, alphabet: int):
        self.order, self.alphabet = order, alphabet
        self.counts = {order: Counter(line[i : i + order] for line in lines for i in range(len(line) - order + 1))}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d = {n: self.discounts(c) for n, c in self.counts.items()}
        self.contexts = {n: defaultdict(Counter) for n in self.counts}
        for n, c in self.counts.items():
            for g, v in c.items():
                self.contexts[n][g[:-1]][g] = v

    @staticmethod
    def discounts(counts: Counter) -> tuple[float, float, float]:
        n1, n2, n3, n4 = (sum(v == i for v in counts.values()) for i in (1, 2, 3, 4))
        if not n1 or not n2:
            return 0.5, 0.75, 1.0
        y = n1 / (n1 + 2 * n2)
        d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 2 - 3 * y * n3 / n2
        return tuple(min(max(v, 0.05), float(i)) for i, v in enumerate(d, 1))

    def p(self, gram: str) -> float:
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / self.alphabet
        own = self.contexts[n].get(gram[:-1])
        if not own:
            return lower
        cut = lambda v: self.d[n][min(v, 3) - 1]
        c = own.get(gram, 0)
        total = sum(own.values())
        return (c - cut(c) if c else 0) / total + sum(cut(v) for v in own.values()) / total * lower
