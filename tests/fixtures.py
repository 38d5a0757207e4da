"""Small inputs and plain, dense computations to hold the operators against."""

import math
from collections import Counter

import numpy as np

#: Hand-made sequence files with the edge cases of the readers.
FILES = {
    "alpha.functional.fa": ">a one\nACGTAC\nGTACGT\n\nacgtnacg\n",
    "beta.pathological.fasta": ">b1\r\nACGTACGTTT\r\n>b2\r\nTTTACGRYACGT\r\n",
    "gamma.fna": ">only a header\n",
    "delta.fas": "",
    "short.fa": ">s\nAC\n",
}


def windows(sequence: str, k: int) -> list[str]:
    return [sequence[i : i + k] for i in range(len(sequence) - k + 1)]


def counted(sequences: list[str], k: int, keep=lambda w: set(w) <= set("ACGT"), change=lambda w: w) -> Counter:
    return Counter(change(w) for s in sequences for w in windows(s, k) if keep(w))


def canonical(w: str) -> str:
    return min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))


def dense(counts: dict[str, Counter]) -> tuple[list[str], np.ndarray]:
    names = sorted(counts)
    words = sorted(set().union(*counts.values()))
    return names, np.array([[counts[n][w] for w in words] for n in names], float)


def smoothed(c: np.ndarray, alpha: float) -> np.ndarray:
    return (c + alpha) / (c.sum(1, keepdims=True) + alpha * c.shape[1])


def symmetric_kl(p: np.ndarray, w=1.0) -> np.ndarray:
    return np.array([[(w * (a - b) * (np.log(a) - np.log(b))).sum() / 2 for b in p] for a in p])


def jensen_shannon(p: np.ndarray, base: float = 2.0) -> np.ndarray:
    def kl(a, m):
        at = a > 0
        return (a[at] * np.log(a[at] / m[at])).sum() / math.log(base)

    return np.array([[(kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2 for b in p] for a in p])


def silhouettes(d: np.ndarray, labels: list[str]) -> list[float]:
    out = []
    for i, own in enumerate(labels):
        mean = {x: np.mean([d[i, j] for j in range(len(labels)) if labels[j] == x and j != i]) if any(labels[j] == x and j != i for j in range(len(labels))) else None for x in set(labels)}
        if mean[own] is None:
            out.append(0.0)
            continue
        b = min(v for x, v in mean.items() if x != own)
        out.append((b - mean[own]) / max(mean[own], b) if max(mean[own], b) else 0.0)
    return out
