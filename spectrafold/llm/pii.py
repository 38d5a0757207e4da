"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Those of numbers start where a run of digits starts, as no match can start within one;
#: an e-mail is looked for from each "@", which takes time in proportion to the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    """Whether the digits pass Luhn's check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlaps in each kind; matches that fail their check are dropped."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end, 0))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the model ---------------------------------------------------------------------------------------------------------

#: Characters that the model tells apart; digits are one class, so are other lower-case and other upper-case letters.
SIGNS = "@.-+() \n_%/:,#$*"
WINDOW, HIDDEN = 64, 12
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Characters of a window of a text, and of what two neighbouring windows share.
PIECE, SHARED = 384, 32
#: Most characters of a row of windows, and characters that are scored at once.
ROW, GROUP = 2400, 1_200_000
#: Rows are filled up to a multiple of WIDE in the work, and the tags of PLACES places of them are scored at once.
WIDE, PLACES = 64, 16
#: Exponent of a gate that is shut: beyond it, 1 / (1 + exp(SHUT)) is 0 in single precision.
SHUT = 1000.0
#: By how much the tags of a span must score above the same stretch left outside (natural logarithm of the odds).
SURE = 2.2


def _table() -> np.ndarray:
    out = np.full(129, len(SIGNS) + 3, np.uint8)
    out[48:58], out[97:123], out[65:91], out[128] = len(SIGNS), len(SIGNS) + 1, len(SIGNS) + 2, len(SIGNS) + 1
    for i, c in enumerate(SIGNS):
        out[ord(c)] = i
    return out


TABLE = _table()


def encoded(text: str) -> np.ndarray:
    """Class of each character."""
    parts = [np.frombuffer(text[i : i + GROUP].encode("utf-32-le"), np.uint32) for i in range(0, len(text), GROUP)]
    return np.concatenate([np.zeros(0, np.uint8), *(TABLE[np.minimum(p, 128)] for p in parts)])


CLASSES = len(SIGNS) + 5  # and one for what lies outside the text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Bidirectional LSTM over character classes, a linear layer, and CRF transitions."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.3 / np.sqrt(h), (h, 4 * h))
            self.p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["out"] = rng.normal(0, 0.1, (2 * h, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["move"] = np.zeros((TAGS, TAGS))

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, tuple]:
        if d == "b":
            x = x[:, ::-1]
        n, t = x.shape
        hs = HIDDEN
        pre = self.p[f"x{d}"][x] + self.p[f"c{d}"]
        h, c = np.zeros((n, hs)), np.zeros((n, hs))
        out, kept = np.empty((n, t, hs)), []
        for i in range(t):
            z = pre[:, i] + h @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * hs]), np.tanh(z[:, 3 * hs :])
            new = gates[:, hs : 2 * hs] * c + gates[:, :hs] * g
            th = np.tanh(new)
            kept.append((h, c, gates, g, th))
            c, h = new, gates[:, 2 * hs :] * th
            out[:, i] = h
        return (out[:, ::-1] if d == "b" else out), (x, kept)

    def _lstm_back(self, grad: np.ndarray, kept: tuple, d: str, g: dict) -> None:
        x, steps = kept
        if d == "b":
            grad = grad[:, ::-1]
        hs = HIDDEN
        dh_next = dc_next = 0.0
        dpre = np.empty((*x.shape, 4 * hs))
        dw = np.zeros_like(self.p[f"h{d}"])
        for i in range(x.shape[1] - 1, -1, -1):
            h, c, gates, cand, th = steps[i]
            gi, gf, go = gates[:, :hs], gates[:, hs : 2 * hs], gates[:, 2 * hs :]
            dh = grad[:, i] + dh_next
            dc = dh * go * (1 - th**2) + dc_next
            dz = np.concatenate([dc * cand * gi * (1 - gi), dc * c * gf * (1 - gf), dh * th * go * (1 - go), dc * gi * (1 - cand**2)], axis=1)
            dpre[:, i] = dz
            dw += h.T @ dz
            dh_next, dc_next = dz @ self.p[f"h{d}"].T, dc * gf
        g[f"h{d}"] = dw
        g[f"c{d}"] = dpre.sum((0, 1))
        g[f"x{d}"] = np.zeros_like(self.p[f"x{d}"])
        np.add.at(g[f"x{d}"], x.reshape(-1), dpre.reshape(-1, 4 * hs))

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Score of each tag at each place."""
        f, kf = self._lstm(x, "f")
        b, kb = self._lstm(x, "b")
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["bias"], (both, kf, kb)

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log normaliser, probability of each tag at each place, expected moves) under the CRF."""
        n, t, k = s.shape
        move = self.p["move"]
        weight = np.exp(move)

        def through(v: np.ndarray, w: np.ndarray) -> np.ndarray:
            top = v.max(1, keepdims=True)
            return np.log(np.exp(v - top) @ w) + top

        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for i in range(1, t):
            alpha[:, i] = through(alpha[:, i - 1], weight) + s[:, i]
        for i in range(t - 2, -1, -1):
            beta[:, i] = through(beta[:, i + 1] + s[:, i + 1], weight.T)
        top = alpha[:, -1].max(1, keepdims=True)
        norm = np.log(np.exp(alpha[:, -1] - top).sum(1)) + top[:, 0]
        tags = np.exp(alpha + beta - norm[:, None, None])
        a = np.exp(alpha[:, :-1] - alpha[:, :-1].max(2, keepdims=True))
        b = (beta + s)[:, 1:]
        b = np.exp(b - b.max(2, keepdims=True))
        both = np.einsum("nti,ij,ntj->nt", a, weight, b)
        moves = np.einsum("nti,ntj->ij", a / both[:, :, None], b) * weight
        return norm, tags, moves

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags y, and its gradient."""
        s, (both, kf, kb) = self.scores(x)
        norm, tags, moves = self.marginals(s)
        n, t = y.shape
        rows, cols = np.arange(n)[:, None], np.arange(t)
        gold = s[rows, cols, y].sum(1) + self.p["move"][y[:, :-1], y[:, 1:]].sum(1)
        ds = tags
        ds[rows, cols, y] -= 1
        ds /= n
        np.add.at(moves, (y[:, :-1], y[:, 1:]), -1)
        g = {"move": moves / n, "out": both.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS), "bias": ds.sum((0, 1))}
        dboth = ds @ self.p["out"].T
        self._lstm_back(dboth[:, :, :HIDDEN], kf, "f", g)
        self._lstm_back(dboth[:, :, HIDDEN:], kb, "b", g)
        return float((norm - gold).mean()), g

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags by Viterbi of windows of classes."""
        s, _ = self.scores(x)
        n, t, k = s.shape
        return viterbi(s.reshape(-1, k), np.arange(n) * t, np.full(n, t), np.full(n, -1), np.full(n, -1), self.p["move"]).reshape(n, t)


def viterbi(s: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best tags of stretches of the scores s, all stretches step by step together; tags elsewhere are 0.

    before and after are the known tags on either side of a stretch, -1 at the end of a text.
    """
    out = np.zeros(len(s), np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, before, after = starts[order], lengths[order], before[order], after[order]
    back = np.zeros(s.shape, np.int8)
    enter = np.vstack([move, np.zeros(s.shape[1])])[before]
    leave = np.vstack([move.T, np.zeros(s.shape[1])])[after]
    last = np.zeros(len(starts), np.int8)
    best = np.zeros((0, s.shape[1]))
    many = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1 if len(lengths) else 1), "left")  # those longer than t
    for t in range(int(lengths[0]) if len(lengths) else 0):
        k = int(many[t])
        at = starts[:k] + t
        if t == 0:
            best = enter + s[at]
        else:
            way = best[:k, :, None] + move
            back[at] = way.argmax(1)
            best = way.max(1) + s[at]
        done = int(many[t + 1])
        if done < k:
            last[done:k] = (best[done:] + leave[done:k]).argmax(1)
    tag = last
    for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
        k = int(many[t])
        at = starts[:k] + t
        out[at] = tag[:k]
        tag[:k] = back[at, tag[:k]]
    return out


class Reader:
    """A trained tagger that scores many texts at once in single precision."""

    def __init__(self, model: Tagger):
        p, h = model.p, HIDDEN
        # Both sigmoid and tanh come from 1 / (1 + exp(-a)), with a twice as large for tanh.
        sign = -np.concatenate([np.ones(3 * h), np.full(h, 2.0)])
        self.step = {d: np.ascontiguousarray((np.concatenate([p[f"h{d}"], p[f"x{d}"] + p[f"c{d}"]]) * sign).T.astype(np.float32)) for d in "fb"}
        for step in self.step.values():  # between windows all gates are shut, so that both cell and state become 0
            step[: 3 * h, -1], step[3 * h :, -1] = SHUT, 0
        self.out = np.ascontiguousarray(np.concatenate([p["out"], p["bias"][None]]).T.astype(np.float32))
        self.move = p["move"]
        m = self.move
        # The most that the moves of a stretch of other tags gain over staying outside: each step in it, on entering, on leaving.
        self.inside, self.enter, self.leave = m[1:, 1:].max() - m[0, 0], m[0, 1:].max() - m[0, 0], m[1:, 0].max() - m[0, 0]
        # A place that scores so much more outside than otherwise is outside, whatever stands on either side.
        self.swing = max(0.0, (m.max(1) - m[:, 0]).max()) + max(0.0, (m[:, :] - m[0]).max())

    def scores(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores by row, place and tag, how much the best other tag scores above outside), both directions starting afresh wherever a window ends.

        rows: the classes by place and row.
        """
        t, many = rows.shape
        h = HIDDEN
        n = -(-many // WIDE) * WIDE
        kinds = np.arange(CLASSES, dtype=np.uint8)[:, None]
        # The two directions stand side by side, so that one call does a step of each: places from the first on, and from the last back.
        sides = np.full((t, 2 * n), CLASSES - 1, np.uint8)
        sides[:, :many], sides[:, n : n + many] = rows, rows[::-1]
        seen = np.empty((t, 2 * h + 1, n), np.float32)
        seen[:, 2 * h] = 1  # for the bias
        state, cell, part = np.zeros((h + CLASSES, 2 * n), np.float32), np.zeros((h, 2 * n), np.float32), np.empty((h, 2 * n), np.float32)
        z = np.empty((4 * h, 2 * n), np.float32)
        own, kind = state[:h], state[h:]
        enter, keep, show, new = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
        with np.errstate(over="ignore"):  # 1 / (1 + infinity) is the 0 that it should be
            for i in range(t):
                np.equal(kinds, sides[i], out=kind, casting="unsafe")
                np.matmul(self.step["f"], state[:, :n], out=z[:, :n])
                np.matmul(self.step["b"], state[:, n:], out=z[:, n:])
                np.exp(z, out=z)
                z += 1
                np.divide(1, z, out=z)
                # The cell is held -2 times, as the exponent of its tanh.
                new *= -4
                new += 2
                new *= enter
                cell *= keep
                cell += new
                np.exp(cell, out=part)
                part += 1
                np.divide(2, part, out=part)
                part -= 1
                np.multiply(part, show, out=own)
                seen[i, :h] = own[:, :n]
                seen[t - 1 - i, h : 2 * h] = own[:, n:]
        total, above = np.empty((many, t, TAGS), np.float32), np.empty((many, t), np.float32)
        for i in range(0, t, PLACES):
            tags = np.matmul(self.out, seen[i : i + PLACES])[:, :, :many]
            above[:, i : i + PLACES] = (tags[:, 1:].max(1) - tags[:, 0]).T
            total[:, i : i + PLACES] = tags.transpose(2, 0, 1)
        return total, above

    def outside(self, above: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether each place is outside of all spans on the best path of its text, where that can be told without decoding.

        A stretch of other tags gains at most the sum of what its places score above outside, and what its moves can gain. A
        place is outside if that is negative for all stretches that it is in: for the best sum that ends at the place and
        the best one that starts there.
        """
        value = above + self.inside
        out = np.zeros(len(above), bool)
        const = self.enter + self.leave - self.inside + 1e-3
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            v = value[a:b]
            v[0] -= min(0.0, self.enter)
            v[-1] -= min(0.0, self.leave)
            up = np.concatenate([[0.0], np.cumsum(v)])
            best = up[1:] - np.minimum.accumulate(up[:-1]) + np.maximum.accumulate(up[:0:-1])[::-1] - up[:-1] - v
            out[a:b] = best + const < 0
        return out

    def read(self, texts: list[str]) -> Iterator[tuple[int, list[Span]]]:
        """(number, spans) of each text, in order.

        Every character of every text is scored. Windows overlap; where they do, a character has the scores of the window
        that it is deeper in. The scores of a whole text are decoded as one sequence: places that are outside of all spans
        whatever the rest cut it into stretches, and the best path of each is part of that of the text. Of a long text, what
        follows the last such place waits for the next group of windows.
        """
        kept: list[list[Span]] = [[] for _ in texts]
        waiting, early, base = np.zeros((0, TAGS), np.float32), np.zeros(0), 0
        told = 0
        for pieces, classes in _grouped(texts):
            scores, above, bounds = self._merged(pieces, classes)
            s, above = np.concatenate([waiting, scores]), np.concatenate([early, above])
            bounds = bounds + len(waiting)
            bounds[0] = 0
            numbers = [*dict.fromkeys(k for k, *_ in pieces)]
            offsets = np.zeros(len(numbers), np.int64)
            offsets[0] = base  # the first text of a group may have begun in another one
            k, _, stop = pieces[-1][:3]
            whole = stop == len(texts[k])
            end = len(s)
            if not whole:  # what waits begins with a place that is outside, whatever follows
                fixed = np.flatnonzero(above[int(bounds[-2]) :] < -self.swing - 1e-3)
                end = int(bounds[-2]) + (int(fixed[-1]) if len(fixed) else 0)
            for number, spans in self._spans(s[:end], above[:end], np.minimum(bounds, end), numbers, texts, offsets, whole):
                kept[number] += spans
            waiting, early, base = (s[:0], above[:0], 0) if whole else (s[end:], above[end:], int(offsets[-1]) + end - int(bounds[-2]))
            while told < (numbers[-1] + 1 if whole else numbers[-1]):
                yield told, kept[told]
                kept[told] = []
                told += 1
        while told < len(texts):
            yield told, kept[told]
            told += 1

    def _merged(self, pieces: list[tuple[int, int, int, int, int]], classes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, how much above outside, bounds of the texts in them) of the characters that the windows stand for."""
        total = sum(b - a + 1 for _, _, _, a, b in pieces)
        row = max(PIECE + 1, min(ROW, total // 256))
        at, places = 0, []
        for _, _, _, a, b in pieces:
            if at % row + b - a > row:
                at += row - at % row
            places.append(at)
            at += b - a + 1
        n = -(-at // row)
        flat = np.full(n * row, CLASSES - 1, np.uint8)
        picked, sizes, last = [], [], -1
        for place, (k, start, stop, a, b) in zip(places, pieces, strict=True):
            flat[place : place + b - a] = classes[k][a:b]
            picked.append(np.arange(place + start - a, place + stop - a))
            if k != last:
                sizes.append(0)
                last = k
            sizes[-1] += stop - start
        scores, above = self.scores(np.ascontiguousarray(flat.reshape(n, row).T))
        at = np.concatenate(picked)
        return scores.reshape(-1, TAGS)[at], above.reshape(-1)[at].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])

    def _spans(self, s: np.ndarray, above: np.ndarray, bounds: np.ndarray, numbers: list[int], texts: list[str], offsets: np.ndarray, whole: bool) -> Iterator[tuple[int, list[Span]]]:
        """Spans of the texts whose scores lie between the bounds."""
        open_ = ~self.outside(above, bounds)
        edge = np.zeros(len(s) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(open_ & (edge[:-1] | np.concatenate([[True], ~open_[:-1]]))) if len(s) else np.zeros(0, np.int64)
        ends = np.flatnonzero(open_ & (edge[1:] | np.concatenate([~open_[1:], [True]]))) + 1 if len(s) else starts
        before = np.where(edge[starts], -1, 0)
        after = np.where(edge[ends], -1, 0)
        if not whole and len(ends) and ends[-1] == len(s):
            after[-1] = 0
        tags = viterbi(s, starts, ends - starts, before, after, self.move)
        kind = (tags.astype(np.int64) + 1) // 2
        new = (kind > 0) & (edge[:-1] | (tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind)) if len(s) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        stops = np.flatnonzero((kind > 0) & np.concatenate([(kind[1:] != kind[:-1]) | new[1:] | edge[1:-1], [True]])) + 1 if len(s) else begins
        owner = np.searchsorted(bounds, begins, "right") - 1
        found: dict[int, list[Span]] = {}
        for a, b, i in zip(begins.tolist(), stops.tolist(), owner.tolist(), strict=True):
            own = tags[a:b].astype(np.int64)
            gain = float((s[np.arange(a, b), own] - s[a:b, 0]).sum())
            line = [0 if edge[a] else int(tags[a - 1]), *own.tolist(), 0 if b == len(s) or edge[b] else int(tags[b])]
            gain += sum(self.move[x, y] for x, y in zip(line, line[1:], strict=False)) - self.move[line[0], 0] - self.move[0, line[-1]] - (b - a - 1) * self.move[0, 0]
            start, stop = a - int(bounds[i]) + int(offsets[i]), b - int(bounds[i]) + int(offsets[i])
            if gain >= SURE and well_formed(texts[numbers[i]][start:stop], int(kind[a]) - 1):
                found.setdefault(i, []).append((start, stop, int(kind[a]) - 1))
        for i, number in enumerate(numbers):
            yield number, found.get(i, [])


def _grouped(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int, int, int]], dict[int, np.ndarray]]]:
    """Groups of windows (text, first and last character that it stands for, and that it covers), and the classes of their texts."""
    pieces, classes, size = [], {}, 0
    step = PIECE - SHARED
    for k, text in enumerate(texts):
        n = len(text)
        if n:
            classes[k] = encoded(text)
        for a in range(0, max(n - SHARED, min(n, 1)), step):
            b = min(n, a + PIECE)
            pieces.append((k, a + SHARED // 2 if a else 0, n if b == n else b - SHARED // 2, a, b))
            size += b - a + 1
            if size >= GROUP:
                yield pieces, classes
                pieces, classes, size = [], {k: classes[k]}, 0
    if pieces:
        yield pieces, classes


def well_formed(value: str, kind: int) -> bool:
    """Whether a span of the model can be what it says: the model doesn't count digits."""
    digits = DIGIT.findall(value)
    if kind == 0:
        return "." in value.partition("@")[2]
    if kind == 1:
        parts = value.split(".")
        return len(parts) == 4 and all(p.isdecimal() and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn("".join(digits))
    return 7 <= len(digits) <= 15


def example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A made-up line with some personal data in it, and numbers that are none."""
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    digits = lambda n: pick("0123456789", n)
    word = lambda: pick("abcdefghiklmnoprstuvy", rng.integers(2, 9))

    def entity(kind: int) -> str:
        if kind == 0:
            sep = rng.choice([".", "_", "-", "", "+"])
            return f"{word()}{sep}{word()}{digits(rng.integers(0, 3))}@{word()}.{rng.choice(['com', 'org', 'net', 'example', 'co.uk', 'de', 'test'])}"
        if kind == 1:
            return ".".join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == 2:
            sep = rng.choice([" ", "-", ""])
            return sep.join([digits(4), digits(4), digits(4), digits(4)])
        form = rng.integers(0, 4)
        if form == 0:
            return f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}"
        if form == 1:
            return f"({digits(3)}) {digits(3)}-{digits(4)}"
        if form == 2:
            return f"{digits(3)}-{digits(3)}-{digits(4)}"
        return f"+{rng.integers(1, 99)}-{digits(3)}-{digits(4)}-{digits(2)}"

    def other() -> str:
        form = rng.integers(0, 15)
        return [f"{rng.integers(1900, 2100)}", f"{rng.integers(0, 24)}:{digits(2)}", f"${rng.integers(1, 999)}.{digits(2)}", f"{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"20{digits(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}", f"#{digits(rng.integers(2, 9))}", f"{rng.integers(1, 99)}%", pick("0123456789abcdef", rng.integers(8, 40)), f"@{word()}",
            f"{rng.integers(1, 32):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2100)}", f"97{rng.integers(8, 10)}-{rng.integers(0, 10)}-{digits(2)}-{digits(6)}-{digits(1)}",
            f"{rng.integers(1, 32):02d}/{rng.integers(1, 13):02d}/{rng.integers(1900, 2100)}", digits(rng.integers(5, 10)), f"{rng.integers(1, 999)},{digits(3)}.{digits(2)}", f"{digits(3)}-{digits(2)}"][form]

    text, spans = "", []
    for _ in range(rng.integers(3, 7)):
        for _ in range(rng.integers(1, 5)):
            text += (word().capitalize() if rng.random() < 0.15 else word()) + rng.choice([" ", " ", " ", ", ", ": ", "\n"])
        if rng.random() < 0.7:
            if rng.random() < 0.6:
                kind = int(rng.integers(0, len(KINDS)))
                new = entity(kind)
                spans.append((len(text), len(text) + len(new), kind))
            else:
                new = other()
            text += new + rng.choice([" ", " ", ". ", ", ", "\n"])
    return text, spans


def labelled(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and their tags."""
    x, y = np.full((n, WINDOW), CLASSES - 1), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = example(rng)
        tags = np.zeros(len(text), np.int64)
        for start, end, kind in spans:
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        own = encoded(text)[at : at + WINDOW]
        x[i, : len(own)], y[i, : len(own)] = own, tags[at : at + WINDOW]
    return x, y


@lru_cache(maxsize=2)
def trained(steps: int = 260, batch: int = 48, seed: int = 11) -> Tagger:
    """A tagger trained with Adam on steps x batch made-up windows; the same for the same numbers."""
    rng, model = np.random.default_rng(seed), Tagger(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for i in range(1, steps + 1):
        _, grad = model.step(*labelled(rng, batch))
        rate = 0.02 * (1 - 0.9 * i / steps)
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g**2
            model.p[k] -= rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
    return model


def model_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """Spans of each text by the model."""
    return [spans for _, spans in Reader(model).read(texts)]


def apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of the base spans, which come in order of their starts but may overlap one another."""
    starts, reach = [s[0] for s in base], np.maximum.accumulate([s[1] for s in base]) if base else []
    out = []
    for span in spans:
        at = bisect_left(starts, span[1])  # those from here on begin behind the span
        if not at or reach[at - 1] <= span[0]:
            out.append(span)
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", steps: int = 260) -> DataFrame:
    """(id, counts of the base spans by kind, base_sha256, spans, n_added) of each row, in one pass without a shuffle.

    Places are code points, ends exclusive. Base spans are those of the patterns; the model adds spans that overlap none of
    them. Null text counts as empty; equal rows stay separate; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(trained(steps).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = sent.value
        reader = Reader(model)
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        for batch in batches:
            n = len(batch)
            counts, hashes, lists, added = np.zeros((len(KINDS), n), np.int64), [], [], np.zeros(n, np.int64)
            texts = [x.as_py() for x in batch.column(1)]
            for i, more in reader.read(texts):
                base = base_spans(texts[i])
                for s in base:
                    counts[s[2], i] += 1
                new = apart(more, base)
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(base + new))
                added[i] = len(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(hashes, pa.string()), pa.array(lists, pa.string()), pa.array(added)], names)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")
