"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

The model is trained once a driver process on TRAIN_WINDOWS synthetic windows with labelled spans (a documented bound; the
labels come from the generator, no row of the corpus is used). Every text is decoded whole, in windows of WINDOW characters whose
starts are STRIDE apart, by Viterbi over the CRF, and the windows' spans are reconciled over the whole text: a span cut by a
window's edge gives way to a neighbour's whole span; cut pieces of one kind that overlap or touch are joined, and a cut secret
goes on to the end of its run of token characters, so spans of any length come out whole (so does a secret of which the model
found a part as long as one); of overlapping spans the one decoded nearer a window's middle stays. Base spans always stay; a
model span is added only if it overlaps none of them and is well-formed for its kind.

Defined cases: a null or empty text has no spans; texts of any length are read whole, in time that grows with their length, runs
of one character included; ids are passed through, null and repeated ones too; an empty table gives an empty result; other
columns are ignored; offsets are code points, end exclusive.
"""

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

KINDS = ("email", "ip", "card", "phone", "secret")
WINDOW, STRIDE = 512, 480
#: Windows that are decoded together, of one length; shorter windows go by lengths that are multiples of STEP.
BATCH, STEP = 1024, 64
HIDDEN = 8
#: Training windows, and their length.
TRAIN_WINDOWS, TRAIN_LENGTH = 8192, 96
EPOCHS = 12

#: Base patterns, leftmost and non-overlapping by kind: email is a run of _LOCAL, @ and _HOST; ip is four of the parts of _DOTTED.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Characters of secrets, and their least length.
TOKEN, SECRET = "A-Za-z0-9_-", 20
_RUN, _ONE = re.compile(rf"[{TOKEN}]+"), re.compile(rf"[{TOKEN}]")
_PREFIX = re.compile(r"sk-|ghp_|AKIA")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, looked for from each @, so that long runs cost their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = host.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Places of `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`: four parts at a time of each dotted run, those above 255 dropped."""
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for low in range(0, len(parts) - 3, 4):
            four = parts[low : low + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in _ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the model -------------------------------------------------------------------------------------------------------

#: Character classes: each of these characters is a class of its own; then digits, a-f, g-z, A-F, G-Z, other ASCII, beyond ASCII.
OWN = "@.-_+() \n=\"':/%,"
CLASSES = len(OWN) + 7
O_TAG = 0  # tags: outside, then begin and inside of each kind
TAGS = 1 + 2 * len(KINDS)


def _class_table() -> np.ndarray:
    table = np.full(128, len(OWN) + 5, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch in OWN:
            table[c] = OWN.index(ch)
        elif ch.isdigit():
            table[c] = len(OWN)
        elif ch.islower():
            table[c] = len(OWN) + (1 if ch <= "f" else 2)
        elif ch.isupper():
            table[c] = len(OWN) + (3 if ch <= "F" else 4)
    return table


TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], np.uint8(len(OWN) + 6))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    """Parameters; gates are ordered input, forget, output, candidate."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = 4 * HIDDEN
        self.p = {f"{d}{k}": rng.normal(0, s, shape).astype(np.float32) for d in "fb" for k, s, shape in (("x", 0.3, (CLASSES, g)), ("h", 0.2, (HIDDEN, g)))}
        for d in "fb":
            self.p[d + "x"][:, HIDDEN : 2 * HIDDEN] += 0.5
        self.p |= {"w": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)).astype(np.float32), "o": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """x: (T, B) classes, in the direction's order; states (T, B, H)."""
        wx, wh = self.p[d + "x"], self.p[d + "h"]
        steps, batch = x.shape
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        states, tape = np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            z = wx[x[t]] + h @ wh
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, old = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                tape.append((before, old, i, f, o, g, tc))
        return states, tape

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, tape_f = self._lstm(x, "f", keep)
        backward, tape_b = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        return both @ self.p["w"] + self.p["o"], both, tape_f, tape_b

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray):
        """Mean CRF negative log-likelihood of tags y (T, B), and gradients."""
        steps, batch = x.shape
        e, both, tape_f, tape_b = self.emissions(x, True)
        trans = self.p["t"]
        e64 = e.astype(np.float64)
        m = e64.max()
        exp_t = np.exp(trans.astype(np.float64))
        alpha, scale = np.empty((steps, batch, TAGS)), np.empty((steps, batch))
        a = np.exp(e64[0] - m)
        for t in range(steps):
            if t:
                a = (alpha[t - 1] @ exp_t) * np.exp(e64[t] - m)
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        beta = np.ones((batch, TAGS))
        d_e, d_t = np.empty_like(e64), np.zeros((TAGS, TAGS))
        for t in range(steps - 1, -1, -1):
            marginal = alpha[t] * beta
            d_e[t] = marginal / marginal.sum(axis=1, keepdims=True)
            if t:
                right = beta * np.exp(e64[t] - m) / scale[t][:, None]
                d_t += exp_t * (alpha[t - 1].T @ right)
                beta = right @ exp_t.T
        log_z = np.log(scale).sum(axis=0) + steps * m
        cols = np.arange(batch)
        gold = sum(e64[t, cols, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        for t in range(steps):
            d_e[t, cols, y[t]] -= 1
            if t:
                d_t -= np.bincount(y[t - 1] * TAGS + y[t], minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        d_e = (d_e / batch).astype(np.float32)
        grad = {"t": (d_t / batch).astype(np.float32), "w": both.reshape(-1, 2 * HIDDEN).T @ d_e.reshape(-1, TAGS), "o": d_e.sum(axis=(0, 1))}
        d_both = d_e @ self.p["w"].T
        one_hot = np.eye(CLASSES, dtype=np.float32)
        for d, tape, part, xs in (("f", tape_f, d_both[:, :, :HIDDEN], x), ("b", tape_b, d_both[::-1, :, HIDDEN:], x[::-1])):
            gx, gh = np.zeros_like(self.p[d + "x"]), np.zeros_like(self.p[d + "h"])
            dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                before, old, i, f, o, g, tc = tape[t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                gx += one_hot[xs[t]].T @ dz
                gh += before.T @ dz
                dh, dc = dz @ self.p[d + "h"].T, dc * f
            grad |= {d + "x": gx, d + "h": gh}
        return float((log_z - gold).mean()), grad

    def _inference(self) -> dict:
        """Weights for decoding: tanh(z) is 2 / (1 + exp(-2z)) - 1, so one exp, which is cheaper than tanh, serves all gates; states are held halved."""
        if not hasattr(self, "ready"):
            sign = np.repeat(np.array([-1, -2], np.float32), [3 * HIDDEN, HIDDEN])
            self.ready = {k: np.ascontiguousarray(v) for k, v in {
                "fx": self.p["fx"] * sign, "bx": self.p["bx"] * sign, "fh": self.p["fh"] * sign * 2, "bh": self.p["bh"] * sign * 2,
                "fw": self.p["w"][:HIDDEN].T * 2, "bw": self.p["w"][HIDDEN:].T * 2,
            }.items()}
        return self.ready

    def _add_emissions(self, e: np.ndarray, x: np.ndarray, d: str) -> None:
        """One direction's part of the emissions e (T, TAGS, B) of classes x (T, B): the forward one is written, the backward one is added to it."""
        ready = self._inference()
        wx, wh, w = ready[d + "x"], ready[d + "h"], ready[d + "w"]
        steps, batch = x.shape
        z, gates = np.empty((batch, 4 * HIDDEN), np.float32), np.empty((batch, 4 * HIDDEN), np.float32)
        h, c, own = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32), np.empty((batch, HIDDEN), np.float32)
        i, f, o, g = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        part, bias = np.empty((TAGS, batch), np.float32), self.p["o"][:, None]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(wx, x[t], axis=0, out=z, mode="clip")
            np.matmul(h, wh, out=gates)
            gates += z
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(f, c, out=c)
            np.subtract(g, 0.5, out=own)
            own *= i
            c += own
            np.multiply(c, -4, out=own)
            np.exp(own, out=own)
            own += 1
            np.reciprocal(own, out=own)
            own -= 0.5
            np.multiply(o, own, out=h)
            if d == "f":
                np.matmul(w, h.T, out=e[t])
                e[t] += bias
            else:
                np.matmul(w, h.T, out=part)
                e[t] += part

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (B, T) for classes (B, T)."""
        x = np.ascontiguousarray(x.T, np.intp)
        steps, batch = x.shape
        e = np.empty((steps, TAGS, batch), np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut: 1 / (1 + inf)
            self._add_emissions(e, x, "f")
            self._add_emissions(e, x, "b")
        tags, some = np.zeros((batch, steps), np.int64), np.flatnonzero(~self._outside(e))
        if len(some):
            tags[some] = self._best(e if len(some) == batch else e.take(some, axis=2))
        return tags

    def _outside(self, e: np.ndarray) -> np.ndarray:
        """Whether no path of emissions e (T, TAGS, B) can be better than the one that is outside throughout: all other tags are taken as one, with the
        greatest of their emissions and of their transitions. Its score is rounded as theirs are, step by step, so it is never below one of theirs."""
        trans, apart = self.p["t"], np.arange(TAGS) != O_TAG
        stay, enter, leave, inside = trans[O_TAG, O_TAG], trans[O_TAG, apart].max(), trans[apart, O_TAG].max(), trans[apart][:, apart].max()
        most = e[:, 1:].max(axis=1)
        out, other, sure = e[0, O_TAG].copy(), most[0], np.ones(e.shape[2], bool)
        for t in range(1, len(e)):
            sure &= other + leave <= out + stay
            other = np.maximum(out + enter, other + inside)
            other += most[t]
            out += stay
            out += e[t, O_TAG]
        return sure & (other <= out)

    def _best(self, e: np.ndarray) -> np.ndarray:
        """Tags (B, T) of the best paths of emissions e (T, TAGS, B), which is overwritten."""
        steps, _, batch = e.shape
        trans = self.p["t"]
        into, one, top = np.ascontiguousarray(trans.T), np.empty((TAGS, batch), np.float32), np.empty((TAGS, batch), np.float32)
        out_of = [np.ascontiguousarray(trans[k][:, None]) for k in range(TAGS)]
        stays, outside = np.ones(batch, bool), np.empty(batch, np.float32)
        for t in range(1, steps):  # e[t] becomes the greatest score of a path that ends in each tag
            before = e[t - 1]
            np.add(before[0], out_of[0], out=top)
            outside[:] = top[O_TAG]
            for k in range(1, TAGS):
                np.add(before[k], out_of[k], out=one)
                np.maximum(top, one, out=top)
            stays &= outside == top[O_TAG]
            e[t] += top
        last = e[-1].argmax(axis=0)
        tags = np.zeros((batch, steps), np.int64)
        # where the best way to be outside always was to have been outside, a path that ends outside has no other tag: no need to step back
        rest = np.flatnonzero(~stays | (last != O_TAG))
        if len(rest):
            e, back = e.take(rest, axis=2), np.empty((steps, len(rest)), np.int64)
            back[-1] = last[rest]
            for t in range(steps - 1, 0, -1):
                back[t - 1] = (e[t - 1] + into[back[t]].T).argmax(axis=0)
            tags[rest] = back.T
        return tags


def _made(rng: np.random.Generator, kind: int) -> str:
    """A synthetic entity of the kind."""
    pick = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    if kind == 0:
        name = pick(low, rng.integers(2, 9)) + (("." if rng.random() < 0.5 else "_") + pick(low, rng.integers(2, 7)) if rng.random() < 0.5 else "")
        name = (pick(dig, rng.integers(1, 4)) + name if rng.random() < 0.2 else name) if rng.random() < 0.8 else pick(dig, rng.integers(1, 4))
        host = pick(low, rng.integers(3, 9)) + (pick(dig, 1) if rng.random() < 0.3 else "")
        return f"{name}@{host}" + rng.choice(["", ".example"]) + rng.choice([".com", ".org", ".net", ".de", ".fr", ".co.uk"])
    if kind == 1:
        return ".".join(str(v) for v in rng.integers(0, 256, 4))
    if kind == 2:
        body = pick(dig, 15)
        number = next(body + c for c in dig if luhn(body + c))
        sep = rng.choice(["", "", "-", " "])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = pick("123456789", 1) + pick(dig, 2), pick(dig, 3), pick(dig, 4)
        lead = rng.choice(["+1 ", "+44 ", "+49-", "", "", "1-"])
        return lead + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"])
    return pick(hexa, rng.choice([32, 40, 64])) if rng.random() < 0.7 else rng.choice(["sk-", "ghp_", "AKIA"]) + pick(low.upper() + dig + low, rng.integers(20, 36))


def training_windows(n: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags (n, TRAIN_LENGTH) of synthetic text with labelled spans; some windows hold numbers that are no entity."""
    rng = np.random.default_rng(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "la", "que", "der", "sch", "ción", "é", "ü", "lly", "ing", "ent"]
    decoys = [lambda: str(rng.integers(0, 10 ** int(rng.integers(1, 6)))), lambda: f"{rng.integers(1, 32)}/{rng.integers(1, 13)}/{rng.integers(1950, 2030)}", lambda: f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}", lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 20)}", lambda: f"{rng.integers(0, 1000)}.{rng.integers(0, 100):02d}", lambda: "@" + "".join(rng.choice(syllables, 2))]
    xs, ys = np.zeros((n, TRAIN_LENGTH), np.int64), np.zeros((n, TRAIN_LENGTH), np.int64)
    for k in range(n):
        text, tags = "", []
        while len(text) < 2 * TRAIN_LENGTH:
            u = rng.random()
            if u < 0.12:
                kind = int(rng.integers(0, len(KINDS)))
                lead = 'token = "' if kind == 4 and rng.random() < 0.5 else ""
                made = _made(rng, kind)
                text, tags = text + lead + made, tags + [O_TAG] * len(lead) + [1 + 2 * kind] + [2 + 2 * kind] * (len(made) - 1)
                tail = ('"' if lead else "") + str(rng.choice([" ", ". ", ", ", "\n", "### ", "%%% "]))
            else:
                made = decoys[int(rng.integers(0, len(decoys)))]() if u < 0.24 else "".join(rng.choice(syllables, int(rng.integers(1, 5))))
                made = made.capitalize() if rng.random() < 0.1 else made
                text, tags = text + made, tags + [O_TAG] * len(made)
                tail = str(rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "$$$ "]))
            text, tags = text + tail, tags + [O_TAG] * len(tail)
        s = int(rng.integers(0, len(text) - TRAIN_LENGTH))
        xs[k], ys[k] = classes_of(text)[s : s + TRAIN_LENGTH], tags[s : s + TRAIN_LENGTH]
    return xs, ys


@lru_cache(maxsize=2)
def trained(seed: int = 5) -> dict:
    """Parameters after EPOCHS of Adam over the training windows."""
    model, (xs, ys) = Model(seed), training_windows()
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, batch = 0, 128
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for low in range(0, len(xs), batch):
            some = order[low : low + batch]
            _, grad = model.loss_and_gradient(np.ascontiguousarray(xs[some].T), np.ascontiguousarray(ys[some].T))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.02 * min(1, step / 10) * (1 - step / (EPOCHS * len(xs) / batch + 1)) + 0.001
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model.p


def model_from(p: dict) -> Model:
    model = Model.__new__(Model)
    model.p = p
    return model


# --- spans over whole texts ------------------------------------------------------------------------------------------


def window_starts(n: int) -> range:
    """Starts of the windows that cover a text of n characters."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), O_TAG]):
        if start >= 0 and t != 2 + 2 * kind:
            out.append((start, kind, i))
            start = -1
        if t and t % 2:
            start, kind = i, (t - 1) // 2
        elif t and start < 0:
            start, kind = i, (t - 2) // 2
    return out


def well_formed(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a model span may be added: checks that a base pattern has failed are not overruled."""
    s = text[start:end]
    d = _digits(s)
    whole = not (start and text[start - 1].isalnum() and s[0].isalnum()) and not (end < len(text) and text[end].isalnum() and s[-1].isalnum())
    if not whole:
        return False
    if kind == 0:
        return s.count("@") == 1 and s[0] != "@" and "." in s.split("@")[1].strip(".")
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and all(map(_small, s.split(".")))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]([ .-]?[0-9])*", s))
    if kind == 3:
        return 10 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", s)) and bool(re.search(r"[ ().-]", s)) and not re.fullmatch(r"[0-9]+(\.[0-9]+){3,}", s)
    # a word of few digits is a secret only with a known prefix, or with capitals or digits amid its letters
    odd = len(d) >= 3 or _PREFIX.match(s) or re.search(r"[a-z][A-Z]|[A-Za-z][0-9][A-Za-z]", s)
    return len(s) >= SECRET and bool(odd) and bool(re.fullmatch(rf"[{TOKEN}]+", s)) and bool(re.search(r"[A-Za-z]", s))


def _joined(text: str, pieces: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int]]:
    """Spans of cut pieces (start, kind, end, open on the left, on the right): those of one kind that overlap or touch are one span."""
    out: list[list[int]] = []
    for kind in range(len(KINDS)):
        for s, _, e, left, right in sorted(p for p in pieces if p[1] == kind):
            done = out[-1][2] if out and out[-1][1] == kind else 0
            while kind == 4 and left and s > done and _ONE.match(text[s - 1]):
                s -= 1
            if kind == 4 and right and e > done and (run := _RUN.match(text, e)):
                e = run.end()
            if out and out[-1][1] == kind and s <= out[-1][2]:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([s, kind, e])
    return [(s, kind, e) for s, kind, e in out]


def reconcile(text: str, base: list[tuple[int, int, int]], windows: list[tuple[int, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int]]:
    """Base spans and the model spans added to them, in order. windows: start, and spans inside."""
    found, pieces = [], []
    for begin, spans in windows:
        for s, kind, e in spans:
            left, right = s == 0 and begin > 0, e == WINDOW and begin + e < len(text)
            if kind == 4 and e - s >= SECRET:  # as long as a secret, and yet only a part of its word
                left |= begin + s > 0 and text[begin + s - 1 : begin + s + 1].isalnum()
                right |= text[begin + e - 1 : begin + e + 1].isalnum() and begin + e < len(text)
            if left or right:
                a, b = begin + s, min(begin + e, len(text))
                # a secret's piece that runs past its word is cut down to its words
                runs = [(a + r.start(), a + r.end()) for r in _RUN.finditer(text[a:b])] if kind == 4 else [(a, b)]
                pieces += [(x, kind, y, left and x == a, right and y == b) for x, y in runs]
            found.append((2 if left or right else 0, abs(begin + WINDOW // 2 - (begin + s + begin + e) // 2), begin + s, kind, min(begin + e, len(text))))
    found += [(1, 0, *span) for span in _joined(text, pieces)]
    # what is taken: disjoint stretches in order
    starts, ends = [], []
    for s, _, e in base:
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    added = []
    for _, _, s, kind, e in sorted(found):
        while e > s and text[e - 1] in " .,\n\"'":
            e -= 1
        while s < e and text[s] in " .,\n\"'":
            s += 1
        k = bisect_left(starts, e)
        if e > s and (k == 0 or ends[k - 1] <= s) and well_formed(text, kind, s, e):
            starts.insert(k, s), ends.insert(k, e)
            added.append((s, kind, e))
    return sorted([*base, *added])


def find_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text, (base spans, all spans)."""
    groups: dict[int, list[tuple[int, int]]] = {}  # windows (text, start) by padded length
    for k, text in enumerate(texts):
        for s in window_starts(len(text)) if text else ():
            size = min(WINDOW, len(text) - s)
            groups.setdefault(-(-size // STEP) * STEP, []).append((k, s))
    classes = [classes_of(t) for t in texts]
    windows: list[list] = [[] for _ in texts]
    for length, some in groups.items():
        for low in range(0, len(some), BATCH):
            part = some[low : low + BATCH]
            x = np.full((len(part), length), OWN.index("\n"), np.uint8)
            for row, (k, s) in zip(x, part, strict=True):
                own = classes[k][s : s + length]
                row[: len(own)] = own
            tags = model.decode(x)
            for j in np.flatnonzero(tags.any(axis=1)).tolist():
                k, s = part[j]
                windows[k].append((s, _spans_of(tags[j])))
    out = []
    for text, own in zip(texts, windows, strict=True):
        base = base_spans(text)
        out.append((base, reconcile(text, base, own) if own else base))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row: n_spans counts all spans, the model's too."""
    parameters = df.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_from(parameters.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                made = find_spans([x or "" for x in some.column(1).to_pylist()], model)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in made], pa.int64()) for kind in range(4)]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in made])
                yield pa.RecordBatch.from_arrays([some.column(0), *counts, digests, pa.array([written(every) for _, every in made]), pa.array([len(every) for _, every in made], pa.int64())], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the later part is covered by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out.append(text[at:s] + f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with spans masked in the text; all rows and columns stay."""
    parameters = df.sparkSession.sparkContext.broadcast(trained())  # of fixed size
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_from(parameters.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                texts = some.column(at).to_pylist()
                made = find_spans([x or "" for x in texts], model)
                masked = [t if t is None or not every else mask_text(t, every) for t, (_, every) in zip(texts, made, strict=True)]
                yield some.set_column(at, some.schema.field(at), pa.array(masked, some.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
