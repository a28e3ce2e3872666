"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions beside them."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the tagger knows. Only `secret` has no pattern.
TAGGED = (*KINDS, "secret")
#: Windows of a text start each STRIDE characters; the last one is shorter.
WINDOW, STRIDE = 512, 448
#: Windows are as long as a multiple of this, with spaces at the end; as many of one length are tagged together.
ROUND, TOGETHER = 32, 1024
#: Texts of about as many bytes are tagged together.
PART_BYTES = 4_000_000
#: The length of the labelled crops that the tagger is fitted on.
CROP = 160

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds_up(kind: str, s: str) -> bool:
    """Whether s can be what the kind says: the rule for matches of its pattern, and a filter on what the tagger found."""
    digits = _DIGITS.sub("", s)
    if kind == "ip":
        return s.count(".") == 3 and all(x.isdigit() and len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "email":
        return "@" in s[1:-1] and "." in s.rpartition("@")[2].strip(".")
    return len(s) >= 16 and " " not in s


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that hold up, in order.

    Per kind the leftmost non-overlapping matches. A run of digits or of an
    address's characters is looked at once, from its start, which is where the
    leftmost match in it starts if there is one.
    """
    found = []
    if _HINT.search(text) is None:
        return found
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds_up(KINDS[kind], m[0])]
    return sorted(found)


# --- the tagger

TAGS = 1 + 2 * len(TAGGED)
_CHARS = 130


def encode(text: str) -> np.ndarray:
    """ASCII as it is, other letters 128, the rest 129."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(code, 129).astype(np.uint8)
    high = np.flatnonzero(code >= 128)
    if high.size:
        found, at = np.unique(code[high], return_inverse=True)
        out[high] = np.array([128 if chr(c).isalpha() else 129 for c in found], np.uint8)[at]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, a forward and a backward LSTM, a linear layer, and CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden

        def init(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"E": init(_CHARS, embed) * 3, "O": init(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(embed, 4 * hidden), f"U{d}": init(hidden, 4 * hidden), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """States of x (length, batch, embed); gates in the order input, forget, output, cell."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, U = h, self.p[f"U{d}"]
        pre = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        out, saved = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ U
            g, s = np.tanh(z[:, 3 * n :]), _sigmoid(z[:, : 3 * n])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            before = c
            c = f * before + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, saved

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """Scores (length, batch, tags) of chars (batch, length)."""
        x = self.p["E"][chars.T]
        forward, saved_f = self._lstm(x, "f", keep)
        backward, saved_b = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["O"] + self.p["o"], (x, both, saved_f, saved_b)

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """emissions() as (length, tags, batch), for tagging.

        Characters are looked up behind the input weights; a sigmoid is half of one
        plus the tanh of the half, and the states are kept at their double.
        """
        n, (B, L) = self.hidden, chars.shape
        codes, out = np.ascontiguousarray(chars.T.astype(np.intp)), np.empty((L, TAGS, B), np.float32)
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), n)
        z, own = np.empty((4 * n, B), np.float32), np.empty((TAGS, B), np.float32)
        gates, (i, f, o, g) = z[: 3 * n], z.reshape(4, n, B)
        for d, order, O in (("f", range(L), self.p["O"][:n]), ("b", range(L - 1, -1, -1), self.p["O"][n:])):
            table = np.ascontiguousarray(((self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]) * half).T, np.float32)
            U, O = np.ascontiguousarray((self.p[f"U{d}"] * half / 2).T, np.float32), np.ascontiguousarray(O.T / 2, np.float32)
            h, c, keep = np.zeros((n, B), np.float32), np.zeros((n, B), np.float32), np.empty((n, B), np.float32)
            for t in order:
                np.matmul(U, h, out=z)
                z += table.take(codes[t], 1)
                np.tanh(z, out=z)
                gates += 1
                c *= f
                c += np.multiply(i, g, out=keep)
                c *= 0.5
                np.multiply(o, np.tanh(c, out=keep), out=h)
                if d == "f":
                    np.matmul(O, h, out=out[t])
                else:
                    out[t] += np.matmul(O, h, out=own)
        out += self.p["o"][:, None]
        return out

    def _may_tag(self, e: np.ndarray) -> np.ndarray:
        """Which columns of scores (length, tags, batch) may have a best path other than no tag at all.

        Against that path a stretch of tags gains at most its emissions, and what the
        best transitions into, inside and out of tags give; the others can't win.
        """
        T = self.p["T"] - self.p["T"][0, 0]
        into, inside, out = T[0, 1:].max(), T[1:, 1:].max(), T[1:, 0].max()
        gain = e[:, 1:].max(1) - e[:, 0]
        run, found = gain[0], gain[0] + out >= 0
        for x in gain[1:]:
            run = np.maximum(run + inside, into) + x
            found |= run + out >= 0
        return found | (run >= 0)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tags (batch, length), by Viterbi."""
        e = self.scores(chars)
        out = np.zeros(chars.shape, np.int64)
        some = np.flatnonzero(self._may_tag(e))
        if some.size == 0:
            return out
        e = np.ascontiguousarray(e[:, :, some])
        T, best = self.p["T"], np.empty_like(e)
        best[0] = e[0]
        for t in range(1, len(e)):
            best[t] = (best[t - 1][:, None, :] + T[:, :, None]).max(0) + e[t]
        tags, rows = np.empty((some.size, len(e)), np.int64), np.arange(some.size)
        tags[:, -1] = best[-1].argmax(0)
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = (best[t] + T[:, tags[rows, t + 1]]).argmax(0)
        out[some] = tags
        return out

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood of the tags, and its gradients."""
        e, (x, both, *saved) = self.emissions(chars, True)
        T, (L, B, K) = self.p["T"], e.shape

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return (np.log(np.exp(a - m).sum(axis, keepdims=True)) + m).squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, L):
            alpha[t] = lse(alpha[t - 1][:, :, None] + T, 1) + e[t]
        for t in range(L - 2, -1, -1):
            beta[t] = lse(T + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold, rows = tags.T, np.arange(B)
        score = sum(e[t, rows, gold[t]] for t in range(L)) + sum(T[gold[t], gold[t + 1]] for t in range(L - 1))
        de = np.exp(alpha + beta - z[:, None])
        for t in range(L):
            de[t, rows, gold[t]] -= 1
        pair = np.exp(alpha[:-1, :, :, None] + T + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        de /= B
        grad = {"T": pair / B, "O": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, K), "o": de.sum((0, 1))}
        dh = de @ self.p["O"].T
        dx = np.zeros_like(x)
        n = self.hidden
        for d, own, cache in (("f", dh[:, :, :n], saved[0]), ("b", dh[::-1, :, n:], saved[1])):
            source = x if d == "f" else x[::-1]
            U, dz = self.p[f"U{d}"], np.empty((L, B, 4 * n), np.float32)
            dc, hidden, gU = np.zeros((B, n), np.float32), np.zeros((B, n), np.float32), np.zeros_like(U)
            for t in range(L - 1, -1, -1):
                h, before, i, f, o, g, tc = cache[t]
                total = own[t] + hidden
                dc = dc + total * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), total * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                gU += h.T @ dz[t]
                hidden, dc = dz[t] @ U.T, dc * f
            grad |= {f"U{d}": gU, f"b{d}": dz.sum((0, 1)), f"W{d}": source.reshape(L * B, -1).T @ dz.reshape(L * B, -1)}
            back = dz @ self.p[f"W{d}"].T
            dx += back if d == "f" else back[::-1]
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], chars.T, dx)
        return float((z - score).mean()), grad

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        total = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                _, grad = self.gradients(chars[own], tags[own])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                scale = min(1.0, 5 / max(norm, 1e-9))
                for k, g in grad.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


_ONSETS = ("", "", "b", "c", "ch", "d", "f", "g", "h", "k", "l", "m", "n", "p", "pf", "ph", "qu", "r", "s", "sch", "sh", "st", "str", "t", "th", "tr", "v", "w", "wh", "z", "ñ")
_NUCLEI = ("a", "e", "i", "o", "u", "a", "e", "i", "o", "ea", "ie", "ou", "au", "ei", "io", "y", "ä", "ö", "ü", "é", "è", "ê", "í", "ó", "")
_CODAS = ("", "", "", "n", "nd", "nt", "r", "s", "ss", "st", "sh", "t", "tz", "l", "ll", "ld", "ng", "m", "ch", "ck", "rr", "x", "ß", "wh", "ble", "ly", "tion")


def _letters(rng: random.Random, most: int) -> str:
    return "".join(rng.choice(_ONSETS) + rng.choice(_NUCLEI) + rng.choice(_CODAS) for _ in range(rng.randint(1, most))) or "a"


def _word(rng: random.Random) -> str:
    w = _letters(rng, rng.choice((1, 1, 2, 2, 3, 4, 6)))
    return rng.choice((w, w, w, w, w.capitalize(), w.upper() + "!!", w + rng.choice((",", ".", "&&&", "%%%", "***", "###", "$$$"))))


def _look_alike(rng: random.Random) -> str:
    """What has letters or signs enough for a secret, and is none."""
    words = [_letters(rng, 3) for _ in range(rng.randint(2, 5))]
    return rng.choice((
        "".join(x.capitalize() for x in words),
        words[0] + "".join(x.capitalize() for x in words[1:]),
        rng.choice("_-/.").join(words),
        "_".join(words).upper(),
        f"https://{words[0]}.{rng.choice(('org', 'example.com', 'net'))}/{'/'.join(words[1:])}",
        f"/{'/'.join(words)}.{rng.choice(('py', 'html', 'txt'))}",
        rng.choice("=-*#~_.ax") * rng.randint(8, 60),
    ))


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secret(rng: random.Random) -> str:
    """A random string of one alphabet, with digits or without."""
    alphabet = rng.choice(("0123456789abcdef", "0123456789abcdef", _UPPER + _LOWER + "0123456789", _UPPER + _LOWER + "0123456789_-", _UPPER + _LOWER, _UPPER + _LOWER))
    return "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 24, 32, 40, 40, 48, 64))))


def labelled_example(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up passage and its labelled spans; personal data among words and look-alikes."""
    parts: list[tuple[str, str]] = []
    prose = rng.random() < 0.3
    for _ in range(rng.randint(8, 30)):
        kind = rng.choices(("word", "email", "ip", "card", "phone", "secret", "number", "look"), (60, 0, 0, 0, 0, 0, 3, 4) if prose else (60, 4, 4, 4, 4, 8, 6, 5))[0]
        if kind == "email":
            s = f"{_word(rng).lower().strip('!')}{rng.choice(('.', '_', ''))}{rng.randint(0, 99)}@{rng.choice(('mail', 'post', 'web'))}{rng.randint(1, 9)}.{rng.choice(('example.com', 'org', 'co.uk', 'net'))}"
        elif kind == "ip":
            s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == "card":
            while not luhn(s := _number(rng, rng.choice((13, 15, 16, 16, 16)))):
                pass
            s = rng.choice((s, re.sub(r"(.{4})(?=.)", rng.choice((r"\1 ", r"\1-")), s)))
        elif kind == "phone":
            s = rng.choice((f"+{rng.randint(1, 99)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}", f"+{rng.randint(1, 99)} {_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}", f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}", f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}"))
        elif kind == "secret":
            s = _secret(rng)
            if rng.random() < 0.6:
                quote = rng.choice(('"', "'", ""))
                parts += [(f"{rng.choice(('token', 'key', 'secret', 'api_key', 'password', 'Authorization'))}{rng.choice((' = ', '=', ': '))}{quote}", ""), (s, "secret"), (quote + " ", "")]
            else:
                parts += [(s, "secret"), (rng.choice((" ", " ", "\n", ", ", ". ")), "")]
            continue
        elif kind == "number":
            s = rng.choice((_number(rng, rng.randint(1, 4)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"@{_word(rng)}", f"{_word(rng)}{rng.randint(1, 999)}", f"({rng.randint(1, 99)})"))
            kind = "word"
        elif kind == "look":
            s, kind = _look_alike(rng), "word"
        else:
            s = _word(rng)
        parts += [(s, "" if kind == "word" else kind), (rng.choice((" ", " ", " ", ", ", ". ", "\n", "### ", "%%% ", " | ")), "")]
    text, spans = "", []
    for s, kind in parts:
        if kind:
            spans.append((len(text), len(text) + len(s), kind))
        text += s
    return text, spans


@functools.lru_cache(2)
def trained(examples: int = 3000, epochs: int = 8, seed: int = 17) -> Tagger:
    """A tagger fitted on made-up labelled passages; the same on every machine."""
    rng = random.Random(seed)
    chars, tags = np.full((examples, CROP), 32, np.int64), np.zeros((examples, CROP), np.int64)
    for k in range(examples):
        text, spans = labelled_example(rng)
        own = np.zeros(len(text), np.int64)
        for s, e, kind in spans:
            own[s:e] = 2 + 2 * TAGGED.index(kind)
            own[s] -= 1
        at = rng.randint(0, max(0, len(text) - CROP))
        piece = encode(text)[at : at + CROP]
        chars[k, : len(piece)], tags[k, : len(piece)] = piece, own[at : at + CROP]
    return Tagger().fit(chars, tags, epochs)


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over all of a text of n characters; each but a text's only one holds more than what the one before has."""
    return [(s, min(n, s + WINDOW)) for s in range(0, n if n <= WINDOW else n - (WINDOW - STRIDE), STRIDE)]


def reconcile(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the non-overlapping choice of (start, kind, end, weight) of most weight."""
    best: dict[tuple[int, int, int], int] = {}
    for s, k, e, w in spans:
        best[s, k, e] = best.get((s, k, e), 0) + w
    own = sorted(best, key=lambda x: x[2])
    ends = [x[2] for x in own]
    score, take = [0], []
    for n, x in enumerate(own):
        at = int(np.searchsorted(ends[:n], x[0], "right"))
        take.append((score[at] + best[x] > score[n], at))
        score.append(max(score[n], score[at] + best[x]))
    out, n = [], len(own)
    while n:
        used, at = take[n - 1]
        if used:
            out.append(own[n - 1])
        n = at if used else n - 1
    return sorted(out)


def united(pieces: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, weight) of pieces (start, kind, end, and whether a window cut the start or the end).

    A piece with a cut start goes on from those of its kind with a cut end that it
    overlaps or touches. What is whole weighs its length twice.
    """
    groups: list[list] = []  # start, kind, end, cut start, cut end, how far pieces with a cut end reach
    for s, k, e, late, early in sorted(pieces):
        own = [s, k, e, late, early, e if early else -1]
        for x in [x for x in groups if late and x[1] == k and x[5] >= s]:
            groups.remove(x)
            first, last = min(x, own, key=lambda g: (g[0], g[3])), max(x, own, key=lambda g: (g[2], not g[4]))
            own = [first[0], k, last[2], first[3], last[4], max(x[5], own[5])]
        groups.append(own)
    return [(s, k, e, (1 if late or early else 2) * (e - s)) for s, k, e, late, early, _ in groups]


def _pieces(tags: np.ndarray, s: int, e: int, n: int) -> Iterator[tuple[int, int, int, bool, bool]]:
    """The spans in the tags of the window from s to e of a text of n characters, as united() takes them."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    head = np.append(True, (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1))
    starts = np.flatnonzero(head)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), tags.size], strict=True):
        if kind[a] >= 0:
            yield s + a, int(kind[a]), s + b, a == 0 and s > 0, b == e - s and e < n


def tagged_spans(tagger: Tagger, texts: list[str], batch: int = TOGETHER) -> list[list[tuple[int, int, int]]]:
    """Per text the tagger's spans (start, kind, end), reconciled over all of its windows, which hold every character.

    A span that touches a window's edge inside the text may go on beyond it; such
    pieces are united with those that they go on in, then weighed, so that a span of
    any length that no window holds is one span. A window is as long as its own
    characters ask for, so that a text's spans don't depend on the texts beside it.
    """
    codes = [encode(text) for text in texts]
    work: dict[int, list[tuple[int, int, int]]] = {}
    for n, own in enumerate(codes):
        for s, e in windows(own.size):
            work.setdefault(-(-(e - s) // ROUND) * ROUND, []).append((n, s, e))
    found: list[list[tuple[int, int, int, bool, bool]]] = [[] for _ in texts]
    for length, all_of in work.items():
        for at in range(0, len(all_of), batch):
            part = all_of[at : at + batch]
            chars = np.full((len(part), length), 32, np.uint8)
            for row, (n, s, e) in enumerate(part):
                chars[row, : e - s] = codes[n][s:e]
            tags = tagger.decode(chars)
            for row in np.flatnonzero(tags.any(1)).tolist():
                n, s, e = part[row]
                found[n] += _pieces(tags[row, : e - s], s, e, codes[n].size)
    return [reconcile(united(x)) if x else [] for x in found]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PART_BYTES of the column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _finder(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for text, more in zip(texts, tagged_spans(tagger, texts), strict=True):
                    base = base_spans(text)
                    rows.append([{"start": s, "end": e, "kind": KINDS[k], "base": True} for s, k, e in base])
                    taken = sorted((s, e) for s, _, e in base)
                    for s, k, e in more:
                        if all(e <= a or b <= s for a, b in taken) and holds_up(TAGGED[k], text[s:e]):
                            rows[-1].append({"start": s, "end": e, "kind": TAGGED[k], "base": False})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, kind)], names=["id", "text", "spans"])

    return run


SPANS = "array<struct<start:long,end:long,kind:string,base:boolean>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(id_col, text, spans): personal data of each text, in code points, ends exclusive.

    The patterns' spans are marked `base` and stay, even where kinds overlap. The
    tagger reads every character of every text; it adds its spans that overlap none
    of the base ones. A separate filter, `holds_up`, then drops those that can't be
    what their kind says (a card without a check digit, a secret of under 16 characters).
    Null texts are empty and have no spans. Each row stands for itself, whatever
    its id. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(_finder(tagger or trained()), f"id {kind}, text string, spans {SPANS}").withColumnRenamed("id", id_col)


def _redactor(tagger: Tagger, text_at: int):
    find = _finder(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(text_at), batch.column(text_at).fill_null("")], names=["id", "text"])
            at = 0
            for found in find([own]):
                out = []
                for was, text, spans in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
                    pieces, done = [], 0
                    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                        if x["start"] >= done:
                            pieces += [text[done : x["start"]], f"<{x['kind'].upper()}>"]
                        done = max(done, x["end"])
                    out.append(None if was is None else "".join([*pieces, text[done:]]))
                part = batch.slice(at, found.num_rows)
                at += found.num_rows
                yield part.set_column(text_at, batch.schema.field(text_at), pa.array(out, batch.schema.field(text_at).type))

    return run


def redact(docs: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; null texts stay null."""
    return docs.mapInArrow(_redactor(tagger or trained(), docs.columns.index(text_col)), docs.schema)
