"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns are exact and their spans always stay.  The tagger is trained here in numpy, from
labelled spans in sentences that a seeded generator writes (addresses and numbers in the usual and
in some unusual forms, among words, dates, prices, marks and hexadecimal keys); no corpus text is used.  Every
text is cut into windows of 1,024 characters that overlap by 48, and every window is decoded with the CRF's
best path.  The paths of a text's windows are joined where both give the same label, nearest to the middle of
their overlap, so a span may go on over any number of windows.  What follows from the joined path is
reconciled over the whole text, leftmost first, and never overlaps a pattern's span.  The trained cells are read
by ONNX Runtime, which executors need.

A tagger's span counts only if it can be what it is called: an address has ``@`` inside, a number seven digits.

Defined results: a null text is an empty text; repeated rows give repeated rows; a text of any
length is read whole, window by window; extra columns are not read; an empty table gives none.
Texts are tagged some at a time, which changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnstore.llm.common import lean, own_names_apart, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE, BATCH = 1024, 976, 640
#: Times that are read at once.
TIMES = 128
#: A gate's sigmoid at minus this is 0 in 32 bits, beside any hidden state.
SHUT = 1000
#: Characters of texts that are tagged together.
SLICE = 1 << 20
SENTENCE, HIDDEN, EMBEDDING, SENTENCES, EPOCHS, SEED = 96, 12, 12, 2000, 18, 7
_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PLAIN = str.maketrans("éèêàçñóíüöä", "eeeacnoiuoa", "ß")
_NOT_DIGIT = re.compile("[^0-9]")

Span = tuple[int, int, int]  # kind, start, end


# Patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and start.  Linear in the text."""
    out: list[Span] = []
    at = last = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = max(at + 1, last)
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for kind, pattern, least, most in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def spans_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# The tagger


def _codes(text: str) -> np.ndarray:
    """Character classes: 1 to 95 printable ASCII, 96 white space, 97 other characters, 0 padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c - 31, np.where(c < 32, 96, 97)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """A bidirectional LSTM with a linear layer and CRF transitions."""

    def __init__(self, rng: np.random.Generator):
        e, h, n = EMBEDDING, HIDDEN, len(LABELS)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": small(98, e) * 3, "out": small(2 * h, n), "out_b": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": small(e, 4 * h), f"h{d}": small(h, 4 * h), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), h)}

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states [time, batch, hidden] in reading direction ``d`` for x [time, batch, 4 hidden]."""
        w, size = self.p[f"h{d}"], HIDDEN
        h = c = np.zeros((x.shape[1], size), np.float32)
        out, kept = np.empty((*x.shape[:2], size), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = x[t] + h @ w
            gates, g = _sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t], kept[t] = h, (i, f, o, g, before, tc, last)
        return out, kept

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """[time, batch, label] for codes [batch, time]."""
        p, ids = self.p, codes.T
        x = p["emb"][ids]
        f, kf = self._lstm((p["emb"] @ p["xf"] + p["bf"])[ids], "f")
        b, kb = self._lstm((p["emb"] @ p["xb"] + p["bb"])[ids], "b")
        both = np.concatenate([f, b], axis=2)
        return both @ p["out"] + p["out_b"], (ids, x, both, kf, kb)

    def step(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the CRF's negative log-likelihood, for a batch."""
        p, h = self.p, HIDDEN
        e, (ids, x, both, kf, kb) = self.emissions(codes)
        time, batch, n = e.shape
        y, rows = labels.T, np.arange(batch)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, time):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + p["trans"], 1)
        for t in range(time - 2, -1, -1):
            beta[t] = _logsum(p["trans"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = _logsum(alpha[-1], 1)[:, None]
        de = np.exp(alpha + beta - whole)
        g = {"trans": np.zeros_like(p["trans"])}
        for t in range(1, time):
            pair = alpha[t - 1][:, :, None] + p["trans"] + (e[t] + beta[t])[:, None, :] - whole[:, :, None]
            g["trans"] += np.exp(pair).sum(axis=0)
            np.add.at(g["trans"], (y[t - 1], y[t]), -1)
        de[np.arange(time)[:, None], rows, y] -= 1
        flat = de.reshape(-1, n)
        g["out"], g["out_b"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        dboth = de @ p["out"].T
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, dboth[:, :, :h]), ("b", kb, dboth[:, :, h:])):
            w = p[f"h{d}"]
            dz = np.empty((time, batch, 4 * h), np.float32)
            dh = dc = np.zeros((batch, h), np.float32)
            gh = np.zeros_like(w)
            for t in range(time - 1, -1, -1) if d == "f" else range(time):
                i, f, o, c, before, tc, last = kept[t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)], axis=1)
                gh += last.T @ dz[t]
                dh, dc = dz[t] @ w.T, dc * f
            flat = dz.reshape(-1, 4 * h)
            g |= {f"h{d}": gh, f"x{d}": x.reshape(-1, EMBEDDING).T @ flat, f"b{d}": flat.sum(axis=0)}
            dx += dz @ p[f"x{d}"].T
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids.ravel(), dx.reshape(-1, EMBEDDING))
        return {k: v / batch for k, v in g.items()}

    def _scan(self, codes: np.ndarray, active: list[int], d: str, out: np.ndarray) -> None:
        """Adds what a reading of codes [time, window] gives each label to ``out`` [time, label, window].

        The same cells as in :meth:`_lstm`, run by :func:`_reader` some times at once.  At each time the first
        ``active`` windows go on; in the others the gates are shut, which leaves a state of zeros.
        """
        p, size = self.p, HIDDEN
        table = (p["emb"] @ p[f"x{d}"] + p[f"b{d}"]).astype(np.float32)
        table[0] = np.repeat(np.array([-SHUT, -SHUT, -SHUT, 0], np.float32), size)
        label = (p["out"][:size] if d == "f" else p["out"][size:]).T
        on, turn = np.asarray(active), 1 if d == "f" else -1
        h, c = (np.zeros((codes.shape[1], size), np.float32) for _ in range(2))
        for a in range(0, len(codes), TIMES)[::turn]:
            n = active[a]
            some = np.where(np.arange(n) < on[a : a + TIMES, None], codes[a : a + TIMES, :n], 0)
            h[:n], c[:n], every = _reader()(None, {"table": table, "w": p[f"h{d}"], "h": h[:n], "c": c[:n], "codes": some[::turn]})
            out[a : a + TIMES, :, :n] += label @ every[::turn].transpose(0, 2, 1)

    def decode(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best label path [window, time] of each row of codes, of which the first ``sizes`` count."""
        order = np.argsort(-sizes, kind="stable")
        codes, time = codes[order].T, int(sizes.max(initial=0))
        active = [int(np.count_nonzero(sizes > t)) for t in range(time)]
        codes = np.ascontiguousarray(codes[:time])
        p, n = self.p, len(LABELS)
        e = np.zeros((time, n, codes.shape[1]), np.float32)
        e += p["out_b"][:, None]
        self._scan(codes, active, "f", e)
        self._scan(codes, active, "b", e)
        trans, flat = p["trans"][:, :, None], np.empty(n * n * codes.shape[1], np.float32)
        for t in range(1, time):  # e becomes the best path's score
            k = active[t]
            from_each = np.add(e[t - 1, :, None, :k], trans, out=flat[: n * n * k].reshape(n, n, k))
            e[t, :, :k] += np.maximum.reduce(from_each, axis=0)
        path = np.zeros((time, codes.shape[1]), np.int8)
        for t in range(time - 1, -1, -1):
            k, on = active[t], active[t + 1] if t + 1 < time else 0
            if on:
                path[t, :on] = (np.take(p["trans"], path[t + 1, :on], axis=1, mode="clip") + e[t, :, :on]).argmax(axis=0)
            path[t, on:k] = e[t, :, on:k].argmax(axis=0)
        out = np.zeros((len(sizes), codes.shape[0]), np.int8)
        out[order] = path.T
        return out


def _message(*fields: tuple[int, int | str | bytes]) -> bytes:
    """A protocol buffer of (number, value): integers, or strings and messages with their length."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@lru_cache(1)
def _reader() -> Callable[[None, dict[str, np.ndarray]], list[np.ndarray]]:
    """Runs the cells over codes [time, window] in ONNX Runtime: the last states, and the hidden ones of each time.

    The weights are inputs, so it fits any tagger.  Numpy takes more than twice as long, mostly for exponentials.
    """
    import onnxruntime

    real, whole = 1, 7  # ONNX's numbers for 32-bit floats and 64-bit integers

    def value(name: str, kind: int, *shape: int | str) -> bytes:
        dims = [(1, _message((1 if isinstance(n, int) else 2, n))) for n in shape]
        return _message((1, name), (2, _message((1, _message((1, kind), (2, _message(*dims)))))))

    def node(op: str, takes: str, gives: str, *attributes: bytes) -> bytes:
        return _message(*((1, n) for n in takes.split()), *((2, n) for n in gives.split()), (4, op), *((5, a) for a in attributes))

    def number(name: str, n: int) -> bytes:
        return _message((1, name), (3, n), (20, 2))

    state = [value(n, real, "window", HIDDEN) for n in ("h", "c", "h_next", "c_next", "h_kept")]
    cell = [
        node("Gather", "table code", "x", number("axis", 0)), node("Gemm", "h w x", "z"), node("Split", "z sizes", "zi zf zo zg", number("axis", 1)),
        node("Sigmoid", "zi", "i"), node("Sigmoid", "zf", "f"), node("Sigmoid", "zo", "o"), node("Tanh", "zg", "g"),
        node("Mul", "f c", "old"), node("Mul", "i g", "new"), node("Add", "old new", "c_next"), node("Tanh", "c_next", "t"), node("Mul", "o t", "h_next"), node("Identity", "h_next", "h_kept"),
    ]
    body = _message(*((1, n) for n in cell), (2, "cell"), *((11, v) for v in (*state[:2], value("code", whole, "window"))), *((12, v) for v in state[2:]))
    sizes = _message((1, 4), (2, whole), (8, "sizes"), (9, np.full(4, HIDDEN, "<i8").tobytes()))
    scan = node("Scan", "h c codes", "h_last c_last every", _message((1, "body"), (6, body), (20, 5)), number("num_scan_inputs", 1))
    takes = (value("table", real, 98, 4 * HIDDEN), value("w", real, HIDDEN, 4 * HIDDEN), *state[:2], value("codes", whole, "time", "window"))
    gives = (value("h_last", real, "window", HIDDEN), value("c_last", real, "window", HIDDEN), value("every", real, "time", "window", HIDDEN))
    graph = _message((1, scan), (2, "reader"), (5, sizes), *((11, v) for v in takes), *((12, v) for v in gives))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks run side by side
    options.enable_cpu_mem_arena = False  # an arena keeps what it once took
    model = _message((1, 8), (7, graph), (8, _message((1, ""), (2, 14))))
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]).run


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def labelled(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A made-up sentence of 96 characters or more and the spans of personal data in it."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    letters = list("abcdefghijklmnopqrstuvwxyz" + "aeiounrst" * 3 + "éèêàçñóíüöäß")

    def word(least: int = 1) -> str:
        w = "".join(rng.choice(letters, rng.integers(least, 15)))
        r = rng.random()
        return w.upper() if r < 0.04 else w.capitalize() if r < 0.18 else w

    def card() -> str:
        body = pick("4", "5", "3", "0", "9") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick(body, body, " ".join(body[i : i + 4] for i in (0, 4, 8, 12)), "-".join(body[i : i + 4] for i in (0, 4, 8, 12)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{pick(1, 33, 49)} ({a}) {b}-{c}", f"+{pick(1, 34, 49)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}")

    make = (
        lambda: f"{word(2)}{pick('', '.', '_')}{pick('', digits(2))}@{word(2)}{pick('', digits(1))}.{pick('example.com', 'com', 'org', 'net')}".lower().translate(_PLAIN),
        lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4)),
        card,
        phone,
    )
    noise = (
        lambda: f"{rng.integers(1900, 2030)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: f"{digits(2)}.{digits(2)}", lambda: f"${digits(3)}",
        lambda: "".join(rng.choice(list("0123456789abcdef"), 40)), lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()} @ {word()}", lambda: digits(rng.integers(1, 9)),
        lambda: "".join(rng.choice(list("#*$%&|<>=-_.~"), rng.integers(1, 9))), lambda: f"{word()}_{word()}", lambda: f"{word()}.{word()}()", lambda: f"<{word()}>", lambda: f"{word()}'{word()}",
        lambda: f"https://{word(2)}.{pick('com', 'org')}/{word()}/{digits(3)}", lambda: f"{word()}-{digits(2)}{word()}", lambda: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop0123456789"), rng.integers(12, 40))),
    )
    text, spans = "", []
    while len(text) < SENTENCE:
        r = rng.random()
        if r < 0.12:
            k = int(rng.integers(4))
            value = make[k]()
            spans.append((k, len(text), len(text) + len(value)))
            text += value
        else:
            text += noise[rng.integers(len(noise))]() if r < 0.2 else word()
        text += pick(" ", " ", " ", " ", ", ", ". ", "\n", ".\n")
    return text, spans


@lru_cache(1)
def trained(seed: int = SEED) -> Tagger:
    """The tagger, trained with Adam on ``SENTENCES`` made-up sentences; the same for a seed."""
    rng = np.random.default_rng(seed)
    codes, labels = np.zeros((SENTENCES, SENTENCE), np.int64), np.zeros((SENTENCES, SENTENCE), np.int64)
    for row in range(SENTENCES):
        text, spans = labelled(rng)
        shift = int(rng.integers(0, len(text) - SENTENCE + 1))
        path = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            path[a:b], path[a] = 2 + 2 * k, 1 + 2 * k
        codes[row], labels[row] = _codes(text)[shift : shift + SENTENCE], path[shift : shift + SENTENCE]
    tagger = Tagger(rng)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second, n = {k: np.zeros_like(v) for k, v in tagger.p.items()}, 0
    for epoch in range(EPOCHS):
        rate = 0.012 * (1 - epoch / EPOCHS) + 0.001
        order = rng.permutation(SENTENCES)
        for a in range(0, SENTENCES, 48):
            rows, n = order[a : a + 48], n + 1
            for k, g in tagger.step(codes[rows], labels[rows]).items():
                g = np.clip(g, -5, 5)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                tagger.p[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-7)).astype(np.float32)
    return tagger


def seams(paths: np.ndarray, overlap: int) -> np.ndarray:
    """For windows of one text, one after the other: where in the overlap each passes over to the next.

    That is the place nearest to the overlap's middle at which both windows give the same label.
    """
    same = paths[:-1, paths.shape[1] - overlap :] == paths[1:, :overlap]
    near = overlap - np.abs(np.arange(overlap) - overlap // 2)
    best = np.where(same, near, 0)
    return np.where(best.any(axis=1), best.argmax(axis=1), overlap // 2)


def label_spans(labels: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, starts, ends) of the spans in the labels of texts that stand one after the other."""
    kind = (labels + 1) // 2
    fresh = np.zeros(len(labels) + 1, bool)
    fresh[begins] = True
    before = np.concatenate([[0], kind[:-1]])
    fresh[: len(labels)] |= kind != before
    start = (kind > 0) & (fresh[: len(labels)] | (labels % 2 == 1))
    a = np.flatnonzero(start)
    stop = np.concatenate([start | fresh[: len(labels)], [True]])
    ends = np.flatnonzero(stop)
    return kind[a] - 1, a, ends[np.searchsorted(ends, a, side="right")]


def tagged(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans in each text: every window of every text is decoded, and the windows' paths are joined.

    A span may go on over any number of windows.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1) * (sizes > 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    codes = _codes("".join(texts))
    at = (np.cumsum(sizes) - sizes)[owner] + number * STRIDE
    left = np.minimum(WINDOW, sizes[owner] - number * STRIDE)
    paths = np.zeros((len(owner), WINDOW), np.int8)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes, np.zeros(WINDOW, codes.dtype)]), WINDOW)
    for some in np.array_split(np.argsort(-left, kind="stable"), max(1, -(-len(owner) // BATCH))):  # like sizes together, no small rest
        found = tagger.decode(windows[at[some], : left[some].max(initial=0)], left[some])
        paths[some, : found.shape[1]] = found
    low, high = np.zeros(len(owner), np.int64), left.copy()
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    if len(inner):
        overlap = WINDOW - STRIDE
        cut = seams(paths, overlap)[inner]
        short = left[inner + 1] < overlap  # the last window may end within the overlap
        cut = np.where(short, np.minimum(cut, left[inner + 1]), cut)
        high[inner], low[inner + 1] = STRIDE + cut, cut
    places = np.arange(WINDOW)
    labels = paths[(places >= low[:, None]) & (places < high[:, None])]
    begins = np.cumsum(sizes) - sizes
    out: list[list[Span]] = [[] for _ in texts]
    kinds, starts, ends = label_spans(labels, begins[sizes > 0])
    own = np.searchsorted(begins, starts, side="right") - 1
    for k, a, b, n in zip(kinds.tolist(), starts.tolist(), ends.tolist(), own.tolist()):
        while not sizes[n]:
            n -= 1
        out[n].append((k, a - int(begins[n]), b - int(begins[n])))
    return out


def _slices(texts: list[str]) -> Iterator[slice]:
    a = size = 0
    for b, text in enumerate(texts):
        size += len(text)
        if size >= SLICE or b + 1 == len(texts):
            yield slice(a, b + 1)
            a, size = b + 1, 0


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(the patterns' spans, all spans) of each text."""
    out = []
    for some in _slices(texts):
        for text, spans in zip(texts[some], tagged(texts[some], tagger)):
            base = pattern_spans(text)
            out.append((base, _reconciled(base, {s for s in spans if _counts(text[s[1] : s[2]])})))
    return out


def _counts(found: str) -> bool:
    """Whether a span can name somebody: an address or a number of seven digits or more."""
    return "@" in found[1:-1] or len(_NOT_DIGIT.sub("", found)) >= 7


def _reconciled(base: list[Span], tagged: set[Span]) -> list[Span]:
    taken = sorted((a, b) for _, a, b in base)
    out, last, at = list(base), -1, 0
    for k, a, b in sorted(tagged, key=lambda s: (s[1], -s[2], s[0])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= last and not any(x < b and a < y for x, y in taken[at : at + 8]):
            out.append((k, a, b))
            last = b
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the patterns' counts and checksum, and all spans of each row's whole text."""
    model = trained()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_cs_text")
            for a in range(0, len(texts), 512):
                found = find([t.as_py() for t in texts.slice(a, 512)], model)
                columns = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
                columns.append(pa.array([sha256(spans_text(base).encode()).hexdigest() for base, _ in found], pa.string()))
                columns.append(pa.array([spans_text(every) for _, every in found], pa.string()))
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 512), *columns], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_cs_text")).mapInArrow(lean(run), schema)


@own_names_apart
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets, and n_chars, if there, as it is then."""
    model = trained()
    names = docs.columns

    def cut(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if b > at:
                out += [text[at : max(a, at)], f"<{KINDS[k]}>"]
                at = b
        return "".join(out) + text[at:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                column = batch.column(names.index("text"))
                texts = column.to_pylist()
                found = find([t or "" for t in texts], model)
                texts = [None if t is None else cut(t, every) for t, (_, every) in zip(texts, found)]
                yield batch.set_column(names.index("text"), batch.schema.field(names.index("text")), pa.array(texts, column.type))

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
