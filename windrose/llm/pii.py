"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The base patterns (email, ip, card, phone) are matched over the whole text, leftmost and without overlap per kind. The
model learns from windows around their spans, as they stand and rewritten as people write them when a pattern no longer
matches (dotted cards, phones without a plus, "(at)" and "dot" addresses), and from windows that hold no span. It is
fitted in numpy by Adam on the driver. The bound of the fit, and of nothing else: it sees at most SNIPPETS surroundings
of spans and as many others, chosen by a seeded hash among those of all documents whose hash falls to a sample of about
SAMPLE documents.

At prediction a window of WINDOW characters is read where it holds a mark that every kind needs: a digit, an at sign or
a spelled one. Windows follow each other at half their width. Where windows overlap, their tag scores are averaged, more
weight going to the one that sees more on either side, so each run of windows is one sequence, which Viterbi decodes as
a whole: a span of any length is found as one. Spans take in the rest of the runs of local-part characters or digits
that they end in. Those that overlap a base span or fail their kind's test (form, digits,
Luhn, parts up to 255) go, and of the rest the set without overlaps with the largest summed margin is kept. The tests of
form are wide, but the model alone doesn't decide: a span must be one that a person could read as its kind.

Defined results: null or empty text has no spans; very long texts are read whole; repeated rows get equal results; an
empty table gives no rows; other columns are ignored. Without any base span in the sample no spans are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frame, portions, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SNIPPETS, WINDOW, HIDDEN, EMBED, STEPS, BATCH, RATE, SEED, REWRITES = 6000, 1500, 96, 16, 12, 320, 96, 0.02, 5, 3
AT = r"(?:@|[\[(]\x20?at\x20?[\])]|\x20at\x20)"
DOT = r"(?:\.|[\[(]\x20?dot\x20?[\])]|\x20dot\x20)"
GATE = re.compile(r"[0-9@]|[\[(]\x20?at\x20?[\])]|\x20at\x20(?=[A-Za-z0-9-]+(?:\x20dot\x20|[\[(]\x20?dot))")
MIN_MARGIN = 2.0  # of the model's score with the span over that without it, for each span

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards, so that long words cost no more than short ones."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def passes(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if passes(KINDS[kind], m.group())]
    return sorted(out, key=lambda x: (x[0], x[2]))


# --- the model -------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside; first and inner character of each kind
CLASSES = 64


def char_classes() -> np.ndarray:
    """A class for each code point up to 255: one for all digits, one a letter whatever its case."""
    t = np.full(257, 1)
    for c in "0123456789":
        t[ord(c)] = 2
    for c in range(256):
        if chr(c).isalpha():
            t[c] = 12 + (ord(chr(c).lower()) - 97 if chr(c).lower() in "abcdefghijklmnopqrstuvwxyz" else 26)
    for i, c in enumerate("@.+-_%() \n\t,:;/[]|#'\"", 40):
        t[ord(c)] = min(i, CLASSES - 1)
    return t


CHARS = char_classes()


def codes(text: str) -> np.ndarray:
    return CHARS[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 256)].astype(np.int16)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    g = lambda *s: (rng.standard_normal(s) * (0.6 / np.sqrt(s[0]))).astype(np.float32)
    p = {"E": g(CLASSES, EMBED) * 2, "O": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        p |= {f"{d}W": g(EMBED, 4 * HIDDEN), f"{d}U": g(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
        p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1
    return p


def lstm(x: np.ndarray, W, U, b, keep: bool):
    """x: (time, batch, input). The hidden states and, if asked, what the backward pass needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    hs, saved = np.empty((steps, n, HIDDEN), np.float32), []
    pre = x @ W + b
    for t in range(steps):
        z = pre[t] + h @ U
        z[:, : 3 * HIDDEN] = sigmoid(z[:, : 3 * HIDDEN])
        z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((z, before, tc, h))
        h = o * tc
        hs[t] = h
    return hs, saved


def lstm_back(x, W, U, saved, dhs):
    dW, dU, db, dx = np.zeros_like(W), np.zeros_like(U), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(x)
    dh_next, dc = 0.0, 0.0
    for t in range(len(x) - 1, -1, -1):
        z, before, tc, h0 = saved[t]
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh = dhs[t] + dh_next
        dc = dh * o * (1 - tc * tc) + dc
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dW += x[t].T @ dz
        dU += h0.T @ dz
        db += dz.sum(0)
        dx[t], dh_next, dc = dz @ W.T, dz @ U.T, dc * f
    return dW, dU, db, dx


def emissions(p: dict, c: np.ndarray, keep: bool = False):
    """c: (batch, time) classes. Tag scores (time, batch, tag)."""
    x = p["E"][c.T]
    hf, sf = lstm(x, p["fW"], p["fU"], p["fb"], keep)
    hb, sb = lstm(x[::-1], p["bW"], p["bU"], p["bb"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ p["O"] + p["ob"], (x, h, sf, sb)


def crf_gradient(e: np.ndarray, T: np.ndarray, y: np.ndarray):
    """Negative log-likelihood of the tags y (time, batch), and its gradients by emissions and transitions."""
    steps, n, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    lse = lambda v: (m := v.max(1)) + np.log(np.exp(v - m[:, None]).sum(1))
    for t in range(1, steps):
        a[t] = e[t] + lse(a[t - 1][:, :, None] + T)
    for t in range(steps - 2, -1, -1):
        v = T[None] + (e[t + 1] + b[t + 1])[:, None, :]
        m = v.max(2)
        b[t] = m + np.log(np.exp(v - m[:, :, None]).sum(2))
    z = lse(a[-1])
    de = np.exp(a + b - z[None, :, None])
    dT = np.zeros_like(T)
    for t in range(1, steps):
        dT += np.exp(a[t - 1][:, :, None] + T + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    rows = np.arange(n)
    gold = np.zeros(n)
    for t in range(steps):
        de[t, rows, y[t]] -= 1
        gold += e[t, rows, y[t]]
        if t:
            np.add.at(dT, (y[t - 1], y[t]), -1)
            gold += T[y[t - 1], y[t]]
    return float((z - gold).sum()), de, dT


def viterbi(e: np.ndarray, T: np.ndarray) -> np.ndarray:
    steps, n, k = e.shape
    back = np.zeros((steps, n, k), np.int8)
    s = e[0]
    for t in range(1, steps):
        v = s[:, :, None] + T
        back[t] = v.argmax(1)
        s = v.max(1) + e[t]
    path = np.empty((steps, n), np.int64)
    path[-1] = s.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t][np.arange(n), path[t]]
    return path


def train(windows: np.ndarray, tags: np.ndarray, steps: int = STEPS) -> dict:
    rng = np.random.default_rng(SEED)
    p = init(rng)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    marked = np.flatnonzero((tags > 0).any(1))
    for step in range(1, steps + 1):  # half of a batch from windows with spans
        rows = np.concatenate([rng.choice(marked, BATCH // 2), rng.integers(0, len(windows), BATCH - BATCH // 2)])
        c, y = windows[rows], tags[rows].T
        e, (x, h, sf, sb) = emissions(p, c, keep=True)
        _, de, dT = crf_gradient(e, p["T"], y)
        de, dT = (de / len(rows)).astype(np.float32), dT / len(rows)
        g = {"T": dT, "O": np.einsum("tnh,tnk->hk", h, de), "ob": de.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dh = de @ p["O"].T
        g["fW"], g["fU"], g["fb"], dxf = lstm_back(x, p["fW"], p["fU"], sf, dh[:, :, :HIDDEN])
        g["bW"], g["bU"], g["bb"], dxb = lstm_back(x[::-1], p["bW"], p["bU"], sb, dh[::-1, :, HIDDEN:])
        np.add.at(g["E"], c.T, dxf + dxb[::-1])
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
        for k in p:
            q = g[k] * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def rewrite(kind: int, s: str, rng: np.random.Generator) -> str:
    """A span as it might be written when its base pattern no longer matches."""
    way = int(rng.integers(0, 3))
    if kind == 0:
        if rng.integers(0, 2):  # names of other lengths
            s = "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(1, 12)))) + s
        if rng.integers(0, 2):
            return s.replace("@", ("@ ", " @ ", "(at)")[way])
        local, _, domain = s.partition("@")
        return local + (" at ", " [at] ", "(at)")[way] + domain.replace(".", (" dot ", "[dot]", "(dot)")[way])
    if kind == 1:
        return s.replace(".", (" . ", "[.]", ". ")[way])
    d = digits_of(s)
    if kind == 2:
        return (".", "/", "_")[way].join(d[i : i + 4] for i in range(0, len(d), 4))
    return (f"({d[1:4]}) {d[4:7]}-{d[7:]}", f"00{d[:1]} {d[1:4]} {d[4:7]} {d[7:]}", f"{d[1:4]}.{d[4:7]}.{d[7:]}")[way]


def examples(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    windows, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]], middle: int) -> None:
        at = max(0, middle - int(rng.integers(10, WINDOW - 10)))
        c = np.zeros(WINDOW, np.int16)
        y = np.zeros(WINDOW, np.int64)
        own = codes(text[at : at + WINDOW])
        c[: len(own)] = own
        for s, e, k in spans:
            s, e = max(s - at, 0), min(e - at, WINDOW)
            if s < e:
                y[s:e] = 2 + 2 * k
                y[s] = 1 + 2 * k
        windows.append(c)
        tags.append(y)

    for text in texts:
        spans = base_spans(text)
        for s, e, k in spans:
            add(text, spans, (s + e) // 2)
            for _ in range(REWRITES):
                new = rewrite(k, text[s:e], rng)
                near = text[max(0, s - WINDOW) : s] + new + text[e : e + WINDOW]
                start = min(s, WINDOW)
                shifted = [(start, start + len(new), k)] + [x for x in base_spans(near) if x[1] <= start or x[0] >= start + len(new)]
                add(near, shifted, start + len(new) // 2)
        quiet = [m.start() for m in GATE.finditer(text) if not any(s <= m.start() < e for s, e, _ in spans)]
        for i in quiet[:: max(1, len(quiet) // 3)][:3]:
            add(text, spans, i)
        add(text, spans, int(rng.integers(0, max(len(text), 1))))
        # numbers that are nobody's: counts, years, sums
        number = ("%d" % rng.integers(1, 99999), "%d.%02d" % (rng.integers(1, 999), rng.integers(0, 99)), "%d-%d" % (rng.integers(1, 99), rng.integers(1900, 2100)))[int(rng.integers(0, 3))]
        cut = text.find(" ", int(rng.integers(0, max(len(text), 1)))) + 1
        altered = text[:cut][-WINDOW:] + number + " " + text[cut : cut + WINDOW]
        add(altered, base_spans(altered), min(cut, WINDOW))
    return np.array(windows), np.array(tags)


def snippets(text: str) -> list[tuple[str, bool]]:
    """What surrounds the spans of a text, spans close to each other together, and a window around up to three marks and
    one other place outside of them: (text, whether it holds a span)."""
    out, joint = [], []
    spans = base_spans(text)
    for s, e, _ in spans:
        lo, hi = max(0, s - 2 * WINDOW), min(len(text), e + 2 * WINDOW)
        if joint and lo <= joint[-1][1] and hi - joint[-1][0] < 8 * WINDOW:
            joint[-1][1] = max(hi, joint[-1][1])
        else:
            joint.append([lo, hi])
    out += [(text[lo:hi], True) for lo, hi in joint]
    quiet = [m.start() for m in GATE.finditer(text)]
    quiet = [i for i in quiet[:: max(1, len(quiet) // 6)] if not any(s - WINDOW <= i < e + WINDOW for s, e, _ in spans)][:3]
    middle = len(text) // 2
    if not any(s - WINDOW <= middle < e + WINDOW for s, e, _ in spans):
        quiet.append(middle)
    return out + [(text[max(0, i - 2 * WINDOW) : i + 2 * WINDOW], False) for i in quiet]


def in_sample(n: int) -> Column:
    """Whether a document is one of about SAMPLE of n that the fit may take surroundings from."""
    return F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000 * n < SAMPLE


def fit(docs: DataFrame) -> dict | None:
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    n = rows.count()

    def cutouts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, 0):
            found = [x for text in frame(b.column(0)) for x in snippets(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.bool_())], names=["text", "rich"])

    cut = rows.filter(in_sample(n)).select("text").mapInArrow(cutouts, "text string, rich boolean")
    first = lambda rich: sorted(r["text"] for r in cut.filter("rich" if rich else "not rich").orderBy(F.xxhash64("text", F.lit(17)), "text").limit(SNIPPETS).collect())
    texts = first(True)
    rng = np.random.default_rng(SEED)
    rich = [t for t in texts if base_spans(t)]
    if not rich:
        return None
    return train(*examples(rich + first(False), rng))


# --- prediction ------------------------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    half = WINDOW // 2
    slots = sorted({m.start() // half for m in GATE.finditer(text)})
    return sorted({max(0, s * half) for s in slots} | {(s - 1) * half for s in slots if s})


def best_set(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans without overlaps whose margins sum to most."""
    spans = sorted(spans, key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in spans]
    best, take = [0.0], []
    for i, x in enumerate(spans):
        j = int(np.searchsorted(ends[:i], x[0], "right"))
        take.append((best[j] + x[3] > best[i], j))
        best.append(max(best[i], best[j] + x[3]))
    out, i = [], len(spans)
    while i:
        yes, j = take[i - 1]
        if yes:
            out.append(spans[i - 1])
        i = j if yes else i - 1
    return out[::-1]


def runs_of(starts: list[int]) -> list[list[int]]:
    """Windows that overlap, one after another."""
    out: list[list[int]] = []
    for s in starts:
        if out and s - out[-1][-1] < WINDOW:
            out[-1].append(s)
        else:
            out.append([s])
    return out


SIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]


def tag_scores(texts: list[str], p: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, start, scores by character and tag) of every run of windows."""
    runs = [(i, run) for i, t in enumerate(texts) for run in runs_of(window_starts(t))]
    at = 0
    while at < len(runs):
        part, n = [], 0
        while at < len(runs) and (not part or n + len(runs[at][1]) <= 2048):
            part.append(runs[at])
            n += len(runs[at][1])
            at += 1
        c = np.zeros((n, WINDOW), np.int16)
        row = 0
        for i, run in part:
            for s in run:
                own = codes(texts[i][s : s + WINDOW])
                c[row, : len(own)] = own
                row += 1
        e = np.concatenate([emissions(p, c[k : k + 2048])[0].transpose(1, 0, 2) for k in range(0, n, 2048)]) * SIGHT
        row = 0
        for i, run in part:
            size = min(run[-1] + WINDOW, len(texts[i])) - run[0]
            total, weight = np.zeros((run[-1] + WINDOW - run[0], TAGS), np.float32), np.zeros((run[-1] + WINDOW - run[0], 1), np.float32)
            for s in run:
                total[s - run[0] : s - run[0] + WINDOW] += e[row]
                weight[s - run[0] : s - run[0] + WINDOW] += SIGHT
                row += 1
            yield i, run[0], total[:size] / weight[:size]


DIGITS = frozenset("0123456789")


def whole_runs(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    """The span with what belongs to the runs of characters that its ends lie in: an address doesn't begin within its
    local part, nor a number within its digits."""
    first, last = (LOCAL_CHARS, LOCAL_CHARS - {".", "_", "%", "+"}) if kind == 0 else (DIGITS, DIGITS)
    if s < e and text[s] in first:
        while s > 0 and text[s - 1] in first:
            s -= 1
    if s < e and text[e - 1] in last:
        while e < len(text) and text[e] in last:
            e += 1
    return s, e


def added_spans(texts: list[str], base: list[list], p: dict, tests: bool = True) -> list[list[tuple[int, int, int]]]:
    """tests: whether a span must pass its kind's test of form."""
    found: list[dict] = [{} for _ in texts]
    runs = sorted(tag_scores(texts, p), key=lambda x: len(x[2]))
    at = 0
    while at < len(runs):
        end = at + 1  # runs of similar lengths, decoded together
        while end < len(runs) and end - at < 512 and len(runs[end][2]) <= 1.25 * len(runs[at][2]) + 16:
            end += 1
        e = np.full((len(runs[end - 1][2]), end - at, TAGS), -1e6, np.float32)
        e[:, :, 0] = 0
        for row, (_, _, x) in enumerate(runs[at:end]):
            e[: len(x), row] = x
        path = viterbi(e, p["T"]).T
        for row in np.flatnonzero((path > 0).any(1)):
            i, s, x = runs[at + row]
            y, pos = path[row], 0
            while pos < len(x):
                if y[pos] == 0:
                    pos += 1
                    continue
                kind, stop = (y[pos] - 1) // 2, pos + 1
                while stop < len(x) and y[stop] == 2 + 2 * kind:
                    stop += 1
                margin = float((x[np.arange(pos, stop), y[pos:stop]] - x[pos:stop, 0]).sum())
                if margin >= MIN_MARGIN:
                    key = (s + pos, s + stop, int(kind))
                    found[i][key] = max(margin, found[i].get(key, 0.0))
                pos = stop
        at = end
    out = []
    for text, spans, f in zip(texts, base, found, strict=True):
        good = []
        edge = np.zeros(len(text) + 1 if f else 0, np.int32)
        if f and spans:
            np.add.at(edge, [x for x, _, _ in spans], 1)
            np.add.at(edge, [y for _, y, _ in spans], -1)
        taken = np.concatenate([[0], (edge.cumsum() > 0).cumsum()])  # characters of base spans before each place
        for (s, e, k), margin in f.items():
            got = text[s:e]
            s, e = whole_runs(text, s + len(got) - len(got.lstrip()), e - len(got) + len(got.rstrip()), k)
            if taken[s] == taken[e] and (not tests or plausible(k, text[s:e])):
                good.append((s, e, k, margin))
        out.append([(s, e, k) for s, e, k, _ in best_set(good)])
    return out


def plausible(kind: int, s: str) -> bool:
    d = digits_of(s)
    if kind == 0:
        return bool(re.fullmatch(rf"[A-Za-z0-9._%+-]+\s?{AT}\s?[A-Za-z0-9-]+(?:\s?{DOT}\s?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.split(r"\s*\[?\.\]?\s*", s)
        return len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and len(s) <= len(d) + 6
    return 9 <= len(d) <= 15 and len(s) <= len(d) + 8 and not s.isdigit()


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind), in code points; spans holds the base ones too."""
    span = "array<struct<start: long, end: long, kind: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in portions(it, 1):
            texts = frame(b.column(1))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, p) if p else [[] for _ in texts]
            every = [sorted(x + y, key=lambda v: (v[0], v[2])) for x, y in zip(base, more, strict=True)]
            cols = [pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in spans], kind) for spans in (base, every)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, f"doc_id long, base {span}, spans {span}")


def judged(docs: DataFrame, model: dict, tests: bool = True) -> DataFrame:
    """kind, n_base, n_model, n_equal, n_met: the model by itself, the patterns withheld from its spans, against the base spans of
    docs: how many there are, how many it finds, how many of these are a base span of the kind, and how many base spans meet one of
    its spans of the kind. tests: with its tests of form, or all that the network marks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(KINDS), 4), np.int64)
        for b in portions(it, 0):
            texts = frame(b.column(0))
            for base, own in zip(map(base_spans, texts), added_spans(texts, [[] for _ in texts], sent.value, tests), strict=True):
                for k in range(len(KINDS)):
                    x, y = [v for v in base if v[2] == k], [v for v in own if v[2] == k]
                    sums[k] += len(x), len(y), len(set(x) & set(y)), sum(any(s < e2 and s2 < e for s2, e2, _ in y) for s, e, _ in x)
        yield pa.RecordBatch.from_arrays([pa.array(KINDS), *(pa.array(c) for c in sums.T)], names=["kind", "n_base", "n_model", "n_equal", "n_met"])

    each = docs.select("text").mapInArrow(batches, "kind string, n_base long, n_model long, n_equal long, n_met long")
    return each.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n_base", "n_model", "n_equal", "n_met")])


def redact(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in portions(it, at):
            texts = frame(b.column(at))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, p) if p else [[] for _ in texts]
            out = []
            for t, whole, x, y in zip(texts, b.column(at).to_pylist(), base, more, strict=True):
                if whole is None:
                    out.append(None)
                    continue
                pieces, pos = [], 0
                for s, e, k in sorted(x + y, key=lambda v: (v[0], v[2])):
                    if e > pos:
                        pieces += [t[pos : max(s, pos)], f"<{KINDS[k]}>" if s >= pos else ""]
                        pos = e
                out.append("".join([*pieces, t[pos:]]))
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(batches, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find(docs, fit(docs)))
