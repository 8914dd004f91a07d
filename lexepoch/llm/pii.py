"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds spans they miss.

The network is trained in numpy on windows of a bounded sample of documents, labelled with the spans of the base
patterns. All four kinds hold a digit or an @, so windows of WIDTH characters are laid over every stretch of text
near such a character, half overlapping; each window is decoded by the CRF, and a character takes its label from the
window in which it lies nearest to the middle. Spans are then read from the labels of the whole stretch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, text_of

KINDS = ("email", "ip", "card", "phone")
#: Bounds on what the network is trained on.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 6000
WIDTH, HIDDEN, TAGS, CODES = 64, 16, 1 + 2 * len(KINDS), 129

# -- base patterns (fixed values) -------------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins within a run of digits that the one before it left, so the look-behind and the possessive runs
# change no match and keep the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: from each @, back over local characters to the last match at most."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            low = found.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every base span, by start then kind; code points, end exclusive."""
    if not _CUE.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# -- windows ----------------------------------------------------------------------------------------------------------
def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of text within half a window of a digit or an @, merged."""
    out: list[list[int]] = []
    half = WIDTH // 2
    for m in _CUE.finditer(text):
        a, b = max(0, m.start() - half), min(len(text), m.start() + half)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[int]:
    """Starts of windows over a stretch: every half width, the last one so that it reaches the end."""
    starts = list(range(a, max(a + 1, b - WIDTH + 1), WIDTH // 2))
    if starts[-1] + WIDTH < b:
        starts.append(b - WIDTH)
    return starts


def codes(text: str) -> np.ndarray:
    """A code per character: ASCII as it is (0 pads), any other 128; padded to a window."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(WIDTH, np.int16)
    out[:len(raw)] = np.minimum(raw, 128)
    return out


def tags_of(spans: list[tuple[int, int, int]], at: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int8)
    for a, b, k in spans:
        lo, hi = max(a, at) - at, min(b, at + WIDTH) - at
        if lo < hi:
            out[lo:hi] = 2 + 2 * k
            if a >= at:
                out[lo] = 1 + 2 * k
    return out


# -- the network ------------------------------------------------------------------------------------------------------
@dataclass
class Tagger:
    """Two LSTMs of HIDDEN units over character codes, a linear layer and CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (CODES, 4 * h))
            p[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h))
            p[f"c{d}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        p["o"] = rng.normal(0, 0.3, (2 * h, TAGS))
        p["ob"] = np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction over x (steps, batch); gates i, f, o, g lie side by side."""
        h, p = HIDDEN, self.p
        steps, n = x.shape
        hs, saved = np.zeros((steps, n, h), np.float32), []
        hidden, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        table = p[f"x{d}"] + p[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + hidden @ p[f"u{d}"]
            gate = 1 / (1 + np.exp(-np.clip(z[:, :3 * h], -30, 30)))
            g = np.tanh(z[:, 3 * h:])
            before, last = cell, hidden
            cell = gate[:, h:2 * h] * cell + gate[:, :h] * g
            bent = np.tanh(cell)
            hidden = gate[:, 2 * h:] * bent
            hs[t] = hidden
            if keep:
                saved.append((t, gate, g, before, last, bent))
        return hs, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["o"] + self.p["ob"], (both, sf, sb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (steps, batch) by Viterbi."""
        e, _ = self.emissions(x)
        steps, n, k = e.shape
        score, back = e[0], np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            paths = score[:, :, None] + self.p["t"]
            back[t] = paths.argmax(1)
            score = paths.max(1) + e[t]
        out = np.zeros((steps, n), np.int8)
        out[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t][np.arange(n), out[t]]
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (steps, batch) and its gradient by back-propagation through time."""
        e, (both, sf, sb) = self.emissions(x, True)
        e = e.astype(np.float64)
        trans = self.p["t"].astype(np.float64)
        steps, n, k = e.shape

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        gold = e[0, rows, y[0]].sum()
        dt = np.zeros((k, k))
        for t in range(1, steps):
            gold += (e[t, rows, y[t]] + trans[y[t - 1], y[t]]).sum()
            dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dt, (y[t - 1], y[t]), -1.0)
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        de = (de / n).astype(np.float32)
        grad = {"t": (dt / n).astype(np.float32), "ob": de.sum((0, 1)),
                "o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k)}
        dh = de @ self.p["o"].T
        for d, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            grad |= self._back(x, d, saved, part)
        return float((z.sum() - gold) / n), grad

    def _back(self, x: np.ndarray, d: str, saved: list, dh: np.ndarray) -> dict[str, np.ndarray]:
        h, u = HIDDEN, self.p[f"u{d}"]
        gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
        gc = np.zeros(4 * h, np.float32)
        carry_h, carry_c = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        for t, gate, g, before, last, bent in reversed(saved):
            i, f, o = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:]
            total = dh[t] + carry_h
            dc = carry_c + total * o * (1 - bent * bent)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), total * bent * o * (1 - o), dc * i * (1 - g * g)], 1)
            carry_c = dc * f
            carry_h = dz @ u.T
            gu += last.T @ dz
            gc += dz.sum(0)
            np.add.at(gx, x[t], dz)
        return {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}


def train(x: np.ndarray, y: np.ndarray, steps: int = 220, batch: int = 64, rate: float = 0.02, seed: int = 9) -> Tagger:
    """Adam over batches of windows (rows of x codes, y tags); half of each batch comes from windows with a span."""
    net, rng = Tagger.fresh(), np.random.default_rng(seed)
    if not len(x):
        return net
    some, none = np.flatnonzero((y > 0).any(1)), np.flatnonzero(~(y > 0).any(1))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, batch // 2) for p in (some, none) if len(p)])
        _, grad = net.loss_and_gradient(x[pick].T.astype(np.int64), y[pick].T.astype(np.int64))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


# -- spans of the network ---------------------------------------------------------------------------------------------
def _plausible(kind: int, s: str) -> bool:
    """The least a span of the kind must hold, whatever the network says."""
    digits = len(_DIGIT.findall(s))
    if kind == 0:
        return 0 < s.find("@") < len(s) - 1
    if kind == 1:
        return s.count(".") == 3 and digits >= 4 and all(p.isdigit() for p in s.split("."))
    if kind == 2:
        return 12 <= digits <= 19 and all(c in "0123456789 -" for c in s)
    return 9 <= digits <= 15 and not any(c.isalpha() for c in s)


def read_spans(text: str, at: int, tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(tags):
        if tags[i] == 0:
            i += 1
            continue
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        if tags[i] == 1 + 2 * kind and _plausible(kind, text[at + i:at + j]):
            out.append((at + i, at + j, kind))
        i = j
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], net: Tagger, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans the network finds in each text that touch no base span."""
    plans = [(i, a, b, s) for i, t in enumerate(texts) for a, b in stretches(t) for s in windows(a, b)]
    tags = np.zeros((len(plans), WIDTH), np.int8)
    for lo in range(0, len(plans), batch):
        some = plans[lo:lo + batch]
        x = np.array([codes(texts[i][s:min(b, s + WIDTH)]) for i, a, b, s in some], np.int64)
        tags[lo:lo + len(some)] = net.decode(x.T).T
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    row, at = 0, [0] * len(texts)
    while row < len(plans):
        i, a, b, _ = plans[row]
        end = row
        while end < len(plans) and plans[end][:3] == (i, a, b):
            end += 1
        merged, near = np.zeros(b - a, np.int8), np.full(b - a, WIDTH)
        for r in range(row, end):
            lo = plans[r][3] - a
            n = min(WIDTH, b - a - lo)
            far = np.abs(np.arange(n) - (WIDTH - 1) / 2)
            closer = far < near[lo:lo + n]
            merged[lo:lo + n][closer] = tags[r][:n][closer]
            near = near.astype(float)
            near[lo:lo + n][closer] = far[closer]
        found, own = read_spans(texts[i], a, merged), base[i]
        while at[i] < len(own) and own[at[i]][1] <= a:
            at[i] += 1
        k = at[i]
        for s in found:
            while k < len(own) and own[k][1] <= s[0]:
                k += 1
            # Base spans of several kinds can overlap, so those that begin before the end of this one are looked at.
            j, free = k, True
            while free and j < len(own) and own[j][0] < s[1]:
                free, j = own[j][1] <= s[0], j + 1
            if free:
                out[i].append(s)
        row = end
    return out


# -- the operator -----------------------------------------------------------------------------------------------------
def _window_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        x, y = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for a, b in stretches(text):
                for s in windows(a, b):
                    x.append(codes(text[s:min(b, s + WIDTH)]).tobytes())
                    y.append(tags_of(spans, s).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])


def training_texts(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text): the distinct texts with digits or @ that have the ``most`` smallest hashes, however often each occurs."""
    near = docs.select(text_of().alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    top = near.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return near.where(F.col("h") <= F.lit(top)).select("text").distinct()


def fit(docs: DataFrame) -> Tagger:
    """Train on at most TRAIN_WINDOWS windows of at most TRAIN_DOCS distinct texts, those with the smallest hash."""
    ship(docs.sparkSession)
    sample = training_texts(docs)
    found = (sample.repartition(4).mapInArrow(_window_batches, "x binary, y binary")
             .distinct().orderBy(F.xxhash64("x"), "x", "y").limit(TRAIN_WINDOWS).collect())
    x = np.array([np.frombuffer(r.x, np.int16) for r in found]).reshape(-1, WIDTH)
    y = np.array([np.frombuffer(r.y, np.int8) for r in found]).reshape(-1, WIDTH)
    return train(x, y)


def _span_batches(batches: Iterator[pa.RecordBatch], net: Tagger):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        more: list[list[tuple[int, int, int]]] = []
        for lo in range(0, len(texts), 256):
            more += added_spans(texts[lo:lo + 256], base[lo:lo + 256], net)
        counts = [[sum(k == kind for _, _, k in b) for b in base] for kind in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
             pa.array([joined(sorted(b + m, key=lambda s: (s[0], s[2]))) for b, m in zip(base, more)], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_pii(docs: DataFrame, net: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row's whole text.

    Counts and digest are of the base spans; spans has those and what the network adds. Null and empty texts have
    none; repeated rows are read each; texts without digits and @ are not decoded, as no kind can be in them. An
    empty table trains nothing and gives no rows.
    """
    net = net or fit(docs)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        lambda bs: _span_batches(bs, sent.value), f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, net: Tagger | None = None) -> DataFrame:
    """docs with each span of column text replaced by its kind in brackets; all rows and columns are kept."""
    net = net or fit(docs)
    ship(docs.sparkSession)
    sent, column = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def batches(bs: Iterator[pa.RecordBatch]):
        for batch in bs:
            texts = batch.column(column).to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            out = []
            for t, full, b, m in zip(texts, plain, base, added_spans(plain, base, sent.value)):
                parts, at = [], 0
                for x, y, k in sorted(b + m, key=lambda s: (s[0], -s[1])):
                    if x >= at:
                        parts += [full[at:x], f"[{KINDS[k]}]"]
                    at = max(at, y)
                out.append(None if t is None else "".join([*parts, full[at:]]))
            cols = [pa.array(out, pa.string()) if i == column else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(batches, docs.schema)
