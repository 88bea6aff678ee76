"""Secret scan: fixed patterns, and a character convolutional network over other candidates.

Candidates are runs of ``[A-Za-z0-9+/_.=-]`` of ``SHORTEST`` characters or more with a digit or a
letter, anywhere in the whole text, and what base findings leave of such runs.  The network reads
a candidate in windows of ``INSIDE`` characters and its context on both sides; the largest score
counts.  Its layers: character embedding, one convolution, max pooling, a dense layer.  It is trained in
numpy on findings of the patterns and synthetic secrets of many formats against runs known to be
clean (words, hosts, paths, short numbers), a bounded number of each, from a bounded sample of
documents, by hash.  Runs of unknown kind, which the network is asked about, are no examples.  Scores are calibrated by Platt
scaling on a held-out fifth, and the threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, lean, plainly
from .textkit import buffers

SHORTEST = 12
CONTEXT, INSIDE, STEP, BLOCK = 16, 40, 8, 1 << 14
KINDS = ("assign", "access", "hex", "cnn")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
TELLING = re.compile(r"[A-Za-z0-9]")
#: The patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINT = re.compile(rb"(?i)passw|secret|token|api_?key")


def base_spans(text: str, hint: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings, in code points."""
    out = []
    if hint:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def other_runs(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates: the parts of runs that no base finding covers."""
    out, first = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while first < len(spans) and spans[first][1] <= at:
            first += 1
        for x, y, _ in spans[first:]:
            if x >= end:
                break
            if x > at and TELLING.search(text, at, x):
                out.append((at, x))
            at = max(at, y)
        if at < end and TELLING.search(text, at, end):
            out.append((at, end))
    return out


#: Parts of runs known to be clean: short numbers, and words in one case or of capitalised words, with few digits behind.
PLAIN = re.compile(r"[0-9]{0,4}|(?:[A-Z]?[a-z]+|[A-Z]+|(?:[A-Z]?[a-z]{2,})(?:[A-Z][a-z]{2,})+)[0-9]{0,3}")
MARKS = "+/_.=-"
HARSH = re.compile(r"[b-df-hj-np-tv-xz]{7}", re.I)


def clean(run: str) -> bool:
    """Whether all parts of a run are words or short numbers: prose, hosts, paths, addresses, dates."""
    return not HARSH.search(run) and all(PLAIN.fullmatch(s) for s in re.split(r"[+/_.=-]+", run))


def synthetic(r: random.Random) -> str:
    """A secret of one of many formats."""
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    base62, base64 = lower + upper + digits, lower + upper + digits + "+/"
    some = lambda letters, n: "".join(r.choices(letters, k=n))
    return r.choice((
        lambda: r.choice(("ghp_", "gho_", "npm_", "hf_", "dop_v1_")) + some(base62, 36),
        lambda: r.choice(("sk_live_", "sk_test_", "rk_live_", "pk-", "sk-")) + some(base62, r.randint(20, 48)),
        lambda: f"xox{r.choice('bpa')}-{some(digits, 12)}-{some(digits, 12)}-{some(base62, 24)}",
        lambda: f"//hooks.slack.com/services/T{some(upper + digits, 8)}/B{some(upper + digits, 8)}/{some(base62, 24)}",
        lambda: "AIza" + some(base62 + "_-", 35),
        lambda: r.choice(("glpat-", "")) + some(base62 + "_-", 20),
        lambda: f"SG.{some(base62 + '_-', 22)}.{some(base62 + '_-', 43)}",
        lambda: f"eyJ{some(base62, 33)}.eyJ{some(base62, r.randint(30, 90))}.{some(base62 + '_-', 43)}",
        lambda: some(base64, r.choice((22, 43, 86))) + r.choice(("=", "==")),
        lambda: some(base64, r.randint(16, 64)),
        lambda: some(upper + "234567", r.choice((16, 26, 32))),
        lambda: some(lower + digits, r.randint(12, 40)),
        lambda: some(base62, r.randint(12, 40)),
        lambda: some(base62, r.randint(12, 15)),
        lambda: some(lower + digits, r.randint(12, 15)),
        lambda: some("0123456789ABCDEF", r.choice((16, 32, 40))),
    ))()


def window(text: str, a: int, b: int) -> str:
    """Context, the candidate's first characters, context: of one length for all candidates."""
    inside = text[a : min(b, a + INSIDE)]
    return (text[max(0, a - CONTEXT) : a].rjust(CONTEXT) + inside.ljust(INSIDE) + text[b : b + CONTEXT].ljust(CONTEXT))[: 2 * CONTEXT + INSIDE]


def windows(text: str, a: int, b: int) -> list[str]:
    """Windows over the whole candidate, the last up to its end; within it, context is its own characters."""
    starts = [*range(a, b - INSIDE, STEP), max(a, b - INSIDE)]
    return [window(text, x, min(b, x + INSIDE)) for x in starts]


def encode(windows: list[str]) -> np.ndarray:
    """Code points below 128 as they are, others as one symbol."""
    flat = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), -1)
    return np.minimum(flat, 128).astype(np.int64)


class CharCNN:
    """Embedding 8, convolution of width 5 with 24 filters, global max, logistic output."""

    WIDTH, DIM, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.3, (129, self.DIM))
        self.k = r.normal(0, 0.2, (self.WIDTH * self.DIM, self.FILTERS))
        self.kb = np.zeros(self.FILTERS)
        self.w, self.b = r.normal(0, 0.2, self.FILTERS), 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")  # at the threshold, on the held-out examples

    def _forward(self, x: np.ndarray):
        emb = self.e[x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.WIDTH, axis=1)
        cols = cols.transpose(0, 1, 3, 2).reshape(len(x), -1, self.WIDTH * self.DIM)
        pre = cols @ self.k + self.kb
        at = pre.argmax(1)
        top = np.take_along_axis(pre, at[:, None], 1)[:, 0]
        return cols, at, top, np.maximum(top, 0) @ self.w + self.b

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.15, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        for _ in range(max(epochs, -(-600 * 64 // len(x)))):  # 600 steps at least
            order = r.permutation(len(x))
            for a in range(0, len(x), 64):
                rows = order[a : a + 64]
                cols, at, top, z = self._forward(x[rows])
                g = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
                gt = g[:, None] * self.w * (top > 0)
                best = cols[np.arange(len(rows))[:, None], at]
                gk = np.einsum("nf,nfc->cf", gt, best)
                ge = (gt[:, :, None] * self.k.T[None]).reshape(len(rows), self.FILTERS, self.WIDTH, self.DIM)
                where = x[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(self.WIDTH)]
                self.w -= rate * (np.maximum(top, 0).T @ g)
                self.b -= rate * g.sum()
                self.k -= rate * gk
                self.kb -= rate * gt.sum(0)
                np.add.at(self.e, where, -rate * ge)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps ``recall``, whatever its precision."""
        z = self._forward(x)[3]
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
            q = p * (1 - p)
            h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        self.scale, self.shift = a, b
        scores = self.score(x)
        told = np.sort(scores[y > 0])
        self.threshold = float(told[int((1 - recall) * len(told))])
        hit = scores >= self.threshold
        self.recall, self.precision = float(hit[y > 0].mean()), float(y[hit].mean())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self._forward(x[a : a + 256])[3] for a in range(0, len(x), 256)])
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


_RUNNING = np.zeros(256, bool)
_RUNNING[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.=-")]] = True


def _hit(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents in which a pattern or a candidate can be: those with a long run or a hint."""
    docs = np.zeros(len(offsets), bool)
    step = 1 << 22
    for begin in range(0, len(data), step):  # with an overlap of the longest needed run
        part = _RUNNING[data[begin : begin + step + SHORTEST]]
        sums = np.cumsum(np.r_[0, part.astype(np.int32)])
        at = np.flatnonzero(sums[SHORTEST:] - sums[:-SHORTEST] == SHORTEST) + begin
        docs[np.searchsorted(offsets, at, side="right") - 1] = True
    return docs[:-1]


def _docs(batch: pa.RecordBatch):
    """(row, text, may hold an assignment) of the documents that need a look."""
    texts = batch.column("text")
    data, offsets = buffers(texts)
    docs = _hit(data, offsets)
    raw = memoryview(data)
    hints = np.zeros(len(texts), bool)
    for begin in range(0, len(data), 1 << 22):
        at = np.array([m.start() + begin for m in HINT.finditer(raw[begin : begin + (1 << 22) + 16])], np.int64)
        hints[np.searchsorted(offsets, at, side="right") - 1] = True
    for row in np.flatnonzero(docs | hints):
        yield row, str(raw[offsets[row] : offsets[row + 1]], "utf-8"), bool(hints[row])


def _order(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=7).digest(), "little")


def _examples(batches):
    """Labelled examples: (label, window, order); 1 for findings, 2 for clean runs with digits, 3 with capitals in a row, 0 for others."""
    for batch in batches:
        label, shown = [], []
        for _, text, hint in _docs(batch):
            spans = base_spans(text, hint)
            for a, b, kind in spans:
                value = a if kind else ASSIGN.match(text, a).start(2)
                shown += (many := windows(text, value, b))
                label += [1] * len(many)
            edges = {x for s in spans for x in s[:2]}
            for a, b in other_runs(text, spans):
                if clean(text[a:b]) and (a not in edges or text[a] in MARKS) and (b not in edges or text[b - 1] in MARKS):
                    shown += (many := windows(text, a, b))
                    label += [2 if re.search(r"[0-9]", text[a:b]) else 3 if re.search(r"[A-Z]{2}", text[a:b]) else 0] * len(many)
        order = [_order(w) for w in shown]
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(shown, pa.string()), pa.array(order, pa.int64())], names=["label", "window", "order"])


def train(docs: DataFrame, examples: int = 3000, recall: float = 0.99, sample: int = 20_000) -> CharCNN | None:
    """Fits the network on at most ``examples`` findings of the patterns, clean runs with digits, in
    capitals and others each, from at most ``sample`` documents by a hash of doc_id, and ``examples``
    synthetic secrets, which stand between the contexts of clean runs; None without clean runs."""
    learn = bounded_sample(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id"), sample, "doc_id").distinct()
    learn = docs.join(F.broadcast(learn), "doc_id", "left_semi")  # ``sample`` ids: a stated bound
    found = checkpoint(learn.select("text").mapInArrow(lean(_examples), "label int, window string, order long"))
    rows = [(r["label"] == 1, r["window"]) for kind in (0, 1, 2, 3) for r in bounded_sample(found.where(F.col("label") == kind), examples, "order", "window").collect()]
    around = [w for told, w in rows if not told]
    if not around:
        return None
    r = random.Random(13)
    for _ in range(examples):
        secret, w = synthetic(r), r.choice(around)
        rows += [(True, v) for v in windows(w[:CONTEXT] + secret + w[-CONTEXT:], CONTEXT, CONTEXT + len(secret))]
    y = np.array([told for told, _ in rows], float)
    x = encode([w for _, w in rows])
    held = np.array([_order(w) % 5 == 0 for _, w in rows])
    if not (y[held].any() and (1 - y[held]).any() and y[~held].any()):
        held = np.zeros(len(y), bool)
    model = CharCNN()
    model.fit(x[~held], y[~held])
    model.calibrate(x[held] if held.any() else x, y[held] if held.any() else y, recall)
    return model


def _find(batch: pa.RecordBatch, model: CharCNN | None):
    """(base spans by row, further spans by row, texts of the rows looked at)."""
    base: list[list] = [[] for _ in range(batch.num_rows)]
    more: list[list] = [[] for _ in range(batch.num_rows)]
    texts: dict[int, str] = {}
    asked: list[tuple[int, int, int]] = []
    shown: list[str] = []

    def judge() -> None:
        best: dict[tuple[int, int, int], float] = {}
        for key, p in zip(asked, model.score(encode(shown)), strict=True):
            best[key] = max(best.get(key, 0.0), p)
        for (row, a, b), p in best.items():
            if p >= model.threshold and (a, b, 3) not in more[row][-1:]:
                more[row].append((a, b, 3))
        asked.clear()
        shown.clear()

    for row, text, hint in _docs(batch):
        row = int(row)
        base[row] = base_spans(text, hint)
        for a, b in other_runs(text, base[row]) if model is not None else ():
            for w in windows(text, a, b):
                asked.append((row, a, b))
                shown.append(w)
                if len(shown) == BLOCK:
                    judge()
        texts[row] = text
    if shown:
        judge()
    return base, more, texts


def _scan(model: CharCNN | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            base, more, _ = _find(batch, model)
            said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))
            columns = [pa.array([sum(s[2] == k for s in base[i]) for i in range(n)], pa.int64()) for k in range(3)]
            columns.append(pa.array([hashlib.sha256(said(base[i]).encode()).hexdigest() for i in range(n)], pa.string()))
            columns.append(pa.array([said(base[i] + more[i]) for i in range(n)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def _mask(model: CharCNN | None, mask: str):
    def run(batches):
        for batch in batches:
            base, more, texts = _find(batch, model)
            column, sizes = batch.column("text").to_pylist(), None
            if "n_chars" in batch.schema.names:
                sizes = batch.column("n_chars").to_pylist()
            for i, text in texts.items():
                if base[i] or more[i]:
                    column[i] = cut(text, base[i] + more[i], mask)
                    if sizes is not None:
                        sizes[i] = len(column[i])
            new = {"text": pa.array(column, batch.schema.field("text").type)}
            if sizes is not None:
                new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def cut(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each stretch that spans cover replaced by ``mask``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a > at or not out:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def secret_scan(docs: DataFrame, model: CharCNN | None = None, examples: int = 3000) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, by start, then kind (assign, access, hex, cnn).  Null
    and empty texts have no spans.  A null doc_id stays null; other columns are ignored.
    ``model`` None trains one on these documents; where there are no clean runs to train on, the
    patterns alone speak.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, examples) if model is None else model
    return docs.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def secret_scan_in_place(docs: DataFrame, model: CharCNN | None = None, mask: str = "<SECRET>", examples: int = 3000) -> DataFrame:
    """``docs`` with all its columns; each stretch of text that spans cover is replaced by ``mask``.

    n_chars, if there is such a column, follows the texts that change.  Null texts stay null; other
    columns stay as they are, whatever their names."""
    model = train(docs.select("doc_id", "text"), examples) if model is None else model
    plain = plainly(docs)
    return plain.mapInArrow(lean(_mask(model, mask)), plain.schema).toDF(*docs.columns)
