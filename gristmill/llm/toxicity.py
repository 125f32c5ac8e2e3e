"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks."""

from __future__ import annotations

import re
import zlib
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kind

#: The kernel: subsequences of 4 letters that span at most 7 characters, each weighed by DECAY per character skipped.
SPAN, DECAY = 7, 0.7
GAPS = [(a, b, c, DECAY ** (c - 3)) for a, b, c in combinations(range(1, SPAN), 3)]
#: A window has so many starting positions of subsequences.
WIDTH = 10
N_CODES = 1 << 20


def _letters() -> np.ndarray:
    """Codes of Latin-1 characters: 1 to 26 for letters, 27 to 31 for accented ones by kind, 0 for all else."""
    table = np.zeros(256, np.int32)
    for k in range(26):
        table[ord("a") + k] = k + 1
    for code, group in ((27, "é"), (28, "èêë"), (29, "àáâãäåæ"), (30, "òóôõöø"), (31, "ùúûüßñçìíîïýÿ")):
        for c in group:
            table[ord(c)] = code
    return table


_TABLE = _letters()
_OTHERS: list[np.ndarray] = []


def _beyond(codes: np.ndarray) -> np.ndarray:
    """Letter codes of characters beyond Latin-1: letters of any script are spread over the 31 codes, all else is 0."""
    if not _OTHERS:
        spread = 1 + (np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(31)
        _OTHERS.append(np.where([chr(c).isalpha() for c in range(1 << 16)], spread, 0).astype(np.int32))
    low = _OTHERS[0][np.minimum(codes, 0xFFFF)]
    return np.where(codes <= 0xFFFF, low, np.where(codes >= 0x20000, 1 + codes.astype(np.int64) % 31, 0)).astype(np.int32)


def _plain(text: str) -> np.ndarray:
    """A letter code for each character of a lower-case text."""
    try:
        return _TABLE[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        return np.where(codes < 256, _TABLE[np.minimum(codes, 255)], _beyond(codes))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, with SPAN + WIDTH zeros after each, and each text's start."""
    x, starts, places = _encoded(texts)
    return x, places[starts]


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes, each text's start before, and for each position before its place in the codes.

    A sign or space between two letters that stand alone is left out: s.p.e.l.l.e.d words are words.
    """
    gap, parts, starts, at = np.zeros(SPAN + WIDTH, np.int32), [], [], 0
    for t in texts:
        data = _plain((t or "").lower())
        starts.append(at)
        at += len(data) + len(gap)
        parts += (data, gap)
    x = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    letter = np.concatenate(([False, False], x > 0, [False, False]))
    alone = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    keep = ~(~letter[2:-2] & alone[:-2] & alone[2:])
    places = np.cumsum(keep) - keep
    return x[keep], np.array(starts, np.int64), places


def _codes(x: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    n = len(x) - SPAN + 1
    return (x[:n] << 15) | (x[a : a + n] << 10) | (x[b : b + n] << 5) | x[c : c + n]


def window_scores(x: np.ndarray, weights: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The linear decision value, without its constant, of the window that starts at each position of x."""
    f = np.zeros(len(x), np.float32)
    for at in range(0, len(x) - SPAN + 1, block):
        part = x[at : at + block + SPAN - 1]
        own = f[at : at + len(part) - SPAN + 1]
        for a, b, c, w in GAPS:
            own += weights[_codes(part, a, b, c)] * np.float32(w)
    cum = np.concatenate(([0.0], np.cumsum(f, dtype=np.float64)))
    return cum[np.minimum(np.arange(len(x)) + WIDTH, len(x))] - cum[:-1]


def best_windows(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the highest window score; with the codes of all texts and the best window's place in them."""
    x, starts = encode(texts)
    s = window_scores(x, weights)
    top = np.maximum.reduceat(s, starts)
    ends = np.append(starts[1:], len(x))
    return top, x, np.array([a + int(np.argmax(s[a:b])) for a, b in zip(starts, ends)])


def rarity(x: np.ndarray) -> np.ndarray:
    """A weight for each subsequence: those that clean texts (letter codes x) have often count little in the kernel."""
    counts = np.zeros(N_CODES, np.int64)
    for at in range(0, len(x) - SPAN + 1, 1 << 22):
        part = x[at : at + (1 << 22) + SPAN - 1]
        for a, b, c, _ in GAPS:
            counts += np.bincount(_codes(part, a, b, c), minlength=N_CODES)
    return (1 / np.sqrt(1 + counts)).astype(np.float32)


def _features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the subsequences of one window; those with a non-letter count nothing."""
    codes = np.concatenate([_codes(x, a, b, c) for a, b, c, _ in GAPS])
    weights = np.repeat([w for *_, w in GAPS], len(x) - SPAN + 1)
    ok = np.minimum.reduce([codes & 31, codes >> 5 & 31, codes >> 10 & 31, codes >> 15]) > 0
    return codes[ok], weights[ok]


class Landmarks:
    """Landmark windows, the explicit subsequence features they have, each weighed by its rarity, and K^(-1/2)."""

    def __init__(self, windows: list[np.ndarray], rare: np.ndarray, ridge: float = 1e-3):
        self.rare, found = rare, [_features(w) for w in windows]
        self.codes = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, np.int32)]))
        self.phi = self._matrix(found)
        norm = np.sqrt((self.phi**2).sum(axis=1, keepdims=True))
        self.phi = (self.phi / np.maximum(norm, 1e-6)).astype(np.float32)
        value, vector = np.linalg.eigh((self.phi @ self.phi.T).astype(np.float64))
        self.root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0) + ridge)) @ vector.T

    def _matrix(self, found: list) -> np.ndarray:
        out = np.zeros((len(found), len(self.codes)), np.float32)
        if not len(self.codes):  # no landmark has a letter
            return out
        for row, (codes, weights) in zip(out, found):
            at = np.searchsorted(self.codes, codes)
            at[at == len(self.codes)] = 0
            ok = self.codes[at] == codes
            np.add.at(row, at[ok], weights[ok] * self.rare[codes[ok]])
        return out

    def map(self, windows: list[np.ndarray]) -> np.ndarray:
        """Nyström features: kernel values with the landmarks times K^(-1/2)."""
        parts = [self._matrix([_features(w) for w in windows[k : k + 256]]) @ self.phi.T for k in range(0, len(windows), 256)]
        return np.concatenate(parts) @ self.root

    def table(self, w: np.ndarray) -> np.ndarray:
        """The decision as one weight per subsequence: sum over windows of a linear function of the same kernel values."""
        out = np.zeros(N_CODES, np.float32)
        out[self.codes] = self.rare[self.codes] * (self.phi.T @ (self.root @ w))
        return out


def svm(z: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps; both classes weigh the same. y is -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    reg = np.ones(x.shape[1])
    reg[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs = x[on] * share[on, None]
        new = np.linalg.solve(np.diag(reg) + 2 * xs.T @ x[on], 2 * xs.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(v: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and constant of a logistic curve through (v, y), by guarded Newton steps on standardised values with smoothed targets."""
    mean, spread = float(v.mean()), float(v.std()) or 1.0
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([(v - mean) / spread, np.ones_like(v)], axis=1), np.zeros(2)

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, x @ w) - t * (x @ w)).sum() + ridge / 2 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step, scale = np.linalg.solve(h, x.T @ (p - t) + ridge * w), 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-6:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    slope = max(w[0], 1e-3) / spread
    return float(slope), float(w[1] - slope * mean)


def _markers(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Words that toxic texts have far more often than others."""
    seen: dict[str, list[int]] = {}
    for t, label in zip(texts, y):
        for w in set(re.findall(r"[^\W\d_]{4,}", t.lower())):
            seen.setdefault(w, [0, 0])[label] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    least = max(3, n1 // 100)
    return {w: p / n1 for w, (n, p) in seen.items() if p >= least and p / n1 > 8 * (n + 0.5) / n0}


def _window(x: np.ndarray, at: int) -> np.ndarray:
    return x[max(0, at) : max(0, at) + WIDTH + SPAN - 1]


def fit(texts: list[str], labels: list[int], landmarks: int = 256, rounds: int = 3, seed: int = 5) -> bytes:
    """A model from texts with labels 0 and 1, as bytes.

    Labels are of whole texts, so the toxic sentence in each is learned too (multiple-instance SVM): at first the
    sentence window around a word that marks toxic texts, then the window the model finds worst. Clean texts give
    random windows and the worst ones found. Three of four texts train the SVM, the fourth the curve from the worst
    window's value to a score. Without both labels the model is a constant.
    """
    y, rng = np.array(labels, int), np.random.default_rng(seed)
    order = rng.permutation(len(y))
    learn, curve = order[len(order) // 4 :], order[: len(order) // 4]
    if len(set(y[learn])) < 2:
        return _packed(np.zeros(N_CODES, np.float32), 0.0, -3.0)
    train, ty = [texts[k] for k in learn], y[learn]
    marks = _markers(train, ty)
    x, starts, places = _encoded(train)
    found, clean = [], []
    for k, t in enumerate(train):
        low = t.lower()
        if ty[k]:
            hits = [(-marks[w], m.start()) for m in re.finditer(r"[^\W\d_]{4,}", low) if (w := m[0]) in marks]
            if hits:
                found.append(_window(x, places[starts[k] + min(hits)[1]] - 2))
        elif t:
            clean += [_window(x, places[starts[k] + int(p)]) for p in rng.integers(0, len(t), 1)]
    if not found:  # no word stands out: begin with random windows of toxic texts
        found = [_window(x, places[starts[k] + int(p)]) for k, t in enumerate(train) if ty[k] and t for p in rng.integers(0, len(t), 3)]
    if not found or not clean:
        return _packed(np.zeros(N_CODES, np.float32), 0.0, -3.0)
    rare, weights = rarity(encode([t for t, label in zip(train, ty) if not label])[0]), np.zeros(N_CODES, np.float32)
    for turn in range(rounds):
        pick = lambda rows, n: [rows[k] for k in rng.permutation(len(rows))[:n]]
        marks_of = Landmarks(pick(found, landmarks * 3 // 4) + pick(clean, landmarks // 4), rare)
        z = marks_of.map(found + clean)
        w, b = svm(z, np.array([1.0] * len(found) + [-1.0] * len(clean)))
        weights = marks_of.table(w)
        if turn < rounds - 1:
            top, x, at = best_windows(train, weights)
            found = [_window(x, p) for p, v, label in zip(at, top, ty) if label and v + b > 0] or found
            clean += [_window(x, p) for p, v, label in zip(at, top, ty) if not label and v + b > -1]
    held = curve if len(set(y[curve])) == 2 else order
    slope, constant = _logistic(best_windows([texts[k] for k in held], weights)[0], y[held].astype(float))
    return _packed(weights, slope, constant)


def _packed(weights: np.ndarray, slope: float, constant: float) -> bytes:
    return zlib.compress(np.array([slope, constant], "<f8").tobytes() + weights.astype("<f4").tobytes(), 1)


def unpacked(model: bytes) -> tuple[np.ndarray, float, float]:
    data = zlib.decompress(model)
    slope, constant = np.frombuffer(data[:16], "<f8")
    return np.frombuffer(data[16:], "<f4"), float(slope), float(constant)


#: Texts are scored in runs of about so many characters; longer ones in parts that overlap by more than a window.
RUN, OVERLAP = 1 << 20, 128


def score(texts: list[str], model: tuple[np.ndarray, float, float]) -> np.ndarray:
    weights, slope, constant = model
    best, held, owners, size = np.full(len(texts), -np.inf), [], [], 0

    def flush():
        x, starts = encode(held)
        np.maximum.at(best, np.array(owners), np.maximum.reduceat(window_scores(x, weights), starts))

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t or "")), RUN):
            held.append((t or "")[at : at + RUN + OVERLAP])
            owners.append(k)
            size += len(held[-1])
            if size >= RUN:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return 1 / (1 + np.exp(-np.clip(slope * best + constant, -30, 30)))


def _fit_batches(batches, landmarks: int, most_chars: int):
    texts, labels, held = [], [], 0
    for b in batches:  # rows come in the order of their ids' hash
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held < most_chars:
                texts.append(text or "")
                labels.append(label)
                held += len(text or "")
    order = sorted(range(len(texts)), key=lambda k: (zlib.crc32(texts[k].encode()), texts[k]))
    yield pa.RecordBatch.from_arrays([pa.array([fit([texts[k] for k in order], [labels[k] for k in order], landmarks)], pa.binary())], names=["model"])


def _score_batches(batches, model: bytes):
    unpack = unpacked(model)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist(), unpack))], names=["doc_id", "score"])


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 3000, landmarks: int = 256, most_chars: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """Fit on a bounded sample of labelled rows: at most most_toxic and most_clean of them, the first by a hash of their
    ids, and of these the first until their whole texts have most_chars characters.

    Rows without a label or a document are left out; a repeated label row counts once, and so does a repeated id among the
    documents, by the longest of its texts. Columns other than those named don't matter. The sample goes to one task, which
    needs about 30 bytes a character for it, and
    the model (a few MB at most) to the driver. Ids may have any type; if the two tables' types differ, and one is no
    integer, they are compared as text. Without rows of both labels, all texts get one low score.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    as_id = "long" if {kind(labels, id_col), kind(docs, id_col)} <= whole else "string"
    rows = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast(as_id).alias("_gm_id")).agg(F.max(F.col(label_col).cast("int")).alias("_gm_label"))
    key = F.xxhash64("_gm_id", F.lit(3))
    parts = [rows.where(c).orderBy(key, "_gm_id").limit(n) for c, n in ((F.col("_gm_label") > 0, most_toxic), (F.col("_gm_label") <= 0, most_clean))]
    chosen = parts[0].unionByName(parts[1])
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast(as_id).alias("_gm_id"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(chosen), "_gm_id").groupBy("_gm_id", "_gm_label").agg(F.max_by("text", F.char_length(F.coalesce("text", F.lit("")))).alias("text"))
    texts = own.select("text", F.when(F.col("_gm_label") > 0, 1).otherwise(0).alias("label"), key.alias("_gm_key"))
    texts = texts.repartition(1).sortWithinPartitions("_gm_key").select("text", "label")
    found = texts.mapInArrow(partial(_fit_batches, landmarks=landmarks, most_chars=most_chars), "model binary").first()
    return bytes(found["model"]) if found else fit([], [])


def toxicity_scores(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row: the worst window of the whole text.

    Null and empty texts are scored as texts without letters. Letters of scripts other than Latin share the kernel's 31
    codes, so such words are told apart less well. Ids keep their type; repeated rows each have a row.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_score_batches, model=model), f"doc_id {kind(docs, id_col)}, score double")
