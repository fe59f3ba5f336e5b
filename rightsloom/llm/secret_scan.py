"""Secret scans: candidates by rules, each judged by a character convolutional network with its context."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small

# Fixed values of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")

#: Runs of key characters that the network judges where the base finds nothing: from this length on, with letters and
#: digits, or with letters of both cases in a part without signs that is as long.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT, _LETTER, _MIXED = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("(?=[A-Za-z]{16})(?=[A-Z]*[a-z]+[A-Z])[A-Za-z]+")
_NAMES = ("passw", "secret", "token", "api_key", "apikey")

# ---- candidates


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules. A hex run of 24 lies within a run of key characters."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    for a, b in runs:
        if b - a >= MIN_HEX:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and further runs that overlap none of them."""
    runs = [m.span() for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    more, i, end = [], 0, 0
    for a, b in runs:  # both lists go by their starts, so one pass tells what overlaps
        while i < len(base) and base[i][0] < b:
            end = max(end, base[i][2])
            i += 1
        if end > a:
            continue
        s = text[a:b]
        if (_DIGIT.search(s) and _LETTER.search(s)) or _MIXED.search(s):
            more.append((a, 3, b))
    return base, more


# ---- network

LEFT, INSIDE, RIGHT = 24, 48, 12
LENGTH = LEFT + INSIDE + RIGHT
#: Characters: 0 none, 1..128 ASCII, 129 any other; the inside of a span is a second set of them.
VOCAB = 2 * 130
WIDTH, DIM, FILTERS = 5, 12, 32


def windows(spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Codes of each span (of a longer one the first characters, see views) with its context, padded to one length."""
    out = np.zeros((len(spans), LENGTH), np.int16)
    for row, (text, a, b) in zip(out, spans, strict=True):
        left, inside, right = text[max(0, a - LEFT) : a], text[a : min(b, a + INSIDE)], text[b : b + RIGHT]
        code = [min(ord(c), 128) + 1 for c in left + inside + right]
        code[len(left) : len(left) + len(inside)] = [c + 130 for c in code[len(left) : len(left) + len(inside)]]
        at = LEFT - len(left)
        row[at : at + len(left) + len(inside)] = code[: len(left) + len(inside)]
        row[LEFT + INSIDE : LEFT + INSIDE + len(right)] = code[len(left) + len(inside) :]
    return out


STRIDE = 24
_PART = re.compile(r"[^/=.]+")


def views(a: int, b: int, text: str) -> list[tuple[int, int]]:
    """What the network reads of a span: all of it, or of a longer one overlapping windows over its whole length, and its
    parts between '/', '=' and '.' that are long enough for a key, each in windows too."""
    if b - a <= INSIDE:
        return [(a, b)]
    spans = {(a, b)} | {m.span() for m in _PART.finditer(text, a, b) if m.end() - m.start() >= 16}
    return sorted({(i, min(i + INSIDE, y)) for x, y in spans for i in [*range(x, max(y - INSIDE, x), STRIDE), max(y - INSIDE, x)]})


def probabilities(cnn: CharCNN, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Of each span the highest probability of its views."""
    best = np.zeros(len(spans))
    rows, owner = [], []

    def score() -> None:
        np.maximum.at(best, owner, cnn.scores(windows(rows)))
        rows.clear(), owner.clear()

    for k, (text, a, b) in enumerate(spans):
        for x, y in views(a, b, text):
            rows.append((text, x, y))
            owner.append(k)
            if len(rows) == 4096:
                score()
    if rows:
        score()
    return best


class CharCNN:
    """Embedding, one convolution with ReLU, maximum and mean over places, one linear unit. Trained by Adam in numpy."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (VOCAB, DIM)), "w": r.normal(0, 0.15, (WIDTH, DIM, FILTERS)), "b": np.zeros(FILTERS),
            "v": r.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        places = LENGTH - WIDTH + 1
        z = self.p["b"] + sum(e[:, k : k + places] @ self.p["w"][k] for k in range(WIDTH))
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        return e, a, top, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that the findings are secrets."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 3e-3, seed: int = 12) -> CharCNN:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        places = LENGTH - WIDTH + 1
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                e, a, top, pooled, out = self._forward(x[rows])
                d = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
                g = {"v": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
                dp = d[:, None] * self.p["v"]
                da = np.repeat(dp[:, None, FILTERS:] / places, places, 1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :FILTERS], 1)
                da *= a > 0
                g["b"] = da.sum((0, 1))
                flat = da.reshape(-1, FILTERS)
                g["w"] = np.stack([e[:, k : k + places].reshape(-1, DIM).T @ flat for k in range(WIDTH)])
                de = np.zeros_like(e)
                for k in range(WIDTH):
                    de[:, k : k + places] += da @ self.p["w"][k].T
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], x[rows].ravel(), de.reshape(-1, DIM))
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> CharCNN:
        """Platt scaling on findings not trained on; the highest threshold that still recalls the given part of them."""
        z = self.logits(x).astype(np.float64)
        scale, shift = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - y) * z).sum() + 1e-3 * (scale - 1), (p - y).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            scale, shift = np.array([scale, shift]) - np.clip(np.linalg.solve(h, g), -1, 1)
        self.scale, self.shift = float(max(scale, 1e-3)), float(shift)
        own = np.sort(self.scores(x[y == 1]))
        self.threshold = float(min(own[int((1 - recall) * len(own))], 0.5))
        return self


# ---- labelled findings

_HEX, _B64, _UP = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
_SYLLABLES = "an the re in tion on er st en ou th is ed ble at or nd ing wh ch le au ver ge ar do la que es".split()


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n findings with labels, made from rules: keys of usual formats in code, settings and prose, against addresses,
    numbers, paths, versions, identifiers, placeholders and plain digests of files."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    chars = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(r.integers(1, 4))))
    prose = lambda k: " ".join(word() for _ in range(k))
    num = lambda a, b: str(int(r.integers(a, b)))
    secrets = [
        lambda: chars(_HEX, pick([32, 40, 48, 64])), lambda: chars(_B64, int(r.integers(20, 64))), lambda: "AKIA" + chars(_UP, 16),
        lambda: "ghp_" + chars(_B64[:62], 36), lambda: "xoxb-" + chars("0123456789", 11) + "-" + chars(_B64[:62], 24), lambda: "sk_live_" + chars(_B64[:62], 24),
        lambda: "AIza" + chars(_B64[:62] + "-_", 35), lambda: "eyJ" + chars(_B64[:62], 30) + "." + chars(_B64[:62] + "-_", 40), lambda: chars(_B64[:62] + "-_", int(r.integers(18, 44))),
        lambda: chars(string.ascii_letters, int(r.integers(18, 44))), lambda: chars(_B64, 43) + "=", lambda: chars(_HEX, 8) + "-" + chars(_HEX, 4) + "-4" + chars(_HEX, 3) + "-a" + chars(_HEX, 3) + "-" + chars(_HEX, 12),
    ]
    names = ["token", "secret", "api_key", "apikey", "password", "key", "auth", "Authorization: Bearer", "access_key", "client_secret", "credential", "private_key", "pwd"]
    others = [
        lambda: word() + "." + num(10, 99) + "-" + word() + ".example.com", lambda: f"{num(1, 255)}.{num(0, 255)}.{num(0, 255)}.{num(0, 255)}" + "." + word(),
        lambda: f"{num(1990, 2030)}-{num(10, 13)}-{num(10, 29)}T{num(10, 24)}.{num(10, 60)}.{num(10, 60)}Z", lambda: "/".join(word() for _ in range(4)) + "/" + word() + num(0, 99),
        lambda: "v" + num(0, 20) + "." + num(0, 99) + "." + num(0, 99) + "-" + word() + "." + word(), lambda: word() + "_" + word() + "_" + word() + num(0, 99), lambda: word() + "-" + word() + "-" + word() + "-" + num(1, 999),
        lambda: "xxxxxxxxxxxxxxxx" + num(1, 9), lambda: "your_api_key_here_" + num(1, 9), lambda: "=" * int(r.integers(12, 30)) + word() + num(1, 9), lambda: word() + "." + word() + "." + word() + ".html" + num(1, 9),
        lambda: num(10**8, 10**9) + "." + num(10**6, 10**7) + "e-" + num(1, 9), lambda: "chapter-" + num(1, 99) + "." + word() + word(), lambda: word().capitalize() + word().capitalize() + word().capitalize() + num(1, 99) + word(), lambda: "1234567890abcdefgh",
        lambda: "".join(word().capitalize() for _ in range(int(r.integers(4, 9)))), lambda: word() + "".join(word().capitalize() for _ in range(int(r.integers(4, 9)))), lambda: "/".join(word().capitalize() for _ in range(6)),
        lambda: "--------" + num(1, 9) + "--" + word() + "-----", lambda: "www." + word() + word() + num(1, 99) + ".example.org/" + word(),
    ]
    out, y = [], []
    for i in range(n):
        secret = i % 2
        s = pick(secrets)() if secret else pick(others)()
        if len(s) < 16:
            s += "." + chars(_B64[:62], 4).join([word(), word()]) if not secret else chars(_B64[:62], 8)
        style = int(r.integers(5)) if secret else int(r.integers(4, 9))
        before = {0: f'{pick(names)} = "', 1: f"{pick(names)}: ", 2: f'"{pick(names)}": "', 3: f"export {pick(names).upper()}=", 4: prose(3) + " "}.get(style, prose(3) + pick([" ", " ", ", ", " (", " version ", " see ", ": "]))
        after = '"' if before.endswith('"') else pick([" ", ". ", ", ", "\n", ""])
        lead = prose(2) + " " + before
        text = lead + s + after + prose(2)
        out.append((text, len(lead), len(lead) + len(s)))
        y.append(secret)
    return out, np.array(y, np.float32)


def long_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int, int, int]], np.ndarray]:
    """n runs longer than the network's inside, with labels: (text, start, end, start and end of the secret). Keys stand
    late in addresses, paths and dotted names; the others end in names, numbers and versions."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    chars = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(r.integers(1, 4))))
    words = lambda sep: sep.join(word() for _ in range(int(r.integers(4, 12))))
    num = lambda a, b: str(int(r.integers(a, b)))
    heads = [lambda: "//" + words(".") + "/" + words("/") + "/", lambda: words(".") + "=", lambda: words(".") + "." + pick(["credential", "token", "key", "secret"]) + "=", lambda: "/" + words("/") + "/", lambda: "//" + words(".") + "/" + word() + "/" + pick("TBC") + chars("0123456789", 8) + "/" + pick("TBC") + chars(_UP, 8) + "/", lambda: words("-") + "/" + words("_") + "="]
    keys = [lambda: chars(_B64[:62], int(r.integers(20, 64))), lambda: chars(_HEX, pick([32, 40, 64])), lambda: "ghp_" + chars(_B64[:62], 36), lambda: "sk_live_" + chars(_B64[:62], 24), lambda: chars(_B64[:62] + "-_", int(r.integers(20, 44)))]
    tails = [lambda: word() + num(0, 9999), lambda: word() + "-" + num(0, 20) + "." + num(0, 99) + "." + num(0, 99) + ".jar", lambda: words("-") + "-" + num(1, 999) + ".html", lambda: words("_") + num(1, 99), lambda: words("/") + "/" + num(1990, 2030) + "/" + num(1, 13) + "/" + word(), lambda: words(".") + "." + word().capitalize() + word().capitalize() + num(1, 9), lambda: "=" * int(r.integers(12, 60)) + num(1, 9), lambda: "-" * int(r.integers(12, 60)) + num(1, 9), lambda: num(1, 255) + "." + num(0, 255) + "." + num(0, 255) + "/" + words("/")]
    out, y = [], []
    for i in range(n):
        head, body = pick(heads)(), pick(keys)() if i % 2 else pick(tails)()
        while len(head) + len(body) <= INSIDE:
            head = word() + pick("./") + head
        end = "/" + words("/") if r.random() < 0.2 else ""
        lead = word() + pick([" ", ": ", ' "', " https:"])
        at = len(lead) + len(head)
        out.append((lead + head + body + end + " " + word(), len(lead), at + len(body) + len(end), at, at + len(body) if i % 2 else at))
        y.append(i % 2)
    return out, np.array(y, np.float32)


def long_views(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Views of long findings, labelled by what they show: most of a secret, or nothing of one; others are left out."""
    out, y = [], []
    for text, a, b, s, e in long_findings(n, seed)[0]:
        for x, z in views(a, b, text):
            shown = min(z, e) - max(x, s)
            if e == s or shown <= 0 or shown >= min(e - s, 20):
                out.append((text, x, z))
                y.append(e > s and shown > 0)
    return out, np.array(y, np.float32)


RECALL = 0.97
_model: list[CharCNN] = []


def trained(findings: int = 6000, recall: float = RECALL, seed: int = 5) -> CharCNN:
    """The network, trained on labelled findings and calibrated on as many others by half; the same on every call."""
    if not _model:
        x, y = labelled_findings(findings, seed)
        late, late_y = long_views(findings // 6, seed + 2)
        held, held_y = labelled_findings(findings // 2, seed + 1)
        held_late, held_late_y = long_views(findings // 12, seed + 3)
        cnn = CharCNN().fit(windows(x + late), np.concatenate([y, late_y]))
        _model.append(cnn.calibrate(windows(held + held_late), np.concatenate([held_y, held_late_y]), recall))
    return _model[0]


# ---- operator


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, model: CharCNN | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, scores.

    Base spans stay whatever the network says; other runs of key characters become spans of kind model where its
    calibrated probability reaches the threshold, which is the highest of any part of the run. scores has every span's probability, in the order of spans.
    Offsets count code points. Null and empty texts have no spans ('' joined). Whole texts are read; repeated rows
    and null ids are answered row by row; empty tables give empty results; other columns are not read.
    """
    prepare(docs.sparkSession)
    cnn = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            found, asked = [], []
            for text in batch.column("text").to_pylist():
                base, more = candidates(text or "")
                found.append((base, more, len(asked)))
                asked += [(text, a, b) for a, _, b in base + more]
            p = probabilities(cnn, asked)
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "scores")}
            for base, more, at in found:
                scored = list(zip(base + more, p[at : at + len(base) + len(more)].tolist(), strict=True))
                kept = sorted(x for x in scored if x[0][1] < 3 or x[1] >= cnn.threshold)
                for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_model")):
                    out[name].append(sum(s[1] == k for s, _ in kept))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(s for s, _ in kept))
                out["scores"].append(",".join(f"{x:.4f}" for _, x in kept))
            kinds = {k: pa.int64() if k.startswith("n_") else pa.string() for k in out}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, kinds[k]) for k, v in out.items()]], ["doc_id", *out])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, scores string")
