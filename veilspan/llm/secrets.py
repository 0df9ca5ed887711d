"""Secret scans: rules for known shapes, and a character convolutional network for all candidates.

Rules (fixed values, see ``RULES``) find assignments, access keys and hex strings. Candidates are runs of
16 or more token characters that mix digits with letters or change case often. The network, in numpy,
reads each candidate with the characters before and after it, long ones whole, window by window; the
greatest score counts. It is trained on labelled findings: ones made by a seeded generator, and the rules' own
findings in the corpus, which are secrets. Candidates that no rule matches have no label, as a secret of another
shape is one of them: they count as clean with the small weight ``unlabelled``. From the corpus come at most
``max_findings`` candidates of ``max_texts`` whole texts, the first by a hash. Scores are calibrated on labelled findings held back
from training, and the threshold is the highest at which it still finds ``min_recall`` of the secrets among those.

Spans of rules always stay; candidates above the threshold that overlap none of them are added as kind
``cnn``. Offsets are code points, ends exclusive.

Defined cases: null text counts as empty; texts without secrets give an empty list of spans; texts are
read whole at any length; spans that start together come in the order of kinds; null doc_ids are kept; an
empty table gives an empty result, and trains on made findings only; repeated rows get the same spans each; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch, text_of, tidy

#: Kinds in their order, patterns, and least lengths (of group 2, or of the match).
KINDS = ("assign", "access", "hex")
RULES = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: A part of every match, without case: texts that have none need no search.
_HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_BEFORE, _INSIDE, _AFTER = 24, 48, 8
_WIDTH = _BEFORE + _INSIDE + _AFTER


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every rule, by start, then kind as listed."""
    low, found = text.lower(), []
    for k, kind in enumerate(KINDS):
        if kind in _HINTS and not any(x in low for x in _HINTS[kind]):
            continue
        pattern, group, least = RULES[kind]
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        digits = any(c.isdigit() for c in t)
        letters = any(c.isalpha() for c in t)
        turns = sum(a.islower() and b.isupper() for a, b in zip(t, t[1:]))
        if digits and letters or turns >= 2:
            out.append((m.start(), m.end()))
    return out


def _codes() -> np.ndarray:
    """Classes of code points below 128; 0 pads, 1 is anything else."""
    table = np.ones(129, dtype=np.int64)
    for i in range(26):
        table[97 + i], table[65 + i] = 2 + i, 28 + i
    for i in range(10):
        table[48 + i] = 54 + i
    for i, c in enumerate("\"'=:+/_.- \n<>(){}[]"):
        table[ord(c)] = 64 + i
    return table


_CODE = _codes()
_CLASSES = int(_CODE.max()) + 1


def window(text: str, start: int, end: int) -> np.ndarray:
    """Classes of the context before, the candidate (its middle left out if long) and the context after."""
    inside = text[start:end]
    if len(inside) > _INSIDE:
        inside = inside[: _INSIDE // 2] + inside[-(_INSIDE // 2) :]
    parts = ((text[max(0, start - _BEFORE) : start], _BEFORE, True), (inside, _INSIDE, False), (text[end : end + _AFTER], _AFTER, False))
    out = np.zeros(_WIDTH, dtype=np.int64)
    at = 0
    for part, width, right in parts:
        codes = _CODE[np.minimum(np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32), 128)]
        at_part = at + (width - len(codes) if right else 0)
        out[at_part : at_part + len(codes)] = codes
        at += width
    return out


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """The candidate's window and, if it is long, one for every place of a window slid over all of it by half its width."""
    yield window(text, start, end)
    if end - start > _INSIDE:
        for at in (*range(start, end - _INSIDE, _INSIDE // 2), end - _INSIDE):
            yield window(text, at, at + _INSIDE)


@dataclass
class Network:
    """Embedding, one convolution, ReLU, maxima over candidate and context, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def new(seed: int = 3, dim: int = 8, filters: int = 24, width: int = 5) -> Network:
        r = np.random.default_rng(seed)
        return Network(r.normal(0, 0.3, (_CLASSES, dim)), r.normal(0, 0.2, (width * dim, filters)), np.zeros(filters), r.normal(0, 0.1, 2 * filters), 0.0)

    def forward(self, x: np.ndarray):
        width = self.conv.shape[0] // self.embed.shape[1]
        e = self.embed[x]
        patches = np.lib.stride_tricks.sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), _WIDTH - width + 1, -1)
        h = np.maximum(patches @ self.conv + self.bias, 0)
        inner, outer = h.copy(), h.copy()
        inner[:, : _BEFORE - width + 1] = 0
        inner[:, _BEFORE + _INSIDE :] = 0
        outer[:, _BEFORE : _BEFORE + _INSIDE - width + 1] = 0
        at = np.concatenate([inner.argmax(1), outer.argmax(1)], axis=1)
        pooled = np.concatenate([inner.max(1), outer.max(1)], axis=1)
        return patches, at, pooled, pooled @ self.out + self.last

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = 9) -> None:
        rng, n_f = np.random.default_rng(seed), self.conv.shape[1]
        params = [self.embed, self.conv, self.bias, self.out, np.array([self.last])]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        width, dim = self.conv.shape[0] // self.embed.shape[1], self.embed.shape[1]
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[rows], y[rows]
                patches, at, pooled, z = self.forward(xb)
                d = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(rows)
                grads = [np.zeros_like(p) for p in params]
                grads[3], grads[4] = pooled.T @ d, np.array([d.sum()])
                dp = d[:, None] * self.out * (pooled > 0)
                for half in range(2):
                    for f in range(n_f):
                        k = half * n_f + f
                        g, pos = dp[:, k], at[:, k]
                        taken = patches[np.arange(len(rows)), pos]
                        grads[1][:, f] += taken.T @ g
                        grads[2][f] += g.sum()
                        de = (g[:, None] * self.conv[:, f]).reshape(len(rows), width, dim)
                        np.add.at(grads[0], xb[np.arange(len(rows))[:, None], pos[:, None] + np.arange(width)], de)
                t += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                self.last = float(params[4][0])

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float) -> None:
        """Platt scaling on held-out findings, then the highest threshold of enough recall."""
        z = np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)])
        a = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -30, 30)))
            design = np.stack([z, np.ones_like(z)], 1)
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            a = a + np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * (a - [1, 0]))
        self.scale, self.shift = float(a[0]), float(a[1])
        found = np.sort(self.probability(x)[y == 1])
        self.threshold = float(found[int(np.floor((1 - min_recall) * len(found)))]) if len(found) else 0.5


def made_findings(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Seeded labelled findings: tokens and keys in settings of use or bare (1), and ids, names, paths, numbers (0)."""
    rng = np.random.default_rng(seed)
    alphabets = ("abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    lead = ("auth_key=", "Authorization: Bearer ", "client_secret: ", "private key ", "credential=", 'access_token": "', "pwd: ", "key=", "signing_key = ", "", "", "the ", "see ")
    mark = ("", "", "", "ghp_", "sk_live_", "xoxb-", "AKIA", "AIza", "glpat-", "eyJ")
    plain = ("see ", "file ", "on ", "section ", "http://", "order ", "page ", "the ", "version ", "report-", "mail ", "id=", "key ", "")
    letters = list("aeioustnrlchdmpgbfkvwyjxqz")
    odds = np.r_[np.full(14, 5.0), np.full(12, 2.0)]
    word = lambda k: "".join(rng.choice(letters, k, p=odds / odds.sum()))
    number = lambda k: str(rng.integers(10 ** (k - 1), 10**k))
    shapes = [
        lambda: f"{word(6)}.{word(5)}.com/{word(7)}/{rng.integers(1, 99)}",
        lambda: f"{word(8)}-{word(6)}-{rng.integers(1990, 2030)}",
        lambda: f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T1{rng.integers(0, 9)}.00.00",
        lambda: f"{word(5).title()}{word(6).title()}{word(7).title()}",
        lambda: f"{number(9)}.{number(9)}e{rng.integers(9)}",
        lambda: f"{word(9)}_{word(8)}_v{rng.integers(1, 20)}",
        lambda: f"{word(6)}{rng.integers(1, 999)}.{word(4)}.example.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"www.{word(7)}.org/{word(4)}/{word(6)}_{rng.integers(1, 99)}.html",
        lambda: f"/{word(3)}/{word(5)}/{word(6)}{rng.integers(0, 9)}/{word(7)}.{rng.choice(['py', 'txt', 'json', 'mp3'])}",
        lambda: f"{word(4)}.{word(7)}.{word(5).title()}{word(6).title()}{rng.integers(0, 9)}",
        lambda: f"{word(4)}{word(6).title()}{word(5).title()}{word(4).title()}ById{rng.integers(0, 99)}",
        lambda: f"{word(3).upper()}-{number(6)}-{number(8)}",
        lambda: f"{word(7)}={word(6)}_{rng.integers(1, 9)}+{word(6)}",
    ]
    x, y = [], []
    for i in range(n):
        if i % 2:
            pre, token = rng.choice(lead), rng.choice(mark) + "".join(rng.choice(list(alphabets[rng.integers(len(alphabets))]), rng.integers(18, 48)))
        else:
            pre, token = rng.choice(plain), shapes[rng.integers(len(shapes))]()
            token = token if len(token) >= 16 else token + word(16 - len(token))
        before = f"{word(6)} {word(4)}. {pre}"
        x.append(window(f"{before}{token} {word(5)}", len(before), len(before) + len(token)))
        y.append(i % 2)
    return np.stack(x), np.array(y, dtype=float)


def corpus_findings(docs: DataFrame, id_col: str, text_col: str, max_texts: int, max_findings: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of candidates in max_texts whole texts, and whether a rule matches there: the first max_findings by a hash."""
    shape = pa.schema([("h", pa.int64()), ("codes", pa.binary()), ("rule", pa.bool_())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                spans = rule_spans(text)
                for s, e in candidates(text):
                    for column, v in zip(out, (h ^ s, window(text, s, e).astype(np.uint8).tobytes(), any(s < z and a < e for a, z, _ in spans))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)

    rows = docs.select(F.xxhash64(docs[id_col], text_of(docs, text_col)).alias("h"), text_of(docs, text_col).alias("text"))
    picked = rows.select("h").orderBy("h").limit(max_texts).distinct()
    every = rows.join(F.broadcast(picked), "h").mapInArrow(tidy(found), "h bigint, codes binary, rule boolean")  # max_texts numbers at most
    every = Scratch(docs.sparkSession, "secrets").save(every, "findings")
    got = []
    for rule in (True, False):  # half of the bound for either kind
        got += every.where(F.col("rule") == rule).orderBy("h", "codes").limit(max_findings // 2).collect()
    x = np.array([np.frombuffer(r["codes"], np.uint8) for r in got], dtype=np.int64).reshape(-1, _WIDTH)
    return x, np.array([r["rule"] for r in got], dtype=float)


def train_scanner(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = 3000, max_findings: int = 3000, min_recall: float = 0.98, unlabelled: float = 0.1) -> Network:
    """Trains on made findings and on at most max_findings candidates of max_texts texts of the corpus."""
    x, y = made_findings(4000)
    more, rule = corpus_findings(docs, id_col, text_col, max_texts, max_findings)
    weight = np.r_[np.ones(len(x)), np.where(rule == 1, 1.0, unlabelled)]
    x, y = np.concatenate([x, more]), np.r_[y, rule]
    held = np.arange(len(x)) % 5 == 0
    net = Network.new()
    net.train(x[~held], y[~held], weight[~held])
    labelled = held & (weight == 1)
    net.calibrate(x[labelled], y[labelled], min_recall)
    return net


def span_scores(text: str, spans: list, net: Network, block: int = 4096) -> np.ndarray:
    """The greatest probability of each span's windows. spans start with start and end."""
    best = np.zeros(len(spans))
    every = ((i, w) for i, span in enumerate(spans) for w in windows(text, span[0], span[1]))
    while held := list(islice(every, block)):
        np.maximum.at(best, [i for i, _ in held], net.probability(np.stack([w for _, w in held])))
    return best


def scan_text(text: str, net: Network) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of all findings; the network reads each, but rules' spans stay anyhow."""
    base = rule_spans(text)
    rest = [c for c in candidates(text) if not any(c[0] < e and s < c[1] for s, e, _ in base)]
    spans = base + [(s, e, "cnn") for s, e in rest]
    if not spans:
        return []
    scores = span_scores(text, spans, net)
    found = [(s, e, k, float(q)) for (s, e, k), q in zip(spans, scores) if k != "cnn" or q >= net.threshold]
    order = {k: i for i, k in enumerate((*KINDS, "cnn"))}
    return sorted(found, key=lambda f: (f[0], order[f[2]]))


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and findings: array of (start, end, kind, probability), by start, then kind."""
    kind = "array<struct<start:bigint,end:bigint,kind:string,probability:double>>"
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k, "probability": p} for s, e, k, p in scan_text(t.as_py(), net)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], ["doc_id", "findings"])

    return rows.mapInArrow(tidy(scanned), f"doc_id bigint, findings {kind}")


def scan_digests(found: DataFrame) -> DataFrame:
    """The counts and span strings of ``scan``'s findings."""
    said = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    of = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("bigint")
    base = F.array_join(F.transform(F.filter("findings", lambda f: f["kind"] != "cnn"), said), ",")
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("findings", said), ",").alias("spans")
    )


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in rule_spans(text)).encode()).hexdigest()
