"""Personal data: pattern spans plus a skip-chain conditional random field.

Base spans come from four fixed patterns. On top, each document is a random field over its
tokens that hold a digit or an at-sign (all others are outside any span by definition):

* node potentials: a softmax over shape and context features, trained in numpy on the
  base spans of a bounded sample of documents;
* chain potentials between neighbouring tokens: smoothed label transitions;
* skip potentials: tokens that may be one entity hang on hub variables, so distant mentions
  share a potential without listing pairs, and a group of n mentions costs n edges. Equal tokens
  (last seven digits, or the lower-case address) share one hub; similar ones (one character
  changed, put in or left out) share a hub for what is left when that character is taken out.
  The two kinds of hub have a potential each, estimated like the chain's.

Loopy sum-product passes a fixed number of rounds over every document with such tokens. Tokens
under a base span are clamped. Runs of tokens that settle on a label and look like it become
added spans if a token of theirs hangs on a hub with a mention under a base span of that label.
A run without such a mention is added only if it is whole and valid for its kind (digit counts,
check digit, ranges): so a card that directly follows a phone number, where the patterns run
into each other and drop both, is found, and a lone look-alike is left alone, as is a number that
fails its check digit however often it occurs. Base spans stay.

Defined results: a null text is empty; a null id keeps its row; repeated rows each get the
same result; an empty table gives an empty result; extra columns are ignored. Work is linear
in the length of a text (every pattern is matched without re-scanning).
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.llm.common import bounded_sample, documents, id_text, map_batches, map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents whose base spans train the field.
TRAIN_DOCS = 4_000
#: Characters of their texts that are read for that at most; whole texts are taken or left.
TRAIN_CHARACTERS = 32_000_000
ROUNDS = 6
#: Characters that a token has at least, and at most, to be compared with similar ones.
_SIMILAR = (7, 64)
_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_AFTER = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d *= 2
            if d > 9:
                d -= 9
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        else:
            done = at + 1  # an at-sign is not a local character: later matches start after it
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind; failing matches are dropped without a retry."""
    out: list[tuple[str, int, int]] = []
    if not _ANY.search(text):
        return out
    if "@" in text:
        out += (("email", a, b) for a, b in _emails(text))
    if not _DIGITS.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- the field

_N_DIGIT = (0, 1, 4, 7, 10, 12, 14, 20)
_CUES = 32
N_FEATURES = 1 + len(_N_DIGIT) + 8 + _CUES


#: Most tokens that one number is written in: 19 digits.
_GROUPS = 19


def _same_number(a: str, b: str) -> bool:
    """Is one the other without its country code (at most three digits) or a leading zero, or its ending?"""
    a, b = a.lstrip("0"), b.lstrip("0")
    return b.endswith(a) or a.endswith(b) and len(a) <= len(b) + 3


class Tokens:
    """Candidate tokens of one text: spans, features, keys, neighbourhood."""

    def __init__(self, text: str):
        self.spans: list[tuple[int, int]] = []
        self.order: list[int] = []
        cues: list[str] = []
        before = ""
        for i, m in enumerate(_WORD.finditer(text)):
            word = m.group()
            if _ANY.search(word):
                self.spans.append(m.span())
                self.order.append(i)
                cues.append(before)
            before = word
        self.n = len(self.spans)
        self.feats: list[list[int]] = []
        self.keys: list[str | None] = []
        self.alike: list[bool] = []  # an address, or seven digits and no letter
        for j, (a, b) in enumerate(self.spans):
            word = text[a:b]
            digits = "".join(_DIGITS.findall(word))
            f = [0, 1 + max(k for k, n in enumerate(_N_DIGIT) if len(digits) >= n)]
            at = 1 + len(_N_DIGIT)
            flags = ("@" in word, word.startswith("+"), "(" in word, len(re.findall(r"[0-9]\.[0-9]", word)) == 3, "-" in word, any(c.isalpha() for c in word),
                     j > 0 and self.order[j - 1] == self.order[j] - 1, j + 1 < self.n and self.order[j + 1] == self.order[j] + 1)
            f += [at + k for k, on in enumerate(flags) if on]
            self.alike.append("@" in word or len(digits) >= 7 and not flags[5])
            cue = cues[j].lower().strip(".,:;()")
            f.append(at + len(flags) + int.from_bytes(hashlib.blake2b(cue.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _CUES)
            self.feats.append(f)
            if "@" in word:
                self.keys.append("@" + word.lower().strip(".,:;()<>\"'"))
            else:
                self.keys.append(digits[-7:] if len(digits) >= 7 else None)

    def similar(self, text: str) -> list[tuple[int, str]]:
        """(token, hub): each token with every form of it that lacks one character."""
        out = []
        for j, (a, b) in enumerate(self.spans):
            word = text[a:b].lower().strip(".,:;()<>\"'")
            if "@" not in word:
                word = re.sub("[^0-9.]", "", word).strip(".")
                word = word if word.count(".") == 3 else word.replace(".", "")
            if _SIMILAR[0] <= len(word) <= _SIMILAR[1]:
                out += ((j, h) for h in {word[:i] + word[i + 1 :] for i in range(len(word))})
        shared = Counter(h for _, h in out)
        return [(j, h) for j, h in out if shared[h] > 1]

    def hubs(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges to hubs: token, hub, and 0 for a hub of equal tokens or 1 for one of similar tokens.
        Similar tokens that are equal have a hub already."""
        count = Counter(k for k in self.keys if k is not None)
        edges = [(j, k, 0) for j, k in enumerate(self.keys) if k is not None and count[k] > 1]
        near = self.similar(text)
        differ: dict[str, set] = {}
        for j, h in near:
            differ.setdefault(h, set()).add(self.keys[j])
        edges += [(j, "-" + h, 1) for j, h in near if len(differ[h]) > 1]
        ids: dict[str, int] = {}
        rows = np.array([(j, ids.setdefault(h, len(ids)), kind) for j, h, kind in edges], dtype=int).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def link(self, text: str, spans: list[tuple[str, int, int]]) -> None:
        """Keys for numbers written in groups: tokens of a base span get the key of its digits, and
        so do neighbouring digit tokens that together write the same number again."""
        proven: dict[str, set[str]] = {}
        ends = [b for _, b in self.spans]
        for kind, a, b in spans:
            digits = "".join(_DIGITS.findall(text[a:b])) if kind in ("card", "phone") else ""
            if len(digits) < 7:
                continue
            proven.setdefault(digits[-7:], set()).add(digits)
            j = bisect.bisect_right(ends, a)
            while j < self.n and self.spans[j][0] < b:
                self.keys[j] = self.keys[j] or digits[-7:]
                j += 1
        if not proven:
            return
        words = (text[a:b] for a, b in self.spans)
        parts = [None if taken or "@" in w or any(c.isalpha() for c in w) else "".join(_DIGITS.findall(w)) for taken, w in zip(self.labels(spans), words)]
        for k in range(self.n):
            digits, first = "", None
            for j in range(k, max(-1, k - _GROUPS), -1):
                if not parts[j] or j < k and self.order[j + 1] != self.order[j] + 1:
                    break
                digits = parts[j] + digits
                if len(digits) > 19:
                    break
                known = proven.get(digits[-7:], ()) if len(digits) >= 7 else ()
                if any(_same_number(digits, p) for p in known):
                    first = j
                if digits in known:
                    break
            if first is not None:
                key = "".join(parts[first : k + 1])[-7:]
                for j in range(first, k + 1):
                    self.keys[j] = self.keys[j] or key

    def doubtful(self, y: np.ndarray) -> np.ndarray:
        """Tokens outside base spans of which the patterns say nothing: addresses and long numbers that
        they drop, and what stands beside those without a gap."""
        out = (y == 0) & np.array(self.alike, dtype=bool)
        for step in (range(1, self.n), range(self.n - 2, -1, -1)):
            for j in step:
                i = j - 1 if step.step > 0 else j + 1
                if out[i] and not y[j] and abs(self.order[i] - self.order[j]) == 1:
                    out[j] = True
        return out

    def matrix(self) -> np.ndarray:
        x = np.zeros((self.n, N_FEATURES))
        for j, f in enumerate(self.feats):
            x[j, f] = 1.0
        return x

    def labels(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """The label of the base span a token overlaps, 0 for none."""
        y = np.zeros(self.n, dtype=int)
        j = 0
        for kind, a, b in spans:
            while j < self.n and self.spans[j][1] <= a:
                j += 1
            k = j
            while k < self.n and self.spans[k][0] < b:
                if not y[k]:
                    y[k] = LABELS.index(kind)
                k += 1
        return y


def train(texts: Iterable[str]) -> dict:
    """Piecewise training on the base spans of the given texts: node softmax, chain and skip
    potentials. Smoothing keeps every potential defined on a sample without personal data."""
    xs, ys = [], []
    trans = np.full((5, 5), 0.2) + 4.0 * np.eye(5)
    agree, differ = np.array([30.0, 10.0]), np.array([1.0, 1.0])
    for text in texts:
        if not _ANY.search(text):
            continue
        t = Tokens(text)
        if not t.n:
            continue
        y = t.labels(base_spans(text))
        known = ~t.doubtful(y)
        xs.append(t.matrix()[known])
        ys.append(y[known])
        near = np.flatnonzero(np.diff(t.order) == 1)
        near = near[known[near] & known[near + 1]]
        np.add.at(trans, (y[near], y[near + 1]), 1.0)
        last: dict[int, int] = {}
        for j, hub, kind in zip(*t.hubs(text)):  # neighbours on a hub, unless both are no entity
            if hub in last and (y[j] or y[last[hub]]):
                same = y[last[hub]] == y[j]
                agree[kind] += same
                differ[kind] += not same
            last[hub] = j
    w = np.zeros((N_FEATURES, 5))
    w[0, 0] = 1.0
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        prior, target, grown = w.copy(), np.eye(5)[y], np.full_like(w, 1e-8)
        for _ in range(400):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = x.T @ (p - target) / len(y) + 1e-4 * (w - prior)
            grown += slope**2
            w -= slope / np.sqrt(grown)
    chain = np.log(trans / trans.sum(1, keepdims=True))
    # the mean row is the label prior the nodes already hold; only the association counts
    chain -= np.log(trans.sum(0) / trans.sum())
    return {"node": w, "chain": np.clip(chain, -2, 2), "skip": np.log(np.maximum(agree / differ, 1.0))}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def marginals(t: Tokens, edges: tuple[np.ndarray, np.ndarray, np.ndarray], clamped: np.ndarray, model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product over chain edges and hub edges; rows are token label probabilities."""
    unary = t.matrix() @ model["node"]
    unary -= _lse(unary, 1)[:, None]
    held = clamped > 0
    unary[held] = -30.0
    unary[held, clamped[held]] = 0.0
    near = np.flatnonzero(np.diff(t.order) == 1)
    member, hub, kind = edges
    potts = model["skip"][kind][:, None, None] * np.eye(5)
    right, left = np.zeros((t.n, 5)), np.zeros((t.n, 5))  # messages into a token from its left, right
    down, up = np.zeros((len(member), 5)), np.zeros((len(member), 5))
    for _ in range(rounds):
        belief = unary + right + left
        if len(member):
            np.add.at(belief, member, down)
        to_next = _lse((belief[near] - left[near])[:, :, None] + model["chain"][None], 1)
        to_prev = _lse((belief[near + 1] - right[near + 1])[:, None, :] + model["chain"][None], 2)
        right[near + 1] = to_next - to_next.max(1, keepdims=True)
        left[near] = to_prev - to_prev.max(1, keepdims=True)
        if len(member):
            up = _lse((belief[member] - down)[:, :, None] + potts, 1)
            up -= up.max(1, keepdims=True)
            hubs = np.zeros((hub.max() + 1, 5))
            np.add.at(hubs, hub, up)
            down = _lse((hubs[hub] - up)[:, :, None] + potts, 1)
            down -= down.max(1, keepdims=True)
    belief = unary + right + left
    if len(member):
        np.add.at(belief, member, down)
    return np.exp(belief - _lse(belief, 1)[:, None])


def _plausible(kind: str, text: str) -> bool:
    digits = "".join(_DIGITS.findall(text))
    if kind == "email":
        return "@" in text.strip("@") and len(text) >= 5
    if kind == "ip":
        return bool(_IP_AFTER.fullmatch(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9 .-]+", text) is not None
    return 7 <= len(digits) <= 15 and re.fullmatch(r"[+0-9 ().\-/]+", text) is not None


def _whole(kind: str, text: str) -> bool:
    """Is the text valid for its kind without any other mention?"""
    if kind == "phone":
        return bool(_PHONE.fullmatch(text)) and 10 <= sum(map(len, _DIGITS.findall(text))) <= 15
    return any(s == (kind, 0, len(text)) for s in base_spans(text))


def find_spans(text: str, model: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those the field adds."""
    base = base_spans(text)
    if not _ANY.search(text):
        return base, base
    t = Tokens(text)
    clamped = t.labels(base)
    if bool((clamped > 0).all()):
        return base, base
    t.link(text, base)
    edges = t.hubs(text)
    best = marginals(t, edges, clamped, model).argmax(1)
    proven = {(hub, clamped[j]) for j, hub, _ in zip(*edges) if clamped[j]}
    backed = {j for j, hub, _ in zip(*edges) if (hub, best[j]) in proven}
    added = []
    j = 0
    while j < t.n:
        label = best[j]
        if not label or clamped[j]:
            j += 1
            continue
        k = j
        while k + 1 < t.n and best[k + 1] == label and not clamped[k + 1] and t.order[k + 1] == t.order[k] + 1:
            k += 1
        a, b = t.spans[j][0], t.spans[k][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        kind = LABELS[label]
        if a < b and _plausible(kind, text[a:b]) and (_whole(kind, text[a:b]) or any(i in backed for i in range(j, k + 1))):
            added.append((kind, a, b))
        j = k + 1
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def fit(df: DataFrame, rows: int = TRAIN_DOCS) -> dict:
    """The field's potentials from a bounded sample of documents with a digit or at-sign."""
    marked = id_text(df).where(F.col("text").rlike("[0-9@]"))
    texts, size = [], 0
    for r in bounded_sample(marked, rows).select("text").orderBy(F.xxhash64("text"), "text").toLocalIterator():
        size += len(r.text)
        if size > TRAIN_CHARACTERS:
            break
        texts.append(r.text)
    return train(texts)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def detect(df: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per document: counts and digest of base spans, and all spans."""
    model = fit(df) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        field = sent.value

        def step(ids, texts):
            counts, shas, spans = [[], [], [], []], [], []
            for text in texts:
                base, every = find_spans(text or "", field)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                shas.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(every))
            return [ids, *counts, shas, spans]

        return step

    return map_texts(id_text(df), make, SCHEMA)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by its kind; overlapping spans become one mark of the first kind."""
    out, done = [], 0
    for kind, a, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += (text[done:a], f"<{kind.upper()}>")
        done = b
    return "".join(out) + text[done:]


def redact(df: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of df with personal data masked in text (n_chars follows, where it exists)."""
    model = fit(df) if model is None else model
    sent = df.sparkSession.sparkContext.broadcast(model)

    at, length = df.columns.index("text"), df.columns.index("n_chars") if "n_chars" in df.columns else None

    def make():
        field = sent.value

        def step(batch):
            texts = [t if t is None else mask(t, find_spans(t, field)[1]) for t in batch.column(at).cast("string").to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length is None:
                return batch
            counts = pa.array([t if t is None else len(t) for t in texts], batch.schema.field(length).type)
            return batch.set_column(length, batch.schema.field(length), counts)

        return step

    return map_batches(df, make)


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
