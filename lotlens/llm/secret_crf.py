"""Secret scanning: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as begin, inside or outside of a secret, from its shape, the neighbouring words and features of
the file; tags are decoded by Viterbi. It is trained here, on a bounded sample of documents whose pattern matches are the
labels, and on made-up configuration lines that hold secrets the patterns miss. Pattern matches always stay; the field adds
spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import empty_if_null, ship

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A text without one of these, in either case, has no assignment.
_MAY_ASSIGN = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern matches, by start and then kind; code points, end exclusive."""
    out = []
    if _MAY_ASSIGN.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


# --- tokens and their features ---

TOKEN = re.compile(r"[\w+/\-]+|[^\w\s]")
#: Words that stand before secrets; the neighbour features keep these, other words fall into shape classes.
CUES = frozenset("password passwd pwd passphrase secret token key apikey api_key auth authorization bearer credential credentials access private client_secret signing aws login pin salt".split())
B, I, O = range(3)
START = np.array([0.0, -8.0, 0.0])


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


_CUE_PART = re.compile(r"passw|secret|token|api_?key|credential")


def outline(token: str) -> tuple | str:
    """What the features of a token depend on: few values for plain words, the token itself for others."""
    if len(token) > 1 and token.isalpha():
        low = token.lower()
        if low in CUES or len(low) > 4 and _CUE_PART.search(low):
            return token
        return ("a" if token == low else "A" if token.isupper() else "aA", min(len(token).bit_length(), 7), token.isascii())
    return token


def shape(token: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    if len(token) == 1:
        return ("char:" + (token if not token.isalnum() else "x"),)
    if token.isalpha():
        kind, dig = "a" if token == token.lower() else "A" if token.isupper() else "aA", False
    else:
        low, up, dig = any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token)
        kind = f"{'a' * low}{'A' * up}{'0' * dig}{'+' * (not token.isalnum())}"
    size = min(len(token).bit_length(), 7)
    out = ["kind:" + kind, f"size:{size}", f"kind-size:{kind}{size}"]
    if dig or kind not in ("a", "aA", "A"):
        turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(token, token[1:], strict=False))
        out += [f"entropy:{int(_entropy(token) * 2)}", f"turns:{min(turns * 4 // len(token), 4)}"]
    if not token.isascii():
        out.append("not-ascii")
    if token.lower() in CUES:
        out.append("cue")
    return tuple(out)


def as_neighbour(token: str) -> str:
    """The class of a word as its neighbours see it."""
    low = token.lower()
    if low in CUES or len(token) == 1 and not token.isalnum():
        return low
    if _CUE_PART.search(low):
        return "like a cue"
    return "number" if token.isdigit() else "mixed" if any(c.isdigit() for c in token) else "word"


def file_features(text: str) -> tuple[str, ...]:
    """Features of the whole file: how much of it is assignments and how long its lines are."""
    n = len(text) + 1
    marks = text.count("=") + text.count(":") + text.count("{")
    return (f"marks:{min(int(marks / n * 200), 4)}", f"lines:{min((n // (text.count(chr(10)) + 1)).bit_length(), 10)}")


@dataclass
class Field:
    """Weights by feature (three tags each) and by pair of tags; ``own``, ``left`` and ``right`` are remembered per token."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))

    def __post_init__(self):
        self.seen: dict[str, int] = {}  # token -> row of its class
        self.classes: dict = {}
        self.rows = np.zeros((0, 3, 3))
        usable = self.moves[self.moves > -50]
        self.slack = 3 * float(usable.max() - usable.min())

    def total(self, names) -> np.ndarray:
        return sum((self.weights[n] for n in names if n in self.weights), np.zeros(3))

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Rows of ``rows`` (own, as the word before, as the word after; by tag) for the tokens."""
        if len(self.seen) > 400_000:
            self.seen.clear()
            self.classes.clear()
        seen, classes = self.seen, self.classes
        for t in set(tokens).difference(seen):
            at = outline(t)
            row = classes.get(at)
            if row is None:
                row = classes[at] = len(classes)
                if row == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty((max(1024, row), 3, 3))])
                self.rows[row] = self.total(shape(t)), self.total(["before:" + as_neighbour(t)]), self.total(["after:" + as_neighbour(t)])
            seen[t] = row
        return np.fromiter(map(self.seen.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def emissions(self, tokens: list[str], text: str) -> np.ndarray:
        at = self.lookup(tokens)
        out = self.rows[at, 0] + self.total(file_features(text))
        out[1:] += self.rows[at[:-1], 1]
        out[2:] += 0.5 * self.rows[at[:-2], 1]
        out[:-1] += self.rows[at[1:], 2]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Secret spans of whole texts, by Viterbi.

        A token is outside on the best path if its score as outside exceeds both others by more than the change can cost: up to
        three transitions, and the next token's turn from inside to begin. Decoding is needed only for the runs between such
        tokens; runs of one length are decoded together.
        """
        scores, runs, at = [np.zeros((0, 3))], [np.zeros((0, 3), dtype=np.int64)], 0
        for d, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            if not tokens:
                continue
            e = self.emissions(tokens, text)
            lead = e[:, O] - np.maximum(e[:, B], e[:, I]) - self.slack
            lead[:-1] -= np.maximum(e[1:, I] - e[1:, B], 0)
            unsure = np.flatnonzero(lead <= 0)
            if len(unsure):
                first = np.flatnonzero(np.append(True, np.diff(unsure) > 1))
                length = np.diff(np.append(first, len(unsure)))
                runs.append(np.column_stack([np.full(len(first), d), unsure[first], length]))
                scores.append(e[unsure])
        run, e = np.concatenate(runs), np.concatenate(scores)
        begin = np.cumsum(run[:, 2]) - run[:, 2]
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        for length in np.unique(run[:, 2]):
            mine = np.flatnonzero(run[:, 2] == length)
            cells = e[begin[mine][:, None] + np.arange(length)]
            tags = viterbi(cells, self.moves, np.where(run[mine, 1][:, None] == 0, START, self.moves[O]))
            for i in np.flatnonzero((tags == B).any(axis=1)):
                start = None
                for j, tag in enumerate([*tags[i].tolist(), O]):
                    if tag != I and start is not None:
                        found[run[mine[i], 0]].append((int(run[mine[i], 1]) + start, int(run[mine[i], 1]) + j - 1))
                        start = None
                    if tag == B:
                        start = j
        out = []
        for text, f in zip(texts, found, strict=True):
            places = [m.span() for m in TOKEN.finditer(text)] if f else []
            out.append([(places[a][0], places[b][1]) for a, b in sorted(f)])
        return out


def viterbi(e: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (n, length) of n runs (n, length, 3) that are each followed by an outside token."""
    score, back = start + e[:, 0], []
    for t in range(1, e.shape[1]):
        through = score[:, :, None] + moves
        back.append(through.argmax(axis=1))
        score = through.max(axis=1) + e[:, t]
    tag = (score + moves[:, O]).argmax(axis=1)
    tags = [tag]
    for b in reversed(back):
        tag = b[np.arange(len(tag)), tag]
        tags.append(tag)
    return np.stack(tags[::-1], axis=1)


# --- training ---


def made_up_lines(n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int]]]]:
    """(line, secret spans): configuration, code and prose with and without secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    letters = string.ascii_letters + string.digits
    word = lambda: "".join(pick(string.ascii_lowercase) for _ in range(int(rng.integers(2, 9))))
    out = []
    for _ in range(n):
        key = pick(["password", "passwd", "pwd", "secret", "client_secret", "token", "access_token", "api_key", "apikey", "auth", "private_key", "signing_key", "passphrase", "credential", "aws_key", "bearer"])
        alphabet = pick([letters, string.digits + "abcdef", string.ascii_uppercase + string.digits, letters + "+/"])
        value = "".join(pick(alphabet) for _ in range(int(rng.integers(10, 44))))
        before, after = " ".join(word() for _ in range(int(rng.integers(0, 6)))), " ".join(word() for _ in range(int(rng.integers(0, 6))))
        lead = pick([f"{key}={value}", f"{key}: {value}", f'"{key}": "{value}"', f"{key.upper()} = '{value}'", f"{key} -> {value}", f"{key} is {value}", f"Authorization: Bearer {value}", f"--{key} {value}", f"<{key}>{value}</{key}>"])
        if rng.random() < 0.5:
            line = f"{before} {lead} {after}".strip()
            at = line.rindex(value) if line.count(value) == 1 else line.index(value)
            out.append((line, [(at, at + len(value))]))
        else:
            # the same words around things that are no secrets
            calm = pick([f"the {key} of {word()}", f"{word()} = {word()}", f"{word()}: {int(rng.integers(10**6))}", f"{word()}-{word()}-{word()}", f"call +{int(rng.integers(10**9, 10**11))}", f"{word()}@{word()}.com", f"http://{word()}.com/{word()}?{word()}={int(rng.integers(999))}", f"{word()}{int(rng.integers(99))} ({word().title()}{word().title()})", f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}", f"{key}: {word()}", f"forgot {key}? {word()}"])
            out.append((f"{before} {calm} {after}".strip(), []))
    return out


def labelled_windows(text: str, before: int = 60, after: int = 40, calm: int = 160) -> list[tuple[str, list[tuple[int, int]]]]:
    """Pieces of a document around its pattern matches, whose values are the secrets; of one without any, ``calm`` code points from where a hash says."""
    values = [(s + ASSIGN.match(text, s).start(2) - s if kind == "assign" else s, e) for s, kind, e in base_spans(text)]
    out, at = [], 0
    for v, e in values:
        a, b = max(at, v - before), min(len(text), e + after)
        if a < v:
            out.append((text[a:b], [(max(x, a) - a, min(y, b) - a) for x, y in values if a <= x and y <= b]))
        at = e
    if not values:
        a = int(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % max(1, len(text) - calm + 1)
        out.append((text[a : a + calm], []))
    return out


def fit(examples: list[tuple], rounds: int = 80, step: float = 0.3, l2: float = 1e-4) -> Field:
    """Maximum likelihood by full-batch adaptive gradient steps; forward-backward runs over all sequences at once.

    examples: (text, secret spans) or (text, secret spans, features of the file it is from, by default its own).
    """
    names: dict[str, int] = {}
    sequences = []
    for text, spans, *of in examples:
        matches = list(TOKEN.finditer(text))
        if not matches:
            continue
        tokens, tags, whole = [m[0] for m in matches], [], of[0] if of else file_features(text)
        for m in matches:
            inside = next(((s, e) for s, e in spans if s <= m.start() < e), None)
            tags.append(O if inside is None else B if not tags or tags[-1] == O or m.start() == inside[0] else I)
        rows = []
        for i, t in enumerate(tokens):
            f = [(n, 1.0) for n in (*shape(t), *whole)]
            for n, v in (("before", i - 1), ("before", i - 2)):
                if v >= 0:
                    f.append((f"{n}:{as_neighbour(tokens[v])}", 1.0 if v == i - 1 else 0.5))
            if i + 1 < len(tokens):
                f.append(("after:" + as_neighbour(tokens[i + 1]), 1.0))
            rows.append([(names.setdefault(n, len(names)), x) for n, x in f])
        sequences.append((rows, tags))
    if not sequences:
        return Field()
    n, longest = len(sequences), max(len(t) for _, t in sequences)
    tag = np.full((n, longest), -1)
    seq, pos, col, val = [], [], [], []
    for s, (rows, tags) in enumerate(sequences):
        tag[s, : len(tags)] = tags
        for p, row in enumerate(rows):
            for c, x in row:
                seq.append(s)
                pos.append(p)
                col.append(c)
                val.append(x)
    cell, col, val = np.array(seq) * longest + np.array(pos), np.array(col), np.array(val)
    live = tag >= 0
    w, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    moves[O, I] = -100.0  # inside follows begin or inside only
    gold = np.zeros((n, longest, 3))
    gold[live, tag[live]] = 1
    gold_moves = np.zeros((3, 3))
    both = live[:, 1:]
    np.add.at(gold_moves, (tag[:, :-1][both], tag[:, 1:][both]), 1)
    sums_w, sums_m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    length = live.sum(axis=1)
    for _ in range(rounds):
        e = np.stack([np.bincount(cell, w[col, k] * val, minlength=n * longest) for k in range(3)], axis=-1).reshape(n, longest, 3)
        # probabilities, scaled to sum to 1 at each position; beyond a sequence's end, beta stays 1
        e = np.exp(e - e.max(axis=-1, keepdims=True))
        m = np.exp(moves)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((n, longest))
        for t in range(longest):
            now = (alpha[:, t - 1] @ m if t else np.exp(START)) * e[:, t]
            scale[:, t] = now.sum(axis=-1)
            alpha[:, t] = now / scale[:, t, None]
        for t in range(longest - 2, -1, -1):
            back = ((e[:, t + 1] * beta[:, t + 1]) @ m.T) / scale[:, t + 1, None]
            beta[:, t] = np.where((t + 1 < length)[:, None], back, 1)
        p = alpha * beta * live[:, :, None]
        ahead = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * both[:, :, None]
        pairs = np.einsum("nti,ntj->ij", alpha[:, :-1], ahead) * m
        d = ((gold - p) / n).reshape(-1, 3)
        g = np.stack([np.bincount(col, d[cell, k] * val, minlength=len(names)) for k in range(3)], axis=-1) - l2 * w
        gm = (gold_moves - pairs) / n
        gm[O, I] = 0
        sums_w += g * g
        sums_m += gm * gm
        w += step * g / np.sqrt(sums_w)
        moves += step * gm / np.sqrt(sums_m)
    return Field({k: w[i] for k, i in names.items()}, moves)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, windows: int = 1500, made_up: int = 1500, a_document: int = 20, longest: int = 300) -> Field:
    """Fit on windows of the ``sample_rows`` documents with the smallest identifier hashes, and on made-up lines.

    Each document gives at most ``a_document`` windows of under ``longest`` code points, cut on the executors from its whole
    text, with the features of the whole file; ``windows`` bounds their number, by the smallest hashes. Made-up lines take the
    file features of the windows in turn, as if they stood in these files. Null identifiers are left out, null texts are
    empty, repeated rows count as often; an empty table leaves the made-up lines.
    """
    ship(docs.sparkSession)
    sample = docs.select(F.col(id_col).alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    got = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t")).join(F.broadcast(sample), "id")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, w, ",".join(f"{s}:{e}" for s, e in spans), " ".join(file_features(t))) for i, t in zip(f["id"], f["t"], strict=True) for w, spans in labelled_windows(t)[:a_document] if len(w) < longest]
            yield pd.DataFrame(rows, columns=["id", "w", "spans", "file"])

    found = got.mapInPandas(cut, "id long, w string, spans string, file string").orderBy(F.xxhash64("id", "w"), "w").limit(windows).collect()
    examples = [(r["w"], [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x], tuple(r["file"].split())) for r in found]
    files = [f for *_, f in examples] or [()]
    return fit(examples + [(*line, files[i % len(files)]) if files[0] else line for i, line in enumerate(made_up_lines(made_up))])


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def all_spans(texts: list[str], model: Field) -> list[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]]:
    """For each text: pattern spans; these and the field's further spans, by start and then kind."""
    out = []
    for text, found in zip(texts, model.spans_of(texts), strict=True):
        base = base_spans(text)
        more = [(s, "model", e) for s, e in found if all(e <= x or s >= y for x, _, y in base)]
        out.append((base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))))
    return out


def secret_spans(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): ``kind:start:end`` of pattern spans and of all spans, joined by commas; one row per row of ``docs``.

    Whole texts are scanned, however long; null texts count as empty and have no spans; ties at one start go by kind. Repeated
    rows and null identifiers stay; columns other than the two are not carried, so no name clashes; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = Field(*shared.value)
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                got = all_spans(part["t"].tolist(), crf)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "base": [joined(b) for b, _ in got], "spans": [joined(s) for _, s in got]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t"))
    return rows.mapInPandas(scan, f"id {kind}, base string, spans string").withColumnRenamed("id", id_col)


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by ``[kind]``."""
    out, last = [], 0
    for k, s, e in (x.split(":") for x in spans.split(",") if x):
        if int(s) >= last:
            out += [text[last : int(s)], f"[{k}]"]
        last = max(last, int(e))
    return "".join([*out, text[last:]])


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
