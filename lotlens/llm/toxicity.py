"""Toxicity classifier: sparse logistic regression with counterfactual regularisation.

Features are hashed words and word starts (so that unseen inflections of a learned word still count). Besides the labelled
loss, training penalises the squared change of score between a labelled text and its counterfactual copies: where it holds
identity terms, each is swapped for another or left out; where it holds none, one is put in. A neutral mention of a group so
carries no weight of its own, and the terms' features always stay in the model, to be held down.

Training takes a bounded sample of the labelled rows (``train_rows``, the smallest identifier hashes); scoring takes every
whole text. Only the text is an input of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import ship

#: Group terms whose exchange must not change a score.
IDENTITY_TERMS = tuple(
    """women men woman man girls boys female male gay lesbian bisexual transgender trans queer straight heterosexual homosexual
    muslim muslims christian christians jewish jews jew hindu hindus buddhist buddhists catholic catholics atheist atheists
    black white asian african american european latino latina hispanic arab arabs indian chinese mexican immigrant immigrants
    refugee refugees foreigner foreigners disabled blind deaf autistic old young elderly poor
    mujeres hombres musulmanes cristianos judíos negros blancos inmigrantes homosexuales gitanos
    femmes hommes musulmans chrétiens juifs noirs blancs immigrés homosexuels arabes
    frauen männer muslime christen juden schwarze weiße einwanderer homosexuelle ausländer behinderte""".split()
)
PLACE = {t: i for i, t in enumerate(IDENTITY_TERMS)}
BITS = 18
WORD = re.compile(r"\w+")
STARTS = (4, 5, 6)


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and, where it is longer, its starts."""
    h = xxhash.xxh32_intdigest
    return [h(word, 7) & ((1 << BITS) - 1), *(h(word[:n], n) & ((1 << BITS) - 1) for n in STARTS if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counts(words: set[str]) -> np.ndarray:
    """The distinct features (f) of distinct words, and in how many of these words each stands (n)."""
    f, n = np.unique(np.array([x for w in words for x in features(w)], dtype=np.int32), return_counts=True)
    return np.rec.fromarrays([f, n.astype(np.int32)], names="f,n")


def swapped(text: str, turn: int | None) -> str:
    """The text with every identity term replaced by the one ``turn`` places on in the list, or left out; other words stay."""
    other = lambda i: "" if turn is None else IDENTITY_TERMS[(i + turn) % len(IDENTITY_TERMS)]
    return WORD.sub(lambda m: m[0] if (i := PLACE.get(m[0].lower())) is None else other(i), text)


def counterfactuals(text: str | None, swaps: int = 2) -> tuple[bool, list[str]]:
    """Whether the text holds identity terms, and its copies; a hash of the text picks the terms.

    With terms: copies where they are swapped, and one where they are left out (else all terms could come to weigh alike, but
    heavily). Without: a copy with one put in.
    """
    text = text or ""
    h = xxhash.xxh64_intdigest(text, 3)
    if PLACE.keys() & words_of(text):
        return True, [swapped(text, 1 + (h + i * 31) % (len(IDENTITY_TERMS) - 1)) for i in range(swaps)] + [swapped(text, None)]
    return False, [f"{text} {IDENTITY_TERMS[h % len(IDENTITY_TERMS)]}"]


def changes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The features whose count differs between two texts (or the words that only one of them has), with the difference."""
    f = np.concatenate([before["f"], after["f"]])
    n = np.concatenate([-before["n"], after["n"]])
    at, place = np.unique(f, return_inverse=True)
    n = np.bincount(place, n, minlength=len(at)).astype(np.int32)
    return np.rec.fromarrays([at[n != 0], n[n != 0]], names="f,n")


class Model:
    """weights (2**BITS floats) and bias; score = logistic(bias + sum over distinct words of their features' weights)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        cache, z = self.cache, self.bias
        if len(cache) > 250_000:
            cache.clear()
        for w in words_of(text):
            v = cache.get(w)
            if v is None:
                v = cache[w] = float(self.weights[features(w)].sum())
            z += v
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _flat(rows: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the features that have a place."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows = [r[place[r["f"]] >= 0] for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return row, place[np.concatenate([r["f"] for r in rows])], np.concatenate([r["n"] for r in rows]).astype(np.float64)


def fit(rows_of: list[np.ndarray], labels: np.ndarray, swaps_of: list[tuple[int, bool, np.ndarray]] = (), decide: float = 0.7, swap_weight: float = 4.0, l1: float = 5e-5, l2: float = 1e-5, rounds: int = 1000, settled: float = 1e-6) -> Model:
    """Accelerated proximal gradient on the logistic loss, the counterfactual penalty and L1/L2 terms, until no weight moves by ``settled``.

    swaps_of: (row, whether it holds terms of its own, changed features) of each counterfactual copy. Swapped copies and
    copies with a term put in each count as one mean of squared score changes; a ``swap_weight`` of 0 leaves them all out.

    Most toxic texts hold several telling words, which would make one alone count for little; so the bias is then set such that
    ``decide`` is the score at the cut with the best F1 on the training rows, in the middle of its gap; a row counts there with
    the lowest score of it and its swapped copies, so that no mention decides. A cut lies above the
    score of no evidence: where the labels give no telling feature (few rows, one class), the bias is the base rate's, at most
    one half, and no text is decided toxic. No rows: every score is near 0.
    """
    y, swaps_of = np.asarray(labels, dtype=np.float64), swaps_of if swap_weight else ()
    if not len(y) or y.sum() in (0, len(y)):
        return Model(np.zeros(1 << BITS), -30.0 if not y.sum() else 0.0)
    # Features that speak for the label: their share of positives lies above the base rate. Common words speak for nothing.
    n, pos, base = np.zeros(1 << BITS), np.zeros(1 << BITS), y.mean()
    for r, label in zip(rows_of, y, strict=True):
        n[r["f"]] += 1
        pos[r["f"]] += label
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (pos - n * base) / np.sqrt(n * base * (1 - base))
    use = (n >= 4) & (np.nan_to_num(z) >= 5)
    telling = use.any()
    use[[f for t in IDENTITY_TERMS for f in features(t)]] = True
    live = np.flatnonzero(use)
    place = np.full(1 << BITS, -1)
    place[live] = np.arange(len(live))
    row, col, times = _flat(rows_of, place)
    of = np.array([i for i, _, _ in swaps_of], dtype=np.int64)
    own = np.array([o for _, o, _ in swaps_of], dtype=bool)
    pair, pcol, ptimes = _flat([d for *_, d in swaps_of], place)
    share = np.where(own, 1 / max(1, own.sum()), 1 / max(1, (~own).sum()))
    rows = len(y)
    z0 = float(np.log(base / (1 - base)))
    w, b = np.zeros(len(live)), z0
    v, vb, t = w.copy(), b, 1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    fan = np.bincount(row, times, minlength=rows)
    step = 4.0 / (1 + np.mean(fan**2) ** 0.5 + 4 * swap_weight)
    for _ in range(rounds if telling else 0):
        at = vb + np.bincount(row, v[col] * times, minlength=rows)
        p = sigmoid(at)
        d = (p - y) / rows
        q = sigmoid(at[of] + np.bincount(pair, v[pcol] * ptimes, minlength=len(of)))
        pull = 2 * swap_weight * share * (p[of] - q)
        there = -pull * q * (1 - q)
        d += np.bincount(of, pull * p[of] * (1 - p[of]) + there, minlength=rows)
        g = np.bincount(col, d[row] * times, minlength=len(w)) + np.bincount(pcol, there[pair] * ptimes, minlength=len(w)) + l2 * v
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - step * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(np.abs(new - w).max(), abs(nb - b))
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
        if moved < settled:
            break
    weights = np.zeros(1 << BITS)
    weights[live] = w
    z = np.bincount(row, w[col] * times, minlength=rows)
    other = z[of] + np.bincount(pair, w[pcol] * ptimes, minlength=len(of))
    np.minimum.at(z, of[own], other[own])  # what is left of the evidence in the mildest copy
    order = np.argsort(-z, kind="stable")
    z, found = z[order], np.cumsum(y[order])
    below = np.maximum(np.append(z[1:], 0), 0)
    f1 = np.where(z > below + 1e-9, 2 * found / (np.arange(1, rows + 1) + y.sum()), 0)
    at = int(f1.argmax())
    if not f1[at]:
        return Model(weights * 0, min(z0, 0.0))
    return Model(weights, float(np.log(decide / (1 - decide)) - (z[at] + below[at]) / 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, train_rows: int = 5000, **options) -> Model:
    """Fit on the ``train_rows`` labelled rows with the smallest hashes of their identifier.

    usable: which labels may be learned from. Null labels and identifiers are left out; an identifier that is labelled twice
    counts with its larger label, one that ``docs`` repeats with each of its texts. The sample's identifiers (bounded by
    ``train_rows``) are broadcast, so that the texts are filtered, and copied counterfactually, where they are read; the driver
    gets counts of hashed features. Empty tables give a model whose scores are all near 0.
    """
    ship(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna().where(usable if usable is not None else F.lit(True))
    sample = rows.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    got = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, y, text in zip(f["__id"], f["__y"], f["__t"], strict=True):
                own, copies = counterfactuals(text)
                words, others = words_of(text), map(words_of, copies)
                rows.append((int(i), int(y), counts(words).tobytes(), own, [changes(counts(words - c), counts(c - words)).tobytes() for c in others]))
            yield pd.DataFrame(rows, columns=["id", "y", "counts", "own", "swaps"])

    found = got.mapInPandas(split, "id long, y int, counts binary, own boolean, swaps array<binary>").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["counts"])))
    read = lambda data: np.frombuffer(bytes(data), dtype=[("f", np.int32), ("n", np.int32)])
    swaps = [(i, r["own"], read(s)) for i, r in enumerate(found) for s in r["swaps"]]
    return fit([read(r["counts"]) for r in found], np.array([r["y"] for r in found]), swaps, **options)


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: 0 to 1, higher is likelier toxic; one row per row of ``docs``, repeats with equal scores.

    Null and empty texts get the score of no words; whole texts are read, however long. A column of ``docs`` named ``out_col``
    is replaced, other columns stay as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    at = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((at.astype(np.int32), model.weights[at], model.bias))  # at most 2**BITS weights

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        where, values, bias = shared.value
        weights = np.zeros(1 << BITS)
        weights[where] = values
        m = Model(weights, bias)
        for texts in batches:
            yield texts.map(m.score, na_action=None).astype("float64")

    return docs.withColumn(out_col, score(F.col(text_col)))
