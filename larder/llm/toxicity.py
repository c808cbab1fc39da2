"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over the presence of words and word beginnings is trained in numpy from confirmed toxic texts and
unlabelled ones (any texts, whatever their label). Its risk is the class-prior-corrected one: prior * R+(positives) plus the part of the
unlabelled texts' negative risk that the prior leaves, held at zero or above (when it would go below,
the step goes up that part instead). Features are kept where, at the class
prior, most of the texts that have them would be toxic; a proximal step keeps their weights sparse.

The fit takes at most MAX_POSITIVE toxic and MAX_UNLABELLED unlabelled training texts, those of the lowest
id hashes; equal texts and near copies count once. Null texts count as empty and score by the bias; without positives
every score is the prior; texts of any length are scored whole; a score of exactly 0.5 counts as toxic in the
query; repeated rows score alike; a column named score is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import as_texts, map_batches

MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
MIN_TEXTS, MIN_SHARE, PRECISION, STEPS, RATE, SPARSE = 4, 0.004, 0.6, 200, 0.1, 1e-4
SKETCH = 8
#: The prior where no row tells it, and how many labelled rows it weighs as much as.
PRIOR, PRIOR_ROWS = 0.05, 20
WORD = re.compile(r"\w+").findall


#: Lengths of the beginnings of longer words that are features too, so that a stem counts whatever ends it.
STEMS = (4, 5, 6, 7)


def _beginnings(whole: set[str], size: int) -> Counter[str]:
    return Counter([w[:size] for w in whole if len(w) > size])


def features(text: str) -> set[str]:
    """The words of a text, and the beginnings of one, two and three or more of its longer words, with as many stars."""
    whole = set(WORD(text.lower()))
    out = set(whole)
    for size in STEMS:
        for stem, n in _beginnings(whole, size).items():
            out.add(stem + "*")
            if n > 1:
                out.add(stem + "**")
                if n > 2:
                    out.add(stem + "***")
    return out


def families(texts: list[str]) -> list[str]:
    """One text of each group of near copies: texts of which half the SKETCH least shingle hashes agree with an earlier one's are left out."""
    holders: dict[int, list[int]] = {}
    kept = []
    for text in texts:
        w = text.encode().lower().split()
        sketch = sorted({zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:SKETCH]
        agreeing = Counter(k for h in sketch for k in holders.get(h, ()))
        if agreeing and 2 * max(agreeing.values()) >= len(sketch):
            continue
        for h in sketch:
            holders.setdefault(h, []).append(len(kept))
        kept.append(text)
    return kept


def fit(positive: list[str], unlabelled: list[str], prior: float) -> dict:
    """weights by word, and the bias."""
    prior = min(max(prior, 1e-3), 0.999)
    base = math.log(prior / (1 - prior))
    if not positive:
        return {"weights": {}, "bias": base}
    positive, unlabelled = families(positive), families(unlabelled)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in sorted(features(t))], np.int32) for t in [*positive, *unlabelled]]
    seen = np.bincount(np.concatenate([*docs, np.zeros(0, np.int32)]), minlength=len(number))
    n_pos = len(positive)
    in_pos = np.bincount(np.concatenate([*docs[:n_pos], np.zeros(0, np.int32)]), minlength=len(number))
    # the share of toxic texts among those that have a feature, at the class prior
    precision = prior * (in_pos / n_pos) / ((seen - in_pos + 1) / max(1, len(unlabelled)))
    kept = np.flatnonzero((in_pos >= max(MIN_TEXTS, n_pos * MIN_SHARE)) & (precision >= PRECISION))
    w, b = _descend(docs, kept, n_pos, prior, base, SPARSE)
    names = list(number)
    return {"weights": {names[k]: float(x) for k, x in zip(kept, w, strict=True) if x}, "bias": float(b)}


def _descend(docs: list[np.ndarray], kept: np.ndarray, n_pos: int, prior: float, base: float, sparse: float) -> tuple[np.ndarray, float]:
    """Weights of the kept words and the bias, by proximal Adam steps on the non-negative risk; positives come first."""
    size = max((int(d.max()) + 1 for d in docs if len(d)), default=0)
    column = np.full(max(size, int(kept.max(initial=-1)) + 1), -1, np.int32)
    column[kept] = np.arange(len(kept), dtype=np.int32)
    docs = [c[c >= 0] for c in (column[d] for d in docs)]
    flat = np.concatenate([*docs, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at_pos = np.arange(len(docs)) < n_pos
    share = np.where(at_pos, 1 / n_pos, 1 / max(1, len(docs) - n_pos))
    w, b = np.zeros(len(kept)), base
    m1, m2, mb1, mb2 = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(row, w[flat], minlength=len(docs)) + b, -60, 60)
        p = 1 / (1 + np.exp(-z))
        as_negative = np.logaddexp(0, z) * share
        rest = as_negative[~at_pos].sum() - prior * as_negative[at_pos].sum()
        negative = np.where(at_pos, -prior * p, p) * share  # slope of the negative part
        slope = np.where(at_pos, prior * (p - 1), 0) * share + negative if rest >= 0 else -negative
        g, gb = np.bincount(flat, slope[row], minlength=len(kept)), slope.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(m2 / fix2) + 1e-4)
        w = w - scale * m1 / fix1
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparse, 0)
        b -= RATE * (mb1 / fix1) / (math.sqrt(mb2 / fix2) + 1e-4)
    return w, float(b)


class Scorer:
    """Scores texts by a model, looking only for the beginnings it knows."""

    def __init__(self, model: dict):
        self.bias, self.words, self.stems = model["bias"], {}, {}
        for name, weight in model["weights"].items():
            stem = name.rstrip("*")
            if stars := len(name) - len(stem):
                self.stems.setdefault(len(stem), {}).setdefault(stem, [0.0] * 3)[stars - 1] = weight
            else:
                self.words[name] = weight

    def __call__(self, text: str) -> float:
        whole = set(WORD(text.lower()))
        found = [self.words[w] for w in whole.intersection(self.words)]
        for size, known in self.stems.items():
            begun = _beginnings(whole, size)
            for stem in begun.keys() & known.keys():
                found += known[stem][: begun[stem]]
        z = self.bias + math.fsum(found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def sampled(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(text, toxic): one text, the least, of each id chosen from the ids and labels alone; at most as many as the limits."""
    order = F.xxhash64("doc_id")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    positive = ids.join(toxic, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive).withColumn("toxic", F.lit(True))
    unlabelled = ids.orderBy(order, "doc_id").limit(max_unlabelled).withColumn("toxic", F.lit(False))
    rows = docs.select("doc_id", "text").join(F.broadcast(positive.union(unlabelled)), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """The model of docs (doc_id, text) and labels (doc_id, toxic), fitted to the sample in one task."""
    known, bad = labels.where("toxic IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (bad + PRIOR * PRIOR_ROWS) / (known + PRIOR_ROWS)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bool, set[str]] = {True: set(), False: set()}
        for batch in batches:
            for text, is_toxic in zip(as_texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                texts[is_toxic].add(text)
        model = fit(sorted(texts[True]), sorted(texts[False]), prior)
        yield pa.RecordBatch.from_pylist([{"words": list(model["weights"]), "weights": list(model["weights"].values()), "bias": model["bias"]}], schema=pa.schema([("words", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    got = sampled(docs, labels, max_positive, max_unlabelled).repartition(1).mapInArrow(fitted, "words array<string>, weights array<double>, bias double").first()
    if got is None:
        return fit([], [], prior)
    return {"weights": dict(zip(got["words"], got["weights"], strict=True)), "bias": got["bias"]}


def classify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) of the whole text."""

    def make():
        score = Scorer(model)
        return lambda batch: [pa.array([score(t) for t in as_texts(batch.column(text))], pa.float64())]

    return map_batches(docs, make, "score double", keep)
