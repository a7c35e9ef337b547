"""Toxicity by weak supervision.

1. A bounded sample of labelled documents outside the held-out fold gives
   lexicons: words and word beginnings that toxic documents use.
2. Voters are those terms and patterns over them (several distinct hits,
   density, shouting, none at all). A generative model with accuracies and
   correlations turns votes into posterior labels.
3. A linear classifier on term counts learns the posteriors and scores every
   whole text. Only the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, record_batch, text_bytes
from .label_model import fit_linear, fit_posteriors, sigmoid

#: Labelled documents that are used at most, the smallest hashes of doc_id first.
SAMPLE = 12_000
#: Terms that vote.
TERMS = 256
#: Toxic documents that must use a term.
LEAST = 4
STEMS = (3, 4, 5, 6, 7)
FOLDS = 5

_NOT_WORD = bytes(b if (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 0x80) else 32 for b in range(256))
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id's decimal text modulo ``FOLDS``; 0 is held out. Null is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0))


def terms_of(word: str) -> list[str]:
    """The word itself (``=word``) and its proper beginnings."""
    return [f"={word}", *[word[:n] for n in STEMS if len(word) > n]]


@dataclass
class Words:
    """Distinct words of a batch of texts, and each text's word numbers."""

    words: list[str]
    index: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Words:
        plain = [t.translate(_NOT_WORD).translate(_FOLD) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(plain, type=pa.binary()).view(pa.string()))
        coded = split.values.dictionary_encode()
        words = [w.decode("utf-8", "replace") for w in coded.dictionary.view(pa.binary()).to_pylist()]
        return Words(words, coded.indices.to_numpy(), split.offsets.to_numpy())

    def of_text(self, i: int) -> np.ndarray:
        return self.index[self.ends[i] : self.ends[i + 1]]


@dataclass
class Lexicon:
    """Term numbers, and which terms are strong on their own."""

    terms: list[str]
    strong: np.ndarray

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Uses of each term by text, and the number of words."""
        number = {t: i for i, t in enumerate(self.terms)}
        held = Words.of(texts)
        hits: dict[int, list[int]] = {}
        for k, word in enumerate(held.words):
            found = [number[t] for t in terms_of(word) if t in number]
            if found:
                hits[k] = found
        hot = np.zeros(len(held.words) + 1, dtype=bool)
        hot[list(hits)] = True
        out = np.zeros((len(texts), len(self.terms)), dtype=np.float32)
        for i in range(len(texts)):
            own = held.of_text(i)
            for k, n in Counter(own[hot[own]].tolist()).items():
                out[i, hits[k]] += n
        return out, np.diff(held.ends).astype(np.float32)

    def features(self, counts: np.ndarray, words: np.ndarray, texts: list[bytes]) -> np.ndarray:
        hits = counts[:, self.strong].sum(axis=1)
        distinct = (counts[:, self.strong] > 0).sum(axis=1)
        more = [np.log1p(hits), np.log1p(distinct), hits / np.maximum(1, words), (hits > 1).astype(float)]
        return np.column_stack([np.log1p(counts), *more])

    def votes(self, counts: np.ndarray, words: np.ndarray, texts: list[bytes]) -> np.ndarray:
        strong = counts[:, self.strong]
        hits, distinct = strong.sum(axis=1), (strong > 0).sum(axis=1)
        loud = np.array([t.count(b"!") > 2 + len(t) // 200 for t in texts], dtype=bool)
        caps = np.array([sum(map(t.count, (b" A", b" E", b" I", b" T"))) * 30 > len(t) + 30 for t in texts], dtype=bool)
        patterns = [
            hits > 0, hits > 1, hits > 3, distinct > 1, distinct > 2, hits > 0.01 * words, hits > 0.03 * words,
            hits == 0, distinct <= 1, hits < 0.002 * words, loud, caps,
        ]
        return np.column_stack([counts > 0, *patterns]).astype(np.float64)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    base: float
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.lexicon.terms:
            return np.full(len(texts), self.base)
        counts, words = self.lexicon.counts(texts)
        x = self.lexicon.features(counts, words, texts)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``size`` labelled documents outside the held-out fold, written once.

    A document with several labels has the largest; null labels are none.
    """
    own = labels.where(F.col("toxic").isNotNull() & (fold_of() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # bounded, so it can be broadcast
    rows = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.dropDuplicates(["doc_id"]).select("text", F.col("toxic").cast("int").alias("toxic"))
    return materialise(rows, "sample")


def _term_counts(sample: DataFrame) -> DataFrame:
    """``term, a, b``: toxic and clean documents that use a term."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            held = Words.of(batch.column(0).to_pylist())
            terms = [terms_of(w) if w else [] for w in held.words]
            found: Counter = Counter()
            for i, toxic in enumerate(batch.column(1).to_pylist()):
                found.update((t, toxic) for t in set().union(*(terms[k] for k in set(held.of_text(i).tolist()))))
            keys = list(found)
            return record_batch(
                term=pa.array([k[0] for k in keys], type=pa.string()),
                toxic=pa.array([k[1] for k in keys], type=pa.int32()),
                n=pa.array([found[k] for k in keys], type=pa.int64()),
            )

        return step

    counted = map_batches(sample, make, "term string, toxic int, n bigint")
    of = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    return counted.groupBy("term").agg(of(1).alias("a"), of(0).alias("b"))


def induce_lexicon(sample: DataFrame, toxic: int, clean: int) -> Lexicon:
    """The terms that most favour toxic documents, by log-likelihood ratio."""
    a, b = F.col("a"), F.col("b")
    in_toxic, in_clean = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
    p = (a + b + 1) / (toxic + clean + 2)
    gain = a * F.log(in_toxic / p) + b * F.log(in_clean / p)
    gain += (F.lit(toxic) - a) * F.log((1 - in_toxic) / (1 - p)) + (F.lit(clean) - b) * F.log((1 - in_clean) / (1 - p))
    ranked = _term_counts(sample).where(a >= LEAST).where(in_toxic > 2 * in_clean).withColumn("gain", gain).where("gain > 3.0")
    best = ranked.orderBy(F.desc("gain"), "term").limit(TERMS).collect()
    strong = [r["a"] / (r["a"] + r["b"]) > 0.8 and r["a"] >= 2 * LEAST for r in best]
    return Lexicon([r["term"] for r in best], np.array(strong, dtype=bool))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Learn from a bounded sample; without labels of both kinds every score is the share of toxic ones."""
    sample = labelled_sample(docs, labels, size)
    shares = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = shares.get(1, 0), shares.get(0, 0)
    base = toxic / (toxic + clean) if toxic + clean else 0.0
    none = Model(Lexicon([], np.zeros(0, dtype=bool)), np.zeros(1), base)
    if not toxic or not clean:
        return none
    lexicon = induce_lexicon(sample, toxic, clean)
    if not lexicon.terms:
        return none

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(0).to_pylist()
            counts, words = lexicon.counts(texts)
            x = lexicon.features(counts, words, texts).astype("<f4")
            votes = lexicon.votes(counts, words, texts).astype("u1")
            pack = lambda rows: pa.array([r.tobytes() for r in rows], type=pa.binary())
            return record_batch(x=pack(x), votes=pack(votes), toxic=batch.column(1))

        return step

    table = map_batches(sample, make, "x binary, votes binary, toxic int").toArrow()  # at most ``size`` rows
    width = len(lexicon.terms) + 4
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f4").reshape(-1, width)
    votes = np.frombuffer(b"".join(table["votes"].to_pylist()), "u1").reshape(len(x), -1)
    strong = votes[:, : len(lexicon.terms)][:, lexicon.strong].sum(axis=1)
    start = np.where(strong > 1, 0.9, np.where(strong == 1, 0.5, 0.05))
    start = (start + np.where(table["toxic"].to_numpy() == 1, 0.95, 0.02)) / 2
    used = votes.std(axis=0) > 0
    q, rates, correlations = fit_posteriors(votes[:, used], start, base)
    return Model(lexicon, fit_linear(x, q), base, rates, correlations)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; a null text is empty.

    Repeated rows stay; a null doc_id counts as held out; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = model.score(batch.column(2).to_pylist())
            predicted = pa.array((found >= 0.5).astype(np.int32))
            return record_batch(doc_id=batch.column(0), held_out=batch.column(1), score=pa.array(found, type=pa.float64()), predicted=predicted)

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), (fold_of() == 0).alias("held_out"), text_bytes())
    return map_batches(rows, make, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Fit and score; see ``fit`` and ``score``."""
    return score(docs, fit(docs, labels, size))


def drop_toxic(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more, all columns as they are."""
    model = fit(docs, labels, size)
    at = docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            return batch.filter(pa.array(model.score(texts) < 0.5))

        return step

    return map_batches(docs, make, docs.schema)
