"""Toxicity by a factorization machine over hashed terms.

Terms are 64-bit hashes of words, of their first bytes (insults are often built on one stem) and of "at least so
often in this document". A factorization machine gives each chosen term a weight and a short vector; two terms add
the inner product of their vectors, so that words which are harmless alone count when they meet.

The model is fitted on a bounded sample of labelled rows (``positives`` and ``negatives``, chosen by hash of the id):
terms are screened against the labels first, then weights and vectors are learned together. Its size is bounded by
``terms``, and every document is scored by it over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, narrow
from .quality_divergence import _lowered
from .textbytes import Slice, mix, owners, slices


@dataclass(frozen=True)
class Machine:
    positives: int = 3_000  # bounds of the labelled sample
    negatives: int = 6_000
    terms: int = 4_096
    least_documents: int = 4  # toxic documents of the sample that a term must occur in
    prefixes: tuple[int, ...] = (5, 6, 7, 8)  # bytes
    often: tuple[int, ...] = (1, 2, 3)
    factors: int = 6
    rounds: int = 250
    step: float = 0.05
    shrink: float = 2e-4
    seed: int = 11


def base_terms(s: Slice, plan: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and word beginning, with repetitions."""
    words, starts, ends, first = _lowered(s)
    doc = owners(first)
    found, of = [words], [doc]
    prefix = s.prefix(lower=True)
    for k in plan.prefixes:
        long_enough = ends - starts >= k
        found.append(mix(s.fingerprints(starts[long_enough], starts[long_enough] + k, lower=True, prefix=prefix) + np.uint64(k)))
        of.append(doc[long_enough])
    return np.concatenate(of), np.concatenate(found)


def counted_terms(doc: np.ndarray, term: np.ndarray, plan: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) pairs without repetition; a term that occurs n times gives one term for each bound up to n."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])) if len(doc) else np.zeros(0, bool)
    times = np.diff(np.append(np.flatnonzero(new), len(doc)))
    doc, term = doc[new], term[new]
    parts = [(doc[times >= m], variant(term[times >= m], m)) for m in plan.often]
    return np.concatenate([d for d, _ in parts]), np.concatenate([t for _, t in parts])


def variant(term: np.ndarray, times: int) -> np.ndarray:
    return mix(term + np.uint64(times * 0x1F83D9AB))


@dataclass
class Model:
    """Sorted terms, their weights and vectors; ``bases`` are the hashes that the terms are variants of."""

    bases: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def gate(self) -> np.ndarray:
        """One flag per value of a hash's first 20 bits; most hashes of a text end here."""
        flags = np.zeros(1 << 20, dtype=bool)
        flags[(self.bases >> np.uint64(44)).astype(np.int64)] = True
        return flags


def margins(doc: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray, vectors: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's margin, and its sum of vectors."""
    total = np.stack([np.bincount(doc, weights=vectors[at, f], minlength=n) for f in range(vectors.shape[1])], axis=1)
    squares = np.bincount(doc, weights=(vectors**2).sum(axis=1)[at], minlength=n)
    return bias + np.bincount(doc, weights=weights[at], minlength=n) + 0.5 * ((total**2).sum(axis=1) - squares), total


def _fit(doc: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, n_terms: int, plan: Machine) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on the weighted logistic loss of all rows at once."""
    rng = np.random.default_rng(plan.seed)
    n = len(label)
    bias = np.array([np.log(weight[label == 1].sum() / max(weight[label == 0].sum(), 1e-9))])
    state = [bias, np.zeros(n_terms), rng.normal(0, 0.03, (n_terms, plan.factors))]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for round_ in range(1, plan.rounds + 1):
        margin, total = margins(doc, at, n, state[1], state[2], state[0][0])
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label) / weight.sum() * 100
        pull = error[doc]
        by_vector = np.stack([np.bincount(at, weights=pull * (total[doc, f] - state[2][at, f]), minlength=n_terms) for f in range(plan.factors)], axis=1)
        slopes = [np.array([error.sum()]), np.bincount(at, weights=pull, minlength=n_terms) + plan.shrink * state[1], by_vector + plan.shrink * state[2]]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            state[k] = state[k] - plan.step * (first[k] / (1 - 0.9**round_)) / (np.sqrt(second[k] / (1 - 0.999**round_)) + 1e-8)
    return state[1], state[2], float(state[0][0])


def _screen(doc: np.ndarray, term: np.ndarray, label: np.ndarray, plan: Machine) -> np.ndarray:
    """The terms that separate the labels best, by the z value of their rates; both directions count."""
    keys, found = np.unique(term[label[doc] == 1], return_counts=True)
    keys = keys[found >= plan.least_documents]
    if not len(keys):
        return keys
    at = np.minimum(np.searchsorted(keys, term), len(keys) - 1)
    hit = keys[at] == term
    yes = np.bincount(at[hit], weights=label[doc[hit]], minlength=len(keys))
    no = np.bincount(at[hit], weights=1 - label[doc[hit]], minlength=len(keys))
    n_yes, n_no = max(label.sum(), 1), max((1 - label).sum(), 1)
    rate = (yes + no + 1) / (n_yes + n_no + 2)
    z = ((yes + 0.5) / (n_yes + 1) - (no + 0.5) / (n_no + 1)) / np.sqrt(rate * (1 - rate) * (1 / n_yes + 1 / n_no))
    best = np.lexsort((keys, -np.abs(z)))[: plan.terms]
    return np.sort(keys[best[np.abs(z[best]) >= 4]])


_MODEL_SCHEMA = "kind string, term long, weight double, vector array<double>"


def _train(plan: Machine, yes_weight: float, no_weight: float):
    """mapInArrow step over the whole bounded sample: the model as rows."""

    def run(source):
        docs, bases, labels, n = [], [], [], 0
        for batch in source:
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            for i, j, s in slices(batch.column("text")):
                doc, term = base_terms(s, plan)
                docs.append(doc + n)
                bases.append(term)
                labels.append(toxic[i:j])
                n += s.n
        if not n or not 0 < sum(x.sum() for x in labels) < n:
            return
        doc, base, label = np.concatenate(docs), np.concatenate(bases), np.concatenate(labels)
        pair_doc, pair_term = counted_terms(doc, base, plan)
        terms = _screen(pair_doc, pair_term, label, plan)
        if not len(terms):
            return
        at = np.minimum(np.searchsorted(terms, pair_term), len(terms) - 1)
        hit = terms[at] == pair_term
        weights, vectors, bias = _fit(pair_doc[hit], at[hit], label.astype(float), np.where(label == 1, yes_weight, no_weight), len(terms), plan)
        distinct = np.unique(base)
        used = np.zeros(len(distinct), dtype=bool)
        for m in plan.often:
            used |= np.isin(variant(distinct, m), terms)
        bases_used = distinct[used]
        kinds = ["bias", *["term"] * len(terms), *["base"] * len(bases_used)]
        numbers = np.concatenate([np.zeros(1, np.uint64), terms, bases_used]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds), pa.array(numbers), pa.array(np.concatenate([[bias], weights, np.zeros(len(bases_used))])),
                pa.array([[], *vectors.tolist(), *[[]] * len(bases_used)], pa.list_(pa.float64())),
            ],
            names=["kind", "term", "weight", "vector"],
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", plan: Machine = Machine()) -> Model:
    """Learn from labelled rows whose crc32(id as text) modulo 5 is not 0. Rows with NULL id or label teach nothing.

    Only the sample's ids, at most ``positives`` + ``negatives``, are sent to all tasks; the texts stay where they are
    read, and one task learns from the sample. With labels of one kind only the model has no terms and scores 0.5
    times that kind's side of even.
    """
    known = narrow(labels, key=id_column, toxic=label_column).where("key is not null and toxic is not null")
    known = known.groupBy("key").agg(F.max("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("key").cast("string")) % 5 != 0)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = F.xxhash64("key")
    sample = known.where("toxic = 1").orderBy(by_hash, "key").limit(plan.positives).unionByName(known.where("toxic = 0").orderBy(by_hash, "key").limit(plan.negatives))
    own = narrow(docs, key=id_column, text=text_column)
    chosen = own.join(F.broadcast(durable(sample)), "key").select("key", "text", "toxic")
    weight = {k: totals.get(k, 0) / max(1, min(totals.get(k, 0), most)) for k, most in ((1, plan.positives), (0, plan.negatives))}
    rows = chosen.repartition(1).sortWithinPartitions("key").mapInArrow(_train(plan, weight[1], weight[0]), _MODEL_SCHEMA).collect()
    terms = [r for r in rows if r["kind"] == "term"]
    bias = next((r["weight"] for r in rows if r["kind"] == "bias"), 2.0 * (totals.get(1, 0) > 0) - 2.0 * (totals.get(0, 0) > 0))
    unsigned = lambda kind: np.array([r["term"] for r in rows if r["kind"] == kind], dtype=np.int64).view(np.uint64)
    return Model(np.sort(unsigned("base")), unsigned("term"), np.array([r["weight"] for r in terms]), np.array([r["vector"] for r in terms]).reshape(len(terms), plan.factors), bias)


def _score(model: Model, plan: Machine):
    def run(source):
        gate = model.gate()
        for batch in source:
            for i, j, s in slices(batch.column("text")):
                margin = np.full(s.n, model.bias)
                if len(model.terms):
                    doc, base = base_terms(s, plan)
                    near = gate[(base >> np.uint64(44)).astype(np.int64)]
                    doc, term = counted_terms(doc[near], base[near], plan)
                    at = np.minimum(np.searchsorted(model.terms, term), len(model.terms) - 1)
                    hit = model.terms[at] == term
                    margin, _ = margins(doc[hit], at[hit], s.n, model.weights, model.vectors, model.bias)
                score = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(score)], names=["key", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", plan: Machine = Machine()) -> DataFrame:
    """One row per document: id, held_out (crc32(id as text) modulo 5 is 0), score and predicted.

    Defined results: NULL and empty text get the score of a text without any chosen term; a NULL id stays NULL and counts
    as not held out; repeated rows are scored one by one; an empty table gives no rows; other columns are ignored.
    """
    own = narrow(docs, key=id_column, text=text_column)
    kind = own.schema["key"].dataType.simpleString()
    scored = own.mapInArrow(_score(model, plan), f"key {kind}, score double")
    held_out = F.coalesce(F.crc32(F.col("key").cast("string")) % 5 == 0, F.lit(False))
    return scored.select(F.col("key").alias(id_column), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
