"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahaz.llm import words
from terrahaz.llm.frames import checkpointed, flat, text_slices

MAX_EXAMPLES = 4096
"""Labelled rows of each class the index is fitted on; the bound of the training sample."""
MAX_TERMS = 8192
"""Terms the vectors have, those that go most clearly with one label."""
MIN_GAIN = 30.0
"""Log-likelihood ratio (G squared) a term must reach."""
MIN_ODDS = 3.0
"""Times as often a term must stand in toxic examples."""
NEIGHBOURS = 15
BLOCK = 128
THRESHOLD = 0.3
_DOUBT = 0.5

BREAKS = words.SPACE.copy()
BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_KINDS = ((4, 0x1B873593), (5, 0x3C6EF372), (6, 0x2545F491), (None, 0))


def _terms(texts: pa.Array):
    """(row, term hash) of each word and of its first 4, 5 and 6 bytes, in ASCII lower case."""
    data, offsets = flat(texts)
    data = words.LOWER[data]
    starts, ends, first = words.bounds(data, offsets, BREAKS)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    for length, salt in _KINDS:
        if length is None:
            yield row, words.hashes(data, starts, ends)
        else:
            long = ends - starts > length
            yield row[long], words.hashes(data, starts[long], starts[long] + length) ^ np.uint64(salt)


@dataclass
class Model:
    """Terms, their weights and the examples as an index; its size is bounded by the three constants above."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    known: np.ndarray  # by the low bits of a hash: may be a term
    ids: list
    labels: np.ndarray
    posting: list  # of each term: (block, first, last, greatest weight) arrays, example numbers, weights
    bare: float  # raw score of a text without any term
    steps: np.ndarray
    levels: np.ndarray
    weight: float

    def vectors(self, texts: pa.Array):
        """Row, term number and unit-length TF-IDF weight of every term of each text, rows ascending."""
        keys = []
        for row, hashed in _terms(texts):
            some = np.flatnonzero(self.known[hashed & np.uint64(0xFFFFF)])
            at = np.searchsorted(self.terms, hashed[some])
            hit = self.terms[np.minimum(at, len(self.terms) - 1)] == hashed[some]
            keys.append(row[some[hit]] * len(self.terms) + at[hit])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row, term = key // len(self.terms), key % len(self.terms)
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, weight ** 2, len(texts)))
        return row, term, weight / norm[row]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1):
        """The ``NEIGHBOURS`` examples of greatest cosine (> 0), exactly: a block of examples
        is opened only while the sum of its greatest weights can still beat the last neighbour."""
        count = -(-len(self.ids) // BLOCK)
        bound = np.zeros(count)
        for t, w in zip(terms.tolist(), weights.tolist()):
            blocks, _, _, greatest, _, _ = self.posting[t]
            bound[blocks] += w * greatest
        best, who = np.zeros(0), np.zeros(0, np.int64)
        for block in np.argsort(-bound, kind="stable").tolist():
            least = best[-1] if len(best) == NEIGHBOURS else 0.0
            if bound[block] <= 0 or bound[block] < least - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                blocks, begin, end, _, example, own = self.posting[t]
                k = int(np.searchsorted(blocks, block))
                if k < len(blocks) and blocks[k] == block:
                    part = slice(int(begin[k]), int(end[k]))
                    score[example[part] - block * BLOCK] += w * own[part]
            if skip // BLOCK == block and skip >= 0:
                score[skip % BLOCK] = 0
            hit = np.flatnonzero(score > 0)
            best, who = np.append(best, score[hit]), np.append(who, hit + block * BLOCK)
            order = np.lexsort((who, -best))[:NEIGHBOURS]
            best, who = best[order], who[order]
        return best, who

    def raw(self, best: np.ndarray, who: np.ndarray) -> float:
        """Votes weighted by squared closeness; few or far neighbours leave the score near that of a bare text."""
        votes = best ** 2 * np.where(self.labels[who] == 1, 1.0, self.weight)
        return float((votes[self.labels[who] == 1].sum() + _DOUBT * self.bare) / (votes.sum() + _DOUBT))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.steps, self.levels))


def _sample(docs: DataFrame, labels: DataFrame, learn: Column | None) -> DataFrame:
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if learn is not None:
        marked = marked.where(learn)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = None
    for value in (0, 1):
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * MAX_EXAMPLES ids
    return checkpointed(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))


def _gains(sample: DataFrame) -> DataFrame:
    """(term, n1, n0): examples of either label that hold a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            toxic = batch.column(2).to_numpy() == 1
            rows, terms = zip(*_terms(texts))
            both = np.unique(np.stack([np.concatenate(terms), np.concatenate(rows).astype(np.uint64)], 1), axis=0)
            term, place = np.unique(both[:, 0], return_inverse=True)
            ones = np.bincount(place, toxic[both[:, 1].astype(np.int64)], len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(term)) - ones)],
                names=["term", "n1", "n0"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "term long, n1 long, n0 long").groupBy("term").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Steps and levels of the non-decreasing fit of label to raw."""
    order = np.argsort(raw, kind="stable")
    stack: list[list[float]] = []
    for r, y, w in zip(raw[order], label[order], weight[order]):
        stack.append([r * w, y * w, w])
        while len(stack) > 1 and stack[-2][1] / stack[-2][2] >= stack[-1][1] / stack[-1][2]:
            last = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], last)]
    return np.array([s[0] / s[2] for s in stack]), np.array([(s[1] + 0.02) / (s[2] + 0.2) for s in stack])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model | None:
    """Index over at most ``MAX_EXAMPLES`` labelled rows of each class (least hash of doc_id first).

    ``labels`` has doc_id and toxic (0/1); rows with nulls are left out, of
    repeated ids the greatest label counts. ``learn`` limits the rows learnt
    from. None when there is no labelled document.
    """
    sample = _sample(docs, labels, learn)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        return None
    all1 = labels if learn is None else labels.where(learn)
    prior = all1.where("toxic IS NOT NULL").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    weight = 1.0 if not n1 or not n0 or prior in (0.0, 1.0) else (n1 / prior - n1) / n0

    def part(a, b):
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    counts = _gains(sample).withColumn("n", F.col("n1") + F.col("n0")).where("n >= 3")
    total = float(n1 + n0)
    gain = 2 * (part(F.col("n1"), F.col("n") * (n1 / total)) + part(F.col("n0"), F.col("n") * (n0 / total))
                + part(n1 - F.col("n1"), (total - F.col("n")) * (n1 / total)) + part(n0 - F.col("n0"), (total - F.col("n")) * (n0 / total)))
    found = counts.withColumn("gain", gain).where((F.col("gain") >= MIN_GAIN) & ((F.col("n1") + 0.5) * n0 > (F.col("n0") + 0.5) * n1 * MIN_ODDS)).orderBy(
        F.desc("gain"), "term").limit(MAX_TERMS).collect() if n1 and n0 else []
    terms = np.array([r["term"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms = terms[order]
    ones, both = (np.array([r[k] for r in found], float)[order] for k in ("n1", "n"))
    # rare terms weigh more, and so do those that tell the labels apart
    idf = (1 + np.log((1 + total) / (1 + both))) * np.log((ones + 0.5) * n0 / ((both - ones + 0.5) * max(n1, 1)))
    known = np.zeros(1 << 20, bool)
    known[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    bare = n1 / (n1 + n0 * weight)
    model = Model(terms, idf, known, [], np.zeros(0, np.int64), [], bare, np.array([0.0, 1.0]), np.array([0.0, 1.0]), weight)
    if not len(terms):
        model.steps, model.levels = np.array([0.0]), np.array([bare])
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            row, term, own = model.vectors(texts)
            cut = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()),
                 pa.array([term[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                 pa.array([own[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "toxic", "term", "own"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, term binary, own binary").collect()
    empty1 = sum(r["toxic"] for r in rows if not r["term"])
    empty0 = sum(1 - r["toxic"] for r in rows if not r["term"]) * weight
    model.bare = (empty1 + 0.01) / (empty1 + empty0 + 1)
    full = [(np.frombuffer(r["term"], "<i4"), np.frombuffer(r["own"]), r["toxic"], r["doc_id"]) for r in rows if r["term"]]
    full.sort(key=lambda r: (int(r[0][r[1].argmax()]), r[2], str(r[3])))  # examples of one leading term share blocks
    model.ids, model.labels = [r[3] for r in full], np.array([r[2] for r in full], np.int64)
    term = np.concatenate([r[0] for r in full]) if full else np.zeros(0, np.int32)
    own = np.concatenate([r[1] for r in full]) if full else np.zeros(0)
    example = np.repeat(np.arange(len(full)), [len(r[0]) for r in full]) if full else np.zeros(0, np.int64)
    order = np.lexsort((example, term))
    term, own, example = term[order], own[order], example[order]
    cut = np.searchsorted(term, np.arange(len(terms) + 1))
    for a, b in zip(cut[:-1], cut[1:]):
        block, begin = np.unique(example[a:b] // BLOCK, return_index=True)
        end = np.append(begin[1:], b - a) if len(begin) else begin
        greatest = np.maximum.reduceat(own[a:b], begin) if len(begin) else own[a:b]
        model.posting.append((block, begin, end, greatest, example[a:b], own[a:b]))
    left = [model.raw(*model.nearest(t, w, skip=k)) for k, (t, w, _, _) in enumerate(full)]
    raw = np.array(left + [model.bare] * 2)
    model.steps, model.levels = _isotonic(
        raw, np.append(model.labels, [1, 0]).astype(float),
        np.append(np.where(model.labels == 1, 1.0, weight), [empty1 + 1e-6, empty0 + 1e-6]))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score (0 to 1, double), predicted (1 from ``THRESHOLD`` on) and evidence.

    ``evidence`` lists the nearest examples as (doc_id, toxic, cosine). A text
    without any indexed term, an empty or a null text gets the calibrated rate
    of such examples and no evidence; without a model every score is 0. Columns
    of these three names are replaced, the others and all rows stay. No shuffle;
    the model, of bounded size, goes to every task.
    """
    kind = docs.schema["doc_id"].dataType
    new = T.StructType([
        T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("doc_id", kind), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())])))])
    kept = [f for f in docs.schema.fields if f.name not in new.names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, schema = shared.value, to_arrow_schema(new)
        for batch, texts in text_slices(batches):
            rows = [(0.0, [])] * len(texts)
            if model is not None:
                rows = [(model.calibrated(model.bare), [])] * len(texts)
                if len(model.ids):
                    row, term, own = model.vectors(texts)
                    there, begin = np.unique(row, return_index=True)
                    for r, a, b in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)]):
                        best, who = model.nearest(term[a:b], own[a:b])
                        rows[r] = (model.calibrated(model.raw(best, who)), [
                            {"doc_id": model.ids[w], "toxic": int(model.labels[w]), "cosine": float(c)}
                            for c, w in zip(best[:3], who[:3].tolist())])
            scores = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(scores),
                 pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array([r[1] for r in rows], schema.field("evidence").type)],
                names=[*(f.name for f in kept), *new.names])

    return docs.mapInArrow(run, T.StructType([*kept, *new.fields]))
