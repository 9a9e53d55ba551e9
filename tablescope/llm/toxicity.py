"""Toxicity (operator 9): a support vector machine on a gap-weighted subsequence kernel.

The kernel of two words sums, over triples of characters in order within a stretch of five, the product of
the weights of their occurrences; each skipped character costs the factor ``DECAY``, so inserted and left-out
characters lower the likeness only a little. A run of one-letter words counts as one word (spelled-out
insults). Word ends are characters too. The kernel is divided by a length factor of either word.

Training: of the sentences of labelled documents, a toxic document has at least one toxic word in one
sentence, a clean one has none. The words that tell the classes apart best, and common ones, are
landmarks; words become Nyström vectors over them, and a linear machine is trained with the best word of each toxic
document against the worst words of clean ones, in rounds. As the machine is a sum over landmarks of
explicit triples, it collapses without loss to one weight per triple, which is what the tasks receive.
A document's score is a logistic function of its three best words, weighted to the labels' shares.

Learned from at most ``most_labelled`` labelled rows of each class, the first by a hash of the id; everything is scored.

Defined cases: missing and empty texts have the lowest words' score; repeated rows score alike;
with labels of one class or none, every score is that class's value, 0 or 1 (0 without labels). Rows with a missing id are
scored and count as held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import SPACE, give_back, pieces, ranges, span_hashes, spans
from tablescope.llm.sides import received, shared, spare

MOST_LABELLED = 1500
LANDMARKS = 256
DECAY = 0.6
ROUNDS = 4
_SYMBOLS = 64
_PIECE = 8 << 20
_WORDS_AT_ONCE = 10_000
_TRIPLES = [(a, b, DECAY ** (b - 2)) for b in (2, 3, 4) for a in range(1, b)]


def _symbols() -> np.ndarray:
    code = np.full(256, 37, np.uint8)  # punctuation
    for k in range(26):
        code[ord("a") + k] = code[ord("A") + k] = 1 + k
    for k in range(10):
        code[ord("0") + k] = 27 + k
    code[0x80:0xC0] = 39 + np.arange(64) % 25
    code[0xC0:] = 38
    return code


_CODE = _symbols()


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, with runs of one-letter words as one."""
    starts, ends = spans(~SPACE[data], offsets)
    if len(starts) > 1:
        single = ends - starts == 1
        close = single[:-1] & single[1:] & (starts[1:] - ends[:-1] == 1)
        row = np.searchsorted(offsets, starts, "right")
        close &= row[:-1] == row[1:]
        starts, ends = starts[np.append(True, ~close)], ends[np.append(~close, True)]
    return starts, ends


def triples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(feature, weight, word) of every triple of the given words, and each word's length factor."""
    sizes = ends - starts + 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    code = np.zeros(bounds[-1] + 4, np.int32)
    inner = ranges(bounds[:-1] + 1, sizes - 2)
    code[inner] = _CODE[data[ranges(starts, ends - starts)]]
    word = np.repeat(np.arange(len(starts)), sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(bounds[-1])  # characters from here to the end
    features, weights, owners = [], [], []
    norm = np.zeros(len(starts))
    first = code[: bounds[-1]] * (_SYMBOLS * _SYMBOLS)
    for a, b, weight in _TRIPLES:
        at = np.flatnonzero(left > b)
        features.append(first[at] + code[at + a] * _SYMBOLS + code[at + b])
        weights.append(weight)
        owners.append(word[at])
        norm += weight * weight * np.maximum(sizes - b, 0)
    return features, weights, owners, np.sqrt(np.maximum(norm, 1.0))


def word_values(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of ``table`` over the triples of each word, over its length factor; each distinct word is worked out once."""
    if not len(starts):
        return np.zeros(0)
    hashes = span_hashes(data, starts, ends, folded=True)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    return distinct_values(table, data, starts[at], ends[at])[which]


def distinct_values(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts))
    for k in range(0, len(starts), _WORDS_AT_ONCE):
        some = slice(k, k + _WORDS_AT_ONCE)
        features, weights, owners, norm = triples(data, starts[some], ends[some])
        for feature, weight, owner in zip(features, weights, owners):
            out[some] += weight * np.bincount(owner, table[feature], minlength=len(norm))
        out[some] /= norm
    return out


def top_three(values: np.ndarray, firsts: np.ndarray, floor: float) -> np.ndarray:
    """The three largest values of each row, largest first, ``floor`` where there are fewer."""
    out = np.full((len(firsts) - 1, 3), floor)
    values = values.copy()
    filled = np.flatnonzero(np.diff(firsts) > 0)
    if not len(filled):
        return out
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for k in range(3):
        best = np.maximum.reduceat(values, firsts[:-1][filled])
        out[filled, k] = np.maximum(best, floor)
        full = np.full(len(firsts) - 1, np.inf)
        full[filled] = best
        at = np.flatnonzero(values == full[row])
        values[at[np.concatenate([[True], row[at][1:] != row[at][:-1]])]] = -np.inf
    return out


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    floor: float
    coefficients: np.ndarray  # of the three best words, and the constant

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends = word_runs(data, offsets)
        best = top_three(word_values(self.table, data, starts, ends), np.searchsorted(starts, offsets), self.floor)
        return 1 / (1 + np.exp(-np.clip(best @ self.coefficients[:3] + self.coefficients[3], -40, 40)))


def _nystroem(data, starts, ends, landmarks: tuple) -> np.ndarray:
    """Kernel values of words with the landmarks, given as a small dense table over the landmarks' triples."""
    column_of, dense = landmarks
    out = np.zeros((len(starts), dense.shape[1]), np.float32)
    for a in range(0, len(starts), 2000):
        s, e = starts[a : a + 2000], ends[a : a + 2000]
        features, weights, owners, norm = triples(data, s, e)
        for feature, weight, owner in zip(features, weights, owners):
            column = column_of[feature]
            use = np.flatnonzero(column >= 0)
            if len(use):
                cut = np.flatnonzero(np.diff(owner[use], prepend=-1))
                out[a + owner[use][cut]] += weight * np.add.reduceat(dense[column[use]], cut, axis=0)
        out[a : a + 2000] /= norm[:, None].astype(np.float32)
    return out


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 200) -> np.ndarray:
    """A linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    penalty = np.append(np.full(z.shape[1], 3e-4), 1e-6)
    v, other, momentum = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    probe = np.ones(x.shape[1])
    for _ in range(30):
        probe = x.T @ (cost * (x @ probe))
        size = np.linalg.norm(probe)
        probe /= size
    rate = 1 / (2 * size + penalty.max())
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ other))
        step = other - rate * (-2 * x.T @ (cost * y * slack) + penalty * other)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        other, v, momentum = step + (momentum - 1) / following * (step - v), step, following
    return v


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
    return w


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """A model from labelled texts; ``share`` is the share of toxic ones among all labelled."""
    flat = np.zeros(_SYMBOLS**3)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(flat, 0.0, np.array([0, 0, 0, 40.0 if len(toxic) and toxic[0] else -40.0]))
    data, starts, ends, hashes, sizes = [], [], [], [], []
    done = 0
    for _, _, part, offsets in pieces(pa.array(texts, pa.large_string())):
        s, e = word_runs(part, offsets)
        data.append(part)
        starts.append(s + done)
        ends.append(e + done)
        hashes.append(span_hashes(part, s, e, folded=True))
        sizes.append(np.diff(np.searchsorted(s, offsets)))
        done += len(part)
    data, starts, ends, hashes, sizes = (np.concatenate(x) for x in (data, starts, ends, hashes, sizes))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(toxic)), sizes)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    del hashes
    pairs = np.unique(doc.astype(np.int64) * len(at) + which)
    pair_doc, pair_word = (pairs // len(at)).astype(np.int32), (pairs % len(at)).astype(np.int32)
    del doc, pairs
    bad, good = toxic.sum(), len(toxic) - toxic.sum()
    in_bad = np.bincount(pair_word[toxic[pair_doc] == 1], minlength=len(at))
    in_good = np.bincount(pair_word[toxic[pair_doc] == 0], minlength=len(at))
    p, q = (in_bad + 0.5) / (bad + 1), (in_good + 0.5) / (good + 1)
    evidence = np.where(p > q, in_bad * np.log(p / q), 0.0)
    telling = np.argsort(-evidence, kind="stable")[: LANDMARKS * 3 // 4]
    common = np.argsort(-(in_bad + in_good), kind="stable")
    marks = np.concatenate([telling, common[~np.isin(common, telling)][: LANDMARKS // 4]])
    word_start, word_end = starts[at], ends[at]
    del starts, ends
    features, weights, owners, norm = triples(data, word_start[marks], word_end[marks])
    used = np.unique(np.concatenate(features))
    column_of = np.full(_SYMBOLS**3, -1, np.int32)
    column_of[used] = np.arange(len(used))
    dense = np.zeros((len(used), len(marks)), np.float32)
    for feature, weight, owner in zip(features, weights, owners):
        np.add.at(dense, (column_of[feature], owner), (weight / norm[owner]).astype(np.float32))
    between = _nystroem(data, word_start[marks], word_end[marks], (column_of, dense)).astype(np.float64)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])

    learn = np.arange(len(toxic)) % 10 < 7
    one_sided = (in_bad >= 5) & (p >= 10 * q)
    table, floor = flat, 0.0
    word_score = evidence.copy()
    pool = np.unique(np.concatenate([common[:500], np.random.default_rng(7).permutation(len(at))[:1000]]))
    for _ in range(ROUNDS):
        order = np.lexsort((-word_score[pair_word], pair_doc))
        head = order[np.concatenate([[True], np.diff(pair_doc[order]) != 0])]
        best_doc, best_word = pair_doc[head], pair_word[head]
        positive = best_word[(toxic[best_doc] == 1) & learn[best_doc]]
        positive = positive[(p > q)[positive] & (in_good[positive] <= 0.2 * (in_bad[positive] + in_good[positive]))]
        positive = np.concatenate([positive, pair_word[(toxic[pair_doc] == 1) & learn[pair_doc] & one_sided[pair_word]]])
        clean = np.unique(pair_word[(toxic[pair_doc] == 0) & learn[pair_doc]])
        hard = clean[np.argsort(-word_score[clean], kind="stable")[:2000]]
        negative = np.setdiff1d(np.union1d(hard, np.intersect1d(pool, clean)), positive)
        if not len(positive) or not len(negative):
            break
        chosen, times = np.unique(positive, return_counts=True)
        members = np.concatenate([chosen, negative])
        z = _nystroem(data, word_start[members], word_end[members], (column_of, dense)).astype(np.float64) @ root
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(negative))])
        v = _machine(z, y, np.concatenate([times * (1.0 / times.sum()), np.full(len(negative), 1.0 / len(negative))]))
        mark_weight = root @ v[:-1]
        table = np.zeros(_SYMBOLS**3)
        table[used] = dense.astype(np.float64) @ mark_weight
        word_score = distinct_values(table, data, word_start, word_end) + v[-1]
        floor = float(word_score.min() - v[-1])
    best = top_three(distinct_values(table, data, word_start, word_end)[which], firsts, floor)
    test = ~learn if (~learn & (toxic == 1)).sum() >= 5 and (~learn & (toxic == 0)).sum() >= 5 else np.ones(len(toxic), bool)
    sampled = toxic[test].mean()
    weight = np.where(toxic[test] == 1, share / sampled, (1 - share) / (1 - sampled))
    use = np.ones(3, bool)
    coefficients = np.zeros(4)
    while True:  # a worse word never lowers the score
        found = _logistic(best[test][:, use], toxic[test], weight)
        if (found[:-1] >= 0).all():
            coefficients[:3][use], coefficients[3] = found[:-1], found[-1]
            return Model(table, floor, coefficients)
        use[np.flatnonzero(use)[found[:-1] < 0]] = False


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_labelled: int = MOST_LABELLED
) -> Model:
    """Fit on labelled documents that are not held out, at most ``most_labelled`` of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    known = known.where("_id IS NOT NULL AND _toxic IS NOT NULL").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    total = sum(counts.values())
    chosen = None
    for label in sorted(counts):
        part = known.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(most_labelled)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return fit([], np.zeros(0, int), 0.0)
    rows = (
        docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"))
        .limit(2 * most_labelled)
        .collect()
    )
    texts, toxic = [r["_text"] for r in rows], np.array([r["_toxic"] for r in rows], int)
    del rows
    model = fit(texts, toxic, counts.get(1, 0) / max(total, 1))
    give_back()  # the driver goes on to other steps
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a toxicity ``score`` from 0 to 1."""
    sent = shared(docs.sparkSession, model)
    fields = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in fields]
    keep = docs.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_column}`").cast("string").alias(spare(docs, "_scored")))
    schema = type(docs.schema)(fields).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(sent)
        for batch in batches:
            got = [model.score(data, offsets) for _, _, data, offsets in pieces(batch.column(batch.num_columns - 1), _PIECE)]
            columns = [*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *got]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, name])

    return keep.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document (doc_id, held_out, score, predicted)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)) if docs.columns else docs
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under 0.5."""
    name = spare(docs, "_toxicity")
    return score(docs, train(docs, labels), name=name).where(F.col(name) < 0.5).drop(name)
