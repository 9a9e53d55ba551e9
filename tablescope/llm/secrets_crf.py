"""Secret scans (operator 1): a linear-chain conditional random field over words.

Base patterns find assignments, access keys and hexadecimal runs. The field tags each word as the begin of
a secret, inside one, or outside, from its shape (length, kinds of characters, changes between them), the words
around it, and features of the file, and Viterbi decoding gives further spans; base spans stay. The chain of a text holds all its
words, and every one is scored and decoded.

The field is trained here, by gradient steps on the exact likelihood, on words that base patterns mark in at most
``most_hits`` documents with a match and ``most_others`` others, the first by a hash: the first ``LEAD`` words of
each, and those of an odd shape (a digit, a sign of code, long, or after an assignment sign) with their neighbours, in stretches of at most
``BLOCK`` words. Marked words are also shown among plain words and without their names, so that the shape alone is learned.

Spans count code points, the end exclusive; a base span is the whole match. Defined cases: missing and empty texts have no
spans; equal texts have equal spans; with no marked word to learn from, only base spans are given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import SPACE, pieces, ranges, row_sums, span_hashes, spans
from tablescope.llm.sides import received, shared

# Fixed by the task: the base patterns, and the least length of the second group and of the others.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")

MOST_HITS = 1500
MOST_OTHERS = 1500
_DIM = 1 << 12
_WORD_BUCKETS = 1 << 10
_LABELS = 3  # outside, begin, inside
LEAD = 16
BLOCK = 64  # words decoded one after another; blocks advance side by side


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if len(text) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def _table(*groups) -> np.ndarray:
    out = np.zeros(256, bool)
    for g in groups:
        out[list(g)] = True
    return out


_LOWER, _UPPER, _DIGIT = _table(range(97, 123)), _table(range(65, 91)), _table(range(48, 58))
_HEX = _table(range(48, 58), range(97, 103))
_ASSIGN = _table(b"=:")
_CODE = _table(b"_/+=:-.")
_QUOTE = _table(b"\"'`")
_EDGE = _table(b"\"'`,;.()[]{}<>!?")


@dataclass(frozen=True)
class Words:
    """All words of a piece; those of a row are a chain."""

    rows: np.ndarray
    starts: np.ndarray  # bytes
    ends: np.ndarray
    features: np.ndarray  # [word, slot] -> index
    chain: np.ndarray  # number of the chain of each word
    odd: np.ndarray | None = None  # words whose shape is not that of plain prose


def describe(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends = spans(~SPACE[data], offsets)
    n = len(starts)
    row = np.searchsorted(offsets, starts, "right") - 1
    rows = len(offsets) - 1
    size = ends - starts

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return sums[ends] - sums[starts]

    digits, code = count(_DIGIT), count(_CODE)
    assigns = count(_ASSIGN)
    last = data[ends - 1] if n else np.zeros(0, np.uint8)
    sign = _ASSIGN[last] if n else np.zeros(0, bool)
    after = np.zeros(n, bool)
    after[1:] = sign[:-1] & (row[1:] == row[:-1])
    odd = ((digits > 0) & (size >= 6)) | ((assigns > 0) & (size >= 6) & ~sign) | (size >= 24) | after
    lower, upper, hexes, quotes = (count(t) for t in (_LOWER, _UPPER, _HEX, _QUOTE))
    high = (size - count(_table(range(128)))) > 0
    kind = _LOWER.astype(np.uint8) + 2 * _UPPER + 3 * _DIGIT
    k = kind[data]
    change = np.zeros(len(data) + 1, np.int32)
    np.cumsum(k[1:] != k[:-1], out=change[1:-1] if len(data) else change[:0])
    changes = change[np.maximum(ends - 1, 0)] - change[starts] if n else np.zeros(0, np.int32)
    s = size
    names = 1 + (span_hashes(data, starts, ends, folded=True) % np.uint64(_WORD_BUCKETS - 1)).astype(np.int32) if n else np.zeros(0, np.int32)

    def share(x: np.ndarray) -> np.ndarray:
        return (4 * x + s - 1) // np.maximum(s, 1)

    def neighbour(shift: int) -> np.ndarray:
        """The name of the word ``shift`` places on in the same row, 0 if there is none."""
        out = np.zeros(n, np.int32)
        here, there = (slice(None, -shift), slice(shift, None)) if shift > 0 else (slice(-shift, None), slice(None, shift))
        out[here] = np.where(row[here] == row[there], names[there], 0)
        return out

    of_row = np.searchsorted(starts, offsets)
    words_in = np.diff(of_row)
    odd_in = np.bincount(row[odd], minlength=rows)
    assigns_in = row_sums(assigns.astype(np.uint64), of_row).astype(np.int64)
    file_odd = np.minimum(3, (20 * odd_in) // np.maximum(words_in, 1))
    file_assign = np.minimum(3, (20 * assigns_in) // np.maximum(words_in, 1))
    before, behind, two = neighbour(-1), neighbour(1), neighbour(-2)
    bucket = np.searchsorted([6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 28, 32, 40, 48, 64], s, "right")
    slots = [
        bucket,
        share(digits) * 5 + share(upper),
        share(lower) * 5 + share(code),
        np.minimum(changes * 8 // np.maximum(s, 1), 7),
        (hexes >= s - quotes - 1) * 4 + (quotes > 0) * 2 + high,
        np.minimum(assigns, 2) * 2 + after,
        bucket * 8 + np.minimum(changes * 8 // np.maximum(s, 1), 7),
        file_odd[row] * 4 + file_assign[row],
    ]
    widths = [16, 25 + 5, 30, 8, 8, 6, 128, 16]
    features, base = np.zeros((n, len(slots) + 3), np.int16), 0
    for i, (slot, width) in enumerate(zip(slots, widths)):
        features[:, i] = base + np.clip(slot, 0, width - 1)
        base += width
    for i, name in enumerate((before, behind, two), len(slots)):
        features[:, i] = base + name
        base += _WORD_BUCKETS
    assert base <= _DIM
    return Words(row, starts, ends, features, row, odd)


WORD_SLOTS = (8, 9, 10)
FIRST_WORD = sum([16, 30, 30, 8, 8, 6, 128, 16])


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # [feature, label]
    steps: np.ndarray  # [label, next label]
    begin: np.ndarray
    end: np.ndarray


def _positions(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by length, longest first: first word and length of each, and the order."""
    firsts = np.flatnonzero(np.diff(chain, prepend=-1))
    lengths = np.diff(np.append(firsts, len(chain)))
    order = np.argsort(-lengths, kind="stable")
    return firsts[order], lengths[order], order


def viterbi(field: Field, words: Words) -> np.ndarray:
    """The best label of each word.

    Chains are cut into blocks of ``BLOCK`` words. All blocks advance side by side, from each label of their first word; then the blocks
    of a chain are joined one after another, which is exact and takes a long chain few steps.
    """
    n = len(words.chain)
    labels = np.zeros(n, np.int8)
    if not n:
        return labels
    scores = np.zeros((n, _LABELS))
    for slot in range(words.features.shape[1]):
        scores += field.weights[words.features[:, slot]]
    heads = np.flatnonzero(np.diff(words.chain, prepend=-1))
    blocks_of = (np.diff(np.append(heads, n)) + BLOCK - 1) // BLOCK
    block_chain = np.repeat(np.arange(len(heads)), blocks_of)
    nth = np.arange(len(block_chain)) - np.repeat(np.cumsum(blocks_of) - blocks_of, blocks_of)
    begins = heads[block_chain] + nth * BLOCK
    sizes = np.diff(np.append(begins, n))
    order = np.argsort(-sizes, kind="stable")
    firsts, lengths = begins[order], sizes[order]

    # best[block, label of its first word, label of the word reached]
    best = np.where(np.eye(_LABELS, dtype=bool), scores[firsts][:, None, :], -np.inf)
    came = np.zeros((n, _LABELS, _LABELS), np.int8)
    alive = [int(np.searchsorted(-lengths, -k, "left")) for k in range(int(lengths[0]))]  # blocks longer than k
    for k in range(1, len(alive)):
        now = alive[k]
        options = best[:now, :, :, None] + field.steps
        came[firsts[:now] + k] = options.argmax(axis=2)
        best[:now] = options.max(axis=2) + scores[firsts[:now] + k][:, None, :]
    whole = np.empty_like(best)
    whole[order] = best

    by_count = np.argsort(-blocks_of, kind="stable")
    lead, count = (np.cumsum(blocks_of) - blocks_of)[by_count], blocks_of[by_count]
    chains = [int(np.searchsorted(-count, -k, "left")) for k in range(int(count[0]))]  # with more than k blocks
    entered, left = np.zeros((len(whole), _LABELS), np.int8), np.zeros((len(whole), _LABELS), np.int8)
    reached = np.zeros((len(heads), _LABELS))
    for k, now in enumerate(chains):
        at = lead[:now] + k
        start = np.broadcast_to(field.begin, (now, _LABELS))
        if k:
            options = reached[:now, :, None] + field.steps
            left[at], start = options.argmax(axis=1), options.max(axis=1)
        options = start[:, :, None] + whole[at]
        entered[at], reached[:now] = options.argmax(axis=1), options.max(axis=1)
    state = (reached + field.end).argmax(axis=1)
    first, last = np.zeros(len(whole), np.int8), np.zeros(len(whole), np.int8)
    for k in range(len(chains) - 1, -1, -1):
        at = lead[: chains[k]] + k
        last[at] = state[: chains[k]]
        first[at] = entered[at, last[at]]
        state[: chains[k]] = left[at, first[at]]

    first, state = first[order], last[order]
    for k in range(len(alive) - 1, -1, -1):
        at = firsts[: alive[k]] + k
        labels[at] = state[: alive[k]]
        state[: alive[k]] = came[at, first[: alive[k]], labels[at]]
    return labels


def train_field(words: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 150) -> Field | None:
    """From (features, chain, labels) groups; gradient steps on the likelihood of all chains."""
    features = np.concatenate([w[0] for w in words])
    labels = np.concatenate([w[2] for w in words])
    if not (labels > 0).any():
        return None
    shift, chains = 0, []
    for _, chain, _ in words:
        chains.append(chain + shift)
        shift += int(chain.max()) + 1 if len(chain) else 0
    chain = np.concatenate(chains)
    firsts, lengths, _ = _positions(chain)
    weights, steps = np.zeros((_DIM, _LABELS)), np.zeros((_LABELS, _LABELS))
    begin, end = np.zeros(_LABELS), np.zeros(_LABELS)
    parameters = [weights, steps, begin, end]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    hot = np.eye(_LABELS)[labels]
    same = np.concatenate([chain[1:] == chain[:-1], [False]])
    seen_steps = np.zeros((_LABELS, _LABELS))
    np.add.at(seen_steps, (labels[:-1][same[:-1]], labels[1:][same[:-1]]), 1)
    lasts = firsts + lengths - 1
    long = int(lengths[0])
    count = [int(np.searchsorted(-lengths, -k, "left")) for k in range(long)]
    for turn in range(1, rounds + 1):
        scores = weights[features].sum(axis=1)
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[firsts] = begin + scores[firsts]
        for k in range(1, long):
            at = firsts[: count[k]] + k
            ahead[at] = scores[at] + np.logaddexp.reduce(ahead[at - 1][:, :, None] + steps[None], axis=1)
        back[lasts] = end
        for k in range(long - 2, -1, -1):
            at = firsts[: count[k + 1]] + k
            back[at] = np.logaddexp.reduce(steps[None] + (scores[at + 1] + back[at + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead[lasts] + end, axis=1)
        total_of = np.zeros(len(chain))
        total_of[ranges(firsts, lengths)] = np.repeat(total, lengths)
        belief = np.exp(ahead + back - total_of[:, None])
        inner = np.flatnonzero(same)
        pair = np.exp(ahead[inner][:, :, None] + steps[None] + (scores[inner + 1] + back[inner + 1])[:, None, :] - total_of[inner][:, None, None])
        wrong = belief - hot
        slope = np.zeros_like(weights)
        for slot in range(features.shape[1]):
            for label in range(_LABELS):
                slope[:, label] += np.bincount(features[:, slot], wrong[:, label], minlength=_DIM)
        slopes = [slope + 0.05 * weights, pair.sum(axis=0) - seen_steps + 0.05 * steps, wrong[firsts].sum(axis=0) + 0.05 * begin, wrong[lasts].sum(axis=0) + 0.05 * end]
        for p, g, (m, v) in zip(parameters, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Field(weights, steps, begin, end)


def _labelled(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of texts with labels from base spans, and again with neighbours hidden."""
    out = []
    for first, _, data, offsets in pieces(pa.array(texts, pa.large_string())):
        words = describe(data, offsets)
        labels = np.zeros(len(words.rows), np.int64)
        for row in np.unique(words.rows).tolist():
            text = texts[first + row]
            found = base_spans(text)
            if not found:
                continue
            at = np.flatnonzero(words.rows == row)
            lead = _code_points(data[offsets[row] : offsets[row + 1]])
            s, e = lead[words.starts[at] - offsets[row]], lead[words.ends[at] - offsets[row]]
            for start, _, end in found:
                inside = at[(s < end) & (e > start)]
                labels[inside] = np.where(labels[inside] > 0, labels[inside], np.where(np.arange(len(inside)) == 0, 1, 2))
        marked = labels > 0
        hidden = words.features[marked]
        for k, slot in enumerate(WORD_SLOTS):
            hidden[:, slot] = FIRST_WORD + k * _WORD_BUCKETS
        kept, chain = _stretches(words, marked)
        out.append((words.features[kept], chain, labels[kept]))
        plain = kept[~(marked | words.odd)[kept]]
        if len(plain):  # a plain word on either side
            sides = [words.features[np.resize(np.roll(plain, k), len(hidden))] for k in (0, len(plain) // 2)]
            hidden = np.stack([sides[0], hidden, sides[1]], axis=1).reshape(-1, hidden.shape[1])
        each = 3 if len(plain) else 1
        shown = np.tile([0, 1, 0] if len(plain) else [1], len(hidden) // each)
        out.append((hidden, np.arange(len(hidden)) // each, shown))
    return out


def _stretches(words: Words, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to learn from, and the number of the stretch of each."""
    near = words.odd | marked
    same = words.rows[1:] == words.rows[:-1]
    near[1:] |= (words.odd | marked)[:-1] & same
    near[:-1] |= (words.odd | marked)[1:] & same
    heads = np.flatnonzero(np.diff(words.rows, prepend=-1))
    place = np.arange(len(near)) - np.repeat(heads, np.diff(np.append(heads, len(near))))
    kept = np.flatnonzero(near | (place < LEAD))
    fresh = np.concatenate([[True], (np.diff(kept) != 1) | (place[kept][1:] % BLOCK == 0)])[: len(kept)]
    return kept, np.cumsum(fresh) - 1


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and their number at the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def crf_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """(start, end) in code points of the decoded spans of the rows that have any."""
    words = describe(data, offsets)
    labels = viterbi(field, words)
    out: dict[int, list[tuple[int, int]]] = {}
    spans_of: list[list[int]] = []
    for k in np.flatnonzero(labels).tolist():
        joined = labels[k] == 2 and spans_of and k and labels[k - 1] and words.chain[k] == words.chain[k - 1]
        if joined:
            spans_of[-1][2] = int(words.ends[k])
        else:
            spans_of.append([int(words.rows[k]), int(words.starts[k]), int(words.ends[k])])
    for row, start, end in spans_of:
        while start < end and _EDGE[data[start]]:
            start += 1
        while end > start and _EDGE[data[end - 1]]:
            end -= 1
        if end - start >= 6:
            begin = int(((data[offsets[row] : start] & 0xC0) != 0x80).sum())
            out.setdefault(row, []).append((begin, begin + int(((data[start:end] & 0xC0) != 0x80).sum())))
    return out


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def train(docs: DataFrame, text_column: str = "text", most_hits: int = MOST_HITS, most_others: int = MOST_OTHERS) -> Field | None:
    texts = docs.select(F.col(f"`{text_column}`").cast("string").alias("text")).where("text IS NOT NULL AND text != ''")
    hit = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
    by = F.xxhash64("text")
    hits = texts.where(F.col("text").rlike(hit)).orderBy(by, "text").limit(most_hits)
    others = texts.where("length(text) < 50000").orderBy(by, "text").limit(most_others)
    sample = sorted(r["text"] for r in hits.union(others).collect())
    return train_field(_labelled(sample)) if sample else None


def scan(docs: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf)."""
    sent = shared(docs.sparkSession, field)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = received(sent)
        for batch in batches:
            texts = batch.column(1)
            for first, end, data, offsets in pieces(texts):
                n = end - first
                counts, digest, joined = np.zeros((n, 4), np.int64), [empty] * n, [""] * n
                extra = crf_spans(field, data, offsets) if field else {}
                plain = np.flatnonzero(~_HEX[data])
                gaps = np.flatnonzero(np.diff(plain, prepend=-1, append=len(data)) > 32)
                marks = np.concatenate([[-1], plain, [len(data)]])
                runs = set()
                for g in gaps.tolist():  # a run of bytes may go over several rows
                    low, high = np.searchsorted(offsets, [marks[g] + 1, marks[g + 1] - 1], "right") - 1
                    runs.update(range(int(low), int(high) + 1))
                signs = np.flatnonzero(_ASSIGN[data] | (data == ord("K")))
                some = set(np.unique(np.searchsorted(offsets, signs, "right") - 1).tolist()) | runs | set(extra)
                for r in sorted(x for x in some if x < n):
                    text = texts[first + r].as_py()
                    found = base_spans(text)
                    more = [(a, 3, b) for a, b in extra.get(r, []) if not any(a < e and b > s for s, _, e in found)]
                    if found or more:
                        for _, kind, _ in (*found, *more):
                            counts[r, kind] += 1
                        digest[r] = hashlib.sha256(_joined(found).encode()).hexdigest()
                        joined[r] = _joined(sorted([*found, *more]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        *[pa.array(counts[:, k]) for k in range(3)],
                        pa.array(digest, pa.string()),
                        pa.array(joined, pa.string()),
                        pa.array(counts[:, 3]),
                    ],
                    names=names,
                )

    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return scan(docs, train(docs, text_column), id_column, text_column)
