"""SentencePiece encoding and decoding (operator 5): segmentations sampled from the piece lattice.

The pieces of a given SentencePiece file span a lattice over the bytes of a text. A path's weight is the product of its
pieces' weights, 1 / (rank + 10) by the rank of a piece in the file, to the power ``sharpness``. Forward filtering sums
the weights of all paths to each place; backward sampling then draws a path from its end, with
random numbers that are a hash of the seed, the row's key, the place in the row and the step, so
a row's segmentation depends neither on partitions nor on other rows.

No piece crosses into a word (spaces, then other characters) or a line break, so the lattice falls apart at those places
without loss. Each distinct word's lattice is filtered once per run of text; each occurrence draws its own path. Characters that
are no piece are spelled in bytes, also the space mark itself, so decoding gives back every text.

Defined cases: missing and empty texts have no pieces; repeated rows have equal pieces; a missing key
counts as its own key. Extra columns pass through; columns ``piece_ids``, ``n_pieces`` and ``lossless`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.arrays import give_back, hash_sums, mixed, pieces, ranges, rolling_hashes, span_hashes
from tablescope.llm.sides import received, shared, spare

_PIECE = 1 << 20
_LATTICE = 96 << 10  # bytes of distinct words whose lattice is laid out at once, 100 bytes for each
_SLOT_BITS = 16
_LONG = 96
_MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes, with the space mark as a space, and their weights; the beginnings of pieces are looked up by their hashes."""

    text: np.ndarray  # all pieces' bytes
    firsts: np.ndarray  # where each id's bytes start, and the end
    log_weight: np.ndarray
    hashes: np.ndarray  # of the beginnings of pieces, whole ones included
    ids: np.ndarray  # the piece that each of them is, 0 if none
    slots: np.ndarray  # which of them a hash's last bits name, -1 if none; those whose slot is taken follow in the next free one
    longest: int
    byte_ids: np.ndarray


def vocabulary(path: str, sharpness: float = 1.0) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw, byte_ids, ranked = [], np.zeros(256, np.int64), []
    for i in range(len(model)):
        piece = b""
        if model.is_byte(i):
            piece = bytes([int(model.id_to_piece(i)[3:5], 16)])
            byte_ids[piece[0]] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace(_MARK, " ").encode()
            ranked.append(i)
        raw.append(piece)
    log_weight = np.full(len(raw), -np.log(len(raw) + 10.0))
    order = np.array(ranked)[np.argsort([-model.get_score(i) for i in ranked], kind="stable")]
    log_weight[order] = -np.log(np.arange(len(order)) + 10.0)
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in raw])])
    text = np.frombuffer(b"".join(raw), np.uint8)
    chosen = np.array(ranked)
    sizes = np.diff(firsts)[chosen]
    owner, size = np.repeat(chosen, sizes), ranges(np.ones(len(chosen), np.int64), sizes)
    hashes, at = np.unique(rolling_hashes(*hash_sums(text), firsts[owner], firsts[owner] + size), return_index=True)
    ids = np.zeros(len(hashes), np.int32)
    ids[np.searchsorted(hashes, rolling_hashes(*hash_sums(text), firsts[chosen], firsts[chosen + 1]))] = chosen
    slots = np.full(1 << max(_SLOT_BITS, int(4 * len(hashes)).bit_length()), -1, np.int32)
    left, slot = np.arange(len(hashes)), (hashes & np.uint64(len(slots) - 1)).astype(np.int64)
    while len(left):
        free = slots[slot] < 0
        slots[slot[free]] = left[free]  # of several the last stays
        again = slots[slot] != left
        left, slot = left[again], (slot[again] + 1) % len(slots)
    return Vocabulary(text, firsts, sharpness * log_weight, hashes, ids, slots, int(np.diff(firsts).max()), byte_ids)


def _found(v: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    """Which beginning of a piece each hash is, -1 if none."""
    slot = (hashes & np.uint64(len(v.slots) - 1)).astype(np.int64)
    out = v.slots[slot]
    left = np.flatnonzero(out >= 0)
    left = left[v.hashes[out[left]] != hashes[left]]
    while len(left):
        slot[left] = (slot[left] + 1) % len(v.slots)
        out[left] = v.slots[slot[left]]
        left = left[out[left] >= 0]
        left = left[v.hashes[out[left]] != hashes[left]]
    return out


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the lattice falls apart, without the end."""
    cut = np.zeros(len(data) + 1, bool)
    space, line = data == 0x20, data == 0x0A
    cut[:-1] |= space | line
    cut[1:-1] &= ~(space[1:] & space[:-1])
    cut[1:] |= line
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


@dataclass(frozen=True)
class Lattice:
    """Pieces within units laid end to end, by the place where they end and their size. A unit of n bytes has n + 1 places."""

    bounds: np.ndarray  # of the units among the places
    firsts: np.ndarray  # of the pieces that end at each place, and the end
    ids: np.ndarray
    sizes: np.ndarray


def _lattice(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lattice:
    sizes = ends - starts
    text = data[ranges(starts, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(bounds[1:], sizes) - np.arange(len(text))
    sums, down = hash_sums(text)
    at = np.arange(len(text))
    places, ids, lengths = [], [], []
    lead = np.flatnonzero((text & 0xC0) != 0x80)
    width = np.diff(np.append(lead, len(text)))
    spelled = np.ones(len(text), bool)  # characters that are no piece
    whole = np.zeros(len(text), np.int64)
    whole[lead] = width
    for size in range(1, v.longest + 1):
        at = at[left[at] >= size]
        if not len(at):
            break
        known = _found(v, rolling_hashes(sums, down, at, at + size))
        at, known = at[known >= 0], known[known >= 0]
        piece = v.ids[known]
        here, piece = at[piece > 0], piece[piece > 0]
        spelled[here[whole[here] == size]] = False
        places.append(here)
        ids.append(piece)
        lengths.append(np.full(len(here), size, np.int32))
    spell = spelled[lead]
    single = ranges(lead[spell], width[spell])
    if len(single):  # a byte takes the place of a piece of one byte there
        byte = np.zeros(len(text), bool)
        byte[single] = True
        if places:
            keep = ~byte[places[0]]
            places[0], ids[0], lengths[0] = places[0][keep], ids[0][keep], lengths[0][keep]
        places.insert(0, single)
        ids.insert(0, v.byte_ids[text[single]].astype(np.int32))
        lengths.insert(0, np.ones(len(single), np.int32))
    place, piece, size = (np.concatenate(x) for x in (places, ids, lengths))
    unit = np.repeat(np.arange(len(sizes)), sizes)[place]
    end = place + unit + size  # units have a place more than bytes
    order = np.argsort(end, kind="stable")
    end = end[order]
    return Lattice(bounds + np.arange(len(bounds)), np.searchsorted(end, np.arange(len(text) + len(sizes) + 1)), piece[order], size[order])


def _filtered(v: Vocabulary, lattice: Lattice) -> np.ndarray:
    """Log of the summed weights of all paths to each place of each unit."""
    out = np.zeros(lattice.bounds[-1])
    # bytes share the weight of a path evenly in the linear sums, which keeps those in range
    lift = 3.0
    sizes = np.diff(lattice.bounds) - 1
    which = np.repeat(np.arange(len(sizes)), sizes + 1)
    step = np.arange(len(which)) - lattice.bounds[:-1][which]  # of each place in its unit
    short = sizes[which] <= _LONG
    count = np.diff(lattice.firsts)
    order = np.argsort(np.where(short, step, -1), kind="stable")
    order = order[np.searchsorted(np.where(short, step, -1)[order], 1) :]
    cuts = np.searchsorted(step[order], np.arange(1, int(step[order[-1]]) + 2)) if len(order) else np.zeros(1, np.int64)
    edge = ranges(lattice.firsts[:-1][order], count[order])
    weight = np.exp(v.log_weight + lift * np.diff(v.firsts))[lattice.ids[edge]]
    source = np.repeat(order, count[order]) - lattice.sizes[edge]
    edges = np.concatenate([[0], np.cumsum(count[order])])
    sums = np.ones(len(which))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        c, d = int(edges[a]), int(edges[b])
        target = np.repeat(np.arange(b - a), count[order[a:b]])
        sums[order[a:b]] = np.bincount(target, sums[source[c:d]] * weight[c:d], minlength=b - a)
    with np.errstate(divide="ignore"):
        out[short] = np.log(sums[short]) - lift * step[short]
    for unit in np.flatnonzero(sizes > _LONG).tolist():
        first, end = lattice.bounds[unit : unit + 2].tolist()
        for p in range(first + 1, end):
            a, b = lattice.firsts[p : p + 2].tolist()
            terms = out[p - lattice.sizes[a:b]] + v.log_weight[lattice.ids[a:b]]
            top = terms.max(initial=-np.inf)
            out[p] = np.log(np.exp(terms - top).sum()) + top if np.isfinite(top) else -np.inf
    return out


def sample(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of each row, sampled by its key, and the bounds of the rows among them.

    Words are worked through in runs of at most ``_PIECE`` bytes, and the distinct ones of a run in groups.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    starts = _units(data, offsets)
    ends = np.append(starts[1:], len(data))
    of_row = np.searchsorted(starts, offsets)
    parts, counts = [], []
    runs = np.searchsorted(starts, np.arange(0, len(data) + _PIECE, _PIECE)).tolist()
    for a, b in zip(runs[:-1], runs[1:]):
        if a == b:
            continue
        row = np.searchsorted(of_row, np.arange(a, b), "right") - 1
        place = np.arange(a, b) - of_row[row]
        seed = mixed(keys[row] ^ mixed(place.astype(np.uint64) + np.uint64(0x51ED27)))
        ids, n = _sample_run(v, data, starts[a:b], ends[a:b], seed)
        parts.append(ids)
        counts.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])[of_row]


def _sample_run(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of a run of words, and the number of each word."""
    _, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    first_at, first_end = starts[first], ends[first]
    filled = np.cumsum(first_end - first_at)
    group_of = np.minimum((filled - 1) // _LATTICE, len(first) - 1)
    by_group = np.argsort(group_of[which], kind="stable")
    bounds = np.searchsorted(group_of[which][by_group], np.arange(int(group_of[-1]) + 2))
    counts = np.zeros(len(starts), np.int64)
    drawn = []
    for g in np.unique(group_of).tolist():
        low, high = np.searchsorted(group_of, [g, g + 1]).tolist()
        words = by_group[bounds[g] : bounds[g + 1]]
        lattice = _lattice(v, data, first_at[low:high], first_end[low:high])
        steps = _draw(v, lattice, _filtered(v, lattice), which[words] - low, seed[words])
        for who, chosen in steps:
            counts[words[who]] += 1
            drawn.append((words[who], chosen))
    lasts = np.cumsum(counts)
    out = np.zeros(lasts[-1], np.int32)
    done = np.zeros(len(starts), np.int64)
    for who, chosen in drawn:
        done[who] += 1
        out[lasts[who] - done[who]] = chosen
    return out, counts


def _draw(v: Vocabulary, lattice: Lattice, logs: np.ndarray, unit: np.ndarray, seed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Backward sampling: per step the words that still draw and the piece each one drew, last pieces first."""
    end = np.repeat(np.arange(len(logs)), np.diff(lattice.firsts))
    reached = logs[end - lattice.sizes]
    able = np.isfinite(reached)
    end, ids, sizes = end[able], lattice.ids[able], lattice.sizes[able]
    firsts = np.searchsorted(end, np.arange(len(logs) + 1))
    total = np.exp(reached[able] + v.log_weight[ids] - logs[end])  # of the pieces of a place so far
    count = np.diff(firsts)
    for k in range(1, int(count.max(initial=0))):
        at = firsts[:-1][count > k] + k
        total[at] += total[at - 1]
    total[firsts[1:][count > 0] - 1] = np.inf  # the last possible one stays if rounding leaves a gap
    active = np.arange(len(unit))
    at = lattice.bounds[1:][unit] - 1
    start = lattice.bounds[:-1][unit]
    steps, step = [], 0
    while len(active):
        random = (mixed(seed[active] + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = firsts[at[active]]
        further = np.flatnonzero(total[edge] <= random)
        while len(further):
            edge[further] += 1
            further = further[total[edge[further]] <= random[further]]
        steps.append((active, ids[edge]))
        at[active] -= sizes[edge]
        active = active[at[active] > start[active]]
        step += 1
    return steps


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of rows of piece ids, as bytes and bounds; the space put before each text is taken off."""
    sizes = np.diff(v.firsts)[ids]
    data = v.text[ranges(v.firsts[:-1][ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], kept[ends]


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][filled], 0x20), offsets + np.concatenate([[0], np.cumsum(filled)])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """``docs`` without the text, with ``piece_ids`` (array of int), ``n_pieces`` and ``lossless``: whether decoding gave back the text."""
    sent = shared(docs.sparkSession, vocabulary(path, sharpness))
    added = ("piece_ids", "n_pieces", "lossless")
    fields = [f for f in docs.schema.fields if f.name not in (*added, text_column)]
    names = [f.name for f in fields]
    schema = T.StructType(fields).add("piece_ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("lossless", "boolean")
    keyed = docs.select(*[F.col(f"`{n}`") for n in names], F.xxhash64(F.col(f"`{id_column}`"), F.lit(seed)).alias(spare(docs, "_key")), F.col(f"`{text_column}`").cast("string").alias(spare(docs, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        v = received(sent)
        for batch in batches:
            keys = batch.column(len(names)).to_numpy().view(np.uint64)
            for first, end, data, offsets in pieces(batch.column(len(names) + 1), _PIECE):
                marked, places = _prefixed(data, offsets)
                ids, bounds = sample(v, marked, places, keys[first:end])
                back, back_bounds = decode(v, ids, bounds)
                same = np.array_equal(back, data) and np.array_equal(back_bounds, offsets)
                lossless = [same or back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(back_bounds, back_bounds[1:], offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, end - first) for c in batch.columns[: len(names)]],
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(bounds)),
                        pa.array(lossless, pa.bool_()),
                    ],
                    names=[*names, *added],
                )

    return keyed.mapInArrow(run, schema)


def decoded(encoded: DataFrame, path: str, name: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``piece_ids`` added."""
    sent = shared(encoded.sparkSession, vocabulary(path))
    names = [n for n in encoded.columns if n != name]
    schema = T.StructType([f for f in encoded.schema.fields if f.name != name]).add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = received(sent)
        for batch in batches:
            ids = batch.column(names.index("piece_ids"))
            bounds = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            data, ends = decode(v, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), bounds)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[a:b].decode() for a, b in zip(ends, ends[1:])], pa.string())], names=[*names, name])

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
