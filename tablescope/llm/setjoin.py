"""Exact similarity join of word sets, shared by the line and the document operators.

Sets (of word or shingle hashes) that are equal share an id, a 64-bit digest of their members, so
copies collapse before anything is compared. Tokens are ordered by rarity, where rarity is a count
over all sets in a table of fixed size; any fixed order gives the same links, rarity only keeps lists
short. Two sets that are similar enough share a token among the first few of each, the prefix, so
each prefix token has a list of the sets that have it. Lists travel as packed blocks dealt by a hash of
the token. Tokens frequent enough to make a long list are split over pairs of blocks of sets, which
together hold every pair of the list.

Within a list, positions and sizes (and, if wished, a parity bitmap of the set) bound the overlap of a
pair from above; pairs under the needed overlap are skipped. A short list gives all its other pairs. Small sets with a bitmap are
tested in the list of their first common members alone, as far as positions tell. There, bitmaps leave hardly a pair that is not similar,
so a set with many pairs in a list gives the first alone, and keeps the others beside it; they are tested if it fails. Where a task has
too many pairs to keep, the lists of sets still open are laid out once more with the members of their sets, and settle by themselves
whether any set before is similar; nothing but the ids of sets found later leaves them. That loses nothing where only earlier
sets are asked for, as lists are in order of first place. In a long list of large sets, each set is first compared with the first set alone. A set found similar to it takes its answer from
there; only the others are then compared with the rest of their lists, and only with sets not already known to
hang together with them. Lists are kept in order of set size and position, so that blocks of sets that are too small or
too large are skipped. Signatures (parities of the members by hash bucket) bound the difference of large sets from below.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.arrays import give_back, mixed, pieces, ranges, row_sums, sort_rows
from tablescope.llm.sides import counted, release
from tablescope.operators.order import materialize

SKETCH_SLICE_BITS = 16
SHORT_LIST = 6
LONGEST_LIST = 1 << 16  # lists longer than this are split
FREQUENT = 1024  # tokens of more small sets than this only count together with others
BLOCK_BYTES = 12 << 20  # aim for what one task of the join holds
ENTRIES_A_TASK = 200_000
PAIRS_AT_ONCE = 1 << 19
MOST_PAIRS = 1 << 20  # of small sets that a task keeps
SIDE_BY_SIDE = 64  # longest list of small sets that is compared along with others
MOST_SEEN = 500_000  # sets whose place a task remembers
ASKED_BITS = 1 << 25  # places of a table of keys or ids that are looked at again
HALF_TELLS = 14  # differences up to which half a bitmap tells most sets apart
MEMBERS_AT_ONCE = 1 << 19  # of the pairs that a task verifies

_ENTRY = ("key", "id", "doc", "n", "pos")
_TYPES = (np.uint64, np.uint64, np.int64, np.int32, np.int32)
_BITMAP = (("low", np.uint64), ("high", np.uint64))
_UNIT = (("unit", np.int32),)
_SMALL = ("doc", "n", "pos", "unit")  # packed byte by byte: their higher bytes are mostly equal, which shuffles compress

#: (bytes, offsets) -> (members sorted within each set, bounds of the sets, row of each set, number of the set in its row)
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Join:
    """What to compare: sets linked when ``den * overlap >= num * union``."""

    sets: Sets
    num: int = 4
    den: int = 5
    bitmap: bool = False  # for small sets: parities of the members by 128 buckets travel with each entry
    signature: bool = False  # for large sets: parities by 512 or more buckets, looked up for chosen pairs
    sketch_bits: int = 22
    skip_single: bool = False  # tokens that one set has can't be shared
    only_earlier: bool = False  # asked is whether an earlier set is similar, else how sets hang together


def _ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return mixed(row_sums(mixed(values), bounds) + mixed(np.diff(bounds).astype(np.uint64)))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parities of the members by hash bucket: four or more buckets per member, 512 at least, a power of two."""
    width = 1 << np.maximum(9, np.ceil(np.log2(np.maximum(4 * np.diff(bounds), 1))).astype(np.int64))
    ends = np.cumsum(width)
    owner = np.repeat(np.arange(len(width)), np.diff(bounds))
    bucket = (ends - width)[owner] + (values & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(bucket, minlength=int(width.sum())).astype(np.uint8) & 1).tobytes()
    return [raw[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist())]


def _folded(signatures: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) over fewer buckets."""
    while signatures.shape[1] > words:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def _docs(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids; a missing one sorts last."""
    return batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def survey(docs: DataFrame, join: Join) -> DataFrame:
    """One row per set (kind 0: doc_id, row, unit, id, n, blob the signature) and packed token counts (kind 1: unit the slice)."""
    schema = "kind int, doc_id long, row long, unit int, id long, n int, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shift = np.uint64(64 - join.sketch_bits)
        width = 1 << min(SKETCH_SLICE_BITS, join.sketch_bits)
        pending, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pending, held
            found, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *pending]), return_counts=True)
            slices, firsts = np.unique(found // width, return_index=True)
            blobs = []
            for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(found)]):
                blobs.append(zlib.compress((found[a:b] % width).astype(np.uint16).tobytes() + counts[a:b].astype(np.uint32).tobytes(), 1))
            n = len(slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(slices.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(blobs, pa.binary())],
                names=["kind", "doc_id", "row", "unit", "id", "n", "blob"],
            )
            pending, held = [], 0

        for batch in batches:
            ids = batch.column(0)
            for first, _, data, offsets in pieces(batch.column(1)):
                values, bounds, rows, units = join.sets(data, offsets)
                pending.append((values >> shift).astype(np.int32))
                held += len(values)
                if held > 1 << 22:
                    yield from flush()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(rows), np.int32)),
                        ids.take(pa.array(rows + first)).cast(pa.int64()),
                        batch.column(2).take(pa.array(rows + first)),
                        pa.array(units.astype(np.int32)),
                        pa.array(_ids(values, bounds).view(np.int64)),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array(_signatures(values, bounds), pa.binary()) if join.signature else pa.nulls(len(rows), pa.binary()),
                    ],
                    names=["kind", "doc_id", "row", "unit", "id", "n", "blob"],
                )
        yield from flush()

    return materialize(docs.mapInArrow(run, schema))


def rarity(surveyed: DataFrame, join: Join) -> np.ndarray:
    """A code of one byte for each bucket of tokens, 8 steps to a doubling of its count.

    The table has 2^sketch_bits bytes whatever the size of the corpus; it is all the driver sees.
    """
    width = 1 << min(SKETCH_SLICE_BITS, join.sketch_bits)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for blob in table.column("blob"):
            raw = zlib.decompress(blob.as_py())
            at, n = np.frombuffer(raw, np.uint16, len(raw) // 6), np.frombuffer(raw, np.uint32, len(raw) // 6, len(raw) // 6 * 2)
            total[at] += n
        code = np.ceil(8 * np.log2(np.maximum(total, 1).astype(np.float64))) + (total > 0)
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([np.minimum(code, 255).astype(np.uint8).tobytes()], pa.binary())})

    codes = np.zeros((1 << join.sketch_bits) // width * width, np.uint8).reshape(-1, width)
    for row in surveyed.where("kind = 1").select("unit", "blob").groupBy("unit").applyInArrow(merge, "unit int, blob binary").toLocalIterator():
        codes[row["unit"]] = np.frombuffer(row["blob"], np.uint8)
    return codes.reshape(-1)


def _fields(join: Join) -> list[tuple[str, type]]:
    return [*zip(_ENTRY, _TYPES), *(_BITMAP if join.bitmap else ()), *(_UNIT if join.only_earlier else ())]


def _planes(entries: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The columns of entries as they are packed."""
    out = []
    for name, v in entries.items():
        raw = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), v.itemsize)
        out += [np.ascontiguousarray(raw[:, k]) for k in range(v.itemsize)] if name in _SMALL else [raw]
    return out


def _pack(entries: dict[str, np.ndarray]) -> bytes:
    return b"".join(v.tobytes() for v in _planes(entries))


def _column(blob: bytes, name: str, kind: type, n: int, at: int) -> np.ndarray:
    """One column of ``n`` packed entries."""
    if name not in _SMALL or not n:
        return np.frombuffer(blob, kind, n, at)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _unpack(blobs: list[bytes], join: Join) -> dict[str, np.ndarray]:
    names = _fields(join)
    width = sum(np.dtype(t).itemsize for _, t in names)
    parts: dict[str, list] = {name: [] for name, _ in names}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in names:
            parts[name].append(_column(blob, name, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in names}


def _marks(keys: DataFrame) -> np.ndarray:
    """A table of ``ASKED_BITS`` bits with the places of the first column's values marked; 4 MB whatever their number."""
    place = keys[keys.columns[0]].bitwiseAND(F.lit(ASKED_BITS - 1)) + 1  # Spark's buckets and their values count from 1
    marked = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(ASKED_BITS // 8, np.uint8)
    for row in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        first = (row["bucket"] - 1) * len(row["bits"])
        out[first : first + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the place of each key is marked."""
    bit = (keys & np.uint64(ASKED_BITS - 1)).astype(np.int64)
    return ((marks[bit >> 3] >> (bit & 7)) & 1).astype(bool)


def postings(docs: DataFrame, join: Join, codes_all: Broadcast, slices: int, total: int, asked_keys: np.ndarray | None = None) -> DataFrame:
    """(slice, blob): the entries of every set, packed by the slice their key falls in.

    With ``asked_keys``, a table of ``ASKED_BITS`` bits, only those of keys whose place is marked, and with their members. A set that a
    task finds again gives its entries again if the place is before the one they were given with.
    """
    keys_all = docs.sparkSession.sparkContext.broadcast(asked_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        codes, keys = codes_all.value, keys_all.value
        shift = np.uint64(64 - join.sketch_bits)
        seen: dict[int, tuple[int, int]] = {}  # the place each set was given with
        unseen = (1 << 63, 0)
        held: list[dict[str, np.ndarray]] = []  # key, owner and position of entries
        sets_held: list[dict[str, np.ndarray]] = []  # what all entries of a set share
        members_held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, sets_held, members_held, size
            if held:
                entries, of_sets = ({k: np.concatenate([h[k] for h in part]) for k in part[0]} for part in (held, sets_held))
                slice_of = (mixed(entries["key"] ^ np.uint64(0xA5A5A5A5)) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(slice_of, kind="stable")
                slice_of = slice_of[order]
                owner = (entries["owner"] + np.repeat(np.cumsum([0, *(len(h["id"]) for h in sets_held[:-1])]), [len(h["key"]) for h in held]))[order]
                entries = {name: entries[name][order] if name in entries else of_sets[name][owner] for name, _ in _fields(join)}
                cuts = np.flatnonzero(np.diff(slice_of, prepend=-1))
                ends = np.append(cuts[1:], len(slice_of))
                planes = _planes(entries)
                blobs = [b"".join(v[a:b].tobytes() for v in planes) for a, b in zip(cuts, ends)]
                if keys is not None:
                    whole, member_at, sizes = np.concatenate(members_held), of_sets["member_at"][owner], entries["n"].astype(np.int64)
                    tails = ({"members": whole[ranges(member_at[a:b], sizes[a:b])], "count": np.array([b - a])} for a, b in zip(cuts, ends))
                    blobs = [blob + _pack(tail) for blob, tail in zip(blobs, tails)]
                yield pa.RecordBatch.from_arrays([pa.array(slice_of[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "blob"])
            held, sets_held, members_held, size = [], [], [], 0

        for batch in batches:
            ids_of_docs = _docs(batch)
            for first, _, data, offsets in pieces(batch.column(1)):
                values, bounds, rows, units = join.sets(data, offsets)
                ids = _ids(values, bounds)
                sizes = np.diff(bounds)
                docs_of_sets = ids_of_docs[rows + first]
                order = np.lexsort((units, docs_of_sets, ids))
                order = order[sizes[order] > 0]
                order = order[np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])[: len(order)])]  # the first place of each
                new = np.zeros(len(ids), bool)
                for i, x, place in zip(order.tolist(), ids[order].tolist(), zip(docs_of_sets[order].tolist(), units[order].tolist())):
                    if place < seen.get(x, unseen):
                        seen[x] = place
                        new[i] = True
                if len(seen) > MOST_SEEN:
                    seen.clear()
                chosen = np.flatnonzero(new)
                if not len(chosen):
                    continue
                sizes = sizes[chosen]
                members = values[ranges(bounds[:-1][chosen], sizes)]
                inner = np.concatenate([[0], np.cumsum(sizes)])
                code = codes[(members >> shift).astype(np.int64)]
                order_key = (code.astype(np.uint64) << np.uint64(56)) | (members >> np.uint64(8))
                sort_rows(order_key, inner)
                prefix = sizes - -(-join.num * sizes // join.den) + 1
                some = join.den * sizes >= join.num * (sizes + 1)  # a larger set can be similar
                some |= join.num * sizes <= join.den * (sizes - 1)  # or a smaller one
                entry, most = _keys(join, order_key, inner, prefix * some, total)
                if keys is not None and not (most > LONGEST_LIST).any():  # else keys change below
                    asked = _marked(keys, entry["key"])
                    entry, most = {k: v[asked] for k, v in entry.items()}, most[asked]
                of_sets = {"id": ids[chosen], "doc": docs_of_sets[chosen], "n": sizes.astype(np.int32)}
                if join.bitmap:
                    bit = np.uint64(1) << (members & np.uint64(63))
                    low = bit * ((members & np.uint64(64)) == 0)
                    of_sets["low"] = np.bitwise_xor.reduceat(low, inner[:-1])
                    of_sets["high"] = np.bitwise_xor.reduceat(bit ^ low, inner[:-1])
                if join.only_earlier:
                    of_sets["unit"] = units[chosen].astype(np.int32)
                hot = most > LONGEST_LIST
                if hot.any():
                    entry = _split(entry, of_sets["id"], hot, np.ceil(most / LONGEST_LIST).astype(np.int64))
                if keys is not None:
                    asked = _marked(keys, entry["key"])
                    entry = {k: v[asked] for k, v in entry.items()}
                    if not asked.any():
                        continue
                    of_sets["member_at"] = inner[:-1] + sum(map(len, members_held))
                    members_held.append(members)
                    size += len(members) // 4
                held.append(entry)
                sets_held.append(of_sets)
                size += max(len(entry["key"]), len(chosen))
                if size > 400_000:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "slice int, blob binary")


def _keys(join: Join, members: np.ndarray, firsts: np.ndarray, prefix: np.ndarray, total: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The keys of sets whose members are in order of rarity, with owner and position, and how many sets may share each.

    A key is a prefix token. With bitmaps, a token that many of the ``total`` sets have makes keys with each later token of a
    prefix longer by one instead, and so on up to four tokens: similar sets share their first k common tokens within the first
    prefix + k - 1, so they still share a key. The position tells how many members before the last one of the key are not part of it.
    """
    count = 2.0 ** ((members >> np.uint64(56)).astype(np.int64) / 8)
    owner, at = np.repeat(np.arange(len(prefix)), prefix), ranges(firsts[:-1], prefix)
    key, most = members[at], count[at]
    out: dict[str, list[np.ndarray]] = {"key": [], "owner": [], "pos": [], "most": []}
    for depth in range(1, 5):
        keep = count[at] > 1 if join.skip_single else np.ones(len(at), bool)
        hot = keep & (most > FREQUENT) if join.bitmap and depth < 4 else np.zeros(len(at), bool)
        give = keep & ~hot
        for name, values in (("key", key), ("owner", owner), ("pos", at - firsts[:-1][owner] - (depth - 1)), ("most", most)):
            out[name].append(values[give])
        if not hot.any():
            break
        owner, at, key, most = owner[hot], at[hot], key[hot], most[hot]
        ends = np.minimum(firsts[:-1][owner] + prefix[owner] + depth, firsts[1:][owner])
        n = np.maximum(ends - at - 1, 0)
        at = ranges(at + 1, n)
        owner = np.repeat(owner, n)
        key = mixed(np.repeat(key, n) * np.uint64(0x9E3779B97F4A7C15) + members[at])
        most = np.repeat(most, n) * count[at] / max(total, 1)
    entry = {name: np.concatenate(parts) for name, parts in out.items()}
    most = entry.pop("most")
    entry["pos"] = entry["pos"].astype(np.int32)
    return entry, most


def _split(entry: dict[str, np.ndarray], ids: np.ndarray, hot: np.ndarray, blocks: np.ndarray) -> dict[str, np.ndarray]:
    """Give the entries of frequent tokens to every pair of blocks their set belongs to."""
    at = np.flatnonzero(hot)
    m = blocks[at]
    again = np.repeat(at, m)
    other = ranges(np.zeros(len(at), np.int64), m).astype(np.uint64)
    own = mixed(ids[entry["owner"][again]]) % np.repeat(m, m).astype(np.uint64)
    pair = (np.minimum(own, other) << np.uint64(32)) | np.maximum(own, other)
    out = {k: np.concatenate([v[~hot], v[again]]) for k, v in entry.items()}
    out["key"][(~hot).sum() :] = mixed(out["key"][(~hot).sum() :] ^ mixed(pair + np.uint64(1)))
    return out


def _possible(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, join: Join) -> np.ndarray:
    """Whether sets i and j can still have the needed overlap."""
    n, m, p, q = (e[c][k].astype(np.int64) for c, k in (("n", i), ("n", j), ("pos", i), ("pos", j)))
    need = -(-join.num * (n + m) // (join.num + join.den))
    most = np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1)
    ok = (join.den * np.minimum(n, m) >= join.num * np.maximum(n, m)) & (most >= need) & (e["id"][i] != e["id"][j])
    if join.bitmap:
        differ = np.bitwise_count(e["low"][i] ^ e["low"][j]).astype(np.int64) + np.bitwise_count(e["high"][i] ^ e["high"][j])
        ok &= differ <= n + m - 2 * need
        ok &= p + q <= n + m - 2 * need  # in the list of their first common members, none before is common
    return ok


def _lists(blobs: list[bytes], join: Join, more: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries of the keys that several sets have (with ``more`` columns), ordered by key and first place; starts and lengths of the lists."""
    e = _unpack(blobs, join) | (more or {})
    order = np.argsort(e["key"])
    key = e["key"][order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:].copy()
    order, key = order[same], key[same]
    if not len(order):
        return {k: v[order] for k, v in e.items()}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))  # of the list
    by = _by_place(e, order, number)
    order, number = order[by], number[by]
    _, once = np.unique(mixed(number.astype(np.uint64) ^ mixed(e["id"][order])), return_index=True)  # of copies from several tasks, the first
    once.sort()
    order, number = order[once], number[once]
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return {k: v[order] for k, v in e.items()}, starts, np.diff(np.append(starts, len(order)))


def _by_place(e: dict[str, np.ndarray], order: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The order by list, then first place, then id."""
    least, doc = int(e["doc"][order].min()), e["doc"][order]
    unit = e["unit"][order].astype(np.int64) if "unit" in e else np.zeros(len(order), np.int64)
    units = int(unit.max()) + 1
    docs = int(doc.max()) - least + 1
    if (int(number[-1]) + 1) * docs * units < 1 << 62:
        place = (number * docs + (doc - least)) * units + unit
        by = np.argsort(place, kind="stable")
        place, ids = place[by], e["id"][order][by]
        if not ((place[1:] == place[:-1]) & (ids[1:] != ids[:-1])).any():
            return by
    place = _places(e, order)
    if (int(number[-1]) + 1) * (int(place.max()) + 1) < 1 << 62:
        return np.argsort(number * (int(place.max()) + 1) + place, kind="stable")
    return np.lexsort((place, number))


def _places(e: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
    """Ranks of the entries' first places (document, then unit if there is one, then id), equal for copies."""
    _, doc = np.unique(e["doc"][order], return_inverse=True)
    if "unit" in e:
        unit = e["unit"][order].astype(np.int64)
        doc = doc * (int(unit.max()) + 1) + unit
    ids = e["id"][order].view(np.int64)
    by = np.argsort(doc, kind="stable")
    tied = doc[by][1:] == doc[by][:-1]
    if (tied & (ids[by][1:] != ids[by][:-1])).any():  # different sets at one place: by id
        by = np.lexsort((ids, doc))
        step = np.concatenate([[0], (doc[by][1:] != doc[by][:-1]) | (ids[by][1:] != ids[by][:-1])])
        doc = np.empty(len(by), np.int64)
        doc[by] = np.cumsum(step)
    return doc


def _leading(later: list[np.ndarray], earlier: list[np.ndarray], most: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The pairs ordered by the later set, and of each later set only the ``most`` first ones, if that is given."""
    i, j = np.concatenate([np.zeros(0, np.int64), *later]), np.concatenate([np.zeros(0, np.int64), *earlier])
    if len(i):
        width = int(i.max()) + 1
        i, j = np.divmod(np.sort(i * width + j), width)
        if most is not None:
            firsts = np.flatnonzero(np.diff(i, prepend=-1))
            rank = np.arange(len(i)) - np.repeat(firsts, np.diff(np.append(firsts, len(i))))
            i, j = i[rank < most], j[rank < most]
    return [i], [j]


class _Found:
    """Possible pairs (later, earlier) so far; once they are many, of each later set the first few, one more than are tested at once.
    ``cut`` marks the sets that lost others by that."""

    def __init__(self, e: dict[str, np.ndarray], join: Join) -> None:
        self.e, self.join, self.cut = e, join, np.zeros(len(e["id"]), bool)
        self.near, self.near_held = [], 0  # pairs of close bitmaps, not tested yet
        self.later, self.earlier, self.held = [], [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.near.append((i, j))
        self.near_held += len(i)
        if self.near_held > PAIRS_AT_ONCE // 4:
            self._settle()

    def _settle(self) -> None:
        i, j = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*self.near)) if self.near else np.zeros((2, 0), np.int64)
        ok = _possible(self.e, i, j, self.join)
        i, j = i[ok], j[ok]
        self.near, self.near_held = [], 0
        self.later.append(np.maximum(i, j))
        self.earlier.append(np.minimum(i, j))
        self.held += len(i)
        if self.held > MOST_PAIRS:
            sets, pairs = np.unique(np.concatenate(self.later), return_counts=True)
            self.cut[sets[pairs > SHORT_LIST + 1]] = True
            self.later, self.earlier = _leading(self.later, self.earlier, SHORT_LIST + 1)
            self.held = 0

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        later, earlier = _leading(self.later, self.earlier)
        return later[0], earlier[0]


def _close(e: dict[str, np.ndarray], start: int, n: int, join: Join, found: _Found) -> None:
    """Add the pairs of close bitmaps within one list. Sets are compared in order of size, block by block, so that
    others than those of a fitting size are skipped; where half the bitmap tells most pairs apart, it alone is compared at first.
    """
    order = start + np.argsort(e["n"][start : start + n], kind="stable")
    sizes = e["n"][order].astype(np.int64)
    larger = join.den * sizes // join.num
    high = np.searchsorted(sizes, larger, "right")
    limit = np.minimum((join.den - join.num) * (sizes + larger) // (join.num + join.den), 255).astype(np.uint8)  # no similar larger set differs in more members
    halves = [e[c][order] for c in ("low", "high")]
    step = max(1, min(64, PAIRS_AT_ONCE // n))
    for first in range(0, n, step):
        end = min(n, first + step)
        a, b = first + 1, int(high[end - 1])
        if a >= b:
            continue
        differ = np.bitwise_count(halves[0][first:end, None] ^ halves[0][None, a:b])
        if limit[end - 1] > HALF_TELLS:
            differ += np.bitwise_count(halves[1][first:end, None] ^ halves[1][None, a:b])
        i, j = np.divmod(np.flatnonzero(differ <= limit[first:end, None]), b - a)
        i, j = i + first, j + a
        ok = (j > i) & (j < high[i])
        found.add(order[i[ok]], order[j[ok]])


def _near_pairs(e: dict[str, np.ndarray], starts: np.ndarray, lengths: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The possible pairs within lists, as (later, earlier), ordered, and which entries have only some of theirs, first ones among them.
    Lists of moderate length advance side by side.
    """
    found = _Found(e, join)
    some = lengths <= SIDE_BY_SIDE
    for start, n in zip(starts[~some].tolist(), lengths[~some].tolist()):
        _close(e, start, n, join, found)
    starts, lengths = starts[some], lengths[some]
    for lag in range(1, SIDE_BY_SIDE):
        if lag & (lag - 1) == 0:  # at 1, 2, 4 ...: leave out the lists that are done
            starts, lengths = starts[lengths > lag], lengths[lengths > lag]
            at = ranges(starts, lengths)
            if not len(at):
                break
            which = np.repeat(np.arange(len(starts)), lengths)
            low, high = e["low"][at], e["high"][at]
            limit = ((join.den - join.num) * e["n"][at].astype(np.int64) // join.num + 1).astype(np.int32)  # more than a similar set differs by
        differ = np.bitwise_count(low[lag:] ^ low[:-lag]).astype(np.int32) + np.bitwise_count(high[lag:] ^ high[:-lag])
        k = np.flatnonzero((which[lag:] == which[:-lag]) & (differ <= limit[lag:]))
        found.add(at[k + lag], at[k])
    return *found.ordered(), found.cut


def _unpack_with_members(blobs: list[bytes], counts: list[int], join: Join) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(fixed parts of the blobs, members of all entries, where each entry's begin)."""
    width = sum(np.dtype(t).itemsize for _, t in _fields(join))
    n_at = sum(np.dtype(t).itemsize for c, t in _fields(join)[: _ENTRY.index("n")])
    fixed, members, sizes = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob, count in zip(blobs, counts):
        fixed.append(blob[: width * count])
        sizes.append(_column(blob, "n", np.int32, count, n_at * count).astype(np.int64))
        members.append(np.frombuffer(blob, np.uint64, int(sizes[-1].sum()), width * count))
    sizes = np.concatenate(sizes)
    return fixed, np.concatenate(members), np.cumsum(sizes) - sizes


def _similar(members: np.ndarray, at: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, join: Join) -> np.ndarray:
    """Whether the sets i and j are similar enough, by their members."""
    out = np.zeros(len(i), bool)
    total = n[i] + n[j]
    by = np.argsort(total, kind="stable")
    first = 0
    while first < len(by):
        width = int(total[by[min(len(by), first + (1 << 12)) - 1]])
        some = by[first : first + min(1 << 12, max(1, (1 << 20) // width))]
        width = int(total[some[-1]])
        table = np.arange(width, dtype=np.uint64)[None, :].repeat(len(some), axis=0)  # fillers differ from each other
        used = np.zeros(len(some), np.int64)
        for side in (i[some], j[some]):
            row = np.repeat(np.arange(len(some)), n[side])
            table[row, ranges(used, n[side])] = members[ranges(at[side], n[side])]
            used = used + n[side]
        table.sort(axis=1)
        overlap = (table[:, 1:] == table[:, :-1]).sum(axis=1)
        out[some] = join.den * overlap >= join.num * (total[some] - overlap)
        first += len(some)
    return out


def _asked_later(blobs: list[bytes], asked: np.ndarray, join: Join) -> np.ndarray:
    """Those of the ``asked`` sets (key and id mixed, sorted) that are similar to a set before them in their list."""
    counts = [int(np.frombuffer(b[-8:], np.int64)[0]) for b in blobs]
    fixed, members, at = _unpack_with_members([b[:-8] for b in blobs], counts, join)
    e, starts, lengths = _lists(fixed, join, {"members": at})
    member_at, n = e["members"], e["n"].astype(np.int64)
    name = mixed(e["key"] ^ mixed(e["id"]))
    is_asked = asked[np.minimum(np.searchsorted(asked, name), len(asked) - 1)] == name
    found = np.zeros(len(name), bool)
    for start, size in zip(starts.tolist(), lengths.tolist()):
        ask = start + np.flatnonzero(is_asked[start : start + size])
        step = max(1, PAIRS_AT_ONCE // size)
        for k in range(0, len(ask), step):
            block = ask[k : k + step]
            end = int(block[-1])
            limit = 2 * (join.den - join.num) * int(n[start : start + size].max()) // join.den  # no similar pair here differs in more members
            differ = np.bitwise_count(e["low"][block][:, None] ^ e["low"][None, start:end]) + np.bitwise_count(e["high"][block][:, None] ^ e["high"][None, start:end])
            i, j = np.nonzero((differ <= limit) & (np.arange(start, end)[None, :] < block[:, None]))
            i, j = block[i], start + j
            ok = _possible(e, i, j, join)
            i, j = i[ok], j[ok]
            found[i[_similar(members, member_at, n, i, j, join)]] = True
    return np.unique(e["id"][found])


_FOUND = "kind int, a long, b long, n int, pos int, key long, more array<long>"


def _first_near_pairs(blobs: list[bytes], join: Join, slice_of: int) -> pa.Table:
    """Pairs a, b of small sets: all of a set b that has few in a list (kind 0), else the first (kind 1, with the list's key, as ``pos`` its slice, and
    as ``more`` the sets of its other pairs there, unless the slice has too many pairs).
    """
    e, starts, lengths = _lists(blobs, join)
    later, earlier, cut = _near_pairs(e, starts, lengths, join)
    head = np.flatnonzero(np.diff(later, prepend=-1))
    candidates = np.diff(np.append(head, len(later)))
    few = np.repeat(candidates <= SHORT_LIST, candidates)
    pairs, votes = np.unique(earlier[few] * len(e["id"]) + later[few], return_counts=True)  # of copies in other lists, some remain
    i, j = np.divmod(pairs, max(1, len(e["id"])))
    head, candidates = head[candidates > SHORT_LIST], candidates[candidates > SHORT_LIST]
    listed = np.where(cut[later[head]], 0, candidates - 1)
    bounds = pa.array(np.concatenate([[0], np.cumsum(listed)]).astype(np.int32), mask=np.append(cut[later[head]], False))
    others = pa.ListArray.from_arrays(bounds, pa.array(e["id"][earlier[ranges(head + 1, listed)]].view(np.int64)))
    more = pa.chunked_array([pa.nulls(len(i), others.type), others])
    kind = np.repeat(np.array([0, 1], np.int32), [len(i), len(head)])
    key = np.concatenate([np.zeros(len(i), np.uint64), e["key"][later[head]]])
    i, j = np.concatenate([i, earlier[head]]), np.concatenate([j, later[head]])
    columns = {"kind": kind, "a": e["id"][i].view(np.int64), "b": e["id"][j].view(np.int64), "n": np.append(votes, np.ones(len(head))).astype(np.int32)}
    columns |= {"pos": np.full(len(i), slice_of, np.int32), "key": key.view(np.int64)}
    return pa.table({k: pa.array(v) for k, v in columns.items()} | {"more": more})


def _first_pairs(blobs: list[bytes], join: Join, slice_of: int = 0) -> pa.Table:
    """Pairs a, b (kind 0, and 1 if from a long list), pairs of a long list that are no candidates (kind 2), and the entries b of long lists a (kind 3)."""
    if join.bitmap:
        return _first_near_pairs(blobs, join, slice_of)
    e, starts, lengths = _lists(blobs, join)
    kinds, left, right = [], [], []

    def give(kind: int, i: np.ndarray, j: np.ndarray) -> None:
        kinds.append(np.full(len(i), kind, np.uint64))
        left.append(e["id"][i])
        right.append(e["id"][j])

    short = lengths <= SHORT_LIST
    for a in range(SHORT_LIST - 1):
        for b in range(a + 1, SHORT_LIST):
            s = starts[short & (lengths > b)]
            ok = _possible(e, s + a, s + b, join)
            give(0, s[ok] + a, s[ok] + b)
    long_at, long_n = starts[~short], lengths[~short]
    other = ranges(long_at + 1, long_n - 1)
    head = np.repeat(long_at, long_n - 1)
    ok = _possible(e, head, other, join)
    give(1, head[ok], other[ok])
    give(2, head[~ok], other[~ok])
    rows, votes = np.unique(np.stack([np.concatenate(x) for x in (kinds, left, right)]), axis=1, return_counts=True)
    whole = ranges(long_at, long_n)
    none = np.full(rows.shape[1], slice_of, np.int32)
    columns = {
        "kind": np.concatenate([rows[0], np.full(len(whole), 3, np.uint64)]).astype(np.int32),
        "a": np.concatenate([rows[1], e["key"][whole]]).view(np.int64),
        "b": np.concatenate([rows[2], e["id"][whole]]).view(np.int64),
        "n": np.concatenate([votes.astype(np.int32), e["n"][whole]]),
        "pos": np.concatenate([none, e["pos"][whole]]),
        "key": np.zeros(len(none) + len(whole), np.int64),
    }
    return pa.table({k: pa.array(v) for k, v in columns.items()} | {"more": pa.nulls(len(none) + len(whole), pa.list_(pa.int64()))})


def _differences(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many buckets the signatures differ, a lower bound of the sets' difference."""
    out = np.zeros(len(x), np.int64)
    widths = np.stack([pc.binary_length(v).to_numpy(zero_copy_only=False) // 8 for v in (x, y)])
    for w in np.unique(widths, axis=1).T:
        at = np.flatnonzero((widths == w[:, None]).all(axis=0))
        for part in np.array_split(at, max(1, len(at) * int(w.max()) // (1 << 20))):
            a, b = (np.frombuffer(b"".join(v.take(pa.array(part)).to_pylist()), np.uint64).reshape(len(part), n) for v, n in zip((x, y), w))
            words = min(a.shape[1], b.shape[1])
            out[part] = np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(axis=1, dtype=np.int64)
    return out


def _likely(pairs: DataFrame, surveyed: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave possible."""
    if not join.signature:
        return pairs
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    known = surveyed.where("kind = 0").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("blob").alias("s"), F.first("n").alias("n"))
    both = pairs.join(known.withColumnsRenamed({"id": "a", "s": "x", "n": "p"}), "a").join(known.withColumnsRenamed({"id": "b", "s": "y", "n": "q"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("p").to_numpy().astype(np.int64) + batch.column("q").to_numpy()
            need = -(-join.num * total // (join.num + join.den))
            ok = pa.array(_differences(batch.column("x"), batch.column("y")) <= total - 2 * need)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "p", "q", "x", "y").mapInArrow(run, "a long, b long")


def _further_pairs(table: pa.Table, join: Join) -> pa.Table:
    """All possible pairs of the asked sets with the rest of their long lists, but for those that hang together already."""
    e = {k: table.column(k).to_numpy() for k in ("list", "id", "n", "pos", "group", "asked")}
    order = np.lexsort((e["pos"], e["n"], e["list"]))
    e = {k: v[order] for k, v in e.items()}
    signatures = None
    if join.signature:
        signatures = np.concatenate([np.zeros((0, 8), np.uint64), *[_folded(np.frombuffer(x.as_buffer(), np.uint64)[None, :], 8) for x in table.column("signature")]])[order]
    starts = np.flatnonzero(np.concatenate([[len(order) > 0], e["list"][1:] != e["list"][:-1]])[: len(order)])
    pairs = [np.zeros((2, 0), np.int64)]
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
        n = e["n"][start:end].astype(np.int64)
        ask = np.flatnonzero(e["asked"][start:end])
        for block in np.array_split(ask, max(1, len(ask) // 256)):
            low = np.searchsorted(n, -(-join.num * n[block] // join.den))
            high = np.searchsorted(n, join.den * n[block] // join.num, "right")
            i, j = start + np.repeat(block, high - low), start + ranges(low, high - low)
            ok = _possible(e, i, j, join)
            ok &= e["group"][i] != e["group"][j]
            i, j = i[ok], j[ok]
            if signatures is not None and len(i):
                total = e["n"][i].astype(np.int64) + e["n"][j]
                need = -(-join.num * total // (join.num + join.den))
                ok = np.bitwise_count(signatures[i] ^ signatures[j]).sum(axis=1, dtype=np.int64) <= total - 2 * need
                i, j = i[ok], j[ok]
            if len(i):
                pairs.append(np.unique(np.stack([np.minimum(e["id"][i], e["id"][j]), np.maximum(e["id"][i], e["id"][j])]), axis=1))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def _again(again: DataFrame, join: Join, packed: Callable[[np.ndarray], DataFrame]) -> DataFrame:
    """(id) of the sets of ``again`` (slice, key, id) that are similar to one before them in one of these lists.

    A table of fixed size tells the tasks which lists to lay out once more, now with members, and each list settles its
    own sets: nothing but ids of sets found leaves it.
    """
    def ask(wanted: pa.Table, lists: pa.Table) -> pa.Table:
        found = np.zeros(0, np.uint64)
        if wanted.num_rows and lists.num_rows:
            key, own = (wanted.column(c).to_numpy().view(np.uint64) for c in ("key", "id"))
            found = _asked_later([b.as_py() for b in lists.column("blob")], np.sort(mixed(key ^ mixed(own))), join)
        return pa.table({"id": pa.array(found.view(np.int64))})

    lists = packed(_marks(again.select("key")))
    return again.groupBy("slice").cogroup(lists.groupBy("slice")).applyInArrow(ask, "id long")


def _more(found: DataFrame, surveyed: DataFrame, groups: DataFrame, again: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that the sets in ``again`` still have to be tested in."""
    entries = found.where("kind = 3").select(F.col("a").alias("list"), F.col("b").alias("id"), "n", "pos")
    entries = (
        entries.join(groups.withColumnRenamed("node", "id"), "id", "left")
        .join(again.withColumn("asked", F.lit(True)), "id", "left")
        .select("list", "id", "n", "pos", F.coalesce("component", "id").alias("group"), F.coalesce("asked", F.lit(False)).alias("asked"))
    )
    entries = materialize(entries)
    mixed_lists = entries.groupBy("list").agg(F.max("asked").alias("some"), (F.min("group") != F.max("group")).alias("several")).where("some AND several")
    entries = entries.join(mixed_lists.select("list"), "list", "left_semi")
    if join.signature:
        ids = entries.select("id").distinct()
        known = surveyed.where("kind = 0").join(ids, "id", "left_semi").groupBy("id").agg(F.first("blob").alias("signature"))
        entries = entries.join(known, "id")
    tasks = max(8, found.where("kind = 3").count() // ENTRIES_A_TASK)
    dealt = entries.withColumn("task", F.pmod(F.xxhash64("list"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(lambda table: _further_pairs(table, join), "a long, b long").distinct()


def _members(docs: DataFrame, surveyed: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """(id, members) of the sets that pairs name, from the texts they are first found in."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    places = surveyed.where("kind = 0").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    places = counted(places.select(F.coalesce("doc_id", F.lit(-1)).alias("_doc")).distinct())
    found = docs.join(places, F.coalesce(F.col(docs.columns[0]).cast("long"), F.lit(-1)) == F.col("_doc"), "left_semi")
    marks_all = docs.sparkSession.sparkContext.broadcast(_marks(pairs.select(F.explode(F.array("a", "b")).alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_all.value
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                values, bounds, _, _ = join.sets(data, offsets)
                ids, first = np.unique(_ids(values, bounds), return_index=True)
                some = _marked(marks, ids)  # a few others that share a place find no pair
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some].view(np.int64)),
                        pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1][first[some]].tolist(), bounds[1:][first[some]].tolist())], pa.binary()),
                    ],
                    names=["id", "members"],
                )

    return found.mapInArrow(run, "id long, members binary").groupBy("id").agg(F.first("members").alias("members"))


def _links(docs: DataFrame, surveyed: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that are similar enough, by the exact overlap of the two sets."""
    members = _members(docs, surveyed, pairs, join)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for c in ("x", "y")]
            filled = np.cumsum(sizes[0] + sizes[1])
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(filled, (filled[first - 1] if first else 0) + MEMBERS_AT_ONCE, "right")))
                part = batch.slice(first, end - first)
                n = np.concatenate([s[first:end] for s in sizes])
                members = np.concatenate([data.view(np.uint64) for c in ("x", "y") for _, _, data, _ in pieces(part.column(c), 1 << 62)])
                one = np.arange(end - first)
                similar = pa.array(_similar(members, np.cumsum(n) - n, n, one, one + len(one), join))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(similar), part.column("b").filter(similar)], names=["a", "b"])
                first = end

    joined = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(
        members.select(F.col("id").alias("b"), F.col("members").alias("y")), "b"
    )
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def first_places(surveyed: DataFrame) -> DataFrame:
    """(id, place, row, rows): where each set is found first, a missing document id last, in which row, and how often it is found."""
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "unit", "row")
    least = surveyed.where("kind = 0 AND n > 0").groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("rows"))
    return least.select("id", F.struct("place.doc", "place.unit").alias("place"), F.col("place.row").alias("row"), "rows")


def links(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(surveyed sets, result). ``docs`` has an id, a text and a row key column (see ``row_key``), in this order.

    The result has, with ``only_earlier``, the (id) of each set that is similar to a set first found
    before it; else verified pairs (a, b) that connect all sets which similar pairs connect.
    """
    surveyed = survey(docs, join)
    docs = docs.select(*docs.columns[:2])
    codes = docs.sparkSession.sparkContext.broadcast(rarity(surveyed, join))
    entries, total = surveyed.where("kind = 0").agg(F.sum(F.col("n") * (join.den - join.num) / join.den + 1), F.count_if(F.col("n") > 0)).first()
    slices = int(max(8, (entries or 0) * (48 if join.bitmap else 32) // BLOCK_BYTES))
    packed = postings(docs, join, codes, slices, total).repartition(slices, "slice")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        return _first_pairs([b.as_py() for b in table.column("blob")], join, key[0].as_py())

    found = materialize(packed.groupBy("slice").applyInArrow(first, _FOUND))
    del packed
    release(docs.sparkSession)  # the lists are the largest shuffle
    if join.only_earlier:
        # lists are in order of first place, with every task's first copy of a set in them: a comes before b
        pairs = materialize(found.where("kind < 2").select("a", "b").distinct())
        later = materialize(_links(docs, surveyed, pairs, join).select(F.col("b").alias("id")).distinct())
        open_sets = counted(found.where("kind = 1").select("key", "b").join(later.withColumnRenamed("id", "b"), "b", "left_anti"))
        if open_sets.isEmpty():
            return surveyed, later
        release(docs.sparkSession)
        rest = found.where("kind = 1").coalesce(max(8, slices // 8)).join(open_sets, ["key", "b"], "left_semi")
        rest = materialize(rest.select(F.col("pos").alias("slice"), "key", F.col("b").alias("id"), "more"))
        pairs = materialize(rest.select(F.explode("more").alias("a"), F.col("id").alias("b")).distinct())
        later = materialize(later.union(_links(docs, surveyed, pairs, join).select(F.col("b").alias("id"))).distinct())
        again = materialize(rest.where("more IS NULL").select("slice", "key", "id").join(later, "id", "left_anti"))
        if not again.isEmpty():
            release(docs.sparkSession)
            new = _again(again, join, lambda keys: postings(docs, join, codes, slices, total, keys))
            later = materialize(later.union(new).distinct())
        release(docs.sparkSession)
        return surveyed, later

    pairs = found.where("kind < 2").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("votes"))
    likely = materialize(_likely(pairs, surveyed, join).join(pairs, ["a", "b"]))
    # each set is first tested with the one it shares most lists with; most others then hang together with it already
    ends = likely.select(F.col("a").alias("id"), F.col("b").alias("other"), "votes").union(likely.select(F.col("b").alias("id"), F.col("a").alias("other"), "votes"))
    best = ends.groupBy("id").agg(F.max_by("other", F.struct("votes", F.negative("other"))).alias("other"))
    best = materialize(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    linked = _links(docs, surveyed, best, join)
    groups = materialize(_labels(linked))
    release(docs.sparkSession)
    rest = _apart(likely.join(best, ["a", "b"], "left_anti"), groups).select("a", "b")
    again = materialize(_apart(found.where("kind IN (1, 2)").select("a", "b").distinct(), groups).select(F.col("b").alias("id")).distinct())
    if not again.isEmpty():
        more = materialize(_more(found, surveyed, groups, again, join).join(likely, ["a", "b"], "left_anti"))
        rest = rest.union(_likely(more, surveyed, join)).distinct()
    return surveyed, linked.union(_links(docs, surveyed, materialize(rest), join))


def _labels(linked: DataFrame) -> DataFrame:
    """(node, component): a smallest neighbour's smallest neighbour. Nodes of one label hang together; more labels than needed only cost tests."""
    both = linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))
    return both.join(once.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("least").alias("least")).toDF("node", "component")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that do not hang together in ``groups`` (node, component)."""
    known = pairs.join(groups.toDF("a", "p"), "a", "left").join(groups.toDF("b", "q"), "b", "left")
    return known.where(F.coalesce("p", "a") != F.coalesce("q", "b"))
