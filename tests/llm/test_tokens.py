"""Encoders, token files and their readers: exact round trips and brute force."""

import glob
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tablescope.llm import piece_sampling, token_counts, wavelet
from tests.llm.conftest import texts

AWKWARD = ["", None, " a  b  c\n\nd \t e'll we’re  ", "é ç à x　 y", "日本 語 ▁ x", "a" * 3000, "▁", "  ", "\n", "x y", "x y"]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 1, "p") for k, t in rows], "doc_id long, text string, start int, payload string")


@pytest.fixture
def rows():
    return list(enumerate(AWKWARD + texts(9, 40)))


def test_wavelet_matrix():
    r = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = r.integers(0, 300, n) ** 2 % 50_000
        m = wavelet.WaveletMatrix(wavelet.pack(ids, 16))
        assert np.array_equal(m.ids(), ids)
        for value in [*ids[:5].tolist(), 0, 49_999, 1 << 17]:
            assert np.array_equal(m.occurrences(value), np.flatnonzero(ids == value))
            assert m.count(value, n // 3, n // 2) == (ids[n // 3 : n // 2] == value).sum()
        assert [m.access(k) for k in range(0, n, 97)] == ids[::97].tolist()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(b"no wavelet matrix at all")


def test_id_files(spark, rows, tokenizer_json, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 500)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    wavelet.write_ids(frame(spark, rows), path, tokenizer_json)
    encoder = Tokenizer.from_str(tokenizer_json)
    want, everything = [], []
    for k, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, len(everything), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        everything += ids
    assert sorted(tuple(r) for r in wavelet.read_documents(spark, path).collect()) == want
    value = Counter(everything).most_common(3)[-1][0]
    places = [k for k, x in enumerate(everything) if x == value]
    assert sorted(r.place for r in wavelet.find_id(spark, path, value).collect()) == places
    assert sum(r.n for r in wavelet.count_id(spark, path, value).collect()) == len(places)
    nothing = f"{tmp_path}/{uuid.uuid4().hex}"
    wavelet.write_ids(frame(spark, []), nothing, tokenizer_json)
    assert wavelet.read_documents(spark, nothing).collect() == []


def test_shards_are_held_one_by_one(spark, tokenizer_json, tmp_path, monkeypatch):
    """Each shard of a task is a row group of its own, also where texts compress to nothing."""
    monkeypatch.setattr(wavelet, "SHARD_IDS", 500)
    monkeypatch.setattr(wavelet, "_PIECE", 1000)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    wavelet.write_ids(frame(spark, [(k, "x y " * 200) for k in range(60)]), path, tokenizer_json)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert max(m.num_rows for m in files) > 2
    assert {m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)} == {1}
    assert len({r.n_tokens for r in wavelet.read_documents(spark, path).collect()}) == 1


def test_starts_over_parts_and_shards(spark, tokenizer_json, tmp_path, monkeypatch):
    """Missing and repeated ids, empty texts, many shards a part: starts follow the counts in the order of the files."""
    monkeypatch.setattr(wavelet, "SHARD_IDS", 40)
    monkeypatch.setattr(wavelet, "_PIECE", 64)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    rows = [(k // 3 if k % 10 else None, t) for k, t in enumerate(texts(4, 60))]
    wavelet.write_ids(frame(spark, rows), path, tokenizer_json)
    shards = spark.read.parquet(path).orderBy("part", "shard").collect()
    assert len({r.part for r in shards}) > 1 and max(r.shard for r in shards) > 1
    ids, counts = [x for r in shards for x in r.doc_ids], [n for r in shards for n in r.counts]
    want = Counter(zip(ids, (np.cumsum(counts) - counts).tolist(), counts))
    assert Counter((r.doc_id, r.start, r.n_tokens) for r in wavelet.read_documents(spark, path).collect()) == want
    assert ids == sorted(ids, key=lambda k: (k is not None, k)) and Counter(ids) == Counter(k for k, _ in rows)


def test_flat_files(spark, rows, tokenizer_json, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 64)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_counts.write_flat(frame(spark, rows), path, tokenizer_json)
    encoder = Tokenizer.from_str(tokenizer_json)
    want, start = [], 0
    for k, (_, t) in enumerate(rows):
        n = len(encoder.encode(t or "", add_special_tokens=False).ids)
        want.append((k, start, n, True))
        start += n + 1
    assert sorted(tuple(r) for r in token_counts.token_counts(spark, path).collect()) == want


def test_separators_across_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 3)
    r = np.random.default_rng(1)
    ids = r.integers(0, 4, 200).astype("<u4")
    cuts = [0, 1, 2, 40, 40, 41, 150, 200]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"ids-{k + 5}.bin").write_bytes(ids[a:b].tobytes())
    ends = np.flatnonzero(ids == 2)
    starts = np.concatenate([[0], ends + 1])
    want = [(k, int(s), int(e - s), True) for k, (s, e) in enumerate(zip(starts, ends))]
    if starts[-1] < len(ids):
        want.append((len(ends), int(starts[-1]), int(len(ids) - starts[-1]), False))
    assert sorted(tuple(x) for x in token_counts.token_counts(spark, str(tmp_path), end_id=2, width=4).collect()) == want


def scanned(ids, end):
    ends = np.flatnonzero(ids == end)
    starts = np.concatenate([[0], ends + 1])
    want = [(k, int(s), int(e - s), True) for k, (s, e) in enumerate(zip(starts, ends))]
    return want + [(len(ends), int(starts[-1]), int(len(ids) - starts[-1]), False)] * int(starts[-1] < len(ids))


@pytest.fixture
def split_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, x) for n, x in zip(names, (size, 0))]
    for n, x in old.items():
        spark.conf.set(n, x)


def test_large_files_are_read_in_splits(spark, tmp_path, split_bytes):
    """No row and no task holds a file."""
    ids = np.random.default_rng(2).integers(0, 500, 40_000).astype("<u2")
    (tmp_path / "ids-1.bin").write_bytes(ids.tobytes())
    split_bytes(8192)
    assert token_counts.blocks(spark, str(tmp_path)).rdd.getNumPartitions() >= 10
    rows = token_counts.blocks(spark, str(tmp_path)).collect()
    assert len({r.split for r in rows}) >= 10 and max(r.n_bytes for r in rows) < 10_000
    assert sorted(tuple(x) for x in token_counts.token_counts(spark, str(tmp_path)).collect()) == scanned(ids, 0)


@pytest.mark.parametrize(
    "width, end, values",
    [
        (1, 0, [0, 1]),
        (1, 0xBF, [0xBF, 0xEF, 0xBB, 0]),
        (2, 0, [0, 0, 1, 256, 257]),
        (2, 0x0101, [0, 1, 256, 257]),
        (2, 0xBBEF, [0xBBEF, 0xEFBF, 0xBFBB, 0xEF]),
        (3, 0xBFBBEF, [0xBFBBEF, 0xEFBFBB, 0]),
        (4, 0, [0, 0, 1, 1 << 24, 1 << 8]),
        (4, 2, [2, 2 << 8, 2 << 24, 0, 0x02020202]),
    ],
)
def test_splits_and_blocks_cut_ids_anywhere(spark, tmp_path, monkeypatch, split_bytes, width, end, values):
    r = np.random.default_rng(width + end)
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 5)
    mark = int.from_bytes((b"\xef\xbb\xbf" * 4)[:width], "little")
    for k, size in enumerate((5, 64)):
        files = [np.concatenate([[mark] * (3 if n % 2 else 0), r.choice(values, r.integers(0, 40)), [end] * (n % 3)]).astype(np.int64) for n in range(4)]
        folder = tmp_path / str(k)
        folder.mkdir()
        for n, ids in enumerate(files):
            (folder / f"a b%+ids-{n}.bin").write_bytes(b"".join(int(x).to_bytes(width, "little") for x in ids))
        split_bytes(size)
        got = token_counts.token_counts(spark, str(folder), end_id=end, width=width)
        assert sorted(tuple(x) for x in got.collect()) == scanned(np.concatenate(files), end)


def test_files_that_are_no_ids(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert token_counts.token_counts(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "none" / "ids-1.bin").write_bytes(b"\1\0\0\0")
    for unfit in (-1, 1 << 16):
        assert [tuple(x) for x in token_counts.token_counts(spark, str(tmp_path / "none"), end_id=unfit).collect()] == [(0, 0, 2, False)]
    (tmp_path / "ids-1.bin").write_bytes(b"\1\0\0\0\1")
    with pytest.raises(Exception, match="no whole number of ids"):
        token_counts.token_counts(spark, str(tmp_path)).collect()


def test_pieces_round_trip(spark, rows, piece_file):
    docs = frame(spark, rows)
    got = piece_sampling.encode(docs, piece_file, seed=1)
    assert got.columns == ["doc_id", "start", "payload", "piece_ids", "n_pieces", "lossless"]
    back = {r.doc_id: r for r in piece_sampling.decoded(got, piece_file).collect()}
    assert all(back[k].text == (t or "") and back[k].lossless and back[k].n_pieces == len(back[k].piece_ids) for k, t in rows)
    again = {r.doc_id: r.piece_ids for r in piece_sampling.encode(docs.repartition(7), piece_file, seed=1).collect()}
    assert again == {k: r.piece_ids for k, r in back.items()}
    other = {r.doc_id: r.piece_ids for r in piece_sampling.encode(docs, piece_file, seed=2).collect()}
    assert other != again
    assert piece_sampling.encode(docs.limit(0), piece_file).collect() == []


def test_paths_follow_their_weights(piece_file):
    v = piece_sampling.vocabulary(piece_file, sharpness=0.3)
    text = np.frombuffer(b" banana", np.uint8)
    pieces = {v.text[v.firsts[i] : v.firsts[i + 1]].tobytes(): int(i) for i in v.ids}
    weights = {}

    def extend(at, path):
        if at == len(text):
            weights[path] = np.exp(sum(v.log_weight[i] for i in path))
        for size in range(1, len(text) - at + 1):
            piece = pieces.get(text[at : at + size].tobytes())
            if piece is not None:
                extend(at + size, (*path, piece))

    extend(0, ())
    n = 30_000
    ids, bounds = piece_sampling.sample(v, np.tile(text, n), np.arange(n + 1) * len(text), np.arange(n).astype(np.uint64))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:]))
    assert set(seen) <= set(weights) and len(seen) > 3
    for path, weight in sorted(weights.items(), key=lambda x: -x[1])[:6]:
        share = weight / sum(weights.values())
        assert abs(seen[path] / n - share) < 5 * np.sqrt(share / n) + 1e-4


def test_places_are_looked_up_as_far_as_pieces_begin(piece_file, monkeypatch):
    v = piece_sampling.vocabulary(piece_file)
    looked, hashes = [], piece_sampling.rolling_hashes
    monkeypatch.setattr(piece_sampling, "rolling_hashes", lambda sums, down, starts, ends: (looked.append(len(starts)), hashes(sums, down, starts, ends))[1])
    data = np.frombuffer(b"qzxjvkwpqg" * 200, np.uint8)
    ids, bounds = piece_sampling.sample(v, data, np.array([0, len(data)]), np.array([7], np.uint64))
    assert b"".join(v.text[v.firsts[i] : v.firsts[i + 1]].tobytes() for i in ids.tolist()) == data.tobytes()
    assert sum(looked) < 4 * len(data)
