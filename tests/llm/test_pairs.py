"""Line dedup and document joins against brute force, decontamination against plain tiling, with awkward rows."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import decontamination, line_dedup, ngram_jaccard, piece_sampling, setjoin, toxicity
from tablescope.llm.arrays import span_hashes, words
from tablescope.llm.bpe import WordEncoder
from tablescope.llm.components import components
from tablescope.llm.decontamination import contaminated, without_contaminated
from tablescope.llm.line_dedup import dedup_lines
from tablescope.llm.ngram_jaccard import jaccard_components, one_of_each
from tests.llm.conftest import split_words, texts


def thue_morse(n):
    """Two complementary words of 2^n letters."""
    bits = np.array([bin(k).count("1") % 2 for k in range(1 << n)])
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def shingles(text):
    w = split_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def frame(spark, rows, extra=False):
    rows = list(enumerate(rows)) if rows and not isinstance(rows[0], tuple) else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    names = "doc_id long, text string, id long, n int, kind string, blob string, a long, score double"
    return spark.createDataFrame([(*r, 1, 2, "k", None, None, 0.5) for r in rows], names)


def linked_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def deduped(docs):
    places = {(i, k): frozenset(split_words(line)) for i, t in docs if t is not None for k, line in enumerate(t.split("\n"))}
    first, gone = {}, set()
    for place in sorted(places):
        if places[place]:
            first.setdefault(places[place], place)
            if first[places[place]] != place:
                gone.add(place)
    order = sorted(first, key=first.get)
    late = {s for k, s in enumerate(order) if any(5 * len(s & o) >= 4 * len(s | o) for o in order[:k])}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone and places[i, k] not in late) for i, t in docs}


@pytest.mark.parametrize("short,longest,frequent", [(6, 1 << 16, 1024), (2, 30, 1024), (2, 1 << 16, 2)])
def test_joins_match_brute_force(spark, monkeypatch, short, longest, frequent):
    monkeypatch.setattr(setjoin, "SHORT_LIST", short)
    monkeypatch.setattr(setjoin, "LONGEST_LIST", longest)
    monkeypatch.setattr(setjoin, "FREQUENT", frequent)
    docs = list(enumerate(texts()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs, extra=True)).collect()}
    assert got == linked_components(docs)
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, docs, extra=True)).collect()} == deduped(docs)


@pytest.mark.parametrize("by_id", [1, -1])
def test_lines_of_a_template_in_any_row_order(spark, by_id):
    """Sets with many candidates in a list, within one document and in rows that are not in order of id."""
    r = random.Random(3)
    docs = []
    for d in range(12):
        lines = []
        for t in range(6):
            base = [f"t{t}w{k}" for k in range(20)]
            for _ in range(6):
                line = list(base)
                for at in r.sample(range(20), r.randint(1, 4)):
                    line[at] = f"v{r.randrange(3)}"
                lines.append(" ".join(line))
        r.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    docs += [(d + 100, text) for d, text in docs[:3]]
    table = frame(spark, sorted(docs, key=lambda d: by_id * d[0])).coalesce(1)
    assert {r.doc_id: r.text for r in dedup_lines(table).collect()} == deduped(docs)


def test_joins_on_awkward_tables(spark):
    empty = frame(spark, [])
    assert jaccard_components(empty).collect() == []
    assert dedup_lines(empty).collect() == []
    docs = [(None, "a b c d e f"), (7, "A b c d e f"), (7, "A b c d e f"), (8, None), (9, "")]
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, docs)).na.fill(-1, ["doc_id"]).collect())
    assert got == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9)]
    assert sorted(r.doc_id for r in one_of_each(frame(spark, docs)).collect()) == [7, 7, 8, 9]
    kept = {(r.doc_id, r.text, r.n_removed) for r in dedup_lines(frame(spark, docs)).collect()}
    assert kept == {(None, "", 1), (7, "A b c d e f", 0), (8, None, 0), (9, "", 0)}


def test_rows_without_an_id_are_decided_each_by_itself(spark):
    """A copy among rows that have no id, or share one, costs the others nothing."""
    a, b, c, d = ("\n".join(f"{name}{k} one{name}{k} two{name}{k} six{name}{k} ten{name}{k}" for k in range(3)) for name in "abcd")
    first = a.split("\n")[0]
    docs = [(1, a), (None, f"{first}\n{b}"), (None, c), (None, a), (None, c), (5, d), (5, a), (6, None), (None, None)]
    table = frame(spark, docs)
    gone = {(None, f"{first}\n{b}"): b, (None, a): "", (5, a): ""}
    got = collections.Counter((r.doc_id, r.text) for r in dedup_lines(table).collect())
    assert got == collections.Counter((i, gone.get((i, t), t)) for i, t in docs)
    got = collections.Counter((r.doc_id, r.text) for r in one_of_each(table).collect())
    assert got == collections.Counter(x for x in docs if x not in ((None, a), (5, a)))
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in without_contaminated(table, items).collect())
    assert got == collections.Counter(x for x in docs if x[1] != a)
    later = dedup_lines(frame(spark, [(None, f"{c}\n{first}"), (None, f"{d}\n{first}"), (3, f"{b}"), (3, f"{b}\n{d}")])).collect()
    lines = collections.Counter(line for r in later for line in r.text.split("\n") if line)
    assert lines == collections.Counter([*b.split("\n"), *c.split("\n"), *d.split("\n"), first])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, k) for k in range(100, 140)] + [(60, 60), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 50 for k in [50, *range(100, 140)]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def tiled(doc, item, size):
    """Greedy tiling by trying every pair of places."""
    used_d, used_i, tiles = set(), set(), 0
    while True:
        best = (size - 1, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < size:
            return len(used_i), tiles
        n, d, i = best
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))
        tiles += 1


def test_tiling(spark):
    a = "the quick brown fox jumps over the lazy dog while seven wizards quietly drink tea near an old stone bridge"
    w = a.split()
    docs = [
        (1, "intro words here " + a + " and more"),
        (2, " ".join(w[10:] + ["x"] + w[:10])),  # reordered
        (3, " ".join(w[:6]) + " only a part"),
        (4, None),
        (5, ""),
        (6, a.upper()),
        (6, a.upper()),
        (None, a),
        (8, " ".join(["the"] * 3000)),
        (9, "two words"),
    ]
    items = [(1, a), (2, "the the the the the the the the"), (3, "two words"), (4, None), (5, ""), (6, a)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = collections.Counter((r.doc_id, r.item_id, r.covered_words, r.n_tiles) for r in contaminated(frame(spark, docs, extra=True), bench).collect())
    want = collections.Counter()
    for d, text in docs:
        for i, item in items:
            item = split_words(item)
            if item:
                covered, n = tiled(split_words(text)[:60] if d == 8 else split_words(text), item, min(5, len(item)))
                if covered >= 0.5 * len(item) and n:
                    want[(d, i, covered, n)] += 1
    assert got == want
    assert (2, 1, len(w), 2) in got
    assert sorted(r.doc_id for r in without_contaminated(frame(spark, docs), bench).collect()) == [3, 4, 5]
    assert contaminated(frame(spark, []), bench).collect() == []
    assert contaminated(frame(spark, docs), bench.limit(0)).collect() == []


def test_columns_of_any_name_come_through(spark, piece_file):
    """A table with columns named like every helper column keeps them, with their values."""
    names = ["_key", "_own", "_doc", "_gone", "_toxicity", "_scored", "_text", "row", "id", "score", "_row", "slice"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(["one two three four five six", "one two three four five six", "a line\nb line here", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(5)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing of the kind is here")], "item_id long, text string")
    want = {r[0]: r[2:] for r in rows}
    results = {
        "lines": line_dedup.dedup_lines(docs),
        "shingles": ngram_jaccard.one_of_each(docs),
        "items": decontamination.without_contaminated(docs, items),
        "toxic": toxicity.without_toxic(docs, labels),
        "pieces": piece_sampling.encode(docs, piece_file),
    }
    for name, got in results.items():
        kept = {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()}
        assert kept and all(want[k] == v for k, v in kept.items()), name


@pytest.mark.parametrize("a, b", [thue_morse(11)])
def test_words_that_a_polynomial_cannot_tell_apart(spark, tokenizer_json, piece_file, a, b):
    """Complementary Thue-Morse words collide under any polynomial modulo a power of two; here they stay different words."""
    data = np.frombuffer((a + b).encode(), np.uint8)
    one, other = span_hashes(data, np.array([0, len(a)]), np.array([len(a), len(a + b)]))
    assert one != other
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    encoder = WordEncoder(tokenizer_json)
    ids, bounds = encoder.encode(data, np.array([0, len(a), len(data)]))
    for k, text in enumerate((a, b)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert all(r["lossless"] for r in piece_sampling.encode(docs, piece_file).collect())
    assert {r["component_id"] for r in ngram_jaccard.jaccard_components(docs).collect()} == {1, 2}
    assert sum(r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()) == 0
    items = spark.createDataFrame([(7, b)], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(docs, items).collect()] == [2]


def test_packed_entries_compress_and_come_back():
    join = setjoin.Join(line_dedup.line_sets, bitmap=True, only_earlier=True)
    r = np.random.default_rng(3)
    n = 4000
    entries = {"key": r.integers(0, 1 << 63, n, np.uint64), "id": r.integers(0, 1 << 63, n, np.uint64), "doc": np.sort(r.integers(0, 9000, n)) + (1 << 40)}
    entries |= {"n": r.integers(2, 30, n).astype(np.int32), "pos": r.integers(0, 4, n).astype(np.int32)}
    entries |= {"low": r.integers(0, 1 << 63, n, np.uint64), "high": r.integers(0, 1 << 63, n, np.uint64), "unit": r.integers(0, 60, n).astype(np.int32)}
    blobs = [setjoin._pack({k: v[a:b] for k, v in entries.items()}) for a, b in ((0, 1), (1, n))]
    back = setjoin._unpack(blobs, join)
    assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in entries.items())
    assert len(pa.compress(blobs[1], codec="lz4_raw", asbytes=True)) < 38 * n  # of 52, 32 are hashes


def test_pairs_from_lists_are_in_order_of_first_place(spark):
    words = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join([*words[:k], "x" + words[k], *words[k + 1 :]]) for k in range(12)]
    docs = spark.createDataFrame([(int(d), t) for d, t in zip(np.random.default_rng(1).permutation(12), texts)], "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in dedup_lines(docs).where("text != ''").collect()}
    assert kept == {0}


def test_a_fit_gives_words_values_in_small_groups():
    words = [f"word{k:06d}" for k in range(40_000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.arange(len(words)) * 10
    tracemalloc.start()
    toxicity.distinct_values(np.ones(64**3), data, starts, starts + 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def listed(n, pos, bits, units):
    """A packed list of sets of one key, with the bitmap ``bits``."""
    count = len(units)
    entries = {"key": np.full(count, 7, np.uint64), "id": np.arange(count, dtype=np.uint64) + np.uint64(100), "doc": np.zeros(count, np.int64)}
    entries |= {"n": np.full(count, n, np.int32), "pos": np.array(pos, np.int32)}
    entries |= {"low": np.array(bits, np.uint64), "high": np.zeros(count, np.uint64), "unit": np.array(units, np.int32)}
    return [setjoin._pack(entries)]


@pytest.mark.parametrize("pos, pairs", [((2, 2), 1), ((1, 3), 1), ((3, 2), 0), ((4, 4), 0)])
def test_pairs_are_tested_in_the_list_of_their_first_common_members(pos, pairs):
    join = setjoin.Join(line_dedup.line_sets, bitmap=True, only_earlier=True)
    found = setjoin._first_pairs(listed(20, pos, [1, 2], [0, 1]), join)
    assert found.num_rows == pairs


@pytest.mark.parametrize("count", [40, 300])
def test_a_list_keeps_the_other_pairs_of_sets_with_many(monkeypatch, count):
    join = setjoin.Join(line_dedup.line_sets, bitmap=True, only_earlier=True)
    units = np.random.default_rng(2).permutation(count)
    bits = [1 if u % 3 else (1 << 60) - 1 for u in units.tolist()]  # two kinds of sets
    ids = {u: 100 + k for k, u in enumerate(units.tolist())}  # by place
    want = {(ids[b], ids[a]) for b in range(count) for a in range(b) if (a % 3 == 0) == (b % 3 == 0)}
    found = setjoin._first_pairs(listed(20, [0] * count, bits, units), join, 5).to_pylist()
    assert {(r["b"], a) for r in found for a in [r["a"], *(r["more"] or [])]} == want
    assert all((r["more"] is None) == (r["kind"] == 0) and r["pos"] == 5 for r in found)
    monkeypatch.setattr(setjoin, "MOST_PAIRS", 50)  # too many to keep: the first alone, with the key of the list
    monkeypatch.setattr(setjoin, "PAIRS_AT_ONCE", 50)
    cut = setjoin._first_pairs(listed(20, [0] * count, bits, units), join, 5).to_pylist()
    first = {b: min((a for x, a in want if x == b), key={i: u for u, i in ids.items()}.get) for b, _ in want}
    assert {(r["b"], r["a"]) for r in cut if r["kind"] == 1} == {(r["b"], r["a"]) for r in found if r["kind"] == 1}
    assert all(r["a"] == first[r["b"]] and r["key"] == 7 for r in cut if r["kind"] == 1)
    assert any(r["more"] is None for r in cut if r["kind"] == 1)
    assert {(r["b"], a) for r in cut for a in [r["a"], *(r["more"] or [])]} <= want


def test_spans_of_words_end_at_rows():
    data = np.frombuffer(b"ab cd\tEf\x00\xff \n", np.uint8)
    starts, ends, hashes, firsts = words(data, np.array([0, 0, 1, 4, 4, 8, len(data)]), folded=True)
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 1), (1, 2), (3, 4), (4, 5), (6, 8), (8, 10)]
    assert firsts.tolist() == [0, 0, 1, 3, 3, 5, 6]
    assert hashes[4] == span_hashes(np.frombuffer(b"ef", np.uint8), np.array([0]), np.array([2]))[0]


def test_lines_are_counted_with_the_empty_ones(spark):
    texts = ["", "\n", "a b\n\nc", "\n\na", None, "a\r\nb", "é\n\n\nü"]
    got = {r["doc_id"]: r["n_lines"] for r in dedup_lines(frame(spark, texts)).collect()}
    assert got == {k: 0 if t is None else len(t.split("\n")) for k, t in enumerate(texts)}
