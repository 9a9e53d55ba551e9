"""Source divergences, exact products and conversation repair."""

import hashlib
import heapq
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tablescope.llm import conversation_repair, queries, source_divergence, top_products

FOLDER = "/root/testdata/sf0.01"


def compare(spark, name, tables):
    """The query's rows equal those of its SQL."""
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    a, b = (x[names].astype(str).sort_values(names).to_numpy() for x in (got, want))
    assert a.shape == b.shape and (a == b).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, tables", [("op11_source_divergence", ["documents"]), ("op12_top_products", ["embeddings"])])
def test_queries_match_sql(spark, name, tables):
    compare(spark, name, tables)


# --- operator 11 ------------------------------------------------------------------------------------

def plain_divergences(rows, least, most):
    docs = [tuple(v or "" for v in row) for row in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), s) for t, g, s in docs if g == lang]
        terms = sorted(t for t in {t for words, _ in own for t in words} if sum(t in words for words, _ in own) >= least)
        v, sources = len(terms), sorted({s for _, s in own})
        count = {s: {t: sum(words.count(t) for words, of in own if of == s) for t in terms} for s in sources}
        total = {t: sum(count[s][t] for s in sources) for t in terms}

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in terms}

        shares, q = {s: p(count[s]) for s in sources}, p(total)
        for s in sources:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in terms), o) for o in sources if o != s]
            single = [(shares[s][t] - q[t], t) for t in terms if count[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", single)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or k < most:
                        out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def divergence_rows():
    r = random.Random(3)
    names = ["".join(r.choice("abÄßxyz") for _ in range(r.randint(1, 3))) for _ in range(40)]
    rows = []
    for k in range(150):
        text = " ".join(r.choice(names).upper() if r.random() < 0.2 else r.choice(names) + r.choice(["", ".", "1"]) for _ in range(r.randint(0, 30)))
        rows.append((text, r.choice(["en", "en", "en", "de", None, ""]), r.choice(["hot"] * 5 + ["b", "c", None, ""])))
    rows += [rows[0]] * 3 + [(None, "en", "only null"), ("", "fr", "x"), ("1 2 3", "fr", "y"), ("za " * 100_000, "en", "long"), (None, None, None)]
    return rows


@pytest.mark.parametrize("counts, cells", [(1_000_000, 1 << 20), (40, 24)])
def test_divergences(spark, monkeypatch, counts, cells):
    monkeypatch.setattr(source_divergence, "MOST_COUNTS", counts)
    monkeypatch.setattr(source_divergence, "CELLS_AT_ONCE", cells)
    rows = divergence_rows()
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "text string, lang string, source string, rank int, term string").repartition(5)
    got = source_divergence.divergences(docs, least=8, most=4).collect()
    assert sorted((x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in got) == plain_divergences(rows, 8, 4)


def test_divergences_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence.divergences(docs).collect() == []


def test_shares_are_exact():
    r = random.Random(1)
    counts = np.array([r.randrange(1, 1 << 52) for _ in range(500)])
    totals = np.array([r.randrange(int(c), 9 * 10**15) for c in counts])
    got = source_divergence.shares(counts, totals)
    assert got.tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, totals)]


# --- operator 12 ------------------------------------------------------------------------------------

def plain_products(rows, k, is_query):
    vectors = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in rows if x is not None and all(v is not None and np.isfinite(256 * float(v)) for v in x)]
    out = []
    for n, (i, x) in enumerate(vectors):
        if i is None or not is_query(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j is None, j if j is not None else 0, j) for m, (j, y) in enumerate(vectors) if m != n and len(x) == len(y)]
        for rank, (score, _, _, j) in enumerate(sorted(scored, key=lambda s: s[:3])[:k]):
            out.append((i, rank + 1, j, max(-(1 << 63), min((1 << 63) - 1, -score))))
    return out


def vector_rows():
    r = np.random.default_rng(4)
    rows = [(k, list(map(float, r.normal(size=4) * r.choice([0.01, 1, 1, 40])))) for k in range(200)]
    centre = r.normal(size=4)
    rows += [(k, list(map(float, 50 * centre + r.normal(size=4) * 0.1))) for k in range(200, 320)]  # high cosines
    rows += [(k, [0.5, 0.25, -0.5, 1.0]) for k in range(320, 420)]  # copies
    rows += [(420, None), (430, [1.0, None, 0.0, 0.0]), (440, [float("nan"), 0.0, 0.0, 0.0]), (450, [1.0, 2.0, float("inf"), 0.0])]
    rows += [(None, [3.0, 1.0, 2.0, 1.0]), (10, [1.0, 1.0, 1.0, 1.0]), (10, [1.0, 1.0, 1.0, 1.0]), (460, [1.0, 2.0]), (461, [3.0, 2.0]), (470, []), (480, []), (490, [0.0] * 4)]
    rows += [(500, [1e300, -1e300, 1.0, 0.0]), (501, [1e290, 1.0, 1.0, 0.0]), (510, [1e12, 1e12, 3.0, 7.0]), (520, [1e308] * 4)]
    return rows


@pytest.mark.parametrize("bucket, block, vectors", [(2048, 512, 1 << 19), (16, 8, 64)])
def test_products(spark, monkeypatch, bucket, block, vectors):
    monkeypatch.setattr(top_products, "BUCKET", bucket)
    monkeypatch.setattr(top_products, "QUERIES", block)
    monkeypatch.setattr(top_products, "CELL_VECTORS", vectors)
    monkeypatch.setattr(top_products, "CELL_BYTES", 1 << 12)
    rows = vector_rows()
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, row int").repartition(3)
    got = [tuple(x) for x in top_products.top_products(df, 3, "id % 10 = 0").select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain_products(rows, 3, lambda i: i % 10 == 0), key=str)


def test_products_prune_both_ways():
    """Coordinate lists serve high local thresholds, lengths low ones; neither loses a product."""
    r = np.random.default_rng(1)
    centre = r.normal(size=16)
    close = np.floor(2560 * (centre + r.normal(size=(300, 16)) * np.linspace(0.01, 0.4, 300)[:, None]))
    spread = np.floor(256 * r.normal(size=(300, 16)) * np.geomspace(10, 0.1, 300)[:, None])
    for vectors in (close, spread):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        order = np.argsort(-lengths)
        vectors, lengths = vectors[order], lengths[order]
        ids = np.arange(300)
        block = top_products._Block(top_products._block(0, 1, ids, ids, vectors, lengths, np.full(300, -np.inf)))
        best = top_products._Best(top_products._Block(top_products._block(0, 0, ids[:40], ids[:40], vectors[:40], lengths[:40], np.full(40, -np.inf))), 5)
        top_products.search(top_products.Bucket(block), best)
        exact = vectors[:40] @ vectors.T
        exact[np.arange(40), np.arange(40)] = -np.inf
        fifth = np.sort(exact, axis=1)[:, -5]
        assert (best.bounds == fifth).all()
        again = top_products._Best(top_products._Block(top_products._block(0, 0, ids[:40], ids[:40], vectors[:40], lengths[:40], fifth)), 5)
        done = top_products.search(top_products.Bucket(block), again)
        assert sorted(zip(again.query.tolist(), again.id.tolist())) == sorted(zip(best.query.tolist(), best.id.tolist()))
        assert sum(done[c] for c in ("coordinates", "length")) < 40 * 300
        assert (done["coordinates"] > 0) == (vectors is not spread and (fifth / (lengths[:40] * lengths[0]) >= 0.8).any()) or vectors is spread or done["coordinates"]


def test_products_of_nothing(spark):
    assert top_products.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- operator 13 ------------------------------------------------------------------------------------

def plain_align(initials, faults):
    """Uniform-cost search over all edit strings, in order of cost and then of the string."""
    heap, n = [(0, "", 0, "")], len(initials)
    done = set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if (i, made) in done:
            continue
        done.add((i, made))
        if i == n and re.fullmatch(r"(s?(ua)+)?", made):
            return cost, audit
        steps = [(2, "I", i, made + c) for c in "ua"]
        if i < n:
            steps.append((3, "D", i + 1, made))
            if faults[i] not in "bd":
                extra = faults[i] == "t"
                steps += [(extra, "K", i + 1, made + initials[i])] + [(2 + extra, "R", i + 1, made + c) for c in "ua"]
        for more, letter, k, text in steps:
            if re.fullmatch(r"s?(ua)*u?", text):
                heapq.heappush(heap, (cost + more, audit + letter, k, text))


def test_alignment():
    r = random.Random(7)
    for n in range(9):
        for _ in range(120):
            initials = "".join(r.choice("suauaua-") for _ in range(n))
            faults = "".join(r.choice("bdt    ") for _ in range(n))
            want = plain_align(initials, faults)
            assert conversation_repair.align(initials, faults) == want, (initials, faults)
            assert conversation_repair.align_folded(initials, faults) == want
    for n in (30, 63):  # both forms of the table agree
        for _ in range(5):
            initials, faults = "".join(r.choice("suaua-") for _ in range(n)), "".join(r.choice("bdt     ") for _ in range(n))
            assert conversation_repair.align(initials, faults) == conversation_repair.align_folded(initials, faults)


def plain_repair(rows):
    """The contract of the query, one conversation at a time."""
    out = {}
    for conv in {row[0] for row in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if v is None else v for v in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        key = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}:{t[2]}".encode()).digest())
        turns.sort(key=key)
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults, seen = "", set()
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not solid else "d" if (role, text) in seen else " " if solid[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join((t[1][:1] if t[1][:1] in "sua" else "") or "-" for t in turns)
        illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(turns) - 1))
        cost, audit = (plain_align if len(turns) < 20 else conversation_repair.align_folded)(initials, faults)
        length, at, made = len(audit) - audit.count("D"), iter(turns), []
        pattern = "s" * (length % 2) + "ua" * (length // 2)
        for a in audit:
            turn = None if a == "I" else next(at)
            if a != "D":
                made.append((turn[1] if a == "K" else {"u": "user", "a": "assistant"}[pattern[len(made)]]) + ":" + ("" if a == "I" else turn[2]))
        sha = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)
    return out


def repaired(df):
    rows = conversation_repair.digests(conversation_repair.repair(conversation_repair.damaged(df), present="present")).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_repair(spark):
    r = random.Random(11)
    says = ["Yes.", "No", "Why?", "Good!  \n", "", " \t", "A text. And", None, "é ü", " "]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "umbrella", "User"]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if r.random() < 0.05 else turn + (r.random() < 0.1), role, r.choice(says) if r.random() < 0.5 else f"Said {r.random()}."))
    rows += [(None, t, "user", "x.") for t in range(5)] + [(500, k, ("user", "assistant")[k % 2], f"{k}." if k % 7 else "again.") for k in range(700)]
    rows += rows[:4] + [(501, 1, "user", "a" * 2_000_000), (501, 2, "assistant", "b. " * 500_000)]
    df = spark.createDataFrame([(*row, 1, "z") for row in rows], "conv_id long, turn long, role string, text string, place int, audit string").repartition(4)
    assert repaired(df) == plain_repair(rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_repair_of_test_table(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, FOLDER).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(df) == {}
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = spark.createDataFrame([(dropped, 0, "user", "x.")], df.schema)
    assert repaired(empty) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
