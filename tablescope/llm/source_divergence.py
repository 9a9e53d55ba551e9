"""Source divergence audit (operator 11): how the term shares of each source differ from those of its language.

Tasks fold whole documents into hash stripes: for each (lang, term) the number of documents that hold it and its
occurrences by source. A task spills its stripes when they reach a fixed number of counts; spilled stripes are sorted by key,
so that a pass over each partition merges them with one stripe in hand at a time, and terms in too few documents go
there. The merged stripes give the divergences: a second pass over them, which first reads the totals of all groups, adds
up the differences of all pairs of sources and picks the leading terms of each source.

Terms are runs of ASCII letters and of non-ASCII characters, only A-Z lower-cased. With ``count`` occurrences in a
group, ``N`` those of all kept terms and ``V`` kept terms, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers
throughout (exact while N + 5 V stays below 9 * 10^15).

Defined cases: missing text, lang and source count as empty strings, so they form groups of their own; a group
without any term still has its pairs; a language without a kept term gives pairs of value 0; equal values rank by item in
UTF-8 order; repeated rows count again; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.arrays import pieces, spans
from tablescope.operators.order import materialize

SHARE = 1_000_000_000
PRIOR = 5
MOST_COUNTS = 1_000_000  # counts a task holds before it spills its stripes
ROWS_AT_ONCE = 20_000  # stripes handed on or merged at once
CELLS_AT_ONCE = 1 << 20  # shares laid out at once: terms x sources, and pairs of sources

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each occurring term among them, row of each)."""
    inside = _TERM[data]
    starts, ends = spans(inside, offsets)
    kept = _LOWER[data[inside]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def _list_column(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


class _Fold:
    """The stripes of a task: hashed terms with documents and occurrences by (lang, source)."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def group_numbers(self, langs: pa.Array, sources: pa.Array) -> np.ndarray:
        rows = zip(langs.to_pylist(), sources.to_pylist())
        return np.fromiter((self.names.setdefault(g, len(self.names)) for g in rows), np.int64, len(langs))

    def add(self, dictionary: pa.Array, term: np.ndarray, group: np.ndarray, row: np.ndarray) -> None:
        """Occurrences of terms; a row is in one group."""
        if not len(term):
            return
        width = len(dictionary)
        per_row, n = np.unique(row * width + term, return_counts=True)
        at = np.zeros(int(row.max()) + 1, np.int64)
        at[row] = group
        row, term = np.divmod(per_row, width)
        key = at[row] * width + term
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
        group, term = np.divmod(key[order][cuts], width)
        self.parts.append((dictionary.cast(pa.large_string()), term, group, np.add.reduceat(n[order], cuts), np.diff(np.append(cuts, len(order)))))
        self.size += len(cuts)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """Merge the parts by term, give one row per (lang, term), and start anew."""
        if not self.parts:
            return
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bases = np.cumsum([0, *[len(p[0]) for p in self.parts]])
        term = number[np.concatenate([p[1] + base for p, base in zip(self.parts, bases.tolist())])]
        group, n, documents = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
        langs = {g[0]: None for g in self.names}
        langs = {name: k for k, name in enumerate(langs)}
        lang_of = np.array([langs[g[0]] for g in self.names], np.int64)
        sources = pa.array([g[1] for g in self.names], pa.string())
        width = len(self.names)
        key = (lang_of[group] * len(coded.dictionary) + term) * width + group
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))  # one count per (lang, term, source)
        n, documents = np.add.reduceat(n[order], cuts), np.add.reduceat(documents[order], cuts)
        stripe, group = np.divmod(key[order][cuts], width)
        heads = np.flatnonzero(np.diff(stripe, prepend=-1))
        sizes = np.diff(np.append(heads, len(stripe)))
        documents = np.add.reduceat(documents, heads)
        lang, term = np.divmod(stripe[heads], len(coded.dictionary))
        names = pa.array(list(langs), pa.string()).take(pa.array(lang))
        terms = coded.dictionary.take(pa.array(term)).cast(pa.string())
        by_source = _list_column(sources.take(pa.array(group)), sizes)
        counts = _list_column(pa.array(n), sizes)
        whole = pa.RecordBatch.from_arrays([names, terms, pa.array(documents), by_source, counts], names=["lang", "term", "df", "sources", "counts"])
        self.parts, self.size = [], 0  # numbers of groups stay, those of the batch at hand are in use
        for k in range(0, whole.num_rows, ROWS_AT_ONCE):
            yield whole.slice(k, ROWS_AT_ONCE)


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Spilled stripes (lang, term, df, sources, counts); the stripe of the empty term counts documents."""
    chosen = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, lang, source)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = _Fold()
        for batch in batches:
            groups = folded.group_numbers(batch.column(1), batch.column(2))
            folded.add(pa.array([""]), np.zeros(len(groups), np.int64), groups, np.arange(len(groups)))
            for first, _, data, offsets in pieces(batch.column(0)):
                dictionary, term, row = _terms(data, offsets)
                folded.add(dictionary, term, groups[row + first], row)
                if folded.size > MOST_COUNTS:
                    yield from folded.spill()
        yield from folded.spill()

    return chosen.mapInArrow(run, STRIPE)


def merged(spilled: DataFrame, least: int) -> DataFrame:
    """One stripe per (lang, term) in ``least`` documents or more, and per language the stripe of the empty term.

    A pass over sorted partitions: only the stripe of the current key is held.
    """
    ordered = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None  # the last stripe so far, which the next rows may add to
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                if open_key is not None:
                    part = pa.Table.from_batches([open_key, part]).combine_chunks().to_batches()[0]
                whole = _summed(part)
                open_key = whole.slice(whole.num_rows - 1)
                yield _frequent(whole.slice(0, whole.num_rows - 1), least)
        if open_key is not None:
            yield _frequent(open_key, least)

    return ordered.mapInArrow(run, STRIPE)


def _changes(column: pa.Array) -> np.ndarray:
    return np.append(True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))[: len(column)]


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(entries of each stripe, sources, counts)."""
    sources, counts = batch.column("sources"), batch.column("counts")
    return np.diff(sources.offsets.to_numpy()), sources.flatten(), counts.flatten().to_numpy()


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Add up neighbouring stripes of one key."""
    heads = np.flatnonzero(_changes(batch.column("lang")) | _changes(batch.column("term")))
    sizes, sources, counts = _entries(batch)
    stripe = np.repeat(np.repeat(np.arange(len(heads)), np.diff(np.append(heads, batch.num_rows))), sizes)
    coded = sources.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key = stripe * width + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    stripe, source = np.divmod(key[order][cuts], width)
    sizes = np.bincount(stripe, minlength=len(heads))
    at = pa.array(heads)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("lang").take(at),
            batch.column("term").take(at),
            pa.array(np.add.reduceat(batch.column("df").to_numpy(), heads)),
            _list_column(coded.dictionary.take(pa.array(source)), sizes),
            _list_column(pa.array(np.add.reduceat(counts[order], cuts)), sizes),
        ],
        names=batch.schema.names,
    )


def _frequent(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    return batch.filter(pc.or_(pc.greater_equal(batch.column("df"), least), pc.equal(batch.column("term"), "")))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 counts / totals) in 64-bit numbers, three decimal digits at a time; counts at most totals."""
    out, rest = np.zeros(np.broadcast(counts, totals).shape, np.int64), np.asarray(counts, np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digits
    return out + 1


class _Language:
    """The sources of a language in order, their totals, and the sums of differences so far."""

    def __init__(self, sources: list[str], totals: list[int], kept: int):
        self.sources = sources
        self.number = {s: k for k, s in enumerate(sources)}
        self.totals = np.array(totals, np.int64) + PRIOR * kept
        self.all = sum(totals) + PRIOR * kept
        self.sums: np.ndarray | None = None
        self.leading: dict[int, list[tuple[int, bytes]]] = {}


def divergences(docs: DataFrame, least: int = 30, most: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources of a language, and the ``most`` leading terms of each source."""
    found = materialize(merged(stripes(docs, text, lang, source), least))
    entries = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    totals = entries.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum(F.when(F.col("term") != "", F.col("e.counts")).otherwise(0)).alias("n"))
    kept = found.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    parts = max(1, found.rdd.getNumPartitions())
    # Each partition first gets the totals of all groups (one short row per source), then its share of the stripes.
    heads = totals.join(kept, "lang").select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "lang", "source", F.array("source").alias("sources"), F.array("n").alias("counts"), "v"
    )
    rows = found.where("term != ''").select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "lang", F.col("term").alias("source"), "sources", "counts", F.lit(0).cast("bigint").alias("v")
    )
    dealt = heads.union(rows).repartition(parts, "part").sortWithinPartitions("kind", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        languages: dict[str, _Language] = {}
        heads: dict[str, dict[str, int]] = {}
        kept: dict[str, int] = {}
        begun, first = False, False

        def begin() -> None:
            nonlocal begun
            for language, own in heads.items():
                languages[language] = _Language(sorted(own), [own[s] for s in sorted(own)], kept[language])
            begun = True

        def pairs(language: str, low: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Both directions of the pairs of sources low, low + 1, ... with later ones."""
            own = languages[language]
            a, b = np.nonzero(np.arange(low, low + len(block))[:, None] < np.arange(len(own.sources))[None, :])
            value = block[a, b]
            names = pa.array(own.sources, pa.string())
            a, b = names.take(pa.array(a + low)), names.take(pa.array(b))
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(value), pa.string()), x, pa.array(["pair"] * len(value), pa.string()), y, pa.array(value)], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            for language, own in languages.items():
                if own.sums is not None:
                    yield from pairs(language, 0, own.sums)
                some = [(k, item, value) for k, best in own.leading.items() for value, item in best]
                if some:
                    yield pa.RecordBatch.from_pylist(
                        [{"lang": language, "source": own.sources[k], "part": "term", "item": item.decode(), "value": -value} for k, item, value in some], schema=schema
                    )

        def use(language: str, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> Iterator[pa.RecordBatch]:
            own = languages[language]
            width = len(own.sources)
            at = np.fromiter((own.number[s] for s in sources.flatten().to_pylist()), np.int64, len(sources.flatten()))
            sizes = np.diff(sources.offsets.to_numpy())
            table = np.zeros((len(terms), width), np.int64)
            table[np.repeat(np.arange(len(terms)), sizes), at] = counts.flatten().to_numpy()
            p = shares(table + PRIOR, own.totals[None, :])
            gap = p - shares(table.sum(axis=1) + PRIOR, np.int64(own.all))[:, None]
            row, column = np.nonzero((table > 0) & (gap > 0))
            names = terms.take(pa.array(row)).to_pylist()
            for k, item, value in zip(column.tolist(), names, gap[row, column].tolist()):
                own.leading.setdefault(k, []).append((-value, item.encode()))
            for k in set(column.tolist()):
                if len(own.leading[k]) > most:
                    own.leading[k] = sorted(own.leading[k])[:most]
            step = max(1, CELLS_AT_ONCE // max(width, 1))
            for low in range(0, width, step):
                block = np.zeros((min(step, width - low), width), np.int64)
                for k in range(len(block)):
                    block[k] = np.abs(p - p[:, low + k : low + k + 1]).sum(axis=0)
                if step >= width:
                    own.sums = block if own.sums is None else own.sums + block
                else:  # too many pairs to hold: given block by block, added up later
                    yield from pairs(language, low, block)

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for k in np.flatnonzero(kinds == 0).tolist():
                row = batch.slice(k, 1).to_pylist()[0]
                heads.setdefault(row["lang"], {})[row["source"]] = row["counts"][0]  # two parts may share a partition
                kept[row["lang"]] = row["v"]
                first |= row["part"] == 0
            body = batch.slice(int((kinds == 0).sum()))  # heads come first
            if body.num_rows and not begun:
                begin()
            runs = body.column("lang").dictionary_encode()
            cuts = np.flatnonzero(np.diff(runs.indices.to_numpy(zero_copy_only=False), prepend=-1)).tolist() if body.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], body.num_rows]):
                language = body.column("lang")[a].as_py()
                step = max(1, CELLS_AT_ONCE // max(len(languages[language].sources), 1))
                for k in range(a, b, step):
                    some = body.slice(k, min(step, b - k))
                    yield from use(language, some.column("source"), some.column("sources"), some.column("counts"))
        if not begun:
            begin()
        if first:  # one partition also gives every pair with 0, so that languages without terms have theirs
            for language, own in languages.items():
                step = max(1, CELLS_AT_ONCE // max(len(own.sources), 1))
                for low in range(0, len(own.sources), step):
                    yield from pairs(language, low, np.zeros((min(step, len(own.sources) - low), len(own.sources)), np.int64))
        yield from close()

    given = dealt.mapInArrow(run, "lang string, source string, part string, item string, value long")
    summed = given.repartition("lang", "source", "part").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("part").eqNullSafe("pair") | (F.col("rank") <= most))


#: The same rows in DuckDB, for a table ``documents``.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS n FROM tot GROUP BY ALL),
lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (tot.n + 5 * v.v) AS p
      FROM tot JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = kept.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.n + 5)) // (lt.n + 5 * v.v) AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
