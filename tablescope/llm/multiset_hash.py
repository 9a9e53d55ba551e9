"""Document fingerprints (operator 8): a homomorphic multiset hash of paragraphs.

A paragraph is hashed into a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, each word of
the vector modulo a power of two. The sum does not depend on the order of the paragraphs, and paragraphs can be added to
or taken from a fingerprint without the text (``added``, ``taken``). A vector has 16 words of 32 bits from the
paragraph's SHA-512, which tell texts apart; and 40 words of 60 bits that hold three counters of 20 bits each, in which each
phrase of the paragraph counts in a pseudo-random half of all 120 counters; and the number of phrases. Counters are signed random
sums, so their inner products estimate how many phrases two texts share: the likeness is their cosine, from 0 to 1,
and 1 for equal fingerprints. It is an estimate with an error of about 0.1.

Everything is DataFrame functions. The next document in descending id order is found in ranges of ids: each range is a window, and
the first document of every range is also put at the end of the range before, so no row passes a single task.

Defined cases: a missing text is empty; an empty text has no paragraph and likeness 1 to empty ones, 0 to others; rows with one
id follow each other by a hash of the text; a missing id comes last; a lone document follows itself. ``doc_id`` is taken
to be a key: rows that share one id are in one range.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = 16
COUNTERS = 40
_LANES = 3 * COUNTERS
_COUNTER_BITS = 20
_ONES = 1 | 1 << _COUNTER_BITS | 1 << 2 * _COUNTER_BITS
_PHRASE_END = "[.,;:!?|] "
_FIRST = -(1 << 63)


def _modulus(k: int) -> int:
    return 1 << (32 if k < EXACT else 60)


def _vector_sums() -> list[Column]:
    """One sum per word, over rows of phrases; a paragraph's own words count at its first phrase."""
    exact = [F.sum(F.when(F.col("at") == 0, F.col(f"p{k}")).otherwise(F.lit(0))) for k in range(EXACT)]
    counters = []
    for k in range(COUNTERS):
        half = F.shiftrightunsigned(F.col(f"h{k % 2}"), k // 2).bitwiseAND(F.lit(_ONES))
        counters.append(F.sum(half))
    return [c.alias(f"v{k}") for k, c in enumerate([*exact, *counters, F.count("at")])]


def _words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The fingerprint ``words`` (array of bigint) of the column ``text`` for each combination of the keys."""
    paragraphs = texts.select(*keys, F.explode_outer(F.when(F.col("text") != "", F.split("text", "\n", -1))).alias("paragraph"))
    hashed = paragraphs.withColumn("digest", F.sha2("paragraph", 512)).select(
        *keys,
        *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"p{k}") for k in range(EXACT)],
        F.posexplode_outer(F.split("paragraph", _PHRASE_END, -1)).alias("at", "phrase"),
    )
    phrases = hashed.select(*keys, *[f"p{k}" for k in range(EXACT)], "at", F.xxhash64("phrase").alias("h0"), F.xxhash64("phrase", F.lit(1)).alias("h1"))
    summed = phrases.groupBy(*keys).agg(*_vector_sums())
    n = EXACT + COUNTERS
    words = [F.coalesce(F.col(f"v{k}"), F.lit(0)) % F.lit(_modulus(k)) for k in range(n)]
    return summed.select(*keys, F.array(*words, F.col(f"v{n}")).alias("words"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    n = EXACT + COUNTERS
    moduli = F.array(*[F.lit(_modulus(k)) for k in range(n)], F.lit(1 << 62))
    pairs = F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y)
    return F.zip_with(pairs, moduli, lambda x, m: F.pmod(x, m))


def added(a: Column, b: Column) -> Column:
    """Words of the union of two multisets of paragraphs."""
    return _combined(a, b, 1)


def taken(a: Column, b: Column) -> Column:
    """Words of the first multiset without the paragraphs of the second."""
    return _combined(a, b, -1)


def text_of(words: Column) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), "")


def _counter(word: Column, k: int) -> Column:
    return F.shiftright(word, _COUNTER_BITS * k).bitwiseAND(F.lit((1 << _COUNTER_BITS) - 1)).cast("double")


def _product(a: Column, b: Column) -> Column:
    """The inner product of the signed counters of two fingerprints."""
    counters = [F.slice(x, EXACT + 1, COUNTERS) for x in (a, b)]
    n, m = (F.element_at(x, EXACT + COUNTERS + 1).cast("double") for x in (a, b))
    both = F.zip_with(*counters, lambda x, y: reduce(add, [(2 * _counter(x, k) - n) * (2 * _counter(y, k) - m) for k in range(3)]))
    return F.aggregate(both, F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""
    norm = F.sqrt(_product(a, a) * _product(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _product(a, b) / norm))).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, words) of every text."""
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"), "text")
    return _words(keyed, ["doc_id", "n_chars", "row"]).select("doc_id", "n_chars", text_of(F.col("words")).alias("fingerprint"), "words")


def _ranges(docs: DataFrame) -> Column:
    """The range of ids a row is in: how many of the bounds are under its key, found in two steps."""
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / count for k in range(1, count)] or [0.5]
    bounds = sorted(set(docs.agg(F.percentile_approx("key", F.lit(shares), 10_000)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    key = F.col("key")
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b < key))
    start = F.greatest(F.lit(0), coarse - 1) * step
    return start + F.size(F.filter(F.slice(F.lit(bounds), start + 1, F.lit(step)), lambda b: b < key))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last floor(n / 2) of n code points replaced by the first as many of
    the next document in descending id order), and likenesses: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)."""
    texts = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_FIRST)).alias("key"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    texts = texts.withColumn("range", _ranges(texts))
    tops = texts.groupBy("range").agg(F.max("key").alias("key"))  # one row per range
    order = Window.orderBy("range")
    everywhere = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = tops.select("key", F.coalesce(F.lead("range").over(order), F.min("range").over(everywhere)).alias("above"))
    placed = texts.join(F.broadcast(above), "key", "left").select(
        "doc_id", "key", "text", F.explode(F.array(F.struct("range", F.lit(False).alias("again")), F.struct(F.col("above").alias("range"), F.lit(True).alias("again")))).alias("place")
    )
    placed = placed.where("place.range IS NOT NULL").select("doc_id", "key", "text", "place.range", "place.again")
    follow = Window.partitionBy("range").orderBy("again", F.desc("key"), F.xxhash64("text"))
    n = F.length("text")
    ordered = placed.select("doc_id", "range", "again", F.row_number().over(follow).alias("row"), "text", F.coalesce(F.lead("text").over(follow), F.lit("")).alias("next"))
    half = F.floor(n / 2).cast("int")
    both = ordered.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).select(
        "range", "row", "again", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.when(F.col("again"), F.array("text")).otherwise(F.array("text", "edited"))).alias("which", "text"),
    )
    keys = ["range", "row", "which", "again", "doc_id", "n_chars", "edited_sha256"]
    summed = _words(both, keys)
    along = Window.partitionBy("range").orderBy("row", "which")
    rows = summed.select(*keys, "words", F.lead("words", 1).over(along).alias("edited"), F.lead("words", 2).over(along).alias("next"))
    return rows.where("which = 0 AND NOT again").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("words")).alias("fingerprint"),
        text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited")).alias("near_edited"),
        likeness(F.col("words"), F.col("next")).alias("near_next"),
    )
