"""Word counts and text column statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.stats import ratio
from tablescope.kinds import quoted, string_columns
from tablescope.operators.freq import distinct_counts, per_column

# Fixed value: a word is a letter, digit or underscore followed by at least one more, or an apostrophe.
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def word_frequencies(
    df: DataFrame, column: str | None = None, top_n: int | None = 200, stopwords: Iterable[str] | None = None
) -> DataFrame:
    """``(word, n)`` over the whole texts of the first (or named) text column, most frequent first."""
    texts = string_columns(df)
    column = column or (texts[0] if texts else None)
    if column is None:
        raise ValueError("no text columns found")
    spread = df.select(F.explode(words(quoted(column))).alias("word"))
    if stopwords is not None:
        spread = spread.filter(~F.col("word").isin([w.lower() for w in stopwords]))
    counted = spread.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted if top_n is None else counted.orderBy(F.desc("n"), "word").limit(top_n)


def text_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Length and word count (least, mean, most) and distinct share per text column."""
    names = list(cols) if cols else string_columns(df)
    n_words = lambda c: F.size(words(c)).cast("bigint")
    length = lambda c: F.length(c).cast("bigint")
    base = per_column(
        df,
        names,
        {
            "count": lambda c, _: F.count(c),
            "min_length": lambda c, _: F.min(length(c)),
            "mean_length": lambda c, _: F.avg(length(c)),
            "max_length": lambda c, _: F.max(length(c)),
            "min_words": lambda c, _: F.min(F.when(c.isNotNull(), n_words(c))),
            "mean_words": lambda c, _: F.avg(F.when(c.isNotNull(), n_words(c))),
            "max_words": lambda c, _: F.max(F.when(c.isNotNull(), n_words(c))),
        },
    )
    return base.join(F.broadcast(distinct_counts(df, names)), "column").withColumn(
        "distinct_ratio", ratio(F.col("n_unique"), F.col("count"))
    ).drop("n_unique")
