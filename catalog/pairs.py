"""Column relations: correlations, associations, analysis of variance, bundles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import GAPS, GAPS_SQL, LINEITEM, SQL, numbers, r, register, rounded, table, with_gaps
from tablescope.operators import anova, assoc, corr
from tablescope.plans import recipes, relations
from tablescope.plans.config import RelationConfig

_gaps = GAPS_SQL + " t"
GAP_NUMBERS = list(numbers(GAPS))


# --- correlations ---------------------------------------------------------------------------------

def _pairs(columns):
    return list(combinations(columns, 2))


def pearson_sql(columns, source, digits=6):
    one = "SELECT '{a}' AS col1, '{b}' AS col2, " + r("CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END", digits) + " AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {s}"
    return "\nUNION ALL\n".join(one.format(a=a, b=b, s=source) for a, b in _pairs(columns))


def spearman_sql(columns, source):
    one = """SELECT '{a}' AS col1, '{b}' AS col2, {value} AS r, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM {s} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    return "\nUNION ALL\n".join(one.format(a=a, b=b, s=source, value=r("corr(ra, rb)")) for a, b in _pairs(columns))


def kendall_sql(columns, source):
    one = """SELECT '{a}' AS col1, '{b}' AS col2, {value} AS r, (SELECT sum(c) FROM p)::BIGINT AS n FROM
 (WITH p AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS c FROM {s} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
  SELECT (SELECT sum(p1.c * p2.c * sign(p1.x - p2.x) * sign(p1.y - p2.y)) / 2 FROM p p1, p p2) AS s,
   (SELECT sum(c) * (sum(c) - 1) / 2 FROM p) AS n0,
   (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM p GROUP BY x)) AS n1,
   (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM p GROUP BY y)) AS n2, (SELECT sum(c) FROM p)::BIGINT AS n) k"""
    one = one.replace("(SELECT sum(c) FROM p)::BIGINT AS n FROM\n", "n FROM\n")
    return "\nUNION ALL\n".join(one.format(a=a, b=b, s=source, value=r("s / sqrt((n0 - n1) * (n0 - n2))")) for a, b in _pairs(columns))


register("corr_matrix", lambda s, d: rounded(corr.corr_matrix(table(s, d, "lineitem"))), pearson_sql(list(numbers(LINEITEM)), "lineitem"))
register("corr_matrix_missing", lambda s, d: rounded(corr.corr_matrix(with_gaps(s, d))), pearson_sql(GAP_NUMBERS, _gaps))
register(
    "corr_matrix_constant",
    lambda s, d: rounded(corr.corr_matrix(table(s, d, "orders").select("o_totalprice", "o_custkey", F.lit(5.0).alias("k")))),
    pearson_sql(["o_totalprice", "o_custkey", "k"], "(SELECT o_totalprice, o_custkey, 5.0::DOUBLE AS k FROM orders) t"),
)
register("corr_matrix_spearman", lambda s, d: rounded(corr.corr_matrix(table(s, d, "lineitem"), "spearman")), spearman_sql(list(numbers(LINEITEM)), "lineitem"))
register("corr_matrix_spearman_missing", lambda s, d: rounded(corr.corr_matrix(with_gaps(s, d), "spearman")), spearman_sql(GAP_NUMBERS, _gaps))
KENDALL = ["l_quantity", "l_discount", "l_tax"]
register("corr_matrix_kendall", lambda s, d: rounded(corr.corr_matrix(with_gaps(s, d), "kendall", KENDALL)), kendall_sql(KENDALL, _gaps))
register(
    "corr_matrix_kendall_wide",
    lambda s, d: rounded(corr.corr_matrix(table(s, d, "orders"), "kendall", ["o_custkey", "o_totalprice"])),
    kendall_sql(["o_custkey", "o_totalprice"], "orders"),
)

# Prices that depend on each other, so that there is something strong to find.
PRICED = ["l_quantity", "l_extendedprice", "revenue", "charge", "l_tax"]
PRICED_SQL = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_tax FROM lineitem) t"


def priced(s, d):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(s, d, "lineitem").select(
        "l_quantity", "l_extendedprice", revenue.alias("revenue"), (revenue * (1 + F.col("l_tax"))).alias("charge"), "l_tax"
    )


register(
    "strong_correlations",
    lambda s, d: rounded(corr.strong_correlations(priced(s, d))),
    f"""WITH p AS ({pearson_sql(PRICED, PRICED_SQL, 12)}), s AS ({spearman_sql(PRICED, PRICED_SQL).replace('(round(corr(ra, rb), 6) + 0.0)', 'corr(ra, rb)')}),
  b AS (SELECT p.col1, p.col2, p.r AS pearson, s.r AS spearman, greatest(abs(p.r), abs(s.r)) AS m, p.n FROM p JOIN s USING (col1, col2))
SELECT col1, col2, {r('pearson')} AS pearson, {r('spearman')} AS spearman, {r('m')} AS max_abs, n, CASE WHEN m >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
  CASE WHEN (CASE WHEN abs(pearson) >= abs(spearman) THEN pearson ELSE spearman END) > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(pearson) >= abs(spearman) THEN 'linear' ELSE 'monotone' END AS relation FROM b WHERE m >= 0.3 ORDER BY m DESC LIMIT 20""",
)
register(
    "correlation_summary",
    lambda s, d: rounded(corr.correlation_summary(priced(s, d))),
    f"""WITH p AS ({pearson_sql(PRICED, PRICED_SQL, 12)})
SELECT count(*) AS total_pairs, count(*) FILTER (abs(r) >= 0.3) AS strong_pairs, count(*) FILTER (abs(r) >= 0.7) AS very_strong_pairs, {r('max(abs(r))')} AS max_abs_offdiag,
  {r('avg(abs(r))')} AS mean_abs_offdiag, 1.0::DOUBLE AS max_abs_incl_diag, {r('(2 * sum(abs(r)) + 5) / (2 * count(r) + 5)')} AS mean_abs_incl_diag FROM p""",
)
register("top_correlated_pairs", lambda s, d: rounded(corr.top_correlated_pairs(priced(s, d), 4)), f"SELECT * FROM ({pearson_sql(PRICED, PRICED_SQL)}) p ORDER BY r DESC, col1, col2 LIMIT 4")
register(
    "corr_subset",
    lambda s, d: rounded(corr.corr_subset(priced(s, d), 2)),
    f"""WITH p AS ({pearson_sql(PRICED, PRICED_SQL)}), k AS (SELECT * FROM p ORDER BY abs(r) DESC, col1, col2 LIMIT 2), c AS (SELECT col1 AS c FROM k UNION SELECT col2 FROM k)
SELECT * FROM p WHERE col1 IN (SELECT c FROM c) AND col2 IN (SELECT c FROM c)""",
)


# --- associations ---------------------------------------------------------------------------------

CLASSES = ["p_brand", "p_type", "size_class"]
CLASSES_SQL = "(SELECT p_name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type, 'S' || (p_size % 3)::VARCHAR AS size_class FROM part) t"


def classes(s, d):
    """Part classes with some missing; p_name has more levels than the gate admits."""
    return table(s, d, "part").select(
        "p_name",
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("p_brand"),
        "p_type",
        F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string")).alias("size_class"),
    )


def cells_sql(columns, source):
    one = "SELECT '{a}' AS col1, '{b}' AS col2, {a} AS v1, {b} AS v2, count(*) AS n FROM {s} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"
    rows = "\nUNION ALL\n".join(one.format(a=a, b=b, s=source) for a, b in _pairs(columns))
    return f"""SELECT *, sum(n) OVER (PARTITION BY col1, col2, v1)::BIGINT AS row_n, sum(n) OVER (PARTITION BY col1, col2, v2)::BIGINT AS col_n,
 sum(n) OVER (PARTITION BY col1, col2)::BIGINT AS total FROM ({rows}) c"""


def chi_sql(columns, source):
    """Without Yates (no 2 x 2 pairs among these); p by the closed form for even degrees of freedom."""
    return f"""WITH c AS ({cells_sql(columns, source)}),
 x AS (SELECT col1, col2, max(total) AS n, count(DISTINCT v1) AS l1, count(DISTINCT v2) AS l2, sum(n::DOUBLE * n / (row_n::DOUBLE * col_n)) * max(total) - max(total) AS chi2 FROM c GROUP BY 1, 2),
 y AS (SELECT *, (l1 - 1) * (l2 - 1) AS dof, sqrt(chi2 / (n * (least(l1, l2) - 1))) AS v FROM x),
 z AS (SELECT *, (SELECT sum(exp(k.k * ln(chi2 / 2) - lgamma(k.k + 1) - chi2 / 2)) FROM (SELECT unnest(generate_series(0, (dof / 2)::BIGINT - 1)) AS k) k) AS p FROM y)
SELECT col1, col2, n, l1 AS levels1, l2 AS levels2, dof, chi2, p, v, CASE WHEN v >= 0.5 THEN 'very_strong' WHEN v >= 0.3 THEN 'strong' WHEN v >= 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM z"""


_CHI_OUT = f"col1, col2, n, levels1, levels2, dof, {r('chi2')} AS chi2, {r('p')} AS p_value, p < 0.05 AS significant, {r('v')} AS cramers_v, strength"
register("contingency", lambda s, d: assoc.contingency(classes(s, d)), cells_sql(CLASSES, CLASSES_SQL))
register("contingency_orders", lambda s, d: assoc.contingency(table(s, d, "orders")), cells_sql(["o_orderstatus", "o_orderpriority"], "orders"))
register("chi_square", lambda s, d: rounded(assoc.chi_square(classes(s, d))), f"SELECT {_CHI_OUT} FROM ({chi_sql(CLASSES, CLASSES_SQL)}) t")
register("chi_square_orders", lambda s, d: rounded(assoc.chi_square(table(s, d, "orders"))), f"SELECT {_CHI_OUT} FROM ({chi_sql(['o_orderstatus', 'o_orderpriority'], 'orders')}) t")
register("chi_square_lineitem", lambda s, d: rounded(assoc.chi_square(with_gaps(s, d))), f"SELECT {_CHI_OUT} FROM ({chi_sql(['l_returnflag', 'l_linestatus'], _gaps)}) t")
_TWO = "(SELECT CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS price, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rush' ELSE 'normal' END AS hurry FROM orders)"
register(
    "chi_square_yates",
    lambda s, d: rounded(
        assoc.chi_square(
            table(s, d, "orders").select(
                F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("price"),
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "rush").otherwise("normal").alias("hurry"),
            )
        ).select("col1", "col2", "n", "dof", "chi2", "cramers_v")
    ),
    f"""WITH c AS ({cells_sql(['price', 'hurry'], _TWO + ' t')}), e AS (SELECT *, row_n::DOUBLE * col_n / total AS e FROM c)
SELECT col1, col2, max(total) AS n, 1::BIGINT AS dof, {r('sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e)')} AS chi2, {r('sqrt(sum(pow(greatest(abs(n - e) - 0.5, 0), 2) / e) / max(total))')} AS cramers_v FROM e GROUP BY 1, 2""",
)
register("cramers_v", lambda s, d: rounded(assoc.cramers_v(classes(s, d))), f"SELECT col1, col2, n, {r('v')} AS cramers_v, strength FROM ({chi_sql(CLASSES, CLASSES_SQL)}) t")
register(
    "theils_u",
    lambda s, d: rounded(assoc.theils_u(classes(s, d))),
    f"""WITH c AS (SELECT col1, col2, n::DOUBLE AS n, row_n::DOUBLE AS a, col_n::DOUBLE AS b, total::DOUBLE AS t FROM ({cells_sql(CLASSES, CLASSES_SQL)}) q),
 h AS (SELECT col1, col2, max(t)::BIGINT AS n, sum(-n / t * ln(a / t)) AS h1, sum(-n / t * ln(b / t)) AS h2, sum(-n / t * ln(n / b)) AS h12, sum(-n / t * ln(n / a)) AS h21 FROM c GROUP BY 1, 2)
SELECT col1, col2, n, {r('(h1 - h12) / h1')} AS u_col1_given_col2, {r('(h2 - h21) / h2')} AS u_col2_given_col1 FROM h""",
)
LIFT = RelationConfig(lift_threshold=1.2)
register(
    "association_rules",
    lambda s, d: rounded(assoc.association_rules(classes(s, d), LIFT)),
    f"""WITH c AS ({cells_sql(CLASSES, CLASSES_SQL)}), f AS (SELECT col1, col2, v1, v2, n, n / total AS support, n / row_n AS confidence, (n::DOUBLE * total) / (row_n::DOUBLE * col_n) AS lift FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY col1, col2 ORDER BY lift DESC, v1, v2) AS p FROM f WHERE lift >= 1.2)
SELECT col1, col2, v1, v2, n, {r('support')} AS support, {r('confidence')} AS confidence, {r('lift')} AS lift FROM k WHERE p <= 5""",
)
register("strong_associations", lambda s, d: rounded(assoc.strong_associations(classes(s, d), RelationConfig(top_k=2))), f"SELECT {_CHI_OUT} FROM ({chi_sql(CLASSES, CLASSES_SQL)}) t ORDER BY v DESC LIMIT 2")
register(
    "association_summary",
    lambda s, d: rounded(assoc.association_summary(classes(s, d))),
    f"SELECT count(*) AS total_pairs, count(*) FILTER (p < 0.05) AS significant_pairs, {r('max(v)')} AS max_v, {r('avg(v)')} AS mean_v, count(*) FILTER (v >= 0.3) AS strong_pairs FROM ({chi_sql(CLASSES, CLASSES_SQL)}) t",
)


# --- analysis of variance -------------------------------------------------------------------------

def levels_sql(pairs, source, least=30, skip=False):
    one = "SELECT '{num}' AS num, '{cat}' AS cat, {cat} AS level, count({num}) AS n, avg({num}::DOUBLE) AS mean, var_pop({num}::DOUBLE) AS var_pop FROM {s} WHERE {cat} IS NOT NULL AND {num} IS NOT NULL GROUP BY {cat}"
    rows = "\nUNION ALL\n".join(one.format(num=n, cat=c, s=source) for n, c in pairs)
    kept = f"SELECT * FROM (SELECT *, min(n) OVER (PARTITION BY num, cat) AS least FROM ({rows}) a) b WHERE least >= {least}" if skip else f"SELECT * FROM ({rows}) a WHERE n >= {least}"
    return f"SELECT num, cat, level, n, mean, var_pop FROM (SELECT *, count(*) OVER (PARTITION BY num, cat) AS k FROM ({kept}) c) d WHERE k >= 2"


def anova_sql(pairs, source, **kw):
    return f"""WITH l AS ({levels_sql(pairs, source, **kw)}), g AS (SELECT *, sum(n * mean) OVER (PARTITION BY num, cat) / sum(n) OVER (PARTITION BY num, cat) AS m FROM l),
 b AS (SELECT num, cat, sum(n)::BIGINT AS n, count(*) AS levels, sum(n * pow(mean - m, 2)) AS ssb, sum(n * var_pop) AS ssw FROM g GROUP BY 1, 2)
SELECT num, cat, n, levels, (ssb / (levels - 1)) / (ssw / (n - levels)) AS f, ssb / (ssb + ssw) AS eta2,
 CASE WHEN levels = 3 THEN pow(1 + 2 * ((ssb / (levels - 1)) / (ssw / (n - levels))) / (n - levels), -(n - levels) / 2.0) END AS p FROM b"""


_EFFECT = "CASE WHEN eta2 >= 0.14 THEN 'large' WHEN eta2 >= 0.06 THEN 'medium' WHEN eta2 >= 0.01 THEN 'small' ELSE 'none' END AS effect"
_ANOVA_OUT = f"num, cat, n, levels, {r('f')} AS f_stat, {r('p')} AS p_value, p < 0.05 AS significant, {r('eta2', 8)} AS eta2, {_EFFECT}"


def anova_rounded(frame):
    return frame.select("num", "cat", "n", "levels", F.round("f_stat", 6).alias("f_stat"), F.round("p_value", 6).alias("p_value"), "significant", F.round("eta2", 8).alias("eta2"), "effect")


FLAG = [(n, "l_returnflag") for n in GAP_NUMBERS]
register("anova", lambda s, d: anova_rounded(anova.anova(with_gaps(s, d), cats=["l_returnflag"])), f"SELECT {_ANOVA_OUT} FROM ({anova_sql(FLAG, _gaps)}) t")
BRANDS = [(n, c) for n in ("p_partkey", "p_size", "p_retailprice") for c in ("p_brand", "p_type")]
BIG = RelationConfig(min_sample_size=80)
SKIP = RelationConfig(min_sample_size=80, small_groups="skip_pair")
_STATS = ("num", "cat", "n", "levels", "f_stat", "eta2", "effect")
_STATS_OUT = f"num, cat, n, levels, {r('f')} AS f_stat, {r('eta2', 8)} AS eta2, {_EFFECT}"
register("anova_drop_level", lambda s, d: anova_rounded(anova.anova(table(s, d, "part"), BIG)).select(*_STATS), f"SELECT {_STATS_OUT} FROM ({anova_sql(BRANDS, 'part', least=80)}) t")
register("anova_skip_pair", lambda s, d: anova_rounded(anova.anova(table(s, d, "part"), SKIP)).select(*_STATS), f"SELECT {_STATS_OUT} FROM ({anova_sql(BRANDS, 'part', least=80, skip=True)}) t")
register(
    "level_stats",
    lambda s, d: rounded(anova.level_stats(table(s, d, "part"), RelationConfig())),
    f"SELECT num, cat, level, n, {r('mean')} AS mean, {r('var_pop')} AS var_pop FROM ({levels_sql(BRANDS, 'part')}) t",
)


def kruskal_sql(pairs, source):
    one = """SELECT '{num}' AS num, '{cat}' AS cat, v.n, v.h, v.k FROM (WITH v AS (SELECT {num}::DOUBLE AS x, {cat} AS g FROM {s} WHERE {num} IS NOT NULL AND {cat} IS NOT NULL),
  w AS (SELECT * FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) >= 30)),
  k AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM w),
  q AS (SELECT g, sum(rk) AS rs, count(*) AS c FROM k GROUP BY g), n AS (SELECT count(*)::DOUBLE AS n FROM w),
  t AS (SELECT sum(t::DOUBLE * t * t - t) AS t FROM (SELECT count(*) AS t FROM w GROUP BY x))
 SELECT n::BIGINT AS n, count(*) AS k, (12 / (n * (n + 1)) * sum(rs * rs / c) - 3 * (n + 1)) / (1 - any_value(t.t) / (n * n * n - n)) AS h FROM q, n, t GROUP BY n) v"""
    return "\nUNION ALL\n".join(one.format(num=n, cat=c, s=source) for n, c in pairs)


register(
    "kruskal",
    lambda s, d: rounded(anova.kruskal(with_gaps(s, d), cats=["l_returnflag"])),
    f"SELECT num, cat, n, {r('h')} AS h_stat, {r('exp(-h / 2)')} AS kruskal_p FROM ({kruskal_sql(FLAG, _gaps)}) t",
)
register(
    "kruskal_types",
    lambda s, d: rounded(anova.kruskal(table(s, d, "part")).select("num", "cat", "n", "h_stat")),
    f"SELECT num, cat, n, {r('h')} AS h_stat FROM ({kruskal_sql(BRANDS, 'part')}) t",
)
register(
    "mixed_relations",
    lambda s, d: (lambda m: anova_rounded(m).join(rounded(m).select("num", "cat", "h_stat", "kruskal_p"), ["num", "cat"]))(anova.mixed_relations(with_gaps(s, d), RelationConfig(top_k=3), ["l_returnflag"])),
    f"""SELECT a.*, k.h_stat, k.kruskal_p FROM (SELECT {_ANOVA_OUT} FROM ({anova_sql(FLAG, _gaps)}) t ORDER BY t.eta2 DESC LIMIT 3) a
JOIN (SELECT num, cat, {r('h')} AS h_stat, {r('exp(-h / 2)')} AS kruskal_p FROM ({kruskal_sql(FLAG, _gaps)}) q) k USING (num, cat)""",
)
register(
    "mixed_summary",
    lambda s, d: rounded(anova.mixed_summary(with_gaps(s, d), cats=["l_returnflag"]), 8),
    f"SELECT count(*) AS total_pairs, count(*) FILTER (p < 0.05) AS significant_pairs, {r('max(eta2)', 8)} AS max_eta2, {r('avg(eta2)', 8)} AS mean_eta2, count(*) FILTER (eta2 >= 0.14) AS large_pairs FROM ({anova_sql(FLAG, _gaps)}) t",
)


# --- bundles --------------------------------------------------------------------------------------

# Eight numbers by three classes of three levels: more mixed pairs than the bundle ranks, p-values in closed form.
# order_class has too many levels for the gate.
WIDE_CATS = ["l_returnflag", "part_class", "supp_class"]
WIDE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  'p' || (l_partkey % 3)::VARCHAR AS part_class, 's' || ((l_suppkey + l_linenumber) % 3)::VARCHAR AS supp_class, 'o' || (l_orderkey % 400)::VARCHAR AS order_class FROM lineitem) t"""
WIDE_PAIRS = [(n, c) for n in WIDE_NUMBERS for c in WIDE_CATS]


def wide(s, d):
    return table(s, d, "lineitem").select(
        *WIDE_NUMBERS,
        "l_returnflag",
        F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("part_class"),
        F.concat(F.lit("s"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 3).cast("string")).alias("supp_class"),
        F.concat(F.lit("o"), (F.col("l_orderkey") % 400).cast("string")).alias("order_class"),
    )


def section(name, frame=wide):
    return lambda s, d: relations.analyze_relations(frame(s, d), sections=[name])[name]


def _spearman_exact(columns, source):
    return spearman_sql(columns, source).replace("(round(corr(ra, rb), 6) + 0.0)", "corr(ra, rb)")


register(
    "analyze_relations_metadata",
    section("metadata"),
    "SELECT count(*) AS n_rows, 12::BIGINT AS n_columns, 8::BIGINT AS numeric_columns, 4::BIGINT AS text_columns, 3::BIGINT AS usable_categories FROM lineitem",
)
register(
    "analyze_relations_excluded",
    lambda s, d: section("excluded_columns")(s, d).select("column", F.col("n_levels").between(360, 440).alias("near")),
    f"SELECT 'order_class' AS \"column\", count(DISTINCT order_class) BETWEEN 360 AND 440 AS near FROM {WIDE_SQL}",
)
register(
    "analyze_relations_matrix",
    lambda s, d: rounded(section("correlation_matrix", priced)(s, d)),
    f"""WITH p AS ({pearson_sql(PRICED, PRICED_SQL, 12)}), s AS ({_spearman_exact(PRICED, PRICED_SQL)})
SELECT col1, col2, {r('p.r')} AS pearson, p.n, {r('s.r')} AS spearman, {r('greatest(abs(p.r), abs(s.r))')} AS max_abs FROM p JOIN s USING (col1, col2)""",
)
register("analyze_relations_numerical", lambda s, d: rounded(section("numerical", priced)(s, d)), SQL["strong_correlations"])
register(
    "analyze_relations_numerical_summary",
    lambda s, d: rounded(section("numerical_summary", priced)(s, d)),
    f"""WITH p AS ({pearson_sql(PRICED, PRICED_SQL, 12)}), s AS ({_spearman_exact(PRICED, PRICED_SQL)}), b AS (SELECT p.r, greatest(abs(p.r), abs(s.r)) AS m FROM p JOIN s USING (col1, col2))
SELECT count(*) AS total_pairs, count(*) FILTER (m >= 0.3) AS strong_pairs, count(*) FILTER (m >= 0.7) AS very_strong_pairs, {r('max(abs(r))')} AS max_abs_offdiag,
  {r('avg(abs(r))')} AS mean_abs_offdiag, 1.0::DOUBLE AS max_abs_incl_diag, {r('(2 * sum(abs(r)) + 5) / (2 * count(r) + 5)')} AS mean_abs_incl_diag FROM b""",
)
for _name, _key, _frame in (("categorical_summary", "association_summary", classes), ("theils_u", "theils_u", classes)):
    register(f"analyze_relations_{_name}", (lambda n, f: lambda s, d: rounded(section(n, f)(s, d)))(_name, _frame), SQL[_key])
register(
    "analyze_relations_categorical",
    lambda s, d: rounded(section("categorical", classes)(s, d)),
    f"SELECT {_CHI_OUT} FROM ({chi_sql(CLASSES, CLASSES_SQL)}) t ORDER BY v DESC LIMIT 20",
)
register(
    "analyze_relations_rules",
    lambda s, d: rounded(section("rules", classes)(s, d)),
    SQL["association_rules"].replace("lift >= 1.2", "lift >= 1.5"),
)
register(
    "analyze_relations_level_stats",
    lambda s, d: rounded(section("level_stats")(s, d), 4),
    f"SELECT num, cat, level, n, {r('mean', 4)} AS mean, {r('var_pop', 4)} AS var_pop FROM ({levels_sql(WIDE_PAIRS, WIDE_SQL)}) q",
)
register(
    "analyze_relations_mixed",
    lambda s, d: (lambda m: anova_rounded(m).join(rounded(m).select("num", "cat", "h_stat", "kruskal_p"), ["num", "cat"]))(section("mixed")(s, d)),
    f"""SELECT a.*, k.h_stat, k.kruskal_p FROM (SELECT {_ANOVA_OUT} FROM ({anova_sql(WIDE_PAIRS, WIDE_SQL)}) t ORDER BY t.eta2 DESC, num, cat LIMIT 20) a
JOIN (SELECT num, cat, {r('h')} AS h_stat, {r('exp(-h / 2)')} AS kruskal_p FROM ({kruskal_sql(WIDE_PAIRS, WIDE_SQL)}) q) k USING (num, cat)""",
)
register(
    "analyze_relations_mixed_summary",
    lambda s, d: rounded(section("mixed_summary")(s, d), 8),
    f"SELECT count(*) AS total_pairs, count(*) FILTER (p < 0.05) AS significant_pairs, {r('max(eta2)', 8)} AS max_eta2, {r('avg(eta2)', 8)} AS mean_eta2, count(*) FILTER (eta2 >= 0.14) AS large_pairs FROM ({anova_sql(WIDE_PAIRS, WIDE_SQL)}) t",
)


register(
    "analyze_relations_tokens",
    lambda s, d: rounded(relations.analyze_relations(table(s, d, "part"), tokens=["brand", "type"])["metadata"]),
    "SELECT count(*) AS n_rows, 2::BIGINT AS n_columns, 0::BIGINT AS numeric_columns, 2::BIGINT AS text_columns, 2::BIGINT AS usable_categories FROM part",
)
_RECO = ["o_custkey", "o_totalprice"]
_RECO_CATS = ["o_orderstatus", "o_orderpriority"]
register(
    "recommend_charts",
    lambda s, d: rounded(relations.recommend_charts(table(s, d, "orders").drop("o_orderkey", "o_orderdate"))),
    f"""SELECT * FROM (VALUES ('histogram_box', 'o_custkey', NULL, 'first numeric column', NULL::DOUBLE), ('bar_top10', 'o_orderstatus', NULL, 'first text column', NULL),
 ('scatter_fit', 'o_custkey', 'o_totalprice', 'first two numeric columns', NULL), ('crosstab_heatmap', 'o_orderstatus', 'o_orderpriority', 'first two text columns', NULL)) t(type, col1, col2, reason, score)
UNION ALL SELECT 'heatmap', col1, col2, 'cramers_v', {r('v')} FROM ({chi_sql(_RECO_CATS, 'orders')}) c
UNION ALL SELECT 'scatter', col1, col2, 'correlation', abs(r) FROM ({pearson_sql(_RECO, 'orders')}) p
UNION ALL SELECT * FROM (SELECT 'box', cat, num, 'eta_squared', {r('eta2')} FROM ({anova_sql([(n, c) for n in _RECO for c in _RECO_CATS], 'orders')}) a ORDER BY eta2 DESC LIMIT 3) b""",
)


def _recipe_run(s, d):
    results = recipes.run_recipe(table(s, d, "orders"), ["C2", "C15", "C3", "nonsense", "C27"], order_by="o_orderkey")
    rows = [(x.token, x.error is None) for x in results]
    n = next(x.result for x in results if x.token == "C15")
    return s.createDataFrame(rows, "token string, done boolean").withColumn("n_rows", n.agg(F.max("n_rows")).scalar())


register(
    "run_recipe",
    _recipe_run,
    "SELECT token, done, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('C2', true), ('C15', true), ('C3', true), ('nonsense', false), ('C27', false)) t(token, done)",
)
