"""Scans, profile sections and column roles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsmith.functions.session import shared_folder
from tabsmith.operators import roles, sketches
from tabsmith.operators.correlation import spearman_pairs
from tabsmith.operators.information import neighbour_information
from tabsmith.operators.profile import TableProfile, hash_sample, histogram, top_values, value_counts
from tabsmith.operators.stats import report, round_doubles
from tabsmith.plans.catalogue import query, table
from tabsmith.sources.tables import clean_table

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Every seventh order loses its quantity and every third customer-like key its tax, so
# that NULL handling shows; both engines build the same table.
GAPS_SQL = """(select l_orderkey, l_linenumber,
  case when l_orderkey % 7 = 0 then null else l_quantity end as l_quantity,
  l_extendedprice,
  case when l_partkey % 3 = 0 then null else l_tax end as l_tax,
  case when l_suppkey % 11 = 0 then null else l_returnflag end as l_returnflag
  from lineitem)"""


def gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.expr("case when l_orderkey % 7 = 0 then null else l_quantity end").alias("l_quantity"),
        "l_extendedprice",
        F.expr("case when l_partkey % 3 = 0 then null else l_tax end").alias("l_tax"),
        F.expr("case when l_suppkey % 11 = 0 then null else l_returnflag end").alias("l_returnflag"),
    )


GAPS_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag"]


def union(parts) -> str:
    return " union all ".join(parts)


def _stats_sql(tab: str, cols) -> str:
    return union(f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean,
      round(stddev_samp({c}), 4) as std, round(cast(min({c}) as double), 4) as min, round(cast(max({c}) as double), 4) as max,
      round(quantile_cont(cast({c} as double), 0.5), 4) as median, round(quantile_cont(cast({c} as double), 0.25), 4) as q1,
      round(quantile_cont(cast({c} as double), 0.75), 4) as q3,
      round(quantile_cont(cast({c} as double), 0.75) - quantile_cont(cast({c} as double), 0.25), 4) as iqr,
      round(stddev_samp({c}) / avg({c}), 4) as cv, round(cast(max({c}) as double) - min({c}), 4) as range from {tab}""" for c in cols)


@query("numeric_stats", _stats_sql("lineitem", LINE_NUM))
def numeric_stats(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").numeric_stats())


GAPS_NUM = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"]


@query("numeric_stats_gaps", _stats_sql(GAPS_SQL, GAPS_NUM))
def numeric_stats_gaps(spark, sf_dir):
    return round_doubles(TableProfile(gaps(spark, sf_dir), "l_returnflag").numeric_stats())


SKEW_LABEL = """case when sk > 2 then 'highly_positive' when sk > 0.5 then 'positive' when sk < -2 then 'highly_negative'
  when sk < -0.5 then 'negative' else 'symmetric' end"""


@query("skew_kurtosis", f"""select "column", round(sk, 4) as skewness, round(ku, 4) as kurtosis, {SKEW_LABEL} as skew_label,
  ku > 0 as leptokurtic from ({union(f'''select '{c}' as "column", skewness({c}) as sk, kurtosis({c}) as ku from documents'''
  for c in ["doc_id", "n_chars"])})""")
def skew_kurtosis(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "documents"), "lang").skewness_kurtosis())


@query("shape", "select count(*) as rows, 11 as cols from lineitem")
def shape(spark, sf_dir):
    return TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").shape()


@query("memory_estimate", """select round(sum(16 + 8 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0)
  + coalesce(strlen(source), 0) - 8) / 1e6, 4) as memory_mb from documents""")
def memory_estimate(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "documents"), "lang").memory_estimate())


@query("missing_report", f"""with g as {GAPS_SQL}, n as (select count(*) as n from g)
  select "column", missing, round(100.0 * missing / n.n, 4) as pct,
  case when 100.0 * missing / n.n > 30 then 'high' when 100.0 * missing / n.n > 5 then 'medium' else 'low' end as severity
  from ({union(f'''select '{c}' as "column", count(*) - count({c}) as missing from g''' for c in GAPS_COLS)}), n
  where missing > 0""")
def missing_report(spark, sf_dir):
    return round_doubles(TableProfile(gaps(spark, sf_dir), "l_returnflag").missing())


@query("missing_total", f"""with g as {GAPS_SQL} select cast(sum(missing) as bigint) as total_missing,
  round(100.0 * sum(missing) / (6 * max(n)), 4) as total_missing_pct
  from ({union(f'select count(*) - count({c}) as missing, count(*) as n from g' for c in GAPS_COLS)})""")
def missing_total(spark, sf_dir):
    return round_doubles(TableProfile(gaps(spark, sf_dir), "l_returnflag").missing_total())


DOC_VIEW = "(select lang, source, n_chars % 50 as size_class, doc_id % 2 as half from documents)"


def _doc_view(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("lang", "source", "n_chars % 50 as size_class", "doc_id % 2 as half")


@query("dup_rows", f"""select count(*) as rows, (select count(*) from (select distinct * from {DOC_VIEW})) as distinct_rows,
  count(*) - (select count(*) from (select distinct * from {DOC_VIEW})) as duplicate_rows,
  round(100.0 * (count(*) - (select count(*) from (select distinct * from {DOC_VIEW}))) / count(*), 4) as duplicate_pct
  from {DOC_VIEW}""")
def dup_rows(spark, sf_dir):
    return round_doubles(TableProfile(_doc_view(spark, sf_dir), "lang").duplicate_rows())


@query("dup_documents", """select count(*) as rows, count(distinct (text, lang, source, n_chars)) as distinct_rows,
  count(*) - count(distinct (text, lang, source, n_chars)) as duplicate_rows,
  round(100.0 * (count(*) - count(distinct (text, lang, source, n_chars))) / count(*), 4) as duplicate_pct from documents""")
def dup_documents(spark, sf_dir):
    """Whole texts compared, by fingerprint."""
    return round_doubles(TableProfile(table(spark, sf_dir, "documents").drop("doc_id"), "lang").duplicate_rows())


@query("target_summary_cat", """with v as (select o_orderpriority as class, count(*) as count from orders group by 1),
  t as (select sum(count) as n, max(count) / min(count) as r from v)
  select class, count, round(100.0 * count / t.n, 4) as pct, round(cast(t.r as double), 4) as imbalance_ratio, t.r > 3 as is_imbalanced
  from v, t""")
def target_summary_cat(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "orders"), "o_orderpriority").target_summary())


LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("target_summary_num", f"""select 'o_totalprice' as "column", count(o_totalprice) as count,
  count(*) - count(o_totalprice) as n_missing, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std,
  min(o_totalprice) as min, max(o_totalprice) as max, round(median(o_totalprice), 4) as median,
  round(skewness(o_totalprice), 4) as skewness, round(kurtosis(o_totalprice), 4) as kurtosis,
  {', '.join(f'round(quantile_cont(o_totalprice, {p}), 4) as p{round(100 * p)}' for p in LEVELS)} from orders""")
def target_summary_num(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "orders"), "o_totalprice").target_summary())


def _hist_sql(tab: str, cols, bins: int) -> str:
    one = union(f"""select '{c}' as "column", cast({c} as double) as v from {tab} where {c} is not null""" for c in cols)
    return f"""with l as ({one}), b as (select "column", min(v) as lo, max(v) as hi from l group by 1 having count(*) >= 5),
    w as (select "column", case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi from b),
    c as (select l."column", least(cast(floor((v - lo) / ((hi - lo) / {bins}.0)) as int), {bins - 1}) as bin, count(*) as n
      from l join w using ("column") group by 1, 2),
    f as (select "column", lo, (hi - lo) / {bins} as w, unnest(range({bins})) as bin from w)
    select f."column", cast(f.bin as int) as bin, round(lo + f.bin * w, 4) as lower, round(lo + (f.bin + 1) * w, 4) as upper,
    coalesce(n, 0) as count from f left join c on f."column" = c."column" and f.bin = c.bin"""


@query("histogram20", _hist_sql("lineitem", LINE_NUM, 20))
def histogram20(spark, sf_dir):
    return round_doubles(histogram(table(spark, sf_dir, "lineitem"), LINE_NUM, 20))


@query("categorical_stats", f"""with v as ({union(f'''select '{c}' as "column", {c} as value, count(*) as n from part group by 1, 2'''
  for c in ["p_name", "p_brand", "p_type"])}), p as (select "column", n + 1e-9 as w from v)
  select "column", count(*) as n_unique, cast(0 as bigint) as missing, round(ln(sum(w)) - sum(w * ln(w)) / sum(w), 4) as entropy,
  case when count(*) > 50 then 'high' when count(*) > 10 then 'medium' else 'low' end as cardinality from p group by 1""")
def categorical_stats(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "part"), "p_size").categorical_stats())


def _top_sql(tab: str, cols, k: int) -> str:
    v = union(f"""select '{c}' as "column", {c} as value, count(*) as count from {tab} where {c} is not null group by 1, 2"""
              for c in cols)
    return f"""select * from (select "column", value, count, cast(row_number() over (partition by "column" order by count desc, value)
      as int) as rank from ({v})) where rank <= {k}"""


@query("value_counts_topk", _top_sql("documents", ["text", "lang", "source"], 10))
def value_counts_topk(spark, sf_dir):
    return top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"], 10)


@query("value_counts_all", union(f"""select '{c}' as "column", {c} as value, count(*) as count from orders group by 1, 2"""
                                 for c in ["o_orderstatus", "o_orderpriority"]))
def value_counts_all(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _corr_sql(tab: str, cols) -> str:
    return union(f"""select '{a}' as f1, '{b}' as f2, round(corr({a}, {b}), 4) as r from {tab}"""
                 for a, b in combinations(cols, 2))


@query("pearson", _corr_sql("lineitem", LINE_NUM))
def pearson(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").pearson())


@query("pearson_gaps", _corr_sql(GAPS_SQL, GAPS_NUM))
def pearson_gaps(spark, sf_dir):
    return round_doubles(TableProfile(gaps(spark, sf_dir), "l_returnflag").pearson())


def _spearman_sql(tab: str, cols) -> str:
    def rank(c):
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
    return union(f"""select '{a}' as f1, '{b}' as f2, round(corr(ra, rb), 4) as r from (select {rank(a)} as ra, {rank(b)} as rb
      from {tab} where {a} is not null and {b} is not null)""" for a, b in combinations(cols, 2))


@query("spearman", _spearman_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def spearman(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "part"), "p_size").spearman(["p_partkey"]))


@query("spearman_gaps", _spearman_sql(GAPS_SQL, ["l_quantity", "l_extendedprice", "l_tax"]))
def spearman_gaps(spark, sf_dir):
    # (order, line) repeats in this table, so the key is a hash of the row and its place among equal rows.
    df = gaps(spark, sf_dir)
    keyed = df.withColumn("_row", F.xxhash64(*df.columns)).withColumn("_copy", F.row_number().over(Window.partitionBy("_row").orderBy(*df.columns)))
    return round_doubles(spearman_pairs(keyed, ["l_quantity", "l_extendedprice", "l_tax"], ["_row", "_copy"]))


@query("top_corr", f"""select f1, f2, round(r, 4) as r from ({union(f'''select '{a}' as f1, '{b}' as f2, corr({a}, {b}) as r from lineitem'''
  for a, b in combinations([c for c in LINE_NUM if c != 'l_tax'], 2))}) order by abs(r) desc, f1, f2 limit 5""")
def top_corr(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_tax").top_correlations(5))


@query("target_corr", union(f"""select '{c}' as feature, round(abs(corr({c}, l_extendedprice)), 4) as abs_r from lineitem"""
                            for c in LINE_NUM if c != "l_extendedprice"))
def target_corr(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_extendedprice").target_correlations())


@query("multicollinear", f"""select f1, f2, round(r, 4) as r from ({union(f'''select '{a}' as f1, '{b}' as f2, corr({a}, {b}) as r from lineitem'''
  for a, b in combinations(LINE_NUM, 2))}) where abs(r) > 0.5""")
def multicollinear(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").multicollinear(0.5))


def _outlier_sql(tab: str, cols) -> str:
    parts = union(f"""select '{c}' as "column", cast({c} as double) as v, s.* from {tab},
      (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3, avg({c}) as m,
       stddev_pop({c}) as sd from {tab}) s where {c} is not null""" for c in cols)
    return f"""select "column", count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as iqr_outliers,
      count(*) filter (abs(v - m) / nullif(sd, 0) > 3) as zscore_outliers,
      round(100.0 * count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) / count(*), 4) as iqr_pct,
      round(max(q1 - 1.5 * (q3 - q1)), 4) as lower_fence, round(max(q3 + 1.5 * (q3 - q1)), 4) as upper_fence
      from ({parts}) group by 1 having iqr_outliers > 0 or zscore_outliers > 0"""


@query("outliers", _outlier_sql("events", ["event_id", "user_id", "value"]))
def outliers(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "events"), "event_type").outliers())


@query("outliers_documents", _outlier_sql("documents", ["doc_id", "n_chars"]))
def outliers_documents(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "documents"), "lang").outliers())


@query("jarque_bera", f"""select "column", round(jb, 4) as jb_stat, round(exp(-jb / 2), 4) as jb_p, exp(-jb / 2) > 0.05 as is_normal
  from ({union(f'''select '{c}' as "column", count(*) / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4.0) as jb
    from orders, (select avg(pow(cast({c} as double) - m, 2)) as m2, avg(pow(cast({c} as double) - m, 3)) as m3, avg(pow(cast({c} as double) - m, 4)) as m4
    from orders, (select avg({c}) as m from orders)) group by m2, m3, m4''' for c in ["o_orderkey", "o_custkey", "o_totalprice"])})""")
def jarque_bera(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "orders"), "o_orderstatus").normality())


def _mi_sql(tab: str, features, y: str) -> str:
    def edges(c):
        return ", ".join(f"quantile_cont(cast({c} as double), {i / 10})" for i in range(1, 10))
    cells = union(f"""select '{c}' as feature, len(list_filter(list_distinct([{edges(c)}]), lambda e: e < x)) as bx, y, count(*) as n
      from (select * from (select cast({c} as double) as x, {y} as y from {tab}), (select {', '.join(f'quantile_cont(cast({c} as double), {i / 10}) as e{i}' for i in range(1, 10))} from {tab}))
      group by 1, 2, 3""".replace(f"[{edges(c)}]", "[e1, e2, e3, e4, e5, e6, e7, e8, e9]") for c in features)
    return f"""with cells as ({cells}), n as (select feature, sum(n) as t from cells group by 1),
      x as (select feature, bx, sum(n) as nx from cells group by 1, 2), y as (select feature, y, sum(n) as ny from cells group by 1, 2)
      select cells.feature, round(greatest(sum(n / t * ln(n * t / (nx * ny))), 0), 4) as mi
      from cells join n using (feature) join x using (feature, bx) join y on cells.feature = y.feature and cells.y = y.y group by 1"""


@query("binned_mi", _mi_sql("lineitem", LINE_NUM, "l_returnflag"))
def binned_mi(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").mutual_information())


# The digamma function of a whole number from its harmonic sum.
PSI_SQL = """psi as (select n, -0.5772156649015329 + sum(case when n > 1 then 1.0::double / (n - 1) else 0 end) over (order by n) as psi
    from (select unnest(range(1, (select count(*) from part) + 1)) as n))"""
INSIDE_SQL = "case when c.r = 0 then b.{x} = c.{x} else b.{x} > c.{x} - c.r and b.{x} < c.{x} + c.r end"


@query("neighbour_mi", f"""with {PSI_SQL}, p as (select row_number() over () as id, * from part),
  every as (select 'p_size' as feature, id, p_brand as y, p_size::double as x from p union all select 'p_retailprice', id, p_brand, p_retailprice from p),
  own as (select *, least(3, size - 1) as k from (select *, count(*) over (partition by feature, y) as size from every) where size > 1),
  c as (select a.feature, a.id, any_value(a.x) as x, any_value(a.size) as size, any_value(a.k) as k, list_extract(min(abs(b.x - a.x), 3), any_value(a.k)) as r
    from own a join own b on a.feature = b.feature and a.y = b.y and a.id <> b.id group by a.feature, a.id),
  m as (select c.feature, c.id, any_value(c.size) as size, any_value(c.k) as k, count(*) as m from c join own b on b.feature = c.feature and {INSIDE_SQL.format(x='x')}
    group by c.feature, c.id)
  select feature, round(greatest(0, (select psi from psi where n = any_value(total)) + avg(pk.psi) - avg(ps.psi) - avg(pm.psi)), 6) as mi
  from (select *, count(*) over (partition by feature) as total from m) m join psi pk on pk.n = k join psi ps on ps.n = size join psi pm on pm.n = m group by feature""")
def neighbour_mi(spark, sf_dir):
    """Third-nearest-neighbour information of two numbers about a class."""
    profile = TableProfile(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice"), "p_brand", "classification")
    return round_doubles(profile.mutual_information(neighbours=3), 6)


@query("neighbour_mi_numeric", f"""with {PSI_SQL}, s as (select format('{{:.9g}}', stddev_pop(p_size))::double as sx, format('{{:.9g}}', stddev_pop(p_retailprice))::double as sy from part),
  p as (select row_number() over () as id, p_size / sx as x, p_retailprice / sy as y from part, s),
  c as (select a.id, any_value(a.x) as x, any_value(a.y) as y, list_extract(min(greatest(abs(b.x - a.x), abs(b.y - a.y)), 3), 3) as r
    from p a join p b on a.id <> b.id group by a.id),
  mx as (select c.id, count(*) as m from c join p b on {INSIDE_SQL.format(x='x')} group by c.id),
  my as (select c.id, count(*) as m from c join p b on {INSIDE_SQL.format(x='y')} group by c.id)
  select 'p_size' as feature, round(greatest(0, (select psi from psi where n = (select count(*) from part)) + (select psi from psi where n = 3) - avg(px.psi) - avg(py.psi)), 6) as mi
  from mx join my using (id) join psi px on px.n = mx.m join psi py on py.n = my.m""")
def neighbour_mi_numeric(spark, sf_dir):
    """The same about a number, with distances in both values."""
    return round_doubles(neighbour_information(table(spark, sf_dir, "part"), ["p_size"], "p_retailprice", False), 6)


SKETCHED = ["l_quantity", "l_extendedprice", "l_tax"]


@query("sketched_profile", f"""with g as {GAPS_SQL} {union(f"""select '{c}' as "column", count(distinct l_orderkey % 4) as parts, count(*) as rows, count(*) - count({c}) as missing, round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, min({c}) as low, max({c}) as high, true as near from g""" for c in SKETCHED)}""")
def sketched_profile(spark, sf_dir):
    """Sketches of four parts of the lines, each added to the stored table by itself, merged to a profile.

    ``near``: the ranks of the median and quartiles, counted in the table, are within the error stated for the sketches.
    """
    df, path = gaps(spark, sf_dir), shared_folder(spark, "sketches")
    for part in range(4):
        sketches.append_sketches(df.where(F.col("l_orderkey") % 4 == part), F.lit(part), path, SKETCHED)
    found = sketches.profile_of(sketches.stored_sketches(spark, path))
    at = {r["column"]: r["quantiles"] for r in found.collect()}
    share = lambda c, p, q: F.avg((F.col(c) < q).cast("int")) - 2 * sketches.rank_error() <= p
    upto = lambda c, p, q: F.avg((F.col(c) <= q).cast("int")) + 2 * sketches.rank_error() >= p
    checks = [F.lit(True) if c not in at or not at[c] else share(c, p, q) & upto(c, p, q) for c in SKETCHED for p, q in zip((0.25, 0.5, 0.75), at[c])]
    flags = df.agg(*(x.alias(f"c{i}") for i, x in enumerate(checks))).first()
    near = spark.createDataFrame([(c, all(flags[3 * i:3 * i + 3])) for i, c in enumerate(SKETCHED)], "column string, near boolean")
    return round_doubles(found.join(near, "column").select("column", "parts", "rows", "missing", "mean", "std", "low", "high", "near"))


def _extreme_sql(tab: str, cols) -> str:
    return union(f"""select avg(case when {c} < q1 - 3 * (q3 - q1) or {c} > q3 + 3 * (q3 - q1) then 1.0 else 0.0 end) as f from {tab},
      (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 from {tab}) where {c} is not null"""
                 for c in cols)


@query("quality_score", f"""with g as {GAPS_SQL}, m as (select avg(f) as f from ({union(f"select 1 - count({c}) / count(*) as f from g" for c in GAPS_COLS)})),
  d as (select 1 - (select count(*) from (select distinct * from g)) / count(*) as f from g),
  e as (select avg(f) as f from ({_extreme_sql("g", GAPS_NUM)})),
  s as (select round(greatest(0, 100 - 200 * m.f), 1) as completeness, round(greatest(0, 100 - 500 * d.f), 1) as uniqueness,
    round(greatest(0, 100 - 1000 * e.f), 1) as consistency from m, d, e)
  select *, round((completeness + uniqueness + consistency) / 3, 1) as overall from s""")
def quality_score(spark, sf_dir):
    return TableProfile(gaps(spark, sf_dir), "l_returnflag").quality_score()


@query("quality_profile", f"""with g as {GAPS_SQL}, m as (select avg(f) as f from ({union(f"select 1 - count({c}) / count(*) as f from g" for c in GAPS_COLS)})),
  d as (select (select count(*) from (select distinct * from g)) / count(*) as f from g),
  s as (select round(100 - 100 * m.f, 1) as completeness_pct, round(100 * d.f, 1) as uniqueness_pct from m, d)
  select *, round(completeness_pct * 0.6 + uniqueness_pct * 0.4, 1) as quality_score from s""")
def quality_profile(spark, sf_dir):
    return TableProfile(gaps(spark, sf_dir), "l_returnflag").quality_profile()


@query("recommendations", f"""with g as {GAPS_SQL}, n as (select count(*) as n from g),
  m as ({union(f'''select '{c}' as c, 100.0 * (count(*) - count({c})) / count(*) as p from g''' for c in GAPS_COLS)})
  select case when p > 30 then 'high' else 'medium' end as severity,
    case when p > 30 then 'mostly_missing' else 'partly_missing' end as finding, c as subject, round(p, 4) as value from m where p > 5
  union all select 'medium', 'duplicate_rows', '*', cast(n.n - (select count(*) from (select distinct * from g)) as double) from n
    where n.n > (select count(*) from (select distinct * from g))
  union all select 'low', 'highly_skewed', c, round(s, 4) from ({union(f"select '{c}' as c, skewness({c}) as s from g" for c in GAPS_NUM)}) where abs(s) > 2
  union all select 'high', 'class_imbalance', 'l_returnflag', round(r, 4) from (select max(k) / min(k) as r from
    (select count(*) as k from g where l_returnflag is not null group by l_returnflag)) where r > 3""")
def recommendations(spark, sf_dir):
    return round_doubles(TableProfile(gaps(spark, sf_dir), "l_returnflag").recommendations())


@query("investigate", f"""select 'high_cardinality' as issue, 'p_name' as subject, cast(count(distinct p_name) as double) as value from part having count(distinct p_name) > 50
  union all select 'possible_leakage', c, round(abs(r), 4) from (select 'p_partkey' as c, corr(p_partkey, p_retailprice) as r from part
    union all select 'p_size', corr(p_size, p_retailprice) from part) where abs(r) > 0.98
  union all select 'highly_skewed', c, round(s, 4) from (select 'p_partkey' as c, skewness(p_partkey) as s from part
    union all select 'p_size', skewness(p_size) from part) where abs(s) > 2""")
def investigate(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "part"), "p_retailprice").investigate())


@query("compact_profile", """select fact, value, cast(text as varchar) as text from (
  select 'rows' as fact, cast(count(*) as double) as value, null as text from labels union all select 'cols', 3, null
  union all select 'num_feats', 2, null union all select 'cat_feats', 0, null union all select 'missing_pct', 0, null
  union all select 'dup_pct', round(100.0 * (count(*) - (select count(*) from (select distinct * from labels))) / count(*), 1), null from labels
  union all select 'task', null, 'classification'
  union all select 'classes', count(distinct toxic), null from labels
  union all select 'imbalance', round(min(n) / max(n), 4), null from (select count(*) as n from labels group by toxic)
  union all select 'min_class_n', min(n), null from (select count(*) as n from labels group by toxic)
  union all select 'high_skew:' || c, round(s, 4), null from (select 'doc_id' as c, skewness(doc_id) as s from labels union all
    select 'quality', skewness(quality) from labels) where abs(s) > 1.5)""")
def compact_profile(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "labels"), "toxic").compact_profile())


CUST = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
        ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


@query("schema_profile", union(f"""select '{c}' as "column", '{t}' as dtype, {str(c == 'c_mktsegment').lower()} as is_target,
  count(*) - count({c}) as missing, round(100.0 * (count(*) - count({c})) / count(*), 4) as missing_pct, count(distinct {c}) as "unique",
  round(100.0 * count(distinct {c}) / count(*), 4) as unique_pct,
  {"'numeric'" if num else f"case when count(distinct {c}) <= 50 then 'categorical' else 'high-cardinality' end"} as role,
  {f'round(avg({c}), 4)' if num else 'cast(null as double)'} as mean, {f'round(stddev_samp({c}), 4)' if num else 'null'} as std,
  {f'round(cast(min({c}) as double), 4)' if num else 'null'} as min, {f'round(cast(max({c}) as double), 4)' if num else 'null'} as max,
  {f'round(skewness({c}), 4)' if num else 'null'} as skew,
  {'cast(null as varchar)' if num else f'(select {c} from customer group by 1 order by count(*) desc, {c} limit 1)'} as top_value from customer"""
  for c, t, num in CUST))
def schema_profile(spark, sf_dir):
    return round_doubles(TableProfile(table(spark, sf_dir, "customer"), "c_mktsegment").business_profile())


@query("feature_schema", union(f"""select '{c}' as "column", '{'numeric' if num else 'categorical'}' as type,
  round(100.0 * (count(*) - count({c})) / count(*), 4) as missing_pct,
  {f'round(cast(min({c}) as double), 4)' if num else 'cast(null as double)'} as min, {f'round(cast(max({c}) as double), 4)' if num else 'null'} as max,
  {f'round(avg({c}), 4)' if num else 'null'} as mean, {f'round(median(cast({c} as double)), 4)' if num else 'null'} as median,
  {f'round(stddev_samp({c}), 4)' if num else 'null'} as std,
  {'cast(null as varchar)' if num else f"(select string_agg(v, '|' order by n desc, v) from (select {c} as v, count(*) as n from orders group by 1 order by n desc, v limit 50))"} as categories
  from orders""" for c, num in [("o_orderkey", True), ("o_custkey", True), ("o_totalprice", True), ("o_orderpriority", False)]))
def feature_schema(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    out = TableProfile(df, "o_orderstatus").feature_schema(["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    return round_doubles(out.withColumn("categories", F.array_join("categories", "|")))


@query("feature_interaction", """select 'l_quantity' as f1, 'l_extendedprice' as f2, round(corr(l_quantity, l_extendedprice), 4) as r from lineitem""")
def feature_interaction(spark, sf_dir):
    corr, _ = TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").feature_interaction("l_quantity", "l_extendedprice")
    return round_doubles(corr)


@query("interaction_scatter")
def interaction_scatter(spark, sf_dir):
    return TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").feature_interaction("l_quantity", "l_extendedprice")[1]


@query("bivariate_sample")
def bivariate_sample(spark, sf_dir):
    return TableProfile(table(spark, sf_dir, "lineitem"), "l_returnflag").bivariate_sample()


@query("advanced_eda", """select 'o_totalprice' as "column", round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std,
  min(o_totalprice) as min, max(o_totalprice) as max, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(median(o_totalprice), 4) as median,
  round(quantile_cont(o_totalprice, 0.75), 4) as q3, count(*) filter (o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as outliers,
  round(skewness(o_totalprice), 4) as skewness from orders, (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders)""")
def advanced_eda(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_orderdate")
    return round_doubles(TableProfile(df, "o_orderstatus").advanced()["stats"])


@query("target_histogram", _hist_sql("orders", ["o_totalprice"], 20))
def target_histogram(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey")
    return round_doubles(TableProfile(df, "o_totalprice").advanced()["target"])


@query("hash_sample", """select o_orderkey, o_totalprice from (select *, row_number() over (order by (o_orderkey * 2654435761) % 4294967296, o_orderkey) as rn
  from orders) where rn <= 200""")
def sampled(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return hash_sample(df, 200, key=F.expr("(o_orderkey * 2654435761) % 4294967296"))


@query("id_columns", """select 'c_custkey' as "column", 'dense_key' as reason from customer having count(*) > 5 and min(c_custkey) in (0, 1)
    and max(c_custkey) - min(c_custkey) + 1 = count(c_custkey) and count(distinct c_custkey) = count(c_custkey)
  union all select 'c_name', 'near_unique' from customer having count(c_name) > 10 and count(distinct c_name) / count(c_name) > 0.95
  union all select 'c_mktsegment', 'near_unique' from customer having count(distinct c_mktsegment) / count(c_mktsegment) > 0.95""")
def id_columns(spark, sf_dir):
    rows = roles.detect_id_columns(table(spark, sf_dir, "customer"), "c_nationkey")
    return report(spark, rows, "column string, reason string")


@query("column_roles", """select 'p_partkey' as "column", case when max(p_partkey) - min(p_partkey) + 1 = count(distinct p_partkey) and count(distinct p_partkey) = count(*)
    and min(p_partkey) in (0, 1) then 'id' else 'numeric' end as role from part
  union all select 'p_name', case when count(distinct p_name) / count(*) > 0.95 then 'id' when count(distinct p_name) <= 50 then 'low_card' else 'high_card' end from part
  union all select 'p_brand', case when count(distinct p_brand) <= 50 then 'low_card' else 'high_card' end from part
  union all select 'p_type', case when count(distinct p_type) <= 50 then 'low_card' else 'high_card' end from part
  union all select 'p_size', 'numeric' union all select 'p_retailprice', 'target'""")
def column_roles(spark, sf_dir):
    return roles.roles_table(table(spark, sf_dir, "part"), "p_retailprice")


@query("problem_type", """select 'o_orderstatus' as target, 'classification' as problem_type
  union all select 'o_totalprice', case when count(distinct o_totalprice) <= 20 then 'classification' else 'regression' end from orders
  union all select 'o_custkey', case when count(distinct o_custkey) <= 20 then 'classification' else 'regression' end from orders
  union all select 'o_orderdate', 'time_series'""")
def problem_type(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = [(t, roles.detect_problem_type(df, t)) for t in ["o_orderstatus", "o_totalprice", "o_custkey"]]
    rows.append(("o_orderdate", roles.detect_problem_type(df, "o_totalprice", "o_orderdate")))
    return report(spark, rows, "target string, problem_type string")


@query("all_unique_strings", """select 'c_name' as "column" from customer having count(distinct c_name) = count(*)
  union all select 'c_mktsegment' from customer having count(distinct c_mktsegment) = count(*)""")
def all_unique_strings(spark, sf_dir):
    return report(spark, [(c,) for c in roles.drop_all_unique_strings(table(spark, sf_dir, "customer"), "c_acctbal")], "column string")


@query("distinct_rows", "select distinct lang, source from documents")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("mode_and_median", """select median(l_quantity) as med_quantity, (select l_returnflag from lineitem group by 1 order by count(*) desc, 1 limit 1) as mode_flag,
  (select l_linestatus from lineitem group by 1 order by count(*) desc, 1 limit 1) as mode_status from lineitem""")
def mode_and_median(spark, sf_dir):
    from tabsmith.operators.impute import column_defaults
    d = column_defaults(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"])
    return report(spark, [(d["l_quantity"], d["l_returnflag"], d["l_linestatus"])],
                  "med_quantity double, mode_flag string, mode_status string")


@query("xy_split", f"""select count(*) as rows, count(l_quantity) as with_target, round(sum(l_extendedprice), 2) as price
  from {GAPS_SQL} where l_quantity is not null""")
def xy_split(spark, sf_dir):
    from tabsmith.sources.tables import drop_null_target
    return drop_null_target(gaps(spark, sf_dir), "l_quantity").agg(
        F.count("*").alias("rows"), F.count("l_quantity").alias("with_target"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("nan_to_null", """select count(*) as rows, count(v) as present, round(avg(v), 4) as mean from
  (select case when l_orderkey % 5 = 0 then null else l_quantity end as v from lineitem)""")
def nan_to_null(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.expr("case when l_orderkey % 5 = 0 then double('NaN') else l_quantity end").alias(" v "))
    return clean_table(raw).agg(F.count("*").alias("rows"), F.count("v").alias("present"), F.round(F.avg("v"), 4).alias("mean"))
