"""Feature engineering, imputers, scalers, encoders, splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabsmith.operators import encode, features, impute, ordered_boosting, scale, split
from tabsmith.operators.isolation import mark_outliers
from tabsmith.operators.select import best_by_information, low_variance, reduce_dimensions
from tabsmith.operators.stats import report, round_doubles
from tabsmith.plans.catalogue import query, table
from tabsmith.plans.catalogue.profiling import GAPS_SQL, _mi_sql, gaps

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_SQL = "(select l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax from lineitem)"


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *MEASURES)


# Transformed columns are compared through sums over groups of rows and through extremes,
# which touch every value; a wrong value shows in its group.  The factor keeps sums of
# two-decimal prices away from rounding ties.
TILT = 0.7310585786


def _digest(df, cols, key="l_orderkey", groups=97):
    aggs = []
    for c in cols:
        aggs += [F.round(F.sum(c) * TILT, 3).alias(f"{c}_sum"), F.round(F.min(c), 4).alias(f"{c}_min"),
                 F.round(F.max(c), 4).alias(f"{c}_max")]
    return df.groupBy(F.expr(f"pmod({key}, {groups})").alias("grp")).agg(F.count("*").alias("n"), *aggs)


def _digest_sql(inner, exprs, key="l_orderkey", groups=97):
    parts = ", ".join(f"round(sum({e}) * {TILT}, 3) as {c}_sum, round(min({e}), 4) as {c}_min, round(max({e}), 4) as {c}_max"
                      for c, e in exprs.items())
    return f"select {key} % {groups} as grp, count(*) as n, {parts} from {inner} group by 1"


@query("date_parts", """select o_orderkey, cast(year(o_orderdate) as int) as o_orderdate_year, cast(month(o_orderdate) as int) as o_orderdate_month,
  cast(day(o_orderdate) as int) as o_orderdate_day, cast(isodow(o_orderdate) - 1 as int) as o_orderdate_weekday,
  cast(hour(o_orderdate) as int) as o_orderdate_hour, cast(isodow(o_orderdate) - 1 >= 5 as int) as o_orderdate_is_wknd from orders""")
def date_parts(spark, sf_dir):
    return features.date_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query("date_parts_text", """select o_orderkey, cast(year(o_orderdate) as int) as d_year, cast(month(o_orderdate) as int) as d_month,
  cast(day(o_orderdate) as int) as d_day, cast(isodow(o_orderdate) - 1 as int) as d_weekday, 0 as d_hour,
  cast(isodow(o_orderdate) - 1 >= 5 as int) as d_is_wknd from orders""")
def date_parts_text(spark, sf_dir):
    """Dates kept as text, half of them ISO and half month/day/year."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(
        "case when o_orderkey % 2 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') else date_format(o_orderdate, 'MM/dd/yyyy') end").alias("d"))
    return features.date_parts(df, ["d"])


def _engineered_digest(spark, sf_dir, strategy):
    base = _line(spark, sf_dir)
    df, names = features.engineer_features(base, "l_orderkey", strategy)
    return _digest(df, names)


PAIRS = list(combinations(MEASURES, 2))


@query("interactions", _digest_sql(LINE_SQL, {f"{a}_x_{b}": f"{a} * {b}" for a, b in PAIRS}))
def interactions(spark, sf_dir):
    return _engineered_digest(spark, sf_dir, "interactions")


@query("ratios", f"""select grp, count(*) as n, {', '.join(f'round(sum(ln(1 + {a}_div_{b})), 3) as {a}_div_{b}' for a, b in PAIRS)}
  from (select l_orderkey % 97 as grp, {', '.join(f'{a} / (nullif({b}, 0) + 1e-8) as {a}_div_{b}' for a, b in PAIRS)} from lineitem) group by 1""")
def ratios(spark, sf_dir):
    df, names = features.engineer_features(_line(spark, sf_dir), "l_orderkey", "ratios")
    return df.groupBy(F.expr("l_orderkey % 97").alias("grp")).agg(
        F.count("*").alias("n"), *[F.round(F.sum(F.log1p(c)), 3).alias(c) for c in names])


@query("polynomial", f"""select l_orderkey % 97 as grp, count(*) as n, {', '.join(f'round(sqrt(sum({c} * {c})), 3) as {c}_sq' for c in MEASURES)}
  from lineitem group by 1""")
def polynomial(spark, sf_dir):
    df, names = features.engineer_features(_line(spark, sf_dir), "l_orderkey", "polynomial")
    return df.groupBy(F.expr("l_orderkey % 97").alias("grp")).agg(
        F.count("*").alias("n"), *[F.round(F.sqrt(F.sum(c)), 3).alias(c) for c in names])


_ROW = "[l_linenumber, l_quantity, l_extendedprice, l_tax]"


@query("row_aggregates", f"""select grp, count(*) as n, round(sum(m), 3) as mean, round(sum(s), 3) as std, round(sum(hi), 3) as max, round(sum(lo), 3) as min
  from (select l_orderkey % 97 as grp, list_avg(x) as m, list_stddev_samp(x) as s, list_max(x) as hi, list_min(x) as lo
    from (select l_orderkey, list_filter({_ROW}::double[], lambda v: v is not null) as x from {GAPS_SQL})) group by 1""")
def row_aggregates(spark, sf_dir):
    df, _ = features.engineer_features(gaps(spark, sf_dir), "l_orderkey", "aggregates")
    return df.groupBy(F.expr("l_orderkey % 97").alias("grp")).agg(
        F.count("*").alias("n"), *[F.round(F.sum(f"_feat_{s}"), 3).alias(s) for s in ("mean", "std", "max", "min")])


@query("log_transform", _digest_sql(LINE_SQL, {f"{c}_log": f"ln(1 + {c})" for c in ["l_quantity", "l_extendedprice"]}))
def log_transform(spark, sf_dir):
    """Only strictly positive columns qualify; discount and tax have zeros."""
    return _engineered_digest(spark, sf_dir, "log_transform")


def _fill_sql(exprs):
    return _digest_sql(GAPS_SQL, exprs)


def _fitted(df, estimator, cols):
    return _digest(estimator.fit(df).transform(df), cols)


GAP_NUM = ["l_quantity", "l_tax"]


@query("impute_mean", _fill_sql({c: f"coalesce({c}, (select avg({c}) from {GAPS_SQL}))" for c in GAP_NUM}))
def impute_mean(spark, sf_dir):
    return _fitted(gaps(spark, sf_dir), impute.imputer("mean", GAP_NUM), GAP_NUM)


@query("impute_median", _fill_sql({c: f"coalesce({c}, (select median({c}) from {GAPS_SQL}))" for c in GAP_NUM}))
def impute_median(spark, sf_dir):
    return _fitted(gaps(spark, sf_dir), impute.imputer("median", GAP_NUM), GAP_NUM)


@query("impute_zero", _fill_sql({c: f"coalesce({c}, 0)" for c in GAP_NUM}))
def impute_zero(spark, sf_dir):
    return _fitted(gaps(spark, sf_dir), impute.imputer("zero", GAP_NUM), GAP_NUM)


@query("impute_mode", f"""select coalesce(l_returnflag, (select l_returnflag from {GAPS_SQL} where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1))
  as l_returnflag, count(*) as n from {GAPS_SQL} group by 1""")
def impute_mode(spark, sf_dir):
    df = gaps(spark, sf_dir)
    return impute.Fill.of(["l_returnflag"], strategy="mode").fit(df).transform(df).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("impute_knn", """with g as (select s_suppkey, s_nationkey + s_suppkey * s_suppkey * s_suppkey / 99991.0::double as a, case when s_suppkey % 4 = 0 then null else s_acctbal / 1000 end as b,
    case when s_suppkey % 5 = 0 then null else s_suppkey * s_suppkey * s_suppkey / 9973.0 end as c from supplier),
  f as (select q.s_suppkey, d.b, row_number() over (partition by q.s_suppkey order by
      sqrt(3.0 / (1 + (q.c is not null and d.c is not null)::int) * (pow(q.a - d.a, 2) + coalesce(pow(q.c - d.c, 2), 0)))) as r
    from g q, g d where q.b is null and d.b is not null),
  h as (select q.s_suppkey, d.c, row_number() over (partition by q.s_suppkey order by
      sqrt(3.0 / (1 + (q.b is not null and d.b is not null)::int) * (pow(q.a - d.a, 2) + coalesce(pow(q.b - d.b, 2), 0)))) as r
    from g q, g d where q.c is null and d.c is not null),
  fb as (select s_suppkey, avg(b) as v from f where r <= 5 group by 1), fc as (select s_suppkey, avg(c) as v from h where r <= 5 group by 1)
  select g.s_suppkey, round(coalesce(g.b, fb.v), 6) as b, round(coalesce(g.c, fc.v), 6) as c from g left join fb using (s_suppkey) left join fc using (s_suppkey)""")
def impute_knn(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.expr("s_nationkey + s_suppkey * s_suppkey * s_suppkey / 99991.0D").alias("a"),
        F.expr("case when s_suppkey % 4 = 0 then null else s_acctbal / 1000 end").alias("b"),
        F.expr("case when s_suppkey % 5 = 0 then null else s_suppkey * s_suppkey * s_suppkey / 9973.0D end").alias("c"))
    out = impute.KnnFill.of(["a", "b", "c"], k=5).fit(df).transform(df)
    return round_doubles(out.select("s_suppkey", "b", "c"), 6)


@query("impute_iterative")
def impute_iterative(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    df = gaps(spark, sf_dir)
    return _fitted(df, impute.ChainedFill.of(cols, rounds=3), cols)


@query("clip", f"""select grp, count(*) as n, round(sum(v) * {TILT}, 3) as value_sum, round(min(v), 4) as value_min, round(max(v), 4) as value_max from
  (select event_id % 97 as grp, greatest(least(value, hi), lo) as v from events,
   (select q1 - 1.0 * (q3 - q1) as lo, q3 + 1.0 * (q3 - q1) as hi from (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)))
  group by 1""")
def clip(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return _digest(scale.OutlierClip.of(["value"], factor=1.0).fit(df).transform(df), ["value"], key="event_id")


@query("skew_correct", f"""select grp, count(*) as n, round(sum(v) * {TILT}, 3) as n_chars_sum, round(min(v), 4) as n_chars_min, round(max(v), 4) as n_chars_max from
  (select doc_id % 97 as grp, case when abs(sk) > 0.8 then ln(1 + n_chars) else n_chars end as v from documents,
    (select skewness(n_chars) as sk from documents)) group by 1""")
def skew_correct(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _digest(scale.SkewCorrect.of(["n_chars"]).fit(df).transform(df), ["n_chars"], key="doc_id")


def _scale_sql(shift, width):
    return _digest_sql(f"(select * from {LINE_SQL}, (select {', '.join(f'{shift.format(c=c)} as a_{c}, {width.format(c=c)} as b_{c}' for c in MEASURES)} from lineitem))",
                       {c: f"({c} - a_{c}) / b_{c}" for c in MEASURES})


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.scaler("standard", MEASURES), MEASURES)


@query("scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.scaler("minmax", MEASURES), MEASURES)


@query("scale_robust", _scale_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.scaler("robust", MEASURES), MEASURES)


@query("scale_normalize", _digest_sql(f"(select *, sqrt({' + '.join(f'{c} * {c}' for c in MEASURES)}) as norm from {LINE_SQL})",
                                      {c: f"{c} / norm" for c in MEASURES}))
def scale_normalize(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.scaler("normalize", MEASURES), MEASURES)


@query("scale_power")
def scale_power(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.scaler("power", MEASURES), MEASURES)


@query("scale_quantile")
def scale_quantile(spark, sf_dir):
    return _fitted(_line(spark, sf_dir), scale.QuantileScale.of(MEASURES, levels=1000), MEASURES)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("onehot", """select o_orderkey, cast(o_orderstatus = 'F' as double) as "o_orderstatus=F", cast(o_orderstatus = 'O' as double) as "o_orderstatus=O",
  cast(o_orderstatus = 'P' as double) as "o_orderstatus=P" from orders""")
def onehot(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return encode.OneHotEncode.of(["o_orderstatus"]).fit(df).transform(df)


@query("ordinal", """select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as double) as o_orderpriority,
  cast(dense_rank() over (order by o_orderstatus) - 1 as double) as o_orderstatus from orders""")
def ordinal(spark, sf_dir):
    df = _orders(spark, sf_dir).drop("o_totalprice")
    return encode.OrdinalEncode.of(["o_orderpriority", "o_orderstatus"]).fit(df).transform(df)


@query("freq", """select o_orderkey, round(count(*) over (partition by o_orderpriority) / count(*) over (), 6) as o_orderpriority from orders""")
def freq(spark, sf_dir):
    df = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return round_doubles(encode.FrequencyEncode.of(["o_orderpriority"]).fit(df).transform(df), 6)


@query("freq_high_card", """select p_partkey, round(count(*) over (partition by p_name) / count(*) over (), 6) as p_name from part""")
def freq_high_card(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return round_doubles(encode.FrequencyEncode.of(["p_name"]).fit(df).transform(df), 6)


@query("freq_names", """select c_custkey, round(count(*) over (partition by c_name) / count(*) over (), 6) as c_name from customer""")
def freq_names(spark, sf_dir):
    """A name column: nearly every row has a category of its own."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return round_doubles(encode.FrequencyEncode.of(["c_name"]).fit(df).transform(df), 6)


@query("binary", """select o_orderkey, cast(c & 1 as double) as o_orderpriority_bit0, cast((c >> 1) & 1 as double) as o_orderpriority_bit1,
  cast((c >> 2) & 1 as double) as o_orderpriority_bit2 from (select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as bigint) as c from orders)""")
def binary(spark, sf_dir):
    df = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return encode.BinaryEncode.of(["o_orderpriority"]).fit(df).transform(df)


@query("target_enc", """with g as (select avg(p_retailprice) as m, var_pop(p_retailprice) as v from part),
  s as (select p_name, count(*) as n, avg(p_retailprice) as m, var_pop(p_retailprice) as v from part group by 1)
  select p_partkey, round(case when g.v * s.n + s.v > 0 then (g.v * s.n * s.m + s.v * g.m) / (g.v * s.n + s.v) else g.m end, 4) as p_name, p_retailprice
  from part join s using (p_name), g""")
def target_enc(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return round_doubles(encode.TargetEncode.of(["p_name"], target="p_retailprice").fit(df).transform(df))


@query("target_enc_classes", """with o as (select o_orderkey, o_orderpriority, dense_rank() over (order by o_orderstatus) - 1 as y from orders),
  g as (select k, avg((y = k)::int) as m from o, (select unnest([0, 1, 2]) as k) group by 1),
  s as (select o_orderpriority, k, (sum((y = k)::int) + 10 * max(g.m)) / (count(*) + 10) as e from o, g group by 1, 2)
  select o_orderkey, cast(y as double) as label, round(max(case when k = 0 then e end), 6) as o_orderpriority_c0, round(max(case when k = 1 then e end), 6) as o_orderpriority_c1,
    round(max(case when k = 2 then e end), 6) as o_orderpriority_c2 from o join s using (o_orderpriority) group by 1, 2""")
def target_enc_classes(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    df = encode.LabelEncode.of(["o_orderstatus"]).fit(df).transform(df).drop("o_orderstatus")
    out = encode.TargetEncode.of(["o_orderpriority"], target="label", classes=3, smooth=10.0).fit(df).transform(df)
    return round_doubles(out, 6)


@query("target_enc_out_of_fold", """with f as (select p_partkey, p_brand, p_retailprice as y, p_partkey % 4 as fold from part)
  select p_partkey, round((a.s - b.s + 20.0 * (t.s - c.s) / (t.n - c.n)) / (a.n - b.n + 20.0), 4) as p_brand_te from f
  join (select p_brand, sum(y) as s, count(*) as n from f group by 1) a using (p_brand)
  join (select p_brand, fold, sum(y) as s, count(*) as n from f group by 1, 2) b using (p_brand, fold)
  join (select fold, sum(y) as s, count(*) as n from f group by 1) c using (fold), (select sum(y) as s, count(*) as n from f) t""")
def target_enc_out_of_fold(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.expr("p_partkey % 4").alias("fold"))
    out = encode.out_of_fold_target_encode(df, "p_brand", "p_retailprice", "fold", smooth=20.0)
    return round_doubles(out.select("p_partkey", "p_brand_te"))


ORDER_HASH = "(({k} + 7) * 2654435761) % 4294967296"


@query("ordered_statistics", f"""with o as (select *, {ORDER_HASH.format(k='o_orderkey')} as h, (o_orderstatus = 'F')::int as f from orders)
  select o_orderkey, {', '.join(f"round((coalesce(sum({t}) over {w}, 0) + 2.0 * (select avg({t}) from o)) / (count(*) over {w} + 2.0), 6) as {n}_{c}"
    for c, w in (("status", "s"), ("priority", "p")) for t, n in (("o_totalprice", "price"), ("f", "done")))} from o
  window s as (partition by o_orderstatus order by h, o_orderkey rows between unbounded preceding and 1 preceding),
    p as (partition by o_orderpriority order by h, o_orderkey rows between unbounded preceding and 1 preceding)""")
def ordered_target_statistics(spark, sf_dir):
    """Two targets by two columns of categories, in some twenty buckets of the order."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    out = ordered_boosting.ordered_statistics(
        df, ["o_orderstatus", "o_orderpriority"], {"price": F.col("o_totalprice"), "done": (F.col("o_orderstatus") == "F").cast("int")},
        F.expr(ORDER_HASH.format(k="o_orderkey")), 1 << 32, prior=2.0, bucket_rows=max(1, df.count() // 20))
    names = {f"o_order{c}~{t}": f"{t}_{c}" for c in ("status", "priority") for t in ("price", "done")}
    return round_doubles(out.select("o_orderkey", *(F.col(f"`{a}`").alias(b) for a, b in names.items())), 6)


@query("label_encode", """select o_orderkey, cast(dense_rank() over (order by o_orderstatus) - 1 as double) as label, o_orderstatus as decoded from orders""")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    model = encode.LabelEncode.of(["o_orderstatus"]).fit(df)
    return model.transform(df).select("o_orderkey", "label", model.decode(F.col("label")).alias("decoded"))


@query("low_variance", """select c as "column" from (select 'l_tax' as c, var_pop(l_tax) as v from lineitem union all select 'l_discount', var_pop(l_discount) from lineitem
  union all select 'l_quantity', var_pop(l_quantity) from lineitem) where v <= 0.0008""")
def low_variance_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return report(spark, [(c,) for c in low_variance(df, ["l_quantity", "l_discount", "l_tax"], 0.0008)], "column string")


_PRICE_EDGES = ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(1, 10))
PRICE_BINS = f"(select lineitem.*, len(list_filter(edges, lambda e: e < l_extendedprice)) as price_bin from lineitem, (select list_distinct([{_PRICE_EDGES}]) as edges from lineitem))"
CHOSEN = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]


@query("select_k_best", f"""select feature as "column" from ({_mi_sql(PRICE_BINS, CHOSEN, 'price_bin').replace(', 4) as mi', ', 12) as mi')}) order by mi desc limit 3""")
def select_k_best(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return report(spark, [(c,) for c in best_by_information(df, CHOSEN, "l_extendedprice", 3, False)], "column string")


@query("pca_reduce")
def pca_reduce(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    df = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    width = len(df.first()["features"])
    model = reduce_dimensions(df, width)
    return model.transform(df).select("vec_id", F.size(vector_to_array("features_pca")).alias("components"))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return mark_outliers(df, ["user_id", "value"], 0.05).groupBy("is_outlier").agg(F.count("*").alias("n"))


HASH = "(({k} + 7) * 2654435761) % 4294967296"


@query("strat_split", f"""with h as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {HASH.format(k='o_orderkey')}) as r,
    count(*) over (partition by o_orderstatus) as n from orders)
  select o_orderkey, o_orderstatus, r <= ceil(n * 0.2) as is_val from h""")
def strat_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.assign_split(df, F.expr(HASH.format(k="o_orderkey")), "o_orderstatus", 0.2)


@query("plain_split", f"""with h as (select o_orderkey, row_number() over (order by {HASH.format(k='o_orderkey')}) as r, count(*) over () as n from orders)
  select o_orderkey, r <= ceil(n * 0.25) as is_val from h""")
def plain_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.assign_split(df, F.expr(HASH.format(k="o_orderkey")), None, 0.25)


@query("kfold", f"""with h as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {HASH.format(k='o_orderkey')}) - 1 as r,
    count(*) over (partition by o_orderstatus) as n from orders)
  select o_orderkey, o_orderstatus, cast(case when r < (n % 5) * (n // 5 + 1) then r // (n // 5 + 1) else (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) as fold from h""")
def kfold(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.assign_folds(df, F.expr(HASH.format(k="o_orderkey")), 5, "o_orderstatus")


@query("train_val_union", "select count(*) as n, count(distinct o_orderkey) as keys, round(sum(o_totalprice), 2) as price from orders")
def train_val_union(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    train, val = split.train_val_split(df, ["o_orderkey"], "o_orderstatus")
    return train.unionByName(val).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"),
                                      F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("fill_missing_columns", """select count(*) as n, round(sum(d), 2) as quantity, min(m) as flag from orders,
  (select median(l_quantity) as d from lineitem), (select l_returnflag as m from lineitem group by 1 order by count(*) desc, 1 limit 1)""")
def fill_missing_columns(spark, sf_dir):
    defaults = impute.column_defaults(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag"])
    return impute.fill_missing_columns(table(spark, sf_dir, "orders"), defaults).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_returnflag").alias("flag"))
