"""Drift between tables and over time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tabsmith.functions.session import shared_folder
from tabsmith.operators.drift import chi2_statistics, drift_report, drift_summary, ks_statistics, psi_statistics
from tabsmith.operators.stats import round_doubles
from tabsmith.plans.catalogue import query, table
from tabsmith.streaming.drift_monitor import monitor, reference_bins, windowed_drift

CUT = "timestamp '2024-01-15 00:00:00'"
YEAR = "timestamp '1999-01-01 00:00:00'"
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.where(f"ts < {CUT}"), df.where(f"ts >= {CUT}")


def _lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where(f"l_shipdate < {YEAR}"), df.where(f"l_shipdate >= {YEAR}")


def _union(parts):
    return " union all ".join(parts)


def _ks_sql(tab, ts, cut, cols):
    return _union(f"""select '{c}' as "column", cast(max(nr) as bigint) as n_ref, cast(max(nc) as bigint) as n_cur, round(max(abs(cr / nr - cc / nc)), 6) as ks from
      (select v, sum(sum(r)) over (order by v) as cr, sum(sum(c)) over (order by v) as cc, sum(sum(r)) over () as nr, sum(sum(c)) over () as nc
       from (select {c} as v, ({ts} < {cut})::int as r, ({ts} >= {cut})::int as c from {tab}) group by v)""" for c in cols)


@query("ks_drift", _ks_sql("events", "ts", CUT, ["value", "user_id"]))
def ks_drift(spark, sf_dir):
    ref, cur = _events(spark, sf_dir)
    return round_doubles(ks_statistics(ref, cur, ["value", "user_id"], ref.count() + cur.count()), 6)


@query("ks_drift_bucketed", _ks_sql("lineitem", "l_shipdate", YEAR, LINE))
def ks_drift_bucketed(spark, sf_dir):
    """The path for big tables: running sums inside ordered buckets."""
    ref, cur = _lines(spark, sf_dir)
    return round_doubles(ks_statistics(ref, cur, LINE, ref.count() + cur.count(), bucket_rows=5000), 6)


def _psi_sql(tab, ts, cut, cols):
    one = _union(f"""select '{c}' as "column", cast({c} as double) as v, ({ts} < {cut})::int as r, ({ts} >= {cut})::int as c from {tab}""" for c in cols)
    return f"""with l as ({one}), b as (select "column", min(v) as lo, max(v) as hi, sum(r) as nr, sum(c) as nc from l group by 1),
      k as (select "column", greatest(least(floor((v - lo) / ((hi - lo) / 10.0)), 9), 0) as bin, sum(r) as r, sum(c) as c, max(nr) as nr, max(nc) as nc
        from l join b using ("column") group by 1, 2),
      p as (select "column", case when r = 0 then 1e-4::double else r / nr end as p, case when c = 0 then 1e-4::double else c / nc end as q from k)
      select "column", round(sum((q - p) * ln(q / p)), 6) as psi from p group by 1"""


@query("psi_drift", _psi_sql("lineitem", "l_shipdate", YEAR, LINE))
def psi_drift(spark, sf_dir):
    ref, cur = _lines(spark, sf_dir)
    return round_doubles(psi_statistics(ref, cur, LINE), 6)


def _chi2_sql(tab, ts, cut, cols):
    one = _union(f"""select '{c}' as "column", {c} as v, ({ts} < {cut})::int as r, ({ts} >= {cut})::int as c from {tab}""" for c in cols)
    return f"""with k as (select "column", v, sum(r) as r, sum(c) as c from ({one}) where v is not null group by 1, 2),
      t as (select "column", sum(r) as nr, sum(c) as nc from k group by 1)
      select "column", cast(max(nr) as bigint) as n_ref, cast(max(nc) as bigint) as n_cur, count(*) as categories,
      case when count(*) filter (r = 0) = 0 then round(sum(pow(c - r * nc / nr, 2) / (r * nc / nr)), 6) end as chi2 from k join t using ("column") group by 1"""


@query("chi2_drift", _chi2_sql("lineitem", "l_shipdate", YEAR, ["l_returnflag", "l_linestatus"]))
def chi2_drift(spark, sf_dir):
    ref, cur = _lines(spark, sf_dir)
    return round_doubles(chi2_statistics(ref, cur, ["l_returnflag", "l_linestatus"]), 6)


@query("chi2_new_category", _chi2_sql("events", "ts", CUT, ["props", "event_type"]))
def chi2_new_category(spark, sf_dir):
    ref, cur = _events(spark, sf_dir)
    return round_doubles(chi2_statistics(ref, cur, ["props", "event_type"]), 6)


@query("drift_report", f"""with k as ({_ks_sql("events", "ts", CUT, ["value", "user_id"])}), p as ({_psi_sql("events", "ts", CUT, ["value", "user_id"])}),
  c as ({_chi2_sql("events", "ts", CUT, ["event_type"])})
  select "column", 'numeric' as type, n_ref, n_cur, ks, psi, null as chi2, ks > 0.1 or psi > 0.2 as drifted from k join p using ("column")
  union all select "column", 'categorical', n_ref, n_cur, null, null, chi2, chi2 > 9.487729036781154 from c""")
def report(spark, sf_dir):
    ref, cur = _events(spark, sf_dir)
    cols = ["user_id", "event_type", "value"]
    out = drift_report(ref.select(*cols), cur.select(*cols), check_ts=dt.datetime(2024, 2, 1))
    return round_doubles(out.select("column", "type", "n_ref", "n_cur", "ks", "psi", "chi2", "drifted"), 6)


@query("drift_summary", f"""with k as ({_ks_sql("lineitem", "l_shipdate", YEAR, LINE)}), p as ({_psi_sql("lineitem", "l_shipdate", YEAR, LINE)}),
  d as (select ks > 0.1 or psi > 0.2 as drifted from k join p using ("column"))
  select count(*) filter (drifted) as drifted_columns, round(count(*) filter (drifted) / 4.0::double, 4) as drift_rate, count(*) filter (drifted) > 0 as overall_drift from d""")
def summary(spark, sf_dir):
    ref, cur = _lines(spark, sf_dir)
    return drift_summary(drift_report(ref.select(*LINE), cur.select(*LINE)), len(LINE))


def _window_sql(extra=""):
    return f"""with r as (select cast(value as double) as value, event_type from events where ts < {CUT}), b as (select min(value) as lo, max(value) as hi, count(*) as n from r),
    rb as (select bin, coalesce(r, 0) as r, n from (select unnest(range(10)) as bin) left join
      (select greatest(least(floor((value - lo) / ((hi - lo) / 10.0)), 9), 0) as bin, count(*) as r from r, b group by 1) using (bin), b),
    cur as (select time_bucket(interval '6 hours', ts) as window_start, value, event_type from events where ts >= {CUT} {extra}),
    cb as (select window_start, greatest(least(floor((value - lo) / ((hi - lo) / 10.0)), 9), 0) as bin, count(*) as c from cur, b group by 1, 2),
    w as (select window_start, sum(c) as nc from cb group by 1),
    g as (select window_start, bin, r, n, nc, coalesce(c, 0) as c from (select * from w, rb) left join cb using (window_start, bin)),
    s as (select *, abs(sum(r / n) over (partition by window_start order by bin) - sum(c / nc) over (partition by window_start order by bin)) as gap,
      case when r = 0 then 1e-4::double else r / n end as p, case when c = 0 then 1e-4::double else c / nc end as q from g),
    num as (select window_start, 'value' as "column", cast(max(nc) as bigint) as n_cur, round(max(gap), 6) as ks, round(sum(case when r = 0 and c = 0 then 0 else (q - p) * ln(q / p) end), 6) as psi,
      null::double as chi2 from s group by 1),
    rc as (select event_type, count(*) as r, sum(count(*)) over () as n from r group by 1),
    cc as (select window_start, event_type, count(*) as c from cur group by 1, 2), wc as (select window_start, sum(c) as nc from cc group by 1),
    cat as (select window_start, 'event_type', cast(max(nc) as bigint), null, null, round(sum(pow(coalesce(c, 0) - r * nc / n, 2) / (r * nc / n)), 6)
      from (select * from wc, rc) left join cc using (window_start, event_type) group by 1)
    select cast(window_start as varchar) as window_start, "column", n_cur, ks, psi, chi2 from (select * from num union all select * from cat)"""


def _windows(df):
    out = df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "column", "n_cur", "ks", "psi", "chi2")
    return round_doubles(out, 6)


@query("windowed_drift", _window_sql())
def windows(spark, sf_dir):
    ref, cur = _events(spark, sf_dir)
    return _windows(windowed_drift(cur, reference_bins(ref, ["value", "event_type"]), "ts", "6 hours"))


# The stream closes a window when the watermark (latest event - 10 minutes) has passed it.
CLOSED = "and time_bucket(interval '6 hours', ts) + interval '6 hours' <= (select max(ts) - interval '10 minutes' from events)"


@query("stream_drift", _window_sql(CLOSED))
def stream_drift(spark, sf_dir):
    ref, _ = _events(spark, sf_dir)
    bins = reference_bins(ref, ["value", "event_type"])
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).where(f"ts >= {CUT}")
    work = shared_folder(spark, "stream")
    run = monitor(stream, bins, "ts", f"{work}/out", f"{work}/checkpoint", "6 hours").trigger(availableNow=True).start()
    run.awaitTermination()
    return _windows(spark.read.parquet(f"{work}/out").drop("batch"))
