"""Exploratory report: one small DataFrame per section.

``TableProfile`` computes the shared facts (row and null counts, moments, quartiles,
distinct rows) at most once; a section is then a few rows or one more aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import (
    boolean_columns, date_columns, equal_width_bin, fingerprint, numeric_columns, ref, row_key,
    string_columns, unpivot_numeric, unpivot_strings,
)
from tabsmith.operators.correlation import (
    multicollinear, pearson_pairs, spearman_pairs, target_correlations, top_correlations,
)
from tabsmith.operators.information import mutual_information, neighbour_information
from tabsmith.operators.normality import shapiro_francia, shapiro_table
from tabsmith.operators.roles import MAX_CLASSES, distinct_counts, screened_distinct_counts
from tabsmith.operators.stats import (
    ColumnSummary, clean_values, conditional_counts, null_counts, report, summarize,
)

TARGET_LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` of non-null values of the columns as strings."""
    long = unpivot_strings(df, cols).where("value is not null")
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties by value.

    Spark keeps only k rows per column and task before the shuffle of the window.
    """
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return value_counts(df, cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20, min_rows: int = 5) -> DataFrame:
    """Equal-width histogram ``(column, bin, lower, upper, count)`` with empty bins."""
    long = unpivot_numeric(df, cols)
    bounds = (
        long.groupBy("column")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
        .where(F.col("n") >= min_rows)
    )
    # ``bounds`` has one row per column of the schema, so broadcasting it is bounded.
    counts = (
        long.join(F.broadcast(bounds), "column")
        .withColumn("bin", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
        .groupBy("column", "bin").agg(F.count("*").alias("count"))
    )
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    frame = bounds.select(
        "column", lo.alias("lo"), ((hi - lo) / bins).alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    return frame.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Repeatable uniform sample of n rows without replacement (a heap per task)."""
    order = key if key is not None else row_key(df.columns, seed)
    return df.withColumn("_o", order).orderBy("_o").limit(n).drop("_o")


class TableProfile:
    """Report sections of one table with a target column."""

    def __init__(self, df: DataFrame, target: str, problem_type: str | None = None):
        self.df, self.target, self.problem_type = df, target, problem_type
        self.spark = df.sparkSession
        self.numeric = numeric_columns(df)
        self.strings = string_columns(df)

    # shared facts -------------------------------------------------------------
    @cached_property
    def _nulls(self) -> tuple[int, dict[str, int]]:
        return null_counts(self.df)

    @property
    def rows(self) -> int:
        return self._nulls[0]

    @property
    def missing_counts(self) -> dict[str, int]:
        return self._nulls[1]

    @cached_property
    def stats(self) -> dict[str, ColumnSummary]:
        return summarize(self.df, self.numeric)

    @cached_property
    def distinct_rows(self) -> int:
        """Distinct rows by 128-bit fingerprint: 16 bytes per row cross the network."""
        return self.df.select(*fingerprint(self.df.columns)).distinct().count()

    @cached_property
    def string_cardinality(self) -> dict[str, int]:
        return distinct_counts(self.df, self.strings)

    @cached_property
    def target_is_discrete(self) -> bool:
        if self.target in self.strings or self.target in boolean_columns(self.df):
            return True
        return screened_distinct_counts(self.df, {}, [self.target], near=MAX_CLASSES)[self.target] <= MAX_CLASSES

    @cached_property
    def class_counts(self) -> list[tuple[str, int]]:
        """Class sizes, largest first; only asked for discrete targets."""
        t = ref(self.target)
        rows = self.df.where(t.isNotNull()).groupBy(t.cast("string").alias("c")).count().collect()
        return sorted(((r["c"], r["count"]) for r in rows), key=lambda r: (-r[1], r[0]))

    @cached_property
    def correlations(self) -> DataFrame:
        pairs = list(combinations(self.numeric, 2))
        return pearson_pairs(self.df, self.numeric, pairs, self.missing_counts)

    # shape and types ----------------------------------------------------------
    def shape(self) -> DataFrame:
        return report(self.spark, [(self.rows, len(self.df.columns))], "rows long, cols int")

    def dtypes(self) -> DataFrame:
        return report(self.spark, self.df.dtypes, "column string, dtype string")

    def feature_types(self) -> DataFrame:
        groups = {"numeric": self.numeric, "categorical": self.strings,
                  "datetime": date_columns(self.df), "boolean": boolean_columns(self.df)}
        return report(self.spark, [(k, c) for k, cs in groups.items() for c in cs], "type string, column string")

    def memory_estimate(self) -> DataFrame:
        """Data size in MB: UTF-8 bytes of strings, 8 bytes for any other value."""
        size = F.lit(0)
        for f in self.df.schema:
            c = ref(f.name)
            size = size + (F.coalesce(F.octet_length(c), F.lit(0)) if isinstance(f.dataType, T.StringType) else F.lit(8))
        return self.df.agg((F.sum(size.cast("long")) / 1e6).alias("memory_mb"))

    def duplicate_rows(self) -> DataFrame:
        n = self.rows
        dup = n - self.distinct_rows
        return report(self.spark, [(n, self.distinct_rows, dup, 100.0 * dup / n if n else 0.0)],
                      "rows long, distinct_rows long, duplicate_rows long, duplicate_pct double")

    # missing values -----------------------------------------------------------
    def missing(self) -> DataFrame:
        """``(column, missing, pct, severity)`` of columns with gaps."""
        rows = []
        for c in self.df.columns:
            m = self.missing_counts[c]
            if m:
                pct = 100.0 * m / self.rows
                rows.append((c, m, pct, "high" if pct > 30 else "medium" if pct > 5 else "low"))
        return report(self.spark, rows, "column string, missing long, pct double, severity string")

    def missing_total(self) -> DataFrame:
        total = sum(self.missing_counts.values())
        cells = self.rows * len(self.df.columns)
        return report(self.spark, [(total, 100.0 * total / cells if cells else 0.0)],
                      "total_missing long, total_missing_pct double")

    # target -------------------------------------------------------------------
    def target_classes(self) -> DataFrame:
        """Class sizes with share and the largest-to-smallest ratio."""
        t = ref(self.target)
        counts = (
            self.df.where(t.isNotNull()).groupBy(t.cast("string").alias("class")).agg(F.count("*").alias("count"))
        )
        totals = counts.agg(F.sum("count").alias("n"), (F.max("count") / F.min("count")).alias("imbalance_ratio"))
        joined = counts.join(F.broadcast(totals))  # a single row
        return joined.select(
            "class", "count", (100.0 * F.col("count") / F.col("n")).alias("pct"), "imbalance_ratio",
            (F.col("imbalance_ratio") > 3).alias("is_imbalanced"),
        )

    def target_numeric(self) -> DataFrame:
        s = summarize(self.df, [self.target], TARGET_LEVELS)[self.target]
        q = s.quantiles
        row = (self.target, s.n, self.missing_counts[self.target], s.mean, s.std, s.lo, s.hi, q.get(0.5), s.skew,
               s.kurtosis, *[q.get(p) for p in TARGET_LEVELS])
        levels = ", ".join(f"p{round(100 * p)} double" for p in TARGET_LEVELS)
        return report(self.spark, [row],
                      "column string, count long, n_missing long, mean double, std double, min double, max double, "
                      f"median double, skewness double, kurtosis double, {levels}")

    def target_summary(self) -> DataFrame:
        return self.target_classes() if self.target_is_discrete else self.target_numeric()

    # numeric columns ----------------------------------------------------------
    def numeric_stats(self) -> DataFrame:
        rows = []
        for c in self.numeric:
            s = self.stats[c]
            if not s.n:
                continue
            q1, med, q3 = (s.quantiles[p] for p in (0.25, 0.5, 0.75))
            cv = (s.std / s.mean if s.mean else 0.0) if s.std is not None else None
            rows.append((c, s.n, s.mean, s.std, s.lo, s.hi, med, q1, q3, q3 - q1, cv, s.hi - s.lo))
        return report(self.spark, rows,
                      "column string, count long, mean double, std double, min double, max double, median double, "
                      "q1 double, q3 double, iqr double, cv double, range double")

    def distribution(self, bins: int = 20) -> DataFrame:
        return histogram(self.df, self.numeric, bins)

    def skewness_kurtosis(self) -> DataFrame:
        rows = []
        for c in self.numeric:
            s = self.stats[c]
            sk, ku = s.skew, s.kurtosis
            rows.append((c, sk, ku, skew_label(sk), None if ku is None else ku > 0))
        return report(self.spark, rows,
                      "column string, skewness double, kurtosis double, skew_label string, leptokurtic boolean")

    def _fence_counts(self, factor: float) -> dict[str, int]:
        values = clean_values(self.df, self.numeric)
        conditions = {}
        for c in self.numeric:
            s = self.stats[c]
            if s.n:
                q1, q3 = s.quantiles[0.25], s.quantiles[0.75]
                width = factor * (q3 - q1)
                conditions[c] = (values[c] < q1 - width) | (values[c] > q3 + width)
        return conditional_counts(self.df, conditions)

    @cached_property
    def _mild(self) -> dict[str, int]:
        return self._fence_counts(1.5)

    @cached_property
    def _extreme(self) -> dict[str, int]:
        return self._fence_counts(3.0)

    def outliers(self) -> DataFrame:
        """Columns with values beyond the 1.5-IQR fences or |z| > 3 (population z)."""
        values = clean_values(self.df, self.numeric)
        far = conditional_counts(self.df, {
            c: F.abs(values[c] - F.lit(s.mean)) / F.lit(s.std_pop) > 3
            for c, s in self.stats.items() if s.n and s.m2 > 0
        })
        rows = []
        for c, n_iqr in self._mild.items():
            s, n_z = self.stats[c], far.get(c, 0)
            if n_iqr or n_z:
                q1, q3 = s.quantiles[0.25], s.quantiles[0.75]
                width = 1.5 * (q3 - q1)
                rows.append((c, n_iqr, n_z, 100.0 * n_iqr / s.n, q1 - width, q3 + width))
        return report(self.spark, rows,
                      "column string, iqr_outliers long, zscore_outliers long, iqr_pct double, "
                      "lower_fence double, upper_fence double")

    def normality(self) -> DataFrame:
        """Jarque-Bera test from the moments of all rows; ``is_normal`` when p > 0.05."""
        rows = [(c, s.n, s.m2, s.m3, s.m4) for c, s in self.stats.items() if s.n >= 8 and s.m2 > 0]
        df = report(self.spark, rows, "column string, n long, m2 double, m3 double, m4 double")
        n = F.col("n").cast("double")
        skew = F.sqrt(n) * F.col("m3") / (F.col("m2") * F.sqrt("m2"))
        excess = n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3.0
        jb = n / 6.0 * (skew * skew + excess * excess / 4.0)
        p = F.exp(-jb / 2.0)
        return df.select("column", jb.alias("jb_stat"), p.alias("jb_p"), (p > 0.05).alias("is_normal"))

    # strings ------------------------------------------------------------------
    def categorical_stats(self) -> DataFrame:
        """Distinct values, gaps, entropy in nats (counts + 1e-9) and cardinality band."""
        w = F.col("count") + 1e-9
        stats = value_counts(self.df, self.strings).groupBy("column").agg(
            F.count("*").alias("n_unique"), F.sum(w).alias("t"), F.sum(w * F.ln(w)).alias("s"))
        gaps = report(self.spark, [(c, self.missing_counts[c]) for c in self.strings], "column string, missing long")
        n = F.coalesce("n_unique", F.lit(0))
        return gaps.join(F.broadcast(stats), "column", "left").select(  # one row per column
            "column", n.cast("long").alias("n_unique"), "missing",
            (F.ln("t") - F.col("s") / F.col("t")).alias("entropy"),
            F.when(n > 50, "high").when(n > 10, "medium").otherwise("low").alias("cardinality"),
        )

    def top_values(self, k: int = 10) -> DataFrame:
        return top_values(self.df, self.strings, k)

    # correlation --------------------------------------------------------------
    def pearson(self) -> DataFrame:
        return self.correlations

    def spearman(self, key: Sequence[str]) -> DataFrame:
        return spearman_pairs(self.df, self.numeric, key)

    def target_correlations(self, k: int | None = 15) -> DataFrame:
        return target_correlations(self.correlations, self.target, k)

    def multicollinear(self, threshold: float = 0.85) -> DataFrame:
        return multicollinear(self.correlations, threshold)

    def top_correlations(self, k: int = 15) -> DataFrame:
        return top_correlations(self.correlations.where(
            (F.col("f1") != self.target) & (F.col("f2") != self.target)), k)

    def shapiro(self, sample: int = 500, first: int = 10) -> DataFrame:
        """Shapiro-Wilk of the first numeric columns on a bounded sample (8 values at least); ``shapiro_francia`` takes all rows."""
        return shapiro_table(self.df, self.numeric[:first], sample)

    def shapiro_francia(self) -> DataFrame:
        return shapiro_francia(self.df, self.numeric)

    def mutual_information(self, bins: int = 10, neighbours: int = 0) -> DataFrame:
        """Binned at exact quantiles; with ``neighbours`` from distances to the k-th nearest neighbour."""
        features = [c for c in self.numeric if c != self.target]
        if neighbours:
            return neighbour_information(self.df, features, self.target, self.target_is_discrete, neighbours)
        return mutual_information(self.df, features, self.target, self.target_is_discrete, bins)

    # scores and findings ------------------------------------------------------
    @property
    def missing_pct(self) -> float:
        """Mean over columns of the missing share, in percent."""
        cells = self.rows * len(self.df.columns)
        return 100.0 * sum(self.missing_counts.values()) / cells if cells else 0.0

    @property
    def duplicate_pct(self) -> float:
        return 100.0 * (self.rows - self.distinct_rows) / self.rows if self.rows else 0.0

    def quality_score(self) -> DataFrame:
        """Completeness, uniqueness, consistency and their mean, each 0-100."""
        shares = [n / self.stats[c].n for c, n in self._extreme.items()]
        extreme = 100.0 * sum(shares) / len(shares) if shares else 0.0
        base = report(self.spark, [(self.missing_pct, self.duplicate_pct, extreme)], "m double, d double, e double")
        score = lambda c, k: F.round(F.greatest(F.lit(0.0), 100.0 - F.col(c) * k), 1)
        out = base.select(score("m", 2.0).alias("completeness"), score("d", 5.0).alias("uniqueness"),
                          score("e", 10.0).alias("consistency"))
        mean = (F.col("completeness") + F.col("uniqueness") + F.col("consistency")) / 3.0
        return out.withColumn("overall", F.round(mean, 1))

    def recommendations(self) -> DataFrame:
        """``(severity, finding, subject, value)``; ``subject`` is a column, or '*' for the table."""
        tips: list[tuple[str, str, str, float]] = []
        for c in self.df.columns:
            pct = 100.0 * self.missing_counts[c] / self.rows if self.rows else 0.0
            if pct > 30:
                tips.append(("high", "mostly_missing", c, pct))
            elif pct > 5:
                tips.append(("medium", "partly_missing", c, pct))
        dups = self.rows - self.distinct_rows
        if dups:
            tips.append(("medium", "duplicate_rows", "*", float(dups)))
        for c, n in self.string_cardinality.items():
            if n > 50 and c != self.target:
                tips.append(("medium", "high_cardinality", c, float(n)))
        for c in self.numeric:
            sk = self.stats[c].skew
            if sk is not None and abs(sk) > 2:
                tips.append(("low", "highly_skewed", c, sk))
        if self.target_is_discrete and len(self.class_counts) > 1:
            ratio = self.class_counts[0][1] / self.class_counts[-1][1]
            if ratio > 3:
                tips.append(("high", "class_imbalance", self.target, ratio))
        if not tips:
            tips.append(("good", "clean", "*", 0.0))
        return report(self.spark, tips, "severity string, finding string, subject string, value double")

    def facts(self) -> dict:
        """Compact facts that drive model choice (sizes, gaps, target, strong correlations, skew)."""
        features = [c for c in self.numeric if c != self.target]
        classification = (self.problem_type or ("classification" if self.target_is_discrete else "regression")
                          ) == "classification"
        out: dict = {
            "rows": self.rows, "cols": len(self.df.columns), "num_feats": len(features),
            "cat_feats": len([c for c in self.strings if c != self.target]),
            "missing_pct": round(self.missing_pct, 1), "dup_pct": round(self.duplicate_pct, 1),
            "task": "classification" if classification else "regression",
        }
        if classification:
            sizes = [n for _, n in self.class_counts]
            out["classes"] = len(sizes)
            out["imbalance"] = sizes[-1] / sizes[0] if sizes else 1.0
            out["min_class_n"] = sizes[-1] if sizes else 0
            out["top_corr"] = []
        else:
            s = self.stats[self.target]
            out.update(target_mean=s.mean, target_std=s.std, target_skew=s.skew)
            out["top_corr"] = [(r["feature"], r["abs_r"]) for r in self.target_correlations(4).collect()]
        skews = [(c, self.stats[c].skew) for c in features]
        out["high_skew"] = [(c, sk) for c, sk in skews if sk is not None and abs(sk) > 1.5]
        return out

    def compact_profile(self) -> DataFrame:
        """``facts`` as ``(fact, value)`` rows."""
        rows = []
        for k, v in self.facts().items():
            if isinstance(v, list):
                rows += [(f"{k}:{c}", float(x), None) for c, x in v]
            elif isinstance(v, str):
                rows.append((k, None, v))
            else:
                rows.append((k, None if v is None else float(v), None))
        return report(self.spark, rows, "fact string, value double, text string")

    def issues(self) -> list[tuple[str, str, float]]:
        found: list[tuple[str, str, float]] = []
        for c in self.df.columns:
            share = self.missing_counts[c] / self.rows if self.rows else 0.0
            if share > 0.3:
                found.append(("heavy_missing", c, share))
        task = self.problem_type or ("classification" if self.target_is_discrete else "regression")
        if task == "classification":
            sizes = [n for _, n in self.class_counts]
            ratio = sizes[-1] / sizes[0] if sizes else 1.0
            if ratio < 0.3:
                found.append(("class_imbalance", self.target, ratio))
        for c, n in self.string_cardinality.items():
            if n > 50 and c != self.target:
                found.append(("high_cardinality", c, float(n)))
        for c in self.numeric:
            sk = self.stats[c].skew
            if c != self.target and sk is not None and abs(sk) > 2:
                found.append(("highly_skewed", c, sk))
        if self.duplicate_pct > 5:
            found.append(("duplicates", "*", self.duplicate_pct))
        if task == "regression":
            # Rows complete in every numeric column, as the leakage check wants.
            values = clean_values(self.df, self.numeric)
            complete = self.df
            if any(self.missing_counts[c] for c in self.numeric):
                keep = F.lit(True)
                for c in self.numeric:
                    keep = keep & values[c].isNotNull()
                complete = self.df.where(keep)
            pairs = [(c, self.target) for c in self.numeric if c != self.target]
            rs = pearson_pairs(complete, self.numeric, pairs, dict.fromkeys(self.numeric, 0)).collect()
            found += [("possible_leakage", r["f1"], abs(r["r"])) for r in rs
                      if r["r"] is not None and abs(r["r"]) > 0.98]
        return found

    def investigate(self) -> DataFrame:
        """Data problems ``(issue, subject, value)`` that the adaptive search reacts to."""
        return report(self.spark, self.issues(), "issue string, subject string, value double")

    def business_profile(self) -> DataFrame:
        """Per column: role, gaps, distinct share, moments or the most frequent value."""
        distinct = distinct_counts(self.df, self.df.columns)
        top = {r["column"]: r["value"] for r in top_values(self.df, self.strings, 1).collect()} if self.strings else {}
        rows = []
        for c, dtype in self.df.dtypes:
            n, m = self.rows, self.missing_counts[c]
            s = self.stats.get(c)
            role = "numeric" if s else "categorical" if distinct[c] <= 50 else "high-cardinality"
            rows.append((c, dtype, c == self.target, m, 100.0 * m / n if n else 0.0, distinct[c],
                         100.0 * distinct[c] / n if n else 0.0, role, *((s.mean, s.std, s.lo, s.hi, s.skew)
                         if s else (None,) * 5), top.get(c)))
        return report(self.spark, rows,
                      "column string, dtype string, is_target boolean, missing long, missing_pct double, unique long, "
                      "unique_pct double, role string, mean double, std double, min double, max double, skew double, "
                      "top_value string")

    def quality_profile(self) -> DataFrame:
        """The second quality formula: 0.6 completeness + 0.4 uniqueness."""
        base = report(self.spark, [(100.0 - self.missing_pct, 100.0 - self.duplicate_pct)], "c double, u double")
        return base.select(F.round("c", 1).alias("completeness_pct"), F.round("u", 1).alias("uniqueness_pct")).withColumn(
            "quality_score", F.round(F.col("completeness_pct") * 0.6 + F.col("uniqueness_pct") * 0.4, 1))

    def feature_schema(self, features: Sequence[str] | None = None, k: int = 50) -> DataFrame:
        """Input schema: range, mean, median, std of numbers, or the k commonest categories."""
        features = list(features or [c for c in self.df.columns if c != self.target])
        texts = [c for c in features if c in self.strings]
        cats: dict[str, list[str]] = {}
        if texts:
            for r in top_values(self.df, texts, k).orderBy("column", "rank").collect():
                cats.setdefault(r["column"], []).append(r["value"])
        rows = []
        for c in features:
            s = self.stats.get(c)
            pct = 100.0 * self.missing_counts[c] / self.rows if self.rows else 0.0
            rows.append((c, "numeric" if s else "categorical", pct, *((s.lo, s.hi, s.mean, s.quantiles.get(0.5), s.std)
                         if s else (None,) * 5), cats.get(c)))
        return report(self.spark, rows,
                      "column string, type string, missing_pct double, min double, max double, mean double, "
                      "median double, std double, categories array<string>")

    def advanced(self) -> dict[str, DataFrame]:
        """The sections of the advanced view, over features only."""
        features = [c for c in self.numeric if c != self.target]
        rows = []
        for c in features:
            s = self.stats[c]
            if s.n:
                rows.append((c, s.mean, s.std or 0.0, s.lo, s.hi, s.quantiles[0.25], s.quantiles[0.5],
                             s.quantiles[0.75], self._mild[c], s.skew or 0.0))
        stats = report(self.spark, rows, "column string, mean double, std double, min double, max double, q1 double, "
                                         "median double, q3 double, outliers long, skewness double")
        target = self.target_classes() if self.target_is_discrete else histogram(self.df, [self.target], 20)
        return {"stats": stats, "top_correlations": self.top_correlations(15), "target": target,
                "bivariate": self.bivariate_sample()}

    def bivariate_sample(self, columns: int = 4, classes: int = 5, per_class: int = 150, points: int = 400,
                         seed: int = 42) -> DataFrame:
        """Plot sample ``(column, class, x, y)``: up to ``per_class`` values of each of the
        largest classes, or ``points`` (x, target) pairs for a numeric target."""
        features = [c for c in self.numeric if c != self.target][:columns]
        order = row_key(self.df.columns, seed)
        if self.target_is_discrete:
            names = [c for c, _ in self.class_counts[:classes]]
            base = self.df.where(ref(self.target).cast("string").isin(names)).select(
                order.alias("_o"), ref(self.target).cast("string").alias("class"), F.lit(None).cast("double").alias("y"),
                *[ref(c) for c in features])
            per_group = per_class
        else:
            base = self.df.where(ref(self.target).isNotNull()).select(
                order.alias("_o"), F.lit(None).cast("string").alias("class"), ref(self.target).cast("double").alias("y"),
                *[ref(c) for c in features])
            per_group = points
        long = unpivot_numeric(base, features, ["_o", "class", "y"])
        w = Window.partitionBy("column", "class").orderBy("_o", "value")
        return (long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_group)
                .select("column", "class", F.col("value").alias("x"), "y"))

    def feature_interaction(self, a: str, b: str, points: int = 400, seed: int = 42) -> tuple[DataFrame, DataFrame]:
        """Correlation of two features on rows complete in both and the target, and a scatter sample."""
        missing = [c for c in (a, b) if c not in self.df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")
        sub = self.df.select(ref(a), ref(b), ref(self.target)).na.drop()
        r = pearson_pairs(sub, [a, b], [(a, b)], {a: 0, b: 0})
        corr = r.select("f1", "f2", F.coalesce("r", F.lit(0.0)).alias("r"))
        sample = hash_sample(sub, points, seed)
        if self.target_is_discrete:
            order = sorted(c for c, _ in self.class_counts)
            index = F.array_position(F.lit(order), ref(self.target).cast("string")) - 1
        else:
            index = ref(self.target).cast("double")
        return corr, sample.select(ref(a).alias("x"), ref(b).alias("y"), index.alias("target"))

    def run(self) -> dict[str, DataFrame]:
        """All sections."""
        return {
            "shape": self.shape(), "dtypes": self.dtypes(), "memory": self.memory_estimate(),
            "duplicates": self.duplicate_rows(), "missing": self.missing(), "target": self.target_summary(),
            "numeric_stats": self.numeric_stats(), "distribution": self.distribution(),
            "categorical_stats": self.categorical_stats(), "top_values": self.top_values(),
            "pearson": self.pearson(), "target_correlations": self.target_correlations(),
            "multicollinear": self.multicollinear(), "skewness_kurtosis": self.skewness_kurtosis(),
            "outliers": self.outliers(), "normality": self.normality(), "mutual_information": self.mutual_information(),
            "feature_types": self.feature_types(), "quality": self.quality_score(),
            "recommendations": self.recommendations(),
        }


def skew_label(skew: float | None) -> str | None:
    if skew is None:
        return None
    if abs(skew) <= 0.5:
        return "symmetric"
    side = "positive" if skew > 0 else "negative"
    return f"highly_{side}" if abs(skew) > 2 else side
