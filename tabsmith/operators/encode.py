"""Category encoders and target labels.

A fit produces one table ``(column, category, codes)``.  If it is small its rows travel
inside the model and a transform is a map lookup; otherwise the model keeps the table and
a transform is a left join, broadcast only when the counted rows allow it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import double_arrays, ref, unpivot_strings
from tabsmith.functions.session import BROADCAST_ROWS, BUCKET_ROWS, INLINE_CATEGORIES, cut_lineage
from tabsmith.operators.fitted import ColumnEstimator, FittedColumns, TableModel
from tabsmith.operators.profile import value_counts

GAP = "nan"  # the category of a NULL


def _text(name: str) -> Column:
    return F.coalesce(ref(name).cast("string"), F.lit(GAP))


class CodeMapModel(FittedColumns):
    """Inline form: ``{column: {"map": {category: [codes]}, "default": [...], "names": [...]}}``."""

    @property
    def outputs(self) -> list[str]:
        return [n for f in self.fitted.values() for n in f["names"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        # One lookup per column; the codes are then taken from it in a second projection.
        found, out = {}, {}
        for i, (c, f) in enumerate(self.fitted.items()):
            default = double_arrays([float(v) for v in f["default"]])
            if f["map"]:
                table = F.from_json(F.lit(json.dumps(f["map"])), "map<string,array<double>>")
                found[f"_codes{i}"] = F.coalesce(F.try_element_at(table, _text(c)), default)
            else:
                found[f"_codes{i}"] = default
            out.update({name: F.get(F.col(f"_codes{i}"), F.lit(j)) for j, name in enumerate(f["names"])})
        df = df.withColumns(found).withColumns(out)
        return df.drop(*found, *[c for c in self.fitted if c not in out])


class CodeTableModel(TableModel):
    """Join form, for columns with very many categories."""

    @property
    def outputs(self) -> list[str]:
        return [n for f in self.fitted["columns"].values() for n in f["names"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        small = self.fitted["rows"] <= BROADCAST_ROWS
        for c, f in self.fitted["columns"].items():
            codes = self.table.where(F.col("column") == c).select(F.col("category").alias("_cat"), F.col("codes").alias("_codes"))
            if small:
                codes = F.broadcast(codes)
            df = df.withColumn("_cat", _text(c)).join(codes, "_cat", "left")
            values = F.coalesce("_codes", F.array(*[F.lit(float(v)) for v in f["default"]]))
            df = df.withColumns({n: F.get(values, F.lit(i)) for i, n in enumerate(f["names"])})
            df = df.drop("_cat", "_codes", *([c] if c not in f["names"] else []))
        return df


def _code_model(table: DataFrame, columns: dict[str, dict]):
    """``columns``: per column its default codes and output names."""
    head = table.limit(INLINE_CATEGORIES + 1).collect()
    if len(head) <= INLINE_CATEGORIES:
        spec = {c: {**f, "map": {}} for c, f in columns.items()}
        for r in head:
            spec[r["column"]]["map"][r["category"]] = list(r["codes"])
        return CodeMapModel.of(spec)
    table = cut_lineage(table)  # computed once, not in every transform
    return CodeTableModel.of({"rows": table.count(), "columns": columns}, table)


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)``; a NULL counts as the category ``nan``."""
    return value_counts(df.select(*[_text(c).alias(c) for c in cols]), cols)


class FrequencyEncode(ColumnEstimator):
    """Share of the rows that have the category; unknown 0."""

    def _fit(self, df: DataFrame):
        counts = category_counts(df, self.cols)
        total = df.count()
        table = counts.select("column", F.col("value").alias("category"),
                              F.array(F.col("count") / F.lit(float(max(total, 1)))).alias("codes"))
        return _code_model(table, {c: {"default": [0.0], "names": [c]} for c in self.cols})


def _category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, category, code)`` with codes 0.. in the order of the category texts."""
    values = category_counts(df, cols).select("column", "value")
    if values.limit(BUCKET_ROWS + 1).count() <= BUCKET_ROWS:
        w = Window.partitionBy("column").orderBy("value")
        return values.select("column", F.col("value").alias("category"), (F.row_number().over(w) - 1).alias("code"))
    # Ranks inside ordered parts, and how many categories of the column stand in the parts before.
    parts = cut_lineage(values.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()))
    before: dict[str, int] = {}
    offsets = []
    for r in sorted(parts.groupBy("_part", "column").count().collect()):  # a row per part, and one more per column
        offsets.append((r["_part"], r["column"], before.get(r["column"], 0)))
        before[r["column"]] = before.get(r["column"], 0) + r["count"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, column string, _before long")
    w = Window.partitionBy("_part", "column").orderBy("value")
    ranked = parts.join(F.broadcast(table), ["_part", "column"])
    return ranked.select("column", F.col("value").alias("category"), (F.row_number().over(w) - 1 + F.col("_before")).alias("code"))


class OrdinalEncode(ColumnEstimator):
    """Rank of the category among the sorted categories; unknown -1."""

    def _fit(self, df: DataFrame):
        codes = _category_codes(df, self.cols)
        table = codes.select("column", "category", F.array(F.col("code").cast("double")).alias("codes"))
        return _code_model(table, {c: {"default": [-1.0], "names": [c]} for c in self.cols})


class BinaryEncode(ColumnEstimator):
    """Bits of the category's rank, lowest first; unknown as rank 0."""

    def _fit(self, df: DataFrame):
        codes = _category_codes(df, self.cols)
        sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
        bits = {c: max(1, math.ceil(math.log2(sizes.get(c, 0) + 1))) for c in self.cols}
        most = max(bits.values())
        table = codes.select("column", "category", F.array(*[
            F.shiftright("code", b).bitwiseAND(1).cast("double") for b in range(most)]).alias("codes"))
        return _code_model(table, {
            c: {"default": [0.0] * bits[c], "names": [f"{c}_bit{b}" for b in range(bits[c])]} for c in self.cols})


class OneHotEncode(ColumnEstimator):
    """One column per category; unknown gives zeros.  Beyond ``limit`` (50) categories the
    rarest share one column."""

    def _fit(self, df: DataFrame):
        limit = self.option("limit", 50)
        w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
        top = category_counts(df, self.cols).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1)
        kept: dict[str, list[str]] = {c: [] for c in self.cols}
        for r in top.orderBy("column", "r").collect():  # at most limit + 1 rows per column
            kept[r["column"]].append(r["value"])
        spec: dict[str, dict] = {}
        crowded = {}
        for c, cats in kept.items():
            if len(cats) > limit:
                cats, rare = sorted(cats[:limit - 1]), True
                crowded[c] = cats
            else:
                cats, rare = sorted(cats), False
            width = len(cats) + rare
            names = [f"{c}={v}" for v in cats] + ([f"{c}=(rare)"] if rare else [])
            unit = lambda i, n=width: [1.0 if j == i else 0.0 for j in range(n)]
            spec[c] = {"map": {v: unit(i) for i, v in enumerate(cats)}, "default": [0.0] * width, "names": names}
        if not crowded:
            return CodeMapModel.of(spec)
        # Rare categories must be told from unknown ones, so all categories go to the table.
        every = category_counts(df, self.cols)
        codes = F.array(F.lit(0.0))
        for c, f in spec.items():
            width = len(f["names"])
            unit = F.array(*[F.lit(1.0 if j == width - 1 else 0.0) for j in range(width)])
            for v, u in f["map"].items():
                unit = F.when(F.col("value") == v, F.array(*[F.lit(x) for x in u])).otherwise(unit)
            codes = F.when(F.col("column") == c, unit).otherwise(codes)
        table = every.select("column", F.col("value").alias("category"), codes.alias("codes"))
        return _code_model(table, {c: {"default": f["default"], "names": f["names"]} for c, f in spec.items()})


def target_statistics(df: DataFrame, cols: Sequence[str], targets: Sequence[Column]) -> DataFrame:
    """``(column, category, n, m0, v0, m1, v1, ...)``: mean and population variance of every
    target per category, in one map-side combined aggregate."""
    ys = [f"_y{i}" for i in range(len(targets))]
    wide = df.select(*[t.cast("double").alias(y) for y, t in zip(ys, targets)], *[_text(c).alias(c) for c in cols])
    aggs = [x for i, y in enumerate(ys) for x in (F.avg(y).alias(f"m{i}"), F.var_pop(y).alias(f"v{i}"))]
    return unpivot_strings(wide, cols, ys).groupBy("column", F.col("value").alias("category")).agg(
        F.count(ys[0]).alias("n"), *aggs)


def shrunk_mean(i: int, smooth: float | None, prior: float, y_var: float) -> Column:
    """Category mean of target i pulled to the prior: by ``smooth`` pseudo-rows, or empirical Bayes."""
    n, m = F.col("n"), F.col(f"m{i}")
    if smooth is not None:
        return (n * m + F.lit(float(smooth * prior))) / (n + F.lit(float(smooth)))
    top = F.lit(y_var) * n
    bottom = top + F.col(f"v{i}")
    w = F.when(bottom > 0, top / F.when(bottom > 0, bottom))
    return F.when(w.isNull(), F.lit(prior)).otherwise(w * m + (1.0 - w) * F.lit(prior))


def _indicators(target: str, classes: int) -> list[tuple[str, Column]]:
    """Target columns to average: itself, or one 0/1 column per class beyond two."""
    if classes > 2:
        return [(f"_c{k}", (ref(target) == k).cast("double")) for k in range(classes)]
    return [("", ref(target).cast("double"))]


class TargetEncode(ColumnEstimator):
    """Mean of the target per category; unknown gives the overall mean.

    Options: ``target`` (numeric, or class index with ``classes``), ``smooth`` (pseudo-rows;
    None for empirical-Bayes shrinkage).
    """

    def _fit(self, df: DataFrame):
        target, smooth = self.option("target"), self.option("smooth")
        parts = _indicators(target, self.option("classes", 0))
        priors = df.agg(*[x for i, (_, y) in enumerate(parts) for x in (
            F.avg(y).alias(f"m{i}"), F.var_pop(y).alias(f"v{i}"))]).first()
        defaults = [priors[f"m{i}"] or 0.0 for i in range(len(parts))]
        codes = [shrunk_mean(i, smooth, defaults[i], priors[f"v{i}"] or 0.0) for i in range(len(parts))]
        table = target_statistics(df, self.cols, [y for _, y in parts]).select("column", "category", F.array(*codes).alias("codes"))
        return _code_model(table, {
            c: {"default": defaults, "names": [f"{c}{tag}" for tag, _ in parts]} for c in self.cols})


def out_of_fold_target_encode(df: DataFrame, col: str, target: str, fold: str, name: str | None = None,
                              smooth: float = 20.0) -> DataFrame:
    """Target encoding of the training rows that never uses a row's own fold.

    Sums per (category, fold) are enough: the other folds' sums are the category total
    minus the own fold, so one aggregate serves every fold.
    """
    y = ref(target).cast("double")
    cells = df.groupBy(_text(col).alias("_cat"), ref(fold).alias("_fold")).agg(
        F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"))
    per_fold = cells.groupBy("_fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    total = df.agg(F.count(y).alias("tn"), F.sum(y).alias("ts")).first()
    w = Window.partitionBy("_cat")
    others = cells.select("_cat", "_fold", (F.sum("n").over(w) - F.col("n")).alias("n"),
                          (F.sum("s").over(w) - F.col("s")).alias("s"))
    prior = (F.lit(float(total["ts"])) - F.col("fs")) / (F.lit(float(total["tn"])) - F.col("fn"))
    codes = others.join(F.broadcast(per_fold), "_fold").select(  # one row per fold
        "_cat", "_fold", ((F.col("s") + smooth * prior) / (F.col("n") + smooth)).alias("_code"))
    out = df.withColumn("_cat", _text(col)).withColumn("_fold", ref(fold)).join(codes, ["_cat", "_fold"], "left")
    return out.withColumn(name or f"{col}_te", F.col("_code")).drop("_cat", "_fold", "_code")


def category_encoder(kind: str, cols: Sequence[str], target: str, classes: int) -> ColumnEstimator:
    """Encoder by recipe key; unknown keys mean ordinal."""
    if kind == "onehot":
        return OneHotEncode.of(cols)
    if kind == "target":
        return TargetEncode.of(cols, target=target, classes=classes)
    if kind == "freq":
        return FrequencyEncode.of(cols)
    if kind == "binary":
        return BinaryEncode.of(cols)
    return OrdinalEncode.of(cols)


class LabelModel(FittedColumns):
    """Class index 0.. in the order of the class texts, and back."""

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        f = self.fitted
        at = F.array_position(F.lit(f["classes"]), ref(f["column"]).cast("string")) - 1
        return {f["output"]: F.when(at >= 0, at.cast("double"))}

    @property
    def classes(self) -> list[str]:
        return self.fitted["classes"]

    def decode(self, index: Column) -> Column:
        return F.get(F.lit(self.classes), index.cast("int"))


class LabelEncode(ColumnEstimator):
    """Encode the target's classes; their number is what models must separate, so it is small."""

    def _fit(self, df: DataFrame) -> LabelModel:
        c = self.cols[0]
        rows = df.where(ref(c).isNotNull()).select(ref(c).alias("v")).distinct().limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError(f"{c} has over 10,000 classes")
        values = sorted(r["v"] for r in rows)
        classes = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
        return LabelModel.of({"column": c, "output": self.option("output", "label"), "classes": classes})
