"""Rows in order of a key, dealt into buckets of neighbours, for operators that look at the row beside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Buckets:
    """Lowest and highest key of each bucket, in order; keys between two buckets fall to the lower one."""

    low: list
    high: list

    def __len__(self) -> int:
        return len(self.low)

    def number(self, key: Column) -> Column:
        """The bucket of a key: the bounds not above it are counted, coarse ones first, then those of one stretch."""
        step = max(1, int(len(self.low) ** 0.5))
        stretches = [self.low[i:i + step] for i in range(0, len(self.low), step)]

        def below(bounds: Column) -> Column:
            return F.size(F.filter(bounds, lambda b: b <= key))
        coarse = F.greatest(below(F.array(*(F.lit(s[0]) for s in stretches))), F.lit(1))
        if len(stretches) == 1:
            return F.greatest(below(F.array(*map(F.lit, stretches[0]))), F.lit(1)) - 1
        fine = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in stretches)), coarse)
        return (coarse - 1) * step + F.greatest(below(fine), F.lit(1)) - 1

    def highest(self, bucket: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.high)), bucket + 1)

    def lowest(self, bucket: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.low)), bucket + 1)


def cut(keys: DataFrame, rows_each: int) -> Buckets:
    """Buckets of about equal numbers of rows of the one column of ``keys`` (no nulls).

    There are as many as the shuffle partitions, more if that leaves over ``rows_each`` rows in each, fewer if it
    leaves less than 64.  Two values a bucket come to the driver.
    """
    name, rows = keys.columns[0], keys.count()
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
    parts = max(1, min(parts, rows // 64))
    found = (keys.repartitionByRange(parts, name).groupBy(F.spark_partition_id().alias("p"))
             .agg(F.min(name).alias("low"), F.max(name).alias("high")).collect())
    found.sort(key=lambda r: r["low"])
    return Buckets([r["low"] for r in found], [r["high"] for r in found])
