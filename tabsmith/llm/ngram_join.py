"""Similarity join on word n-grams: grouped prefix join with exact verification.

1. Every text becomes its set of word shingles (64-bit hashes); equal sets are one set from there on.
2. Shingles go to buckets by hash, packed, and a bucket counts in how many sets each stands.  A shingle of one set
   alone links nothing, so only shared ones come back, and a set in which too few are shared can have no link.
3. Shingles are ordered by count, then value.  A prefix of that order must meet the prefix of any similar set.  Sets
   of one size with the same prefix are one group, and only groups are paired, under size and position limits.
4. Pairs of groups are expanded to members and verified on the whole sets.

Copies of a copy make lists with all pairs of thousands of sets.  So the first round pairs each member of a prefix
list with the list's most typical member only, and joins what is verified into components; then all remaining pairs
of a list whose ends are in different components are verified.  A pair inside a component changes nothing, so the
components are those of all links.  There is no cap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.session import cut_lineage
from tabsmith.llm import packed
from tabsmith.llm import text as tx
from tabsmith.llm.components import components

def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """First row, shingle sets and set identities, a block of rows at a time."""
    for at, _, data, offsets in tx.blocks(column):
        data = tx.LOWER[data]
        starts, ends, first = tx.spans(data, offsets, tx.SPACED)
        sets = tx.shingle_hashes(tx.span_hashes(data, starts, ends), first, width)
        yield at, sets, tx.bag_keys(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(h) for h in sets]))))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n, key): size and identity of each row's shingle set; n is 0 and key null without words."""
    def run(batches):
        for batch in batches:
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, found, keys in _sets(batch.column("text"), width):
                n[at:at + len(found)] = [len(h) for h in found]
                key[at:at + len(found)] = keys
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(key, mask=n == 0)], ["doc_id", "n", "key"])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tx.tidy_batches(run), "doc_id long, n long, key long")


def _packed(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """The distinct sets of each block, cut by bucket of the shingle."""
    def run(batches):
        for batch in batches:
            for _, found, keys in _sets(batch.column("text"), width):
                sets = {key: h for key, h in zip(keys.tolist(), found) if len(h)}
                if sets:
                    yield packed.pack(sets, [len(h) for h in sets.values()], list(sets.values()), None, buckets)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tx.tidy_batches(run), packed.SCHEMA)


_FIELDS = ("bags", "sizes", "counts", "df", "token")


def _shared(parts: int):
    """A bucket's shingles that stand in several sets, per set, with the number of these sets; packed by part of the sets."""
    def run(table: pa.Table) -> pa.Table:
        got = packed.Bucket(table, add=False)
        order, edge = got.groups()
        df = np.empty(len(order), np.int64)
        df[order] = np.repeat(np.diff(edge), np.diff(edge))
        keep = df > 1
        owner, df, value = got.owner[keep], df[keep], got.value[keep]
        token = (value.view(np.uint64) | np.uint64(got.number & 0xFFFF) << np.uint64(packed.BITS)).view(np.int64)
        part = (got.bags % parts)[owner]
        by_part = np.lexsort((owner, part))
        owner, part, df, token = owner[by_part], part[by_part], df[by_part], token[by_part]
        sets, first, counts = np.unique(owner, return_index=True, return_counts=True)
        sets, counts = sets[np.argsort(first)], counts[np.argsort(first)]
        there, at = np.unique(part, return_index=True)
        set_at = np.searchsorted(part[np.sort(first)], there)
        cut = lambda x, where: pa.array([y.astype(np.int64).tobytes() for y in np.split(x, where[1:])] if len(there) else [], pa.binary())
        return pa.table([pa.array(there.astype(np.int32)), cut(got.bags[sets], set_at), cut(got.weights[sets], set_at), cut(counts, set_at),
                         cut(df, at), cut(token, at)], ["part", *_FIELDS])
    return run


def _candidates(percent: int):
    """The sets of a part that share enough shingles to have links, with these in order of count and value."""
    def run(table: pa.Table) -> pa.Table:
        bags, sizes, counts, df, token = (np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64) for n in _FIELDS)
        keys, first, back = np.unique(bags, return_index=True, return_inverse=True)
        n, owner = sizes[first], np.repeat(back, counts)
        shared = np.bincount(owner, minlength=len(keys))
        # Shingles that only this set has come first in the order, so they take up places of the prefix.
        prefix = shared - -(-n * percent // 100) + 1
        keep = prefix > 0
        chosen = keep[owner]
        owner, df, token = owner[chosen], df[chosen], token[chosen]
        order = np.lexsort((token, df, owner))
        weight = np.bincount(owner, df, len(keys))[keep] / n[keep]
        return pa.table([pa.array(keys[keep]), pa.array(n[keep]), tx.ragged(token[order], shared[keep]), pa.array(prefix[keep].astype(np.int32)),
                         pa.array(weight)], ["key", "n", "tokens", "prefix", "weight"])
    return run


def candidate_sets(docs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """(key, n, tokens, prefix, weight) of the sets that may have links.

    ``tokens`` are the shared shingles in order of count and value, ``prefix`` how many of them lie in the prefix,
    ``weight`` their mean count, by which typical sets are known.
    """
    buckets = packed.bucket_count(docs.sparkSession, total)
    shared = _packed(docs, width, buckets).groupBy("bucket").applyInArrow(
        tx.tidy_table(_shared(buckets)), "part int, " + ", ".join(f"{n} binary" for n in _FIELDS))
    return shared.groupBy("part").applyInArrow(
        tx.tidy_table(_candidates(percent)), "key long, n long, tokens array<long>, prefix int, weight double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    a = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _may_link(na, nb, ia, ib, percent: int):
    """Size limit, and position limit: what can still be shared from the places ia, ib (0-based) on."""
    least = F.ceil((na + nb) * percent / F.lit(100.0 + percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) >= least)


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every set of ``sets`` that has a link; links inside one component need not all be checked."""
    unique = F.col("n") - F.size("tokens")
    signature = F.when(unique > 0, F.col("key")).otherwise(F.xxhash64("n", F.slice("tokens", 1, F.col("prefix"))))
    member = cut_lineage(sets.select("key", "n", "weight", unique.alias("unique"), "prefix", signature.alias("signature"), (unique > 0).alias("alone")))
    groups = member.groupBy("signature", "alone").agg(F.min("key").alias("g"))
    member = cut_lineage(member.join(groups, ["signature", "alone"]).select("g", "key", "n", "weight", "unique"))
    places = (sets.join(groups.select(F.col("g").alias("key")), "key", "left_semi")
              .select(F.col("key").alias("g"), "n", "weight", (F.col("n") - F.size("tokens")).alias("unique"),
                      F.posexplode(F.slice("tokens", 1, F.col("prefix"))).alias("i", "token"))
              .select("token", "g", "n", "weight", (F.col("i") + F.col("unique")).alias("i")))
    places = cut_lineage(places)
    center = places.groupBy("token").agg(F.max(F.struct("weight", "g", "n", "i")).alias("c"))
    near = places.join(center, "token").where(F.col("g") != F.col("c.g")).where(
        _may_link(F.col("n"), F.col("c.n"), F.col("i"), F.col("c.i"), percent)).select(F.col("c.g").alias("a"), "g").distinct()
    inside = member.where("g != key").select(F.col("g").alias("a"), F.col("key").alias("b"))
    first = near.join(member.select("g", F.col("key").alias("b")), "g").select("a", "b").union(inside)
    edges = cut_lineage(verified(first.distinct(), sets, percent))
    label = components(edges)
    marked = cut_lineage(member.join(label.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "g", "n", F.coalesce("root", "key").alias("label")))
    more = cut_lineage(verified(_across(places, marked, percent), sets, percent))
    return label if more.isEmpty() else components(edges.union(more))


def _band(n):
    """Sizes within about 3 % of each other."""
    return F.floor(F.log(n.cast("double")) / math.log(1.03)).cast("int")


def _across(places: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components whose groups meet in a prefix and may link.

    The larger set of a pair looks for the smaller one in the bands of sizes that its own place leaves possible,
    and a set is listed there only where its place allows a partner of at least its own size.
    """
    p = F.lit(float(percent))
    entry = places.join(marked.select("g", "label").distinct(), "g")
    mixed = entry.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("token")
    entry = cut_lineage(entry.join(mixed, "token").withColumn("left", F.col("n") - F.col("i")))
    home = entry.where((100 + p) * F.col("left") >= 2 * p * F.col("n")).withColumn("band", _band(F.col("n")))
    most = F.least(F.col("n"), F.floor((100 + p) * F.col("left") / p) - F.col("n"))
    probe = entry.withColumn("most", most).withColumn("least", F.ceil(F.col("n") * p / 100.0)).where("most >= least").withColumn(
        "band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))))
    met = (home.select("token", "band", F.col("label").alias("la")).distinct()
           .join(probe.select("token", "band", F.col("label").alias("lb")).distinct(), ["token", "band"]).where("la != lb"))
    x, y = (e.select("token", "band", F.col("label").alias(name), F.struct("g", "n", "i").alias(to))
            for e, name, to in ((home, "la", "x"), (probe, "lb", "y")))
    met = met.join(x, ["token", "band", "la"]).join(y, ["token", "band", "lb"])
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.g") < F.col("y.g")))
    groups = met.where(smaller & _may_link(F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i"), percent)).select(
        "la", "lb", F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).distinct()
    a = marked.select(F.col("g").alias("ga"), F.col("label").alias("la"), F.col("key").alias("a"))
    b = marked.select(F.col("g").alias("gb"), F.col("label").alias("lb"), F.col("key").alias("b"))
    split = marked.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("g")
    split = marked.join(split, "g")
    inner = split.select("g", "label", F.col("key").alias("a")).join(
        split.select("g", F.col("label").alias("other"), F.col("key").alias("b")), "g").where("label < other").select("a", "b")
    return groups.join(a, ["ga", "la"]).join(b, ["gb", "lb"]).select("a", "b").union(inner).distinct()


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text; other columns are ignored).

    Rows link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach.  A text without words or a null text has no shingles and no link: its component is
    its own doc_id.  Equal sets are linked, so rows with a repeated doc_id or text are fine; a null doc_id stays
    null but its row links others, and gets the smallest non-null id of its component.  Sets are told apart by
    64-bit hashes, and intersections by at least 40 bits a shingle and the bucket, so a chance agreement of
    different words is possible but not to be expected.
    """
    return _classified(docs, width, percent).drop("key")


def _classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The components with each row's set identity."""
    rows = cut_lineage(shingle_sets(docs, width))
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("lowest"))
    sets = cut_lineage(candidate_sets(docs, width, percent, total))
    roots = set_links(sets, percent).withColumnRenamed("node", "key")
    rooted = classes.join(roots, "key", "left").select("key", "lowest", F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = cut_lineage(rooted.select("key", "root").join(lowest, "root").select("key", "component_id"))
    return rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id").alias("component_id"), "key")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with one row left of each group of similar texts: that with the smallest doc_id.

    Of several rows with that doc_id in the group the first by text stays.  Rows without words and rows with a null
    doc_id stay.
    """
    found = cut_lineage(_classified(docs, width, percent).where("doc_id is not null"))
    repeated = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    # Rows that share their doc_id are told apart by their sets.
    repeated, names = cut_lineage(repeated), docs.columns
    once = docs.join(gone.union(repeated), docs["doc_id"] == F.col("_id"), "left_anti")

    def keyed(batches):
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for at, found, keys in _sets(batch.column("_text"), width):
                key[at:at + len(found)] = [k if len(h) else 0 for k, h in zip(keys.tolist(), found)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(key)], [*batch.schema.names[:-1], "_key"])
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.LongType())])
    twice = docs.join(repeated, docs["doc_id"] == F.col("_id"), "left_semi").withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    sets = found.join(repeated, found["doc_id"] == F.col("_id"), "left_semi").select(
        F.col("doc_id").alias("_id"), F.coalesce("key", F.lit(0)).alias("_set"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group")).distinct()
    twice = twice.mapInArrow(tx.tidy_batches(keyed), schema)
    twice = twice.join(sets, (twice["doc_id"] == F.col("_id")) & (F.col("_key") == F.col("_set"))).where("_group is null or _group = doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id", "_group").orderBy("text"))
    return once.unionByName(twice.withColumn("_first", first).where("_group is null or _first = 1").select(names))
