"""Line deduplication: lines that stand in many documents go from all but one of them.

Lines are exploded with their positions and normalised; what travels is a 128-bit hash of each, not its text.  The
distinct documents of a hash are counted, and the positions of lines over the threshold are gathered by document and
taken out of the text.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import BROADCAST_ROWS, cut_lineage

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _hashes(text: Column, *names: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in enumerate(names)]


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, t0, t1, place, h0, h1) of every line that is long enough: document, text, position and key as hashes."""
    # A text is hashed in a step of its own: beside the generator that would be done for each line.
    whole = docs.select("doc", *_hashes(F.col("text"), "t0", "t1"), F.split("text", "\n", -1).alias("lines"))
    exploded = whole.select("doc", "t0", "t1", F.posexplode("lines").alias("place", "line"))
    keyed = exploded.where(F.octet_length("line") >= least_chars).withColumn("key", line_key(F.col("line")))
    return keyed.where(F.length("key") >= least_chars).select("doc", "t0", "t1", "place", *_hashes(F.col("key"), "h0", "h1"))


def repeated_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h0, h1, keeper) of the keys in at least ``least_docs`` distinct documents, and the largest of these.

    Documents are counted in two steps, by (key, document) and then by key with sums inside each task before, so a key
    that stands in every document is not gathered anywhere.  Rows with a null id are one document together.
    """
    found = lines.groupBy("h0", "h1").agg(
        F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper"), F.max(F.col("doc").isNull().cast("int")).alias("unnamed"))
    return found.where(F.col("docs") + F.col("unnamed") >= least_docs).select("h0", "h1", "keeper")


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) without repeated lines, and with the columns n_lines (before) and n_dropped.

    Texts are split at line feeds.  Lines whose key (see ``line_key``) has at least ``least_chars`` code points and
    stands in at least ``least_docs`` distinct doc_ids go everywhere but in the largest of these; that one keeps all its
    copies of the line.  The other lines stay, joined by line feeds, as they were.

    A null text is one empty line and stays null; a text that loses all its lines is empty.  Rows with one doc_id are
    one document, and all of them keep the line where that document does; equal rows stay equal rows.  Null doc_ids are
    one document that is smaller than any other.  A row is one text, so a very long one has to fit into a task; its
    lines are taken out in one pass.  Columns named n_lines and n_dropped are replaced, others stay.  Keys are told
    apart by 128 bits of hash.  No row of ``docs`` is lost, and an empty table gives an empty one.
    """
    given = [n for n in docs.columns if n not in ("n_lines", "n_dropped")]
    own = {n: f"_c{i}" for i, n in enumerate(given)}
    kind = dict(docs.dtypes)["text"]
    rows = docs.select(*(F.col(f"`{n}`").alias(own[n]) for n in given))
    text = F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))
    lines = cut_lineage(_lines(rows.select(F.col(own["doc_id"]).alias("doc"), text.alias("text")), least_chars))
    repeated = cut_lineage(repeated_lines(lines, least_docs))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    gone = (lines.join(repeated, ["h0", "h1"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
            .groupBy("doc", "t0", "t1").agg(F.collect_set("place").alias("gone")))
    # The array of lines is made once, below the join, and stands for the text from there on.
    rows = rows.select(*(own[n] for n in given if n != "text"), F.col(own["text"]).isNull().alias("null"),
                       *_hashes(text, "u0", "u1"), F.split(text, "\n", -1).alias("lines"))
    same = F.col(own["doc_id"]).eqNullSafe(F.col("doc")) & (F.col("u0") == F.col("t0")) & (F.col("u1") == F.col("t1"))
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    left = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    left = F.when(~F.col("null"), left).cast(kind)
    return rows.join(gone, same, "left").select(
        *(left.alias("text") if x == "text" else F.col(own[x]).alias(x) for x in given),
        n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
