"""Main text of pages by nearest-URL page differencing.

A page is cut into blocks of text.  Within its host it is paired with the page whose address is nearest; their lines
outside the article are aligned by longest common subsequence, and what both have is template and goes.  The markup
says two things besides: lines inside an article stay, even if a copy of the article stands beside it, and
containers that are never content (menus, footers, adverts, forms, comments, scripts) go, even if they differ.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm import ordered, url_reputation
from tabsmith.llm import text as tx

# Element names of HTML, and words of class, id and role that name page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object math xmp".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("head nav footer aside form button select menu dialog audio video map".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies share sharing social "
    "related newsletter subscribe popup modal widget toolbar pagination pager search login signup complementary contentinfo".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

KEEP, OPEN, DROP = 0, 1, 2


def _is_furniture(name: str, attributes: str, in_content: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_content:
        return True
    if attributes and "=" in attributes and name not in ("body", "html", "article", "main"):
        for value in _NAMES.findall(attributes):
            if not FURNITURE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
                return True
    return False


def lines_of(html: str) -> list[tuple[int, str]]:
    """(KEEP, OPEN or DROP, text) of each block in page order: inside an article, elsewhere, in page furniture.

    References are decoded, white space becomes one blank, empty blocks are left out.  Unclosed elements end with
    what holds them; an end tag without a start is skipped; a comment or raw element that never ends takes the rest.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    state, piece, at, n = OPEN, [], 0, len(html)

    def close():
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append((state, text))
            piece.clear()

    def enter(name: str, was: int):
        stack.append((name, was))
        opened[name] += 1

    def leave(name: str) -> int:
        """The state before the innermost open element of that name."""
        while True:
            x, was = stack.pop()
            opened[x] -= 1
            if x == name:
                return was
    while at < n:
        found = _TAG.search(html, at)
        if not found:
            piece.append(html[at:])
            break
        if found.start() > at:
            piece.append(html[at:found.start()])
        at = found.end()
        if not found.group(2):
            continue
        name = found.group(2).lower()
        if name in RAW:
            if not found.group(1) and not found.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if name in INLINE:
            if name == "br":
                piece.append(" ")
            elif not found.group(1) and _is_furniture(name, found.group(3), False):
                close()
                enter(name, state)
                state = DROP
            elif found.group(1) and opened[name]:
                close()
                state = leave(name)
            continue
        close()
        if not found.group(1) and stack and stack[-1][0] == "p":
            state = leave("p")
        if found.group(1):
            if opened[name]:
                state = leave(name)
        elif name not in VOID and not found.group(3).endswith("/") and name != "p":
            enter(name, state)
            if state != DROP:
                in_content = state == KEEP
                state = DROP if _is_furniture(name, found.group(3), in_content) else KEEP if name in CONTENT else state
        elif name == "p" and state != DROP and _is_furniture(name, found.group(3), False):
            enter(name, state)
            state = DROP
    close()
    return out


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of a and b.

    Equal ends are taken as they are.  Between them few matching places are joined to rising runs one by one; where
    lines repeat so often that they are many, rows of 64 places are worked off at a time, halving ``a`` (Hirschberg).
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _between(a[head:len(a) - tail], b[head:len(b) - tail])
    return [*range(head), *(i + head for i in inner), *range(len(a) - tail, len(a))]


def _between(a: list, b: list) -> list[int]:
    times = Counter(b)
    matches = sum(times[x] for x in a)
    if matches <= max(100_000, 8 * (len(a) + len(b))):
        return _rising(a, b) if matches else []
    half = len(a) // 2
    left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(left + right))
    return [*_between(a[:half], b[:cut]), *(i + half for i in _between(a[half:], b[cut:]))]


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a and each beginning of b, the places of b being bits of one number."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    masks: dict = {}
    ones = (1 << len(b)) - 1
    row = ones
    for x in a:
        if x not in where:
            continue
        mask = masks.get(x)
        if mask is None:
            if len(where[x]) == 1:
                mask = 1 << where[x][0]
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[where[x]] = 1
                mask = masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        hit = row & mask
        row = (row + hit | row - hit) & ones
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _rising(a: list, b: list) -> list[int]:
    """The same by longest rising runs of matching places."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    tails: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            entry = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(entry)
            else:
                ends[k] = j
                tails[k] = entry
    out, entry = [], tails[-1] if tails else None
    while entry:
        out.append(entry[0])
        entry = entry[1]
    return out[::-1]


def _nearness(a: str, b: str) -> int:
    """How many leading path segments, then characters, two paths share."""
    x, y = a.split("/"), b.split("/")
    n = next((i for i, (s, t) in enumerate(zip(x, y)) if s != t), min(len(x), len(y)))
    m = next((i for i, (s, t) in enumerate(zip(a, b)) if s != t), min(len(a), len(b)))
    return n << 32 | m


def main_text(pages: DataFrame, rows_each: int = 8192) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html): blocks joined by line feeds, "" if none is left.

    An address is the path with the query behind it.  A page's partner is the address before or behind its own among
    the distinct addresses of its host in order of path and query, the nearer one (the one before on ties); the page
    with the lowest id stands for an address (of several, that with the lowest line hashes).  A page without partner
    loses only what the markup says.  Null html is empty; a null url has an empty host.  Rows of one address are never
    each other's partners.
    """
    host, path = url_reputation.host_of(F.col("url")), url_reputation.path_of(F.col("url"))
    query = F.regexp_extract(url_reputation.rest_of(F.col("url")), r"^[^?#]*(\?[^#]*)", 1)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"), F.concat(path, query).alias("address"),
                        F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0").alias("number"), F.concat_ws("\u0001", host, path, query).alias("key"))
    schema = pages.select("page_id", "url", F.lit("").alias("text")).schema
    buckets = ordered.cut(rows.select("key").distinct(), rows_each)
    if not len(buckets):
        return pages.sparkSession.createDataFrame([], schema)
    cut = rows.mapInArrow(tx.tidy_batches(_parse), pages.select("page_id", "url").schema.simpleString()[7:-1].replace(":", " ") + ", host string, address string, number string, key string, text binary, size int, states binary, outside binary")
    each = cut.groupBy("key", "host", "address").agg(F.min(F.struct("number", "outside"))["outside"].alias("outside")).withColumn("bucket", buckets.number(F.col("key")))
    # The ends of a bucket go to the buckets beside it too; keys are distinct, so no partner stands further off.
    here, last = F.col("bucket"), len(buckets) - 1
    to = F.array_compact(F.array(
        F.struct(here.alias("bucket"), F.lit(True).alias("own")),
        F.when((F.col("key") == buckets.lowest(here)) & (here > 0), F.struct((here - 1).alias("bucket"), F.lit(False).alias("own"))),
        F.when((F.col("key") == buckets.highest(here)) & (here < last), F.struct((here + 1).alias("bucket"), F.lit(False).alias("own")))))
    each = each.withColumn("to", F.explode(to)).select("to.bucket", "to.own", "key", "host", "address", "outside")
    partners = each.groupBy("bucket").applyInArrow(tx.tidy_table(_partners), "key string, partner binary")
    both = cut.join(partners, "key", "left").select("page_id", "url", "text", "size", "states", "outside", "partner")
    return both.mapInArrow(tx.tidy_batches(_difference), schema)


def _parse(batches):
    for batch in batches:
        texts, sizes, states, outside = [], [], [], []
        for html in batch.column("html").to_pylist():
            lines = lines_of(html)
            text = "\n".join(t for s, t in lines if s != DROP).encode()
            sizes.append(len(text))
            texts.append(pa.compress(text, "zstd", asbytes=True))
            states.append(bytes(s for s, _ in lines))
            other = [t.encode() for s, t in lines if s != KEEP]
            ends = np.cumsum([len(t) for t in other], dtype=np.int64)
            outside.append(tx.span_hashes(np.frombuffer(b"".join(other), np.uint8), np.concatenate(([0], ends[:-1])), ends).tobytes() if other else b"")
        yield pa.record_batch(
            [*(batch.column(n) for n in ("page_id", "url", "host", "address", "number", "key")), pa.array(texts, pa.binary()), pa.array(sizes, pa.int32()),
             pa.array(states, pa.binary()), pa.array(outside, pa.binary())],
            ["page_id", "url", "host", "address", "number", "key", "text", "size", "states", "outside"])


def _partners(table: pa.Table) -> pa.Table:
    """For each address of a bucket, the line hashes of the page that stands for the nearer one beside it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["key"].encode())
    out = []
    for i, row in enumerate(rows):
        if row["own"]:
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j]["host"] == row["host"]]
            partner = max(near, key=lambda j: (_nearness(row["address"], rows[j]["address"]), j < i), default=None)
            out.append((row["key"], None if partner is None else rows[partner]["outside"]))
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.binary()))], ["key", "partner"])


def _difference(batches):
    for batch in batches:
        out = []
        for row in batch.select(["text", "size", "states", "outside", "partner"]).to_pylist():
            shared = set(common(np.frombuffer(row["outside"], np.int64).tolist(), np.frombuffer(row["partner"] or b"", np.int64).tolist()))
            lines = pa.decompress(row["text"], decompressed_size=row["size"], codec="zstd", asbytes=True).decode().split("\n") if row["size"] else []
            kept, at, place = [], 0, 0
            for state in row["states"]:
                if state != KEEP:
                    gone = place in shared
                    place += 1
                if state == KEEP or state == OPEN and not gone:
                    kept.append(lines[at])
                at += state != DROP
            out.append("\n".join(kept))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])
