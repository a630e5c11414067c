import re
from collections import defaultdict

from tabsmith.llm import line_dedup

LONG = "This line stands in very many documents, É and all."


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m.group().lower(), bare)


def by_hand(rows, least_chars=40, least_docs=5):
    places = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                places[key_of(line)].add(i)
    least = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=least) for k, ids in places.items() if len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == i]
        out.append((i, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def rows_of_lines(rows):
    odd = [f"a\n{LONG}\n\nb", f"\t {LONG.upper().replace('É', 'É')}\r\nend", LONG, f"{LONG}\n{LONG}\n", "\n", f"x\n{LONG[:39]}", f"{LONG[:39]}\n" * 3,
           f"{LONG.replace('É', 'é')}", f"\x0b{LONG} \x0c"]
    more = [(100 + i, t) for i, t in enumerate(odd)] + [(200 + i, f"{LONG[:40]}\nown {i}") for i in range(5)] + [(300 + i, f"{LONG[1:40]}0") for i in range(4)]
    more += [(None, LONG), (None, f"{LONG}\nnull"), (104, LONG), (104, LONG), (103, f"{LONG}\n{LONG}\n")]
    long = [(400, "\n".join(f"line {i % 7000} of a very long text, which has many of them" for i in range(60_000)))]
    copies = [(401 + i, "\n".join(f"line {j} of a very long text, which has many of them" for j in range(0, 7000, 2))) for i in range(5)]
    return list(rows) + more + long + copies


def test_lines_by_brute_force(spark, rows):
    rows = rows_of_lines(rows)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, `key.line` string, n_lines int").repartition(4)
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "key.line", "n_lines", "n_dropped"]
    found = sorted(((r[0], r[1], r[3], r[4]) for r in got.collect()), key=repr)
    assert found == by_hand(rows)
    assert sum(r[3] for r in found) > 30_000


def test_lines_other_limits_and_clashing_names(spark, docs, rows):
    got = line_dedup.drop_repeated_lines(docs, least_chars=1, least_docs=2)
    assert set(docs.columns) < set(got.columns)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == by_hand(rows, 1, 2)


def test_lines_of_an_empty_table(none):
    got = line_dedup.drop_repeated_lines(none)
    assert got.count() == 0 and got.columns[-2:] == ["n_lines", "n_dropped"]
