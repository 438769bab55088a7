from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from caremeter.llm.line_dedup import drop_shared_lines

LINE = "This line is shared by many of them"
ROWS = [(1, f"a\n{LINE}\nb"), (2, f"  {LINE.upper()}\t\n{LINE}"), (3, f"{LINE}\n{LINE}\nend"), (4, None), (5, ""),
        (6, "short\nshort"), (7, "short"), (8, "short"), (9, "\n\n"), (10, "É" * 20), (11, "é" * 20), (12, "É" * 20),
        (None, f"{LINE}\nx"), (3, f"again\n{LINE}"), (1, f"a\n{LINE}\nb"),
        (20, "\n".join(f"long text number {i % 7} of line" for i in range(5000))),
        (21, "\n".join(f"long text number {i} of line" for i in range(4))), (22, "long text number 3 of line\nz")]


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -1 if i is None else i
        keep = [x for x in lines if len(holders[key(x)]) < 3 or own == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()], key=str)


def test_drops_like_brute_force(docs, sample):
    assert got(drop_shared_lines(docs(ROWS))) == brute(ROWS)
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert got(drop_shared_lines(sample)) == brute(rows)


def test_clashing_columns_and_empty_table(docs):
    df = docs(ROWS).withColumn("drop", F.lit(1)).withColumn("i", F.lit(9)).withColumn("n_lines", F.lit("x"))
    out = drop_shared_lines(df)
    assert got(out) == brute(ROWS) and {"drop", "i"} <= set(out.columns)
    assert drop_shared_lines(docs([])).count() == 0
