from collections import Counter, defaultdict

import pytest
from strandline.llm.line_dedup import drop_boilerplate, host_of, html_lines
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, text string, n_lines_old int, lines string"


def brute(rows, ratio, least):
    total, seen = Counter(), defaultdict(set)
    for k, (_, h, t) in enumerate(rows):
        total[h] += 1
        for line in (t.split("\n") if t is not None else ()):
            seen[h, line.strip(" ")].add(k)
    out = []
    for i, h, t in rows:
        old = t.split("\n") if t is not None else []
        new = [x for x in old if h is None or not x.strip(" ") or len(seen[h, x.strip(" ")]) < least or len(seen[h, x.strip(" ")]) <= ratio * total[h]]
        out.append((i, h, None if t is None else "\n".join(new), len(old), len(old) - len(new)))
    return out


def key(r):
    return str(r)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.5, 2)])
def test_equals_counting_by_hand(spark, ratio, least):
    rows = [(i, "ab"[i % 3 == 0], f"menu\n own {i}\n\n footer {i % 4} \nmenu") for i in range(60)]
    rows += [(100 + i, "small", "menu\nx") for i in range(4)] + [(200, None, "menu"), (201, None, None), (202, "a", None), (203, "a", ""), (204, "a", "menu"), (0, "b", "menu\n own 0")]
    rows += [(300, "a", "\n".join(f"line {i}" for i in range(20000)) + "\nmenu")] + [(400 + i, None, "menu") for i in range(9)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = drop_boilerplate(df, "host", "text", ratio, least).select("page_id", "host", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, ratio, least), key=key)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drop_boilerplate(df, "host", "text").count() == 0
    got = drop_boilerplate(spark.createDataFrame([(1, "a", "x", 3, "keep")], SCHEMA), "host", "text").first()
    assert got.n_lines_old == 3 and got["lines"] == "keep"
    names = ["c0", "c1", "_found", "_found_host", "_here", "_kept", "total", "line", "h1", "n_lines", "n_dropped"]
    clash = spark.createDataFrame([(1, "a", "x\ny", *["keep"] * len(names))], "page_id int, host string, text string, " + ", ".join(f"{c} string" for c in names))
    got = drop_boilerplate(clash, "host", "text")
    assert got.columns == ["page_id", "host", "text", *names[:-2], "n_lines", "n_dropped"]
    assert tuple(got.first()) == (1, "a", "x\ny", *["keep"] * (len(names) - 2), 2, 0)


def test_hosts_and_html(spark):
    df = spark.createDataFrame([("https://u@WWW.Ex.org:80/a?b#c", '<html><style>p{}</style><p class="x">one <b>two</b><br>three<!-- gone --><script>var t="</p>";</script></p> 1 < 2')], "url string, html string")
    r = df.select(host_of(F.col("url")).alias("h"), html_lines(F.col("html")).alias("t")).first()
    assert r.h == "ex.org" and [x for x in r.t.split("\n") if x] == ["one two", "three", " 1 < 2"]
