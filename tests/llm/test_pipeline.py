from collections import Counter, defaultdict

import corpus_pipeline as cp
from brute import WORD, near
from strandline.llm.mixing import targets
from strandline.llm.pieces import Vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id in (3, 4)")).union(docs.sparkSession.createDataFrame([(9001, None, None, None, 0), (9002, "12 34", "en", "src0", 5), (9003, "", None, "src1", 0)], docs.schema))
    before = docs.collect()
    kept = None
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == cp.COLUMNS
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            after = docs.collect()
            assert all(r.n_chars == len(r.text) for r in after if k)
        if name == "language id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {9001, 9002, 9003}
            assert len(after) >= 0.98 * (len(before) - 3)
        elif name == "line dedup":
            total, seen = Counter(r.source for r in before), defaultdict(set)
            for i, r in enumerate(before):
                for line in r.text.split("\n"):
                    seen[r.source, line.strip(" ")].add(i)
            want = []
            for r in before:
                keep = [x for x in r.text.split("\n") if not x.strip(" ") or len(seen[r.source, x.strip(" ")]) < 5 or len(seen[r.source, x.strip(" ")]) <= 0.1 * total[r.source]]
                want.append((r.doc_id, "\n".join(keep)))
            assert sorted(want) == sorted((r.doc_id, r.text) for r in after)
        elif name == "near-dedup":
            comp = near([(r.doc_id, r.text) for r in before], 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in comp.items() if i == c)
            kept = after
        elif name == "mixing":
            size = defaultdict(int)
            for r in kept:
                size[r.source] += len(WORD.findall(r.text))
            order = sorted(size)
            goal = targets([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
            got = defaultdict(int)
            for r in after:
                got[r.source] += len(WORD.findall(r.text))
            assert dict(got) == {s: int(t + 0.5) for s, t in zip(order, goal, strict=True) if int(t + 0.5)}
            whole = {r.doc_id: r.text for r in kept}
            assert all(r.text in whole[r.doc_id] for r in after)
        else:
            v = Vocabulary.load()
            import numpy as np

            got = out.collect()
            assert Counter((r.doc_id, v.decode(np.array(r.tokens))) for r in got) == Counter((r.doc_id, r.text) for r in before)
            assert all(r.n_tokens == len(r.tokens) for r in got)
        before = after


def test_run_and_empty_documents(spark):
    assert cp.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_lines_in_a_twentieth_of_a_source_go(spark):
    rows = [(i, f"own line {i}\n" + ("said again" if i % 20 == 0 else "four times" if i < 5 else f"other {i}"), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.line_frequency(spark, docs, SF).collect()}
    assert got == {i: f"own line {i}" if i % 20 == 0 else t for i, t, *_ in rows}
