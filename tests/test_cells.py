"""Clusters by falling overlap never list the links that they are made of."""

import random

from strandline.operators import episodes
from strandline.sources.scratch import Scratch
from tests.test_plans import one_by_one

COLUMNS = "owner long, id long, lo long, hi long, sport string"


def test_rows_written_grow_with_the_spans_and_not_with_their_links(spark, monkeypatch):
    written, save = [], Scratch.save

    def counted(self, df):
        out = save(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rnd = random.Random(3)
    rows = [(0, i, lo := rnd.randrange(3000), lo + rnd.randrange(2000, 4000), rnd.choice([None, "run", "walk"])) for i in range(400)]
    got = {r.id: r.cluster for r in episodes.best_first_clusters(spark.createDataFrame(rows, COLUMNS), ["owner"], 0.3, "sport").collect()}
    assert got == one_by_one(rows, 0.3)
    assert max(written) <= 2 * len(rows)  # there are more than 40,000 links


def test_spans_of_many_cells_and_those_without_length_or_key(spark):
    rnd = random.Random(11)
    rows = [(o, 1000 * o + i, lo := rnd.randrange(-30, 400), lo + rnd.choice([0, 1, 5, 30, 200]), rnd.choice([None, None, "run", "walk"])) for o in range(3) for i in rnd.sample(range(1000), 60)]
    odd = [(None, 9001, 0, 10, None), (None, 9002, 0, 10, None), (1, 9003, None, 10, "run")]
    found = episodes.best_first_clusters(spark.createDataFrame(rows + odd, COLUMNS), ["owner"], 0.5, "sport", size=7)
    assert {r.id: r.cluster for r in found.collect()} == one_by_one(rows, 0.5) | {9001: 9001, 9002: 9002, 9003: 9003}
    assert episodes.best_first_clusters(spark.createDataFrame([(1, 1, 0, 9, None), (1, 2, 0, 9, None)], COLUMNS), ["owner"], 0.5, "sport").where("cluster = 1").count() == 2
