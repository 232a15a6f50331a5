"""Clusters by falling overlap settle in a few rounds, whatever the number of links of one span."""

import random

from strandline.operators import episodes
from strandline.sources.scratch import Scratch
from tests.test_plans import one_by_one


def test_rounds_do_not_grow_with_the_links_of_a_span(spark, monkeypatch):
    written = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: written.append(1) or save(self, df))
    rnd = random.Random(8)
    # long spans over many short ones: each of these links is the best that the short span has
    rows = [(o, 1000 * o + i, lo := i * 7 % 290, lo + 4 + i % 3, rnd.choice([None, "run", "walk"])) for o in range(2) for i in range(60)]
    rows += [(o, 1000 * o + 500, 0, 300, "run") for o in range(2)]
    df = spark.createDataFrame(rows, "owner long, id long, lo long, hi long, sport string")
    got = {r.id: r.cluster for r in episodes.best_first_clusters(df, ["owner"], 0.5, "sport").collect()}
    assert got == one_by_one(rows, 0.5)
    assert len(written) < 80  # one by one: a round of four tables for each short span
