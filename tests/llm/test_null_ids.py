"""op8 with near copies that have no id."""

from __future__ import annotations

import random

from tallyforge.llm import jaccard


def test_near_copies_without_an_id_link_and_hide_no_other_link(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]

    def near(*at):
        return " ".join("edit" if i in at else w for i, w in enumerate(base))

    alone = " ".join(f"z{i}" for i in range(40))
    rows = [(4, near()), (5, near(20)), (9, near(60)), (None, near(100)), (None, near(140)), (None, alone), (None, alone + " end"), (7, "something else entirely here now")]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100).collect()
    assert sorted((r["id"] or -1, r["component"]) for r in got if r["component"] is not None) == [(-1, 4), (-1, 4), (4, 4), (5, 4), (7, 7), (9, 4)]
    apart = [r["root"] for r in got if r["component"] is None]
    assert len(apart) == 2 and len(set(apart)) == 1
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 4, 7]
