"""What near copies hold on disk: keys travel in parts, and written copies go as soon as nothing reads them."""

import random

from pyspark.sql import functions as F

from lodestone.llm import jaccard
from lodestone.sources import scratch


def written(spark):
    """Rows that each stage so far has written to its shuffle."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    found = store.stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None)
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}


def test_keys_are_neither_shuffled_at_once_nor_kept(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ONCE", 0, raising=False)
    rng = random.Random(7)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(300)]
    texts += [texts[0] + " more", texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drawn = jaccard.sketch(docs, 5, 80)
    keys = drawn.agg(sum(F.sum(F.size(c)) for c in drawn.columns if c.startswith("keys"))).first()[0]
    before = written(spark)
    found = jaccard.jaccard_groups(docs, 5, 80)
    most = max(v for k, v in written(spark).items() if k not in before)
    assert 0 < most < keys / 2
    assert not any(f"/{label}-" in path for path in scratch._WRITTEN for label in ("sketch", "rows", "reps", "copies", "families"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {k: {300: 0, 301: 1}.get(k, k) for k in range(302)}
