"""The decontamination join by shuffle and by broadcast, hot tokens, clashing columns."""

import random

from pyspark.sql import functions as F

from tillroll.llm import decontaminate
from tillroll.llm.ship import ship


def brute(docs, items, n):
    windows = {}
    for i, x in items:
        w = x.lower().split()
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, x in docs:
        w, hit, found = x.lower().split(), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= owners
        out.append((d, len(w), sorted(hit), sorted(found)))
    return out


def test_hot_token_shuffled_and_broadcast(spark, monkeypatch):
    ship(spark)
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(12)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(30)
    docs = [(i, make(rng.randrange(60)) + " " + passage + " " + make(9)) for i in range(25)] + [(100 + i, passage) for i in range(40)]
    docs += [(200 + i, make(rng.randrange(80))) for i in range(60)]
    items = [(1, passage), (2, passage), (3, make(4) + " " + passage[:60]), (4, "v1 v2"), (5, make(40)), (6, make(3))]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k1", F.lit("mine")).withColumn("_k2", F.lit(1)).withColumn("common", F.lit(True)).repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (10, 4, 1):
        want = brute(docs, items, n)
        for bound in (decontaminate.MAX_INDEX_WORDS, 0):
            monkeypatch.setattr(decontaminate, "MAX_INDEX_WORDS", bound)
            marked = decontaminate.mark(table, bench, n)
            assert marked.columns == ["doc_id", "text", "k1", "_k2", "common", "n_words", "hit_spans", "hit_items", "telling_items"]
            rows = marked.orderBy("doc_id").collect()
            assert [(r.doc_id, r.n_words, [p for s in r.hit_spans for p in range(s["from"], s["to"])], r.hit_items) for r in rows] == want
            assert all(a["to"] < b["from"] for r in rows for a, b in zip(r.hit_spans, r.hit_spans[1:]))
            monkeypatch.undo()


def test_saturated_filter(spark, monkeypatch):
    docs = [(i, f"one two three four five six {i}") for i in range(30)]
    items = [(1, "two three four five"), (2, "six 7"), (3, "absent here")]
    monkeypatch.setattr(decontaminate, "BITS", 64)
    rows = decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, [p for s in r.hit_spans for p in range(s["from"], s["to"])], r.hit_items) for r in rows] == brute(docs, items, 10)
