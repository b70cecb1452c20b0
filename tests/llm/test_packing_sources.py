from collections import Counter

from crawlloom.llm import packing


def test_a_queue_for_each_of_many_sources(spark):
    """More sources than 2,048: each is a queue of its own, and a mixture keyed by source is held."""
    rows = [(k, f"one two three {k}", f"site{k}.test") for k in range(2500)] + [(3000 + k, "word " * 400, s) for k, s in enumerate(["big.test", "large.test"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(docs, sequence=64, window=400, weights={"big.test": 3.0, "large.test": 1.0}).select("doc_id", "queue", "window_id", "length").collect()
    source = {k: s for k, _, s in rows}
    assert all(r.queue == source[r.doc_id] for r in out) and {r.queue for r in out} == set(source.values())
    sent = Counter()
    for r in out:
        sent[r.queue, r.window_id] += r.length
    assert all(295 <= sent["big.test", k] <= 301 and 95 <= sent["large.test", k] <= 101 for k in range(2))
