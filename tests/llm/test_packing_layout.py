"""packing: the sequences do not depend on how rows lie in partitions."""

from siftwork.llm import packing

DOCS = "doc_id long, text string"


def test_lengths_by_partition(spark):
    """Documents of some 1200 and 800 tokens lie apart; each sequence holds one of both."""
    rows = [(i, "a " * 1199 + "a") for i in range(100)] + [(100 + i, "a " * 799 + "a") for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    assert docs.rdd.getNumPartitions() > 1
    found = []
    for layout in (docs, docs.coalesce(1), docs.repartition(7)):
        got = packing.pack_documents(spark, layout).collect()
        assert sorted(r.doc_id for r in got) == list(range(200))
        bins: dict = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
        for parts in bins.values():
            parts.sort()
            assert [p[0] for p in parts] == [sum(p[1] for p in parts[:k]) for k in range(len(parts))]
            assert sum(p[1] for p in parts) <= packing.CAPACITY
        short, long = (max(r.length for r in got if (r.doc_id >= 100) == s) for s in (True, False))
        assert 1024 < long and short + long <= packing.CAPACITY
        found.append(sorted(sorted(p[2] for p in parts) for parts in bins.values()))
    assert [len(x) for x in found] == [100] * 3
    assert found[0] == found[1] == found[2]
