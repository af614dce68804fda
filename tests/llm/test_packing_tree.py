"""Packing over a tree of nodes: what it loses against one best fit over everything, and that its rows are whole."""

import random

from siftwork.llm import packing

CAPACITY = 256


def test_tree_of_33_nodes_and_three_levels(spark, monkeypatch, tmp_path):
    """33 local nodes of some 1,000 pieces, 5 above them, and the root: within 0.5 % of a global best fit."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    from siftwork.llm.units import PLAIN

    monkeypatch.setattr(packing, "WINDOW", 1000)  # on the driver, which deals pieces to nodes
    letters = {c: i for i, c in enumerate(pre_tokenizers.ByteLevel.alphabet())}
    vocabulary = Tokenizer(models.BPE(letters, []))
    vocabulary.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    r = random.Random(9)
    sizes = [min(3 * CAPACITY, int(r.lognormvariate(4.0, 0.9))) for _ in range(33_000)]
    docs = spark.createDataFrame([(i, "a" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(4)
    out = packing.pack(spark, docs, vocabulary.to_str(), PLAIN, CAPACITY)
    rows = out.select("doc_id", "piece", "start", "length", "sequence_id", "offset").collect()
    assert {x.sequence_id >> 56 for x in rows} >= {1, 2, 3}  # bins of all three levels
    assert len({x.sequence_id >> 28 & (1 << 28) - 1 for x in rows if x.sequence_id >> 56 == 1}) >= 32
    ends: dict = {}
    for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= CAPACITY
    whole: dict = {}
    for x in sorted(rows, key=lambda x: (x.doc_id, x.piece)):
        assert x.start == whole.get(x.doc_id, 0)
        whole[x.doc_id] = x.start + x.length
    assert whole == {i: n + 1 for i, n in enumerate(sizes)}
    assert len(ends) <= 1.005 * len(packing.best_fit([x.length for x in rows], CAPACITY))
