"""The store as a log, and searches that skip cells, against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import rank
from siftwork.operators import search
from siftwork.operators import store as log
from siftwork.operators.store import ChunkStore

SCHEMA = "path string, start_line int, end_line int, chunk_kind string, content string, name string, embedding array<float>, chunk_ord int"
DIM = 16


def made(spark, ids, content="chunk"):
    """Rows whose vectors lie around eight directions; the words and names of a direction are its own."""
    rows = []
    for i in ids:
        rng = np.random.default_rng(i)
        v = np.eye(DIM)[i % 8] + rng.normal(0, 0.03, DIM)
        rows.append((f"/f/{i % 8}/name{i % 8}_{i}.rs", 1, 2, "function", f"{content} number{i} group{i % 8}", f"n{i}", (v / np.linalg.norm(v)).astype(np.float32).tolist(), 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"file://{tmp_path}/store")


def paths(df):
    return df.select("path")


def full(store, *args, **more):
    return [(r.path, r.start_line, r.score and round(r.score, 9)) for r in search.hybrid_search(store.read(), *args, **more).collect()]


def bounded(store, *args, **more):
    return [(r.path, r.start_line, r.score and round(r.score, 9)) for r in store.search(*args, **more).collect()]


def test_bounded_search_is_the_full_scan(spark, store):
    odd = [("/f/o/null.rs", 1, 1, "file", "group1", "", None, 0), ("/f/o/short.rs", 1, 1, "file", "group1 chunk", "", [1.0, 2.0], 0), ("/f/o/nan.rs", 1, 1, "file", "group1", "", [float("nan")] * DIM, 0),
           ("/f/o/zero.rs", 1, 1, "file", "group2", "", [0.0] * DIM, 0), ("/f/o/long.rs", 1, 1, "file", "x", "", [9.0] * DIM, 0), ("/f/o/none.rs", 1, 1, "file", None, "", [1.0] + [0.0] * (DIM - 1), 0)]
    store.import_table("/f", made(spark, range(800)).unionByName(spark.createDataFrame(odd, SCHEMA)))
    store.optimize(per_cell=25)
    asked = np.eye(DIM)[1].tolist()
    cases = [
        (("what is group1 chunk?", asked, 10), {}), (("name1", asked, 10), {}), (("group3", asked, 7), {"as_question": False}), (("zzz", [0.0] * DIM, 5), {}), (("group1", [1.0, 2.0], 3), {}), (("", asked, 4), {}),
        (("name1", asked, 10), {"folder": "/f/2"}), (("what is group1?", asked, 10), {"exclude": "/f/1"}), (("name2", asked, 9), {"weights": rank.RankingWeights(0.4, -0.2, 0.5)}), (("name2", asked, 2000), {}),
    ]
    for args, more in cases:
        assert bounded(store, *args, **more) == full(store, *args, **more), (args[0], more)
    assert bounded(store, *cases[0][0]) and store.last_search["cells_read"] < store.last_search["cells"] / 2
    # Deltas count for rows of cells that they replace, and are searched themselves.
    best = store.search(*cases[0][0]).select("path").limit(3)
    store.replace("/f", spark.createDataFrame(best.collect(), "path string"), made(spark, [9]))
    store.replace("/f", paths(made(spark, [17, 25])), made(spark, [25], "chunk again"))
    for args, more in cases:
        assert bounded(store, *args, **more) == full(store, *args, **more), (args[0], more)


def test_scores_read_no_content(spark, store):
    store.import_table("/f", made(spark, range(20)))
    rows = store._live(store._manifest()[1])
    plan = search.top(rows.withColumn("score", search.hybrid_score(rows, "group1 chunk", [1.0] * DIM, rank.RankingWeights(), True)), 3).select("path", "score")
    schema = plan._jdf.queryExecution().toString().split("ReadSchema: ")[-1].split("\n")[0]
    assert "terms" in schema and "content" not in schema
    assert [r.score for r in rows.select(rank.stored_overlap("Number3 é chunk", F.col("terms")).alias("score")).collect()] == [r.score for r in rows.select(rank.overlap("Number3 é chunk", F.col("content")).alias("score")).collect()]


def test_an_edit_writes_one_small_delta(spark, store, tmp_path):
    store.import_table("/f", made(spark, range(100)))
    base = store._manifest()[1]["/f"][0]
    store.replace("/f", paths(made(spark, [4])), made(spark, [4], "edited"))
    segments = store._manifest()[1]["/f"]
    assert segments[0] == base and len(segments) == 2 and spark.read.parquet(segments[1]["rows"]).count() == 1
    assert store.row_count() == 100 and store.read().filter("content LIKE 'edited%'").count() == 1
    store.delete_under("/f/3")
    assert store.row_count() == 87 and store._manifest()[1]["/f"][0] == base
    store.delete_under("/f/none")
    assert len(store._manifest()[1]["/f"]) == 3


def test_deltas_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(log, "MAX_DELTAS", 2)
    store.import_table("/f", made(spark, range(40)))
    base = store._manifest()[1]["/f"][0]
    want = {r.path: r.content for r in made(spark, range(40)).collect()}
    for i in range(5):
        new = made(spark, [i, i + 1], f"v{i}")
        store.replace("/f", paths(made(spark, [i, i + 1, 30 + i])), new)
        want |= {r.path: r.content for r in new.collect()}
        want.pop(made(spark, [30 + i]).first().path, None)
        assert {r.path: r.content for r in store.read().collect()} == want
        assert len(store._manifest()[1]["/f"]) <= 3 and store._manifest()[1]["/f"][0] == base
    monkeypatch.setattr(log, "MAX_GONE", 3)
    store.replace("/f", paths(made(spark, [39])), made(spark, []))
    want.pop(made(spark, [39]).first().path)
    assert len(store._manifest()[1]["/f"]) == 1 and {r.path: r.content for r in store.read().collect()} == want
    store.vacuum()
    assert {r.path: r.content for r in store.read().collect()} == want


def test_a_writer_that_comes_second_loses_nothing(spark, store, monkeypatch):
    store.import_table("/f", made(spark, range(20)))
    other = ChunkStore(spark, store.root)
    create, late = ChunkStore._create, []

    def slow(self, number, parts):
        """Another writer publishes between this one's reading of the manifest and its publishing."""
        if self is store and not late:
            late.append(number)
            other.replace("/f", paths(made(spark, [1, 2])), made(spark, [1], "other"))
            other.import_table("/g", made(spark, [50]))
        return create(self, number, parts)

    monkeypatch.setattr(ChunkStore, "_create", slow)
    store.replace("/f", paths(made(spark, [2, 3])), made(spark, [2, 3], "mine"))
    got = {r.name: r.content.split(" ")[0] for r in store.read().collect()}
    assert (got["n1"], got["n2"], got["n3"], got["n50"], len(got)) == ("other", "mine", "mine", "chunk", 21)
    late.clear()
    store.optimize("/f")  # gives up, as the other writer's delta would follow another base: nothing is lost
    got = {r.name: r.content.split(" ")[0] for r in store.read().collect()}
    assert (got["n1"], "n2" in got, got["n3"], len(got)) == ("other", False, "mine", 20)


def test_versions_of_before_the_log_are_read(spark, store, tmp_path):
    old = f"{store.root}/v-old"
    made(spark, range(5)).drop("name", "chunk_ord").withColumn("folder", F.lit("/f")).write.parquet(old)
    out = store._fs.create(store._path(f"{store.root}/MANIFEST-000000000001.json"))
    out.write(bytearray(('{"parts": {"/f": "%s"}}' % old).encode()))
    out.close()
    assert store.row_count() == 5 and bounded(store, "group1", np.eye(DIM)[1].tolist(), 3) == full(store, "group1", np.eye(DIM)[1].tolist(), 3)
    store.replace("/f", paths(made(spark, [1])), made(spark, [1], "new"))
    assert store.row_count() == 5 and bounded(store, "new group1", np.eye(DIM)[1].tolist(), 3) == full(store, "new group1", np.eye(DIM)[1].tolist(), 3)


def test_empty_parts(spark, store):
    assert store.search("x", [1.0], 3).count() == 0
    store.import_table("/f", made(spark, []))
    store.optimize()
    assert store.row_count() == 0 and store.search("x", [1.0], 3).count() == 0 and store.search("x", [1.0], 0).count() == 0
