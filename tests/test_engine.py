import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import rank, text
from siftwork.functions.embed import HashingEmbedder
from siftwork.operators.store import ChunkStore
from siftwork.plans.api import Engine, Settings, preview
from siftwork.sources import folder as source
from siftwork.streaming.watch import Watcher


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "my_proj"
    root.mkdir()
    (root / ".gitignore").write_text("out/\n*.log\n!keep.log\n")
    (root / "a.rs").write_text("fn parse_header(x: u8) { x }\n\nfn other() {}\n")
    (root / "b.md").write_text("# Title\nThe parse header function reads a header. Other text here.\n")
    (root / "c.log").write_text("x")
    (root / "keep.log").write_text("kept")
    (root / "Cargo.lock").write_text("x")
    (root / "blank.txt").write_text(" \n")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "out").mkdir()
    (root / "out" / "x.txt").write_text("x")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    return store, Watcher(spark, store, HashingEmbedder(64), f"file://{tmp_path}/cp")


def test_listing_and_guards(tree):
    names = {os.path.basename(p) for p, _, _ in source.walk(str(tree))}
    assert names == {"a.rs", "b.md", "keep.log", "blank.txt", "bad.txt"}
    assert source.count_files(str(tree), 3) == 4
    assert source.too_broad("/") and source.too_broad("") and not source.too_broad(str(tree))


def test_scan_search_and_purge(spark, tree, engine, tmp_path):
    store, watch = engine
    state = watch.scan(str(tree))
    assert state["failed_count"] == 2 and state["indexed"] == 3
    assert [(os.path.basename(x["path"]), x["problem"]) for x in state["failed"]] == [("bad.txt", "is not UTF-8 text"), ("blank.txt", "has no text")]
    e = Engine(store, HashingEmbedder(64), Settings(f"{tmp_path}/settings.json"))
    got = json.loads(e.tool_search("parse_header", top_k=2))
    assert len(got["results"]) == 2 and got["results"][0]["path"].endswith(("a.rs", "b.md")) and got["citations"] == []
    assert json.loads(e.tool_search("what does the parse header function do?"))["citations"]
    app = e.app_search("parse_header")["results"]
    assert app[0]["exact_match"] and len({(r["path"], r["start_line"]) for r in app}) == len(app)
    path = os.path.realpath(tree / "a.rs")
    assert all((r["path"], r["start_line"]) != (path, 1) for r in json.loads(e.tool_find_similar(path, 1))["results"])
    with pytest.raises(KeyError):
        e.tool_find_similar(path, 99)
    assert json.loads(e.tool_check_doc_drift(os.path.realpath(tree / "b.md"), 1, stale_threshold=0.0))["likely_stale"] is False
    (tree / "a.rs").write_text("fn parse_header(x: u8) { x }\n")
    before = store.row_count()
    watch.scan(str(tree))
    assert store.row_count() == before - 1
    store.delete_under(str(tree.parent / "my-proj"))
    assert store.row_count() == before - 1
    store.delete_under(os.path.realpath(tree))
    assert store.row_count() == 0


def test_second_scan_embeds_what_changed(spark, tree, engine):
    store, watch = engine
    for name in ("blank.txt", "bad.txt"):
        (tree / name).unlink()
    first = watch.scan(str(tree))
    rows, versions = sorted(store.read().collect()), len(list((tree.parent).glob("**/MANIFEST-*.json")))
    broken = HashingEmbedder(64)
    broken.max_tokens = "none"  # any text fails
    watch.embedder = broken
    assert watch.scan(str(tree)) == first and first["indexed"] == first["total"]
    assert sorted(store.read().collect()) == rows and len(list((tree.parent).glob("**/MANIFEST-*.json"))) == versions
    (tree / "b.md").unlink()  # a file less needs no vector either
    assert watch.scan(str(tree))["total"] == first["total"] - 1
    assert not store.read().filter(F.col("path").endswith("b.md")).count()
    later = os.stat(tree / "a.rs").st_mtime + 10
    os.utime(tree / "a.rs", (later, later))
    with pytest.raises(Exception, match="slice"):
        watch.scan(str(tree))
    watch.embedder = HashingEmbedder(64)
    watch.scan(str(tree))
    assert {r.mtime for r in store.read().filter(F.col("path").endswith("a.rs")).collect()} == {int(later)}


def test_stream_edits_and_deletes(spark, tree, engine):
    store, watch = engine
    q = watch.start(str(tree))
    q.processAllAvailable()
    assert store.read().filter(F.col("path").endswith("a.rs")).count() == 2
    os.utime(tree / "a.rs")
    (tree / "a.rs").write_text("fn only() {}\n")
    (tree / "b.md").unlink()
    q.processAllAvailable()
    rows = {(os.path.basename(r.path), r.name) for r in store.read().collect()}
    assert ("a.rs", "only") in rows and not any(p == "b.md" for p, _ in rows)
    watch.stop(str(tree))
    assert store.row_count() == 0


def test_watched_folders_outlive_the_process(spark, tree, tmp_path):
    settings = Settings(f"{tmp_path}/s.json")
    store = ChunkStore(spark, f"file://{tmp_path}/kept")
    Watcher(spark, store, HashingEmbedder(64), f"file://{tmp_path}/cp", settings=settings).scan(str(tree))
    later = Watcher(spark, store, HashingEmbedder(64), f"file://{tmp_path}/cp", settings=settings)
    assert later.watched() == [os.path.realpath(tree)]
    later.use_model(HashingEmbedder(32))
    assert {r.model for r in store.read().select("model").collect()} == {"hashing-32"} and settings.get("embedding_model") == "hashing-32"
    settings.set("watched_folders", [str(tmp_path / "gone")])
    assert list(Watcher(spark, store, HashingEmbedder(64), f"file://{tmp_path}/cp", settings=settings).resume()) == [str(tmp_path / "gone")]
    later.stop(str(tree))
    assert store.row_count() == 0


def test_old_tables_are_backfilled(spark, engine):
    store, _ = engine
    old = spark.createDataFrame([("/f/a", 1, 2, "file", "x", [0.5])], "path string, start_line int, end_line int, chunk_kind string, content string, embedding array<float>")
    store.import_table("/f", old)
    r = store.read().first()
    assert (r.name, r.truncated, r.mtime) == ("", False, 0)


def test_vacuum_keeps_the_current_version(spark, engine, tmp_path):
    store, _ = engine
    for k in range(3):
        store.import_table("/f", spark.createDataFrame([(f"/f/{k}", 1, 2, "file", "x", [1.0])], "path string, start_line int, end_line int, chunk_kind string, content string, embedding array<float>"))
    files = lambda kind: [p.name for p in (tmp_path / "store").glob(kind)]
    assert len(files("MANIFEST-*.json")) == 3 and len(files("v-*")) == 3
    store.vacuum()
    assert files("MANIFEST-*.json") == ["MANIFEST-000000000003.json"] and len(files("v-*")) == 1
    assert [r.path for r in store.read().collect()] == ["/f/2"]
    store.delete_under("/f")
    assert store.row_count() == 0 and sorted(files("MANIFEST-*.json"))[-1] == "MANIFEST-000000000004.json"


def test_columns(spark):
    rows = [("What?", "# H\nA b. Cd e! x.y\n\nlast"), ("is", "no"), ("island", ""), (" how to ", "é."), ("", "x"), (None, "y")]
    got = spark.createDataFrame(rows, "q string, t string").select("q", text.is_question(F.col("q")).alias("a"), text.sentences(F.col("t")).alias("s")).collect()
    assert [r.a for r in got] == [True, True, False, True, False, False]
    assert [text.question(r.q or "") for r in got] == [r.a for r in got]
    assert got[0].s == ["A b.", "Cd e!", "last"]
    one = spark.range(1).select(text.truncate_content(F.lit("éabc"), 2).alias("t"), text.line_range(F.lit("a\nb\nc\n"), F.lit(2), F.lit(9)).alias("l"), text.extension(F.lit("/x/.md")).alias("e"), rank.dot(F.array(F.lit(-1.0)), F.array(F.lit(1.0))).alias("d"), text.line_of(F.lit("a\nbc"), F.lit("bc")).alias("n")).first()
    assert one.t.startswith("éa\n… [truncated, 2 more") and (one.l, one.e, one.d, one.n) == ("b\nc", "", 0.0, 2)


def test_fuzzy():
    assert rank.fuzzy_raw("main.rs", "xyz") == 0 and rank.fuzzy_raw("a.rs", "") == 0
    assert rank.fuzzy_raw("main.rs", "main") > rank.fuzzy_raw("my_a_i_n.rs", "main") > 0


def test_settings_and_preview(tmp_path):
    s = Settings(f"{tmp_path}/s.json")
    s.set("embedding_model", "m")
    assert s.get("embedding_model") == "m" and s.weights() == rank.RankingWeights()
    (tmp_path / "f").write_text("a\nb\nc")
    assert preview(f"{tmp_path}/f", 2, 9) == "b\nc" and preview(f"{tmp_path}/f", 9, 10) == ""


def test_terms_on_the_driver_are_those_of_the_column(spark):
    texts = ["हिन्दी भाषा", "fooBar_baz-Qux", "ça va ² ½ ab", "İstanbul ΣΑΣ", "naïve café", "", "日本語 テキスト", "a\u0301bc x\u00adyz"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.query_terms(F.col("t")).alias("x")).collect()
    assert [text.terms(r.t) for r in got] == [r.x for r in got]


def test_helpers(tree, tmp_path):
    from siftwork.functions import embed
    from siftwork.plans.api import default_paths

    assert source.suggestions(f"{tree}/O") == [f"{tree}/out"] and source.suggestions("/nowhere/x") == []
    with pytest.raises(TimeoutError):
        source.count_files(str(tree), seconds=-1)
    assert default_paths("/h")["settings"] == "/h/.siftwork/settings.json"
    e = Engine(None, HashingEmbedder(64))
    assert e.find_line_in(str(tree / "b.md"), "what does the parse header function read") == 2 and e.find_line_in(str(tmp_path / "none"), "x") == 1
    got = embed.pooled(np.array([[[3.0, 0.0], [0.0, 3.0], [9.0, 9.0]], [[0.0, 2.0], [5.0, 5.0], [5.0, 5.0]]]), np.array([[1, 1, 0], [1, 0, 0]]))
    assert np.allclose(got, [[0.5**0.5, 0.5**0.5], [0, 1]])


def test_masked_batches(monkeypatch):
    """Batches of texts of several lengths give the vectors of each text alone."""
    from siftwork.functions import embed

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask", "token_type_ids")]

        def run(self, _, feed):
            ids = feed["input_ids"]
            return [np.stack([ids + 1.0, ids**2.0], axis=2)]

    class Words:
        def encode_batch(self, texts):
            return [type("E", (), {"ids": [len(w) for w in t.split()]}) for t in texts]

    e = embed.OnnxEmbedder("/m", max_tokens=3, batch=2)
    e._loaded = (Session(), Words())
    texts = ["a", "", "bb a ccc dd", "a bb", None]
    assert e.embed_many(texts) == [e.embed(t) for t in texts] and [x for _, x in e.embed_many(texts)] == [False, False, True, False, False]


def test_editor_links(spark):
    from siftwork.plans.api import editor_link

    assert spark.range(1).select(editor_link("x://{path}:{line}", F.lit("/a b"), F.lit(7)).alias("l")).first().l == "x:///a b:7"


def test_similarity_is_dot(spark):
    rows = [([1.0, 2.0],), ([-1.0, 0.0],), ([1.0],), (None,), ([],), ([float("nan"), 1.0],), ([0.5, None],)]
    df = spark.createDataFrame(rows, "e array<float>")
    for q in ([1.0, 0.5], []):
        got = df.select(rank.similarity(F.col("e"), q).alias("a"), F.coalesce(rank.dot(F.col("e"), rank.vector(q)), F.lit(0.0)).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
