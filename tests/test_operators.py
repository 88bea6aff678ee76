import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F
from skarn.operators import chunking, evaluate, extractors, fusion, graph, lanes, snapshot
from skarn.plans.queries import QUERIES
from skarn.plans.search import search_records
from skarn.streaming.incremental import index_new_files

TEXTS = ["alpha alpha alpha", "alpha then beta", "alpha beta", "gamma é delta", "beta beta gamma", "Énorme alpha_beta"]


def records(spark, texts=TEXTS, paths=None):
    rows = [(i + 1, paths[i] if paths else f"src/f{i}.go", "text-chunk", f"src/f{i}.go:1", t, 1, t.count("\n") + 1, "core") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "record_id long, path string, kind string, title string, text string, start_line int, end_line int, source string")


@pytest.mark.parametrize(("terms", "need", "match"), [(["alpha", "beta"], "any", '"alpha" OR "beta"'), (["alpha", "beta"], "all", '"alpha" AND "beta"'), (["alpha", "beta"], "phrase", '"alpha beta"'), (["enorme"], "any", '"enorme"')])
def test_bm25_equals_fts5(spark, terms, need, match):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(path, title, text, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, path, title, text) VALUES (?, ?, ?, ?)", [(i + 1, f"src/f{i}.go", f"src/f{i}.go:1", t) for i, t in enumerate(TEXTS)])
    expected = {i: round(-s, 9) for i, s in db.execute("SELECT rowid, bm25(f, 8.0, 4.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
    got = {r["record_id"]: r["score"] for r in lanes.bm25(records(spark), terms, need).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-9 for k in got)


def test_phrase_comes_first(spark):
    found = search_records(records(spark), "alpha beta").orderBy("position").collect()
    assert found[0]["path"] == "src/f2.go" and {"exact", "all-terms", "lexical"} <= set(found[0]["retrieval"].split(","))


def test_pieces_of_long_lines_are_chunks(spark, tmp_path):
    texts = {1: "short\n" + "é" * 10_000 + "\nshort", 2: "word " * 5000, 3: "x" * 8192, 4: None, 5: "ab" * 4097}
    rows = [(i, t, "en", "src1") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for i, t in texts.items():
        for n, line in enumerate((t or "").split("\n"), 1):
            part, pieces = "", []
            for c in line if len(line.encode()) > 8192 else "":
                if len((part + c).encode()) > 8192:
                    pieces.append(part)
                    part = ""
                part += c
            for k, p in enumerate([*pieces, part] if pieces else [], 1):
                expected.add((f"en/src1/{i:08d}.txt", n, k, len(p.strip().encode()), hashlib.sha256(p.strip().encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["chunk_line_pieces"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and {r[0][-5] for r in got} == {"1", "2", "5"}


def test_prefix_reaches_the_wanted_number_of_paths(spark):
    r = records(spark, ["pear"] * 63, ["one/crowd"] * 60 + ["two", "two", "three"]).withColumn("score", F.lit(1.0))
    got = lanes.distinct_path_top(r, 2, *lanes.SCORE_KEYS).orderBy("rank").collect()
    assert [x["path"] for x in got] == ["one/crowd"] * 60 + ["three"] and [x["rank"] for x in got] == list(range(1, 62))
    assert lanes.distinct_path_top(r, 1, *lanes.SCORE_KEYS).count() == 1 and lanes.distinct_path_top(r, 9, *lanes.SCORE_KEYS).count() == 63


def test_ranks_over_many_tasks(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("p").alias("path")).repartition(7)
    got = [(r["k"], r["rank"]) for r in lanes.ranked_widely(rows, F.desc("k")).orderBy("rank").collect()]
    assert got == [(k, n) for n, k in enumerate(sorted((i * 7919 % 5003 for i in range(5000)), reverse=True), 1)]
    assert lanes.ranked_widely(rows.where("false"), F.desc("k")).count() == 0


def lane(spark, rows):
    return spark.createDataFrame(rows, "lane_id int, lane string, rank int, record_id long, path string, start_line int, kind string")


def test_fusion_and_head(spark):
    rows = [(0, "lexical", 1, 1, "orchard/alone", 1, "x"), (0, "lexical", 2, 2, "orchard/both", 1, "x"), (0, "lexical", 3, 7, "orchard/third", 1, "x"), (1, "semantic", 1, 3, "orchard/sense", 1, "x"), (1, "semantic", 2, 4, "orchard/both", 9, "x")]
    got = fusion.fuse(lane(spark, rows)).orderBy("position").collect()
    assert [r["path"] for r in got] == ["orchard/alone", "orchard/both", "orchard/sense", "orchard/third"]
    assert [r["path_score"] for r in got] == pytest.approx([1 / 11, 2 / 12, 1 / 11, 1 / 13])


def test_families_are_balanced(spark):
    rows = [(n, name, k + 1, 100 * n + k, f"crowd/{k:02d}", 1, "x") for n, name in enumerate(["exact", "all-terms", "lexical", "anchor"]) for k in range(15)] + [(9, "semantic", 1, 999, "sense/one", 1, "x")]
    got = fusion.fuse(lane(spark, rows)).orderBy("position").collect()
    assert got[0]["path"] == "crowd/00" and got[1]["path"] == "sense/one"


def test_positions():
    assert fusion.promote_third_root(["a/1", "a/2", "a/3", "a/4", "b/1", "c/1"]) == ["a/1", "a/2", "b/1", "a/3", "a/4", "c/1"]
    assert fusion.promote_third_root(["a/1", "b/2", "b/3", "c/4"]) == ["a/1", "b/2", "b/3", "c/4"]
    many = [f"x{k}" for k in range(35)]
    out = fusion.promote_graph(many, "new", 10)
    assert out[9] == "new" and out[29] == "x9" and out[35] == "x29" and sorted(out) == sorted([*many, "new"])
    assert fusion.promote_graph(many, "x3", 10) == many and fusion.promote_graph(many, "x30", 4)[3] == "x30" and fusion.promote_graph(many, "new", 1) == many


def test_graph(spark):
    files = spark.createDataFrame([(p,) for p in ("lib/gate.ts", "lib/yard.ts", "lib/wall/index.py", "bin/a", "bin/a.ts")], "path string")
    rows = [(1, "lib/yard.ts", "typescript-import", "./gate"), (2, "lib/yard.ts", "typescript-import", "leftpad"), (3, "lib/gate.ts", "typescript-function", "open"), (4, "lib/gate.ts", "typescript-export", "../lib/./wall?x=1"), (5, "bin/run", "typescript-import", "./a.b")]
    facts = spark.createDataFrame([(*r, "plugin:typescript", "{}") for r in rows] + [(6, "lib/yard.ts", "typescript-import", "./gate", "plugin:typescript", '{"structural": true}')], "record_id long, path string, kind string, title string, source string, metadata string")
    edges = graph.resolve(graph.edges(facts), files)
    assert {(r["record_id"], r["target_path"]) for r in edges.collect()} == {(1, "lib/gate.ts"), (2, None), (4, "lib/wall/index.py"), (5, "bin/a.ts")}
    near = lambda seed, scope="": sorted((r["path"], r["record_id"]) for r in graph.one_hop(edges, spark.createDataFrame([(seed, 1)], "path string, rank int"), scope).collect())
    assert near("lib/gate.ts") == [("lib/wall/index.py", None), ("lib/yard.ts", 1)] and near("lib/yard.ts") == [("lib/gate.ts", None)]
    assert near("lib/gate.ts", "lib/wall") == [("lib/wall/index.py", None)] and near("lib/gate.ts", "lib/wal") == []


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "record_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r["record_id"] for r in lanes.vector_top(v, q, 1).collect()] == [1]


def test_chunker():
    w = list(chunking.windows("\n".join(["line"] * 400)))
    assert len(w) >= 3 and all(b - a < 160 and len(t.encode()) <= 8192 for a, b, t, _ in w)
    long = list(chunking.windows("<path d='λ'/>" * 8192))
    assert len(long) >= 3 and all((a, b, p) == (1, 1, True) and len(t.encode()) <= 8192 for a, b, t, p in long)
    assert [(a, b) for a, b, *_ in chunking.windows("\n".join(["x"] * 50 + ["y" * 9000] + ["z"] * 5))][:2] == [(1, 50), (31, 50)]


def test_snapshots_and_queue(spark, tmp_path):
    schema = "path string, content_hash string"
    old = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], schema)
    new = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], schema)
    assert {r["path"]: r["state"] for r in snapshot.diff(old, new).collect()} == {"p": "unchanged", "q": "modified", "r": "deleted", "s": "new"}
    store = snapshot.Store(spark, str(tmp_path))
    assert store.read("files") is None and store.runs() == []
    store.write({"files": old, "other": old})
    before = store.read("files")
    store.write({"files": snapshot.upsert(store.read("files"), new)}, note="second")
    assert before.count() == 3 and store.read("files").count() == 4 and store.read("other").count() == 3
    assert [(e["number"], e["status"], e.get("note")) for e in store.runs()] == [(1, "completed", None), (2, "completed", "second")]
    with pytest.raises(Exception):
        store.write({"files": spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert store.read("files").count() == 4 and store.runs()[-1]["status"] == "failed"
    r = spark.createDataFrame([(1, "rather a long text to embed", "h1"), (2, "no", "h2"), (3, "no", "h2"), (4, "middling", "h3")], "record_id long, input string, input_hash string")
    queue = snapshot.missing_inputs(r, r.where("false").select("record_id", "input_hash")).collect()
    assert [(x["input"], x["record_id"]) for x in queue] == [("no", 2), ("middling", 4), ("rather a long text to embed", 1)]
    assert snapshot.fan_out(r, spark.createDataFrame([("h2", [1.0])], "input_hash string, vector array<double>")).count() == 2


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    store, rows = snapshot.Store(spark, str(tmp_path)), spark.range(3)
    store.write({"t": rows})
    late = snapshot.Store(spark, str(tmp_path))
    seen = late._entries()
    late._entries = lambda: seen
    store.write({"t": spark.range(5)})
    with pytest.raises(snapshot.Conflict):
        late.write({"t": spark.range(9)})
    assert store.read("t").count() == 5


def test_batches_replace_files_with_what_hangs_on_them(spark, tmp_path):
    store = snapshot.Store(spark, str(tmp_path / "a"))
    files = lambda *rows: spark.createDataFrame(rows, "path string, size long, mtime_ns long")
    facts = lambda *rows: spark.createDataFrame([(p, n, n, "fact", t, t, "plugin:x", 0, i) for p, n, t, i in rows], "path string, start_line int, end_line int, kind string, title string, text string, source string, ordinal int, id string")
    snapshot.apply_batch(store, files(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), facts(("a", 1, "one", None), ("b", 1, "two", "x"), ("c", 1, "three", None)))
    keys = {r["path"]: r["record_key"] for r in store.read("records").collect()}
    assert keys == {"a": "plugin:x:a:1:1:fact:0", "b": "plugin:x:b:x", "c": "plugin:x:c:1:1:fact:0"}
    records_ = store.read("records")
    store.write({"vectors": records_.select("record_id", "input_hash", F.lit("live").alias("fingerprint")), "edges": records_.select("record_id", F.col("path").alias("source_path"))})
    problem = spark.createDataFrame([("c", "broken")], "path string, message string")
    snapshot.apply_batch(store, files(("b", 2, 2)), facts(("b", 1, "two, changed", "x")), gone=files(("c", 0, 0)), touched=files(("a", 1, 9)), found=snapshot.diagnostics(problem, "r2", "extract"))
    assert {(r["path"], r["size"], r["mtime_ns"]) for r in store.read("files").collect()} == {("a", 1, 9), ("b", 2, 2)}
    assert {(r["path"], r["text"]) for r in store.read("records").collect()} == {("a", "one"), ("b", "two, changed")}
    assert store.read("vectors").count() == 1 and store.read("edges").count() == 2 and store.read("diagnostics").count() == 1
    with pytest.raises(ValueError):
        snapshot.apply_batch(store, files(("d", 1, 1)), facts(("d", 1, "x", "same"), ("d", 2, "y", "same")))
    other = store.clone(str(tmp_path / "b"), root_id="other")
    other.write({"files": files(("z", 1, 1))})
    assert other.read("records").count() == 2 and other.read("diagnostics") is None and store.read("files").count() == 2 and other.runs()[0]["seeded_from"] == store.root


def test_progress_and_seeds():
    now, seen = [0.0], []
    progress = snapshot.Progress(seen.append, clock=lambda: now[0])
    for step, done in enumerate((0, 1, 2, 3)):
        now[0] = step * 0.2
        progress("read", done, 4)
    progress("read", 4, 4, terminal=True)
    assert [(e["done"], e["terminal"]) for e in seen] == [(0, False), (3, False), (4, True)]
    some = [{"head": h, "live": v, "updated_at_ms": t, "registered": r, "locked": k} for h, v, t, r, k in (("a", True, 1, False, False), ("b", False, 9, False, True), ("b", True, 2, True, False), ("a", False, 5, False, False), ("b", True, 4, False, False))]
    assert [(i["head"], i["live"], i["updated_at_ms"]) for i in snapshot.seed_order(some, "b")] == [("b", True, 4), ("b", True, 2), ("b", False, 9), ("a", True, 1), ("a", False, 5)]
    assert snapshot.prunable(some) == [some[3]]


def test_metrics(spark):
    results = spark.createDataFrame([("c", f"p{k}", k) for k in range(1, 26)], "case_id string, path string, rank int")
    truth = spark.createDataFrame([("c", "p2"), ("c", "p15"), ("d", "x")], "case_id string, path string")
    got = {r["case_id"]: (r["recall_at_10"], r["mrr"], r["noise_at_20"]) for r in evaluate.case_metrics(results, truth).collect()}
    assert got == {"c": (0.5, 0.5, 0.9), "d": (0.0, 0.0, 0.0)}
    p = spark.createDataFrame([(4,), (1,), (3,), (2,)], "v int").agg(evaluate.percentile("v", 0.5).alias("a"), evaluate.percentile("v", 0.95).alias("b"), evaluate.nearest_rank(F.col("v"), 0.5).alias("c")).first()
    assert tuple(p) == (2, 4, 2)


def test_extractors(spark):
    files = [
        ("d/guide.md", "# Title\ntext\n## Child\n```go\nx\n```\n"), ("m/a.py", "import os\nfrom .panels import x\nclass A:\n  def f(self): pass\n  async def g(self): pass\ndef h(): pass\n"),
        ("m/bad.py", "def (:\n"), ("w/a.ts", "import { a } from './owner'\nexport * from './x'\ninterface I {}\nconst c = 1\nfunction f() {\n  const inner = 2\n}\n// class No {}\n"),
        ("g/a.go", 'package a\n\nimport "fmt"\n\ntype T struct{}\n\nconst C = 1\n\nfunc F() {}\n\nfunc (t *T) M() {}\n'), ("package.json", '{"name": "x", "dependencies": {"y": "1"}}'),
        ("go.mod", "module a/b\n\ngo 1.22\n\nrequire (\n\tc/d v1\n)\n"), ("i/main.tf", 'resource "aws_x" "y" {\n  name = var.region\n}\n'), ("j/A.java", "package a.b;\nimport c.D;\npublic class A {\n  public void run() {\n  }\n}\n"), ("c/core.clj", "(ns a.core\n  (:require [b.util :as u]))\n(defn f [x] x)\n"),
    ]
    out = extractors.extract(spark.createDataFrame(files, "path string, content string")).collect()
    by = {}
    for r in out:
        by.setdefault(r["path"], []).append((r["kind"], r["title"]))
    assert [k for k, _ in by["d/guide.md"]] == ["markdown-section", "markdown-section", "markdown-fence"]
    assert by["m/a.py"] == [("python-import", "os"), ("python-import", ".panels"), ("python-class", "A"), ("python-method", "A.f"), ("python-method", "A.g"), ("python-function", "h"), ("python-navigation", "m/a.py")]
    assert [r["message"] for r in out if r["path"] == "m/bad.py"][0].startswith("line 1")
    assert [t for _, t in by["w/a.ts"]] == ["./owner", "./x", "I", "c", "f", "w/a.ts"]
    assert [k for k, _ in by["g/a.go"]] == ["go-import", "go-type", "go-const", "go-function", "go-method", "go-navigation"]
    assert ("npm-dependency", "y") in by["package.json"] and ("go-dependency", "c/d") in by["go.mod"]
    assert by["i/main.tf"] == [("terraform-block", "resource.aws_x.y"), ("terraform-attribute", "resource.aws_x.y.name")]
    assert by["j/A.java"] == [("java-package", "a.b"), ("java-import", "c.D"), ("java-definition", "A"), ("java-definition", "A.run")]
    assert by["c/core.clj"] == [("clojure-file", "a.core")]


def test_stream_indexes_new_files_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), snapshot.Store(spark, str(tmp_path / "store"))
    write = lambda rows: spark.createDataFrame(rows, "path string, content string").write.mode("append").parquet(source)
    run = lambda: index_new_files(spark, spark.readStream.schema("path string, content string").parquet(source), store, str(tmp_path / "cp"))
    write([("a.md", "one"), ("b.md", "two"), ("b.md", "older two")])
    run()
    assert store.read("files").count() == 2
    write([("b.md", "two changed")])
    run()
    run()
    assert {r["text"] for r in store.read("records").where("kind <> 'file'").collect()} == {"one", "two changed"} and len(store.runs()) == 2
