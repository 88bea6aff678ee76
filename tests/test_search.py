import json

import pytest
from pyspark.sql import functions as F
from skarn.operators import citation
from skarn.operators.index import Index, write_index
from skarn.plans import search as S

ROWS = [
    ("yard/gate.go", "file", "yard/gate.go", "yard/gate.go", 1, 1, "core", None),
    ("yard/gate.go", "text-chunk", "yard/gate.go:1", "package yard\n\nfunc openGate() {\n  latch()\n}\n", 1, 5, "core", None),
    ("yard/gate.go", "go-function", "openGate", "func openGate()", 3, 3, "plugin:go", None),
    ("yard/wall.go", "file", "yard/wall.go", "yard/wall.go", 1, 1, "core", None),
    ("yard/wall.go", "text-chunk", "yard/wall.go:1", "the wall has a latch gate\nand tokenised bricks", 1, 2, "core", None),
    ("docs/latch.md", "file", "docs/latch.md", "docs/latch.md", 1, 1, "core", None),
    ("docs/latch.md", "text-chunk", "docs/latch.md:1", "how to oil\nhow to turn\nhow to close\nfirst\nthen\nlast\nthe latch of a gate\nevery year", 1, 8, "core", None),
    ("docs/quiet.md", "text-chunk", "docs/quiet.md:1", "gate gate gate", 1, 1, "core", '{"lexical": false}'),
    ("misc/pear.txt", "text-chunk", "misc/pear.txt:1", "pear tree", 1, 1, "core", None),
]
SCHEMA = "record_id long, path string, kind string, title string, text string, start_line int, end_line int, source string, metadata string"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS, 1)], SCHEMA).persist()


def shown(result):
    return [(r["path"], r["start_line"], r["end_line"]) for r in result.records.orderBy("position").collect()]


def test_lanes_of_a_query(spark, records):
    r = S.search(records, "latch gate")
    got = {x["path"]: set(x["retrieval"].split(",")) for x in r.records.collect()}
    assert set(got) == {"yard/wall.go", "docs/latch.md", "yard/gate.go"} and {"exact", "all-terms", "lexical"} <= got["yard/wall.go"]
    assert (r.active_mode, r.fallback_reason, r.more_paths) == ("lexical", "semantic-unconfigured", [])
    rows = S.lane_rows(records, r.plan, 10).collect()
    assert {x["lane"] for x in rows} == {"exact", "all-terms", "lexical", "path"} and {x["path"] for x in rows if x["lane"] == "path"} == {"yard/gate.go", "docs/latch.md"}
    assert {x["lane"] for x in S.lane_rows(records, S.Q.plan_query("where openGate sits in yard/wall"), 10, extractors=True).collect()} == {"all-terms", "lexical", "path", "extractor", "anchor"} - {"all-terms"}


def test_citations_stand_at_the_evidence(records):
    assert ("docs/latch.md", 3, 8) in shown(S.search(records, "latch gate")) and shown(S.search(records, "latch", scope="docs/")) == [("docs/latch.md", 3, 8)]


def test_literal_fixed_and_regexp(records):
    assert shown(S.search(records, "openGate", mode="lexical"))[0][0] == "yard/gate.go" and len(shown(S.search(records, "openGate"))) == 1
    assert [p for p, *_ in shown(S.search(records, "latch g", match="fixed"))] == ["yard/wall.go"]
    assert [p for p, *_ in shown(S.search(records, "latch (of|gate)", match="regexp"))] == ["docs/latch.md", "yard/wall.go"]
    assert S.search(records, "[0-9]+", match="regexp").fallback_reason == "semantic-query-empty"


def test_an_index_gives_what_a_scan_gives(spark, records, tmp_path):
    write_index(records, str(tmp_path))
    index = Index(spark, str(tmp_path))
    for pattern in ("latch gate", "gate", "openGate", "how to close the latch", "where openGate sits in yard/wall", "nothing-there"):
        a, b = S.search(records, pattern), S.search(records, pattern, index=index)
        for x, y in zip(a.records.orderBy("position").collect(), b.records.orderBy("position").collect(), strict=True):
            assert x.asDict() == y.asDict()
        assert a.more_paths == b.more_paths
    plan = index.postings.where(F.col("term").isin(["gate"]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [EqualTo(term,gate)]" in plan or "PushedFilters: [In(term" in plan or "EqualTo(term,gate)" in plan


def test_modes_and_fallbacks(spark, records):
    vectors = records.select("record_id", "path", "start_line", "kind", "metadata", F.array(F.lit(1.0), F.when(F.col("path") == "misc/pear.txt", 0.0).otherwise(F.col("record_id").cast("double"))).alias("embedding"))
    edges = spark.createDataFrame([("yard/gate.go", "import", "x", "misc/pear.txt", 3)], "source_path string, relation string, target string, target_path string, record_id long")
    near = lambda text: [1.0, 0.0]
    semantic = S.search(records, "some fruit", mode="semantic", vectors=vectors, provider=near)
    assert shown(semantic)[0][0] == "misc/pear.txt" and semantic.active_mode == "semantic"
    hybrid = S.search(records, "latch gate", vectors=vectors, provider=near, edges=edges)
    assert hybrid.active_mode == "hybrid" and hybrid.fallback_reason == "" and "misc/pear.txt" in [p for p, *_ in shown(hybrid)]
    assert [p for p, *_ in shown(S.search(records, "latch gate", mode="graph", edges=edges))] == ["misc/pear.txt"]
    assert shown(S.search(records, "latch gate", mode="graph")) == []
    literal = S.search(records, "openGate", edges=edges, vectors=vectors, provider=near)
    assert literal.active_mode == "hybrid" and [p for p, *_ in shown(literal)] == ["yard/gate.go", "misc/pear.txt"]

    def broken(text):
        raise OSError("no answer")

    assert S.search(records, "latch gate", vectors=vectors, provider=broken).fallback_reason == "semantic-provider-error"
    assert S.search(records, "latch gate", vectors=vectors, provider=near, complete=False).fallback_reason == "semantic-incomplete"
    for more in ({"provider": broken}, {"provider": near, "complete": False}, {}):
        with pytest.raises(S.SemanticUnavailable):
            S.search(records, "latch gate", mode="semantic", vectors=vectors, **more)
    for bad in ({"mode": "fuzzy"}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            S.search(records, "latch", **bad)


def test_paths_beyond_the_results(spark):
    rows = [(i, f"d{i:02d}/x.txt", "text-chunk", "t", "pear " * (40 - i), 1, 1, "core", None) for i in range(1, 36)]
    r = S.search(spark.createDataFrame(rows, SCHEMA), "pear", limit=5)
    assert len(shown(r)) == 5 and len(r.more_paths) == 20 and not set(r.more_paths) & {p for p, *_ in shown(r)}
    told = json.loads(S.result_json(r))
    assert told["command"] == "search" and len(told["data"]["records"]) == 5 and told["data"]["morePaths"] == r.more_paths
    assert told["data"]["records"][0].keys() == {"path", "startLine", "endLine", "title", "excerpt"}


def test_evidence_is_made_of_tokens(spark):
    texts = {1: "tokenised things\nmy Token here", 2: "getToken()", 3: "tokens", 4: None, 5: "Gate\n\n\nOldGate Gate\n"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r["id"]: (r["evidence_line"], r["evidence_terms"]) for r in citation.evidence(df, [["token"]]).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (-1, 0), 4: (-1, 0), 5: (-1, 0)}
    literal = {r["id"]: (r["evidence_line"], r["literal_hit"]) for r in citation.evidence(df, [["oldgate"]], "OldGate").collect()}
    assert literal[5] == (3, True) and literal[1] == (-1, False)
    many = citation.evidence(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(70)) + "\n\n\nw3 w69")], "id int, text string"), [[f"w{k}"] for k in range(70)]).first()
    assert (many["evidence_terms"], many["evidence_line"]) == (70, 0)


def test_files_are_searched_without_an_index(spark):
    files = spark.createDataFrame([("yard/a.txt", "txt", "one\ntwo gate\n"), ("gate/b.txt", "txt", "nothing\n"), ("yard/c.txt", "txt", "x\ny\nthe gate and latch\n"), ("yard2/d.txt", "txt", "gate latch"), ("e.txt", "txt", None)], "path string, kind string, content string")
    assert [p for p, *_ in shown(S.search_files(files, "gate latch"))] == ["yard/c.txt", "yard2/d.txt", "yard/a.txt", "gate/b.txt"]
    assert [p for p, *_ in shown(S.search_files(files, "gate latch", scope="yard/"))] == ["yard/c.txt", "yard/a.txt"]
    assert shown(S.search_files(files, "e and l", match="fixed")) == [("yard/c.txt", 1, 3)]
    assert [p for p, *_ in shown(S.search_files(files, "gate (and|latch)", match="regexp"))] == ["yard/c.txt", "yard2/d.txt"]
    few = S.search_files(files, "gate", limit=2)
    assert few.fallback_reason == "index-busy" and len(shown(few)) == 2 and len(few.more_paths) == 2
