"""Configuration, suites, providers and freshness: what the driver reads, checks and runs."""

import http.server
import json
import os
import subprocess
import sys
import threading

import pytest
from skarn import config as C
from skarn.operators import embedding, extractors
from skarn.plans import suite
from skarn.sources.freshness import dirty_paths, freshness

MODEL = {"kind": "command", "command": ["x"], "model": "m", "dimensions": 3}


def write(path, **more):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"schema": C.SCHEMA} | more))


def test_layers_of_configuration(tmp_path):
    root, user = tmp_path / "r", tmp_path / "u.json"
    path = root / ".skarn" / "config.json"
    assert C.load(str(root), str(user)).embedding is None
    write(user, embedding=MODEL)
    assert C.load(str(root), str(user)).embedding_source == str(user)
    write(path, ignoreGlobs=["*.log"], plugins=[{"id": "p", "version": "1", "command": ["run"], "includeGlobs": ["**"]}])
    both = C.load(str(root), str(user))
    assert both.embedding.model == "m" and both.plugins[0].timeoutMs == 10_000 and both.embedding.batchSize == 64 and both.maxFileBytes == 4 << 20
    write(path, embedding=None)
    assert C.load(str(root), str(user)).embedding_disabled
    write(path, embedding=MODEL | {"model": "other", "queryPrefix": "q: ", "documentPrefix": "d: ", "maxInputChars": 5})
    own = C.load(str(root), str(user)).embedding
    assert (own.model, own.query_text("abcdef"), own.document_text("abcdef")) == ("other", "q: ab", "d: ab")
    bad = [{"colour": 1}, {"plugins": [{"id": "p"}]}, {"embedding": MODEL | {"kind": "http"}}, {"embedding": MODEL | {"dimensions": 0}}, {"embedding": MODEL | {"maxInputChars": 100_001}}, {"embedding": MODEL | {"dimensions": "3"}}, {"ignoreGlobs": "x"}, {"schema": "other"}]
    twin = {"id": "p", "version": "1", "command": ["run"], "includeGlobs": ["**"]}
    for more in [*bad, {"plugins": [twin, twin]}]:
        write(path, **more)
        with pytest.raises(C.ConfigError):
            C.load(str(root), str(user))
    path.write_text(json.dumps({"schema": C.SCHEMA}) + "{}")
    with pytest.raises(C.ConfigError):
        C.load(str(root), str(user))


def test_fingerprints():
    e = lambda **more: C.embedding_fingerprint(C.Embedding(**(MODEL | more)))
    assert e() == e(queryPrefix="q", timeoutMs=5, batchSize=9, apiKeyEnv="K") == e(maxInputChars=6000)
    assert len({e(), e(model="n"), e(dimensions=4), e(documentPrefix="d"), e(maxInputChars=7), e(command=["y"])}) == 6
    x = lambda **more: C.extraction_fingerprint(C.Config(**more))
    assert x() == x(embedding=C.Embedding(**MODEL)) and len({x(), x(ignoreGlobs=["a"]), x(maxFileBytes=1)}) == 3


def test_freshness_follows_the_tree(tmp_path):
    (tmp_path / "a.txt").write_text("one")
    plain = freshness(str(tmp_path), C.Config())
    assert plain == freshness(str(tmp_path), C.Config()) != freshness(str(tmp_path), C.Config(ignoreGlobs=["a*"]))
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    clean = freshness(str(tmp_path), C.Config())
    (tmp_path / "a.txt").write_text("two!")
    dirty = freshness(str(tmp_path), C.Config())
    os.utime(tmp_path / "a.txt", ns=(1, 1))
    assert len({plain, clean, dirty, freshness(str(tmp_path), C.Config())}) == 4
    assert dirty_paths(b" M a\0R  new\0old\0?? b c\0") == ["a", "new", "old", "b c"]


CASE = {"id": "c", "repositoryId": "r", "revision": "a" * 40, "fixRevision": "b" * 40, "query": "q", "sourceUrl": "https://example.com/1", "expectedPaths": ["a/b.txt"], "sourceKinds": ["issue"], "problemClasses": ["p"], "architectureClasses": ["x"]}
SUITE = {"schema": suite.SCHEMA, "id": "s", "repositories": [{"id": "r", "url": "https://example.com/r"}], "cases": [CASE]}


def test_suites_are_checked(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SUITE))
    loaded, digest = suite.load(str(tmp_path / "s.json"))
    assert loaded["cases"][0]["matchKind"] == "" and digest.startswith("sha256:")
    assert suite.check(SUITE | {"cases": [CASE | {"retrievalClass": "graph-neighbor", "expectedBestModes": ["graph", "auto"]}]})
    cases = [{"revision": "abc"}, {"query": " "}, {"expectedPaths": ["/x"]}, {"expectedPaths": ["../x"]}, {"expectedPaths": ["a//b"]}, {"expectedPaths": ["a", "a"]}, {"expectedPaths": []}, {"sourceUrl": "http://x"}, {"repositoryId": "no"}, {"matchKind": "glob"}, {"retrievalClass": "graph-neighbor"}, {"retrievalClass": "odd", "expectedBestModes": ["auto"]}, {"retrievalClass": "graph-neighbor", "expectedBestModes": ["auto", "auto"]}, {"colour": "red"}, {"query": 1}]
    bad = [{"cases": [CASE | c]} for c in cases] + [{"cases": [CASE, CASE]}, {"cases": []}, {"schema": "x"}, {"repositories": [{"id": "r", "url": "ftp://x"}]}, {"more": 1}]
    for more in bad:
        with pytest.raises(suite.SuiteError):
            suite.check(SUITE | more)


def test_ground_truth(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True).stdout.decode().strip()
    git("init", "-q")
    heads = []
    for text in ("one", "two"):
        (tmp_path / "a.txt").write_text(text)
        (tmp_path / "b.txt").write_text("same")
        git("add", ".")
        git("commit", "-qm", text)
        heads.append(git("rev-parse", "HEAD"))
    case = {"revision": heads[0], "fixRevision": heads[1], "expectedPaths": ["a.txt", "b.txt"]}
    assert suite.unchanged_truth(str(tmp_path), case) == ["b.txt"]
    with pytest.raises(suite.SuiteError):
        suite.unchanged_truth(str(tmp_path), case | {"revision": "c" * 40})


WORKER = """
import json, sys
for line in sys.stdin:
    asked = json.loads(line)
    if any(i["text"] == "fail" for i in asked["inputs"]):
        print(json.dumps({"error": "cannot"}), flush=True)
    elif any(i["text"] == "end" for i in asked["inputs"]):
        sys.exit(1)
    elif not any(i["text"] == "late" for i in asked["inputs"]):
        print(json.dumps({"vectors": [{"id": i["id"], "vector": [float(len(i["text"])), 0, 1]} for i in reversed(asked["inputs"])]}), flush=True)
"""


def test_command_provider(spark):
    config = C.Embedding(**(MODEL | {"command": [sys.executable, "-c", WORKER], "timeoutMs": 2000}))
    ask = embedding.provider(config)
    assert ask(["a", "bcd"]) == [[1.0, 0.0, 1.0], [3.0, 0.0, 1.0]]
    for bad in ("fail", "end", "late"):
        with pytest.raises(embedding.ProviderError):
            ask([bad])
    assert ask(["abcd"]) == [[4.0, 0.0, 1.0]]
    ask.close()
    rows = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 9)], "input_hash string, input string").repartition(2)
    got = {r["input_hash"]: list(r["vector"]) for r in embedding.embed(rows, embedding.provider(config), 3, batch=3).collect()}
    assert got == {str(i): [float(i), 0.0, 1.0] for i in range(1, 9)}


def test_a_failed_provider_is_asked_no_more(spark):
    def fails(texts):
        if "bad" in texts:
            raise OSError("gone")
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "longer")], "input_hash string, input string").coalesce(1)
    got = {r["input_hash"]: r["error"] for r in embedding.embed(rows, fails, 1, batch=1).collect()}
    assert got == {"1": None, "2": "gone", "3": "gone"}
    assert embedding.embed(rows, lambda t: [[1.0, 2.0]] * len(t), 1).where("error IS NOT NULL").count() == 3


def test_http_provider(monkeypatch):
    monkeypatch.setattr(embedding, "BACKOFF_S", 0.01)
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers.get("Authorization"), body["input"]))
            code = {"busy": 503, "no": 400}.get(body["input"][0], 200)
            if body["input"][0] == "busy" and len(seen) % 2 == 0:
                code = 200
            data = [{"index": i, "embedding": [len(t), 0, 1]} for i, t in reversed(list(enumerate(body["input"])))]
            out = json.dumps({"data": data[: 1 if body["input"][0] == "few" else None]}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("A_KEY", "k")
        ask = embedding.provider(C.Embedding("openai-compatible", endpoint=f"http://127.0.0.1:{server.server_port}/", model="m", dimensions=3, apiKeyEnv="A_KEY"))
        assert ask(["a", "bc"]) == [[1.0, 0.0, 1.0], [2.0, 0.0, 1.0]] and seen.pop() == ("Bearer k", ["a", "bc"])
        assert ask(["busy"]) == [[4.0, 0.0, 1.0]] and len(seen) == 2
        seen.clear()
        for bad, tries in (("no", 1), ("few", 1)):
            with pytest.raises(embedding.ProviderError):
                ask([bad, "x"])
            assert len(seen) == tries
            seen.clear()
    finally:
        server.shutdown()


def test_extractors_cut_rather_than_refuse(spark):
    many = "\n".join(f"# h{k}\n" for k in range(400))
    long = "# one\n" + "é" * 50_000
    fence = "# a\n```\n# b\n```\n## c ##\n"
    rows = spark.createDataFrame([("many.md", many), ("long.md", long), ("fence.md", fence), ("big.tf", "\n".join(f"x{k} = 1" for k in range(500)))], "path string, content string")
    got: dict[str, list] = {}
    for r in extractors.extract(rows).collect():
        assert r["message"] is None
        got.setdefault(r["path"], []).append(r)
    assert len(got["many.md"]) == 256 and got["many.md"][255]["title"] == "h255" and len(got["big.tf"]) == 256
    assert len(got["long.md"][0]["text"].encode()) <= (64 << 10) - 1
    assert [(r["kind"], r["title"], r["start_line"], r["end_line"]) for r in got["fence.md"]] == [("markdown-section", "a", 1, 2), ("markdown-fence", "", 2, 4), ("markdown-section", "c", 5, 6)]
