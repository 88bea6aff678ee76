import json
import os

from skarn import cli
from skarn.operators.snapshot import Store
from skarn.plans import indexing
from skarn.plans import search as S


def test_a_tree_is_indexed_step_by_step(spark, tmp_path, capsys):
    root, store = tmp_path / "tree", Store(spark, str(tmp_path / "store"))
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "gate.py").write_text("from .wall import brick\n\ndef open_gate():\n    return brick\n")
    (root / "lib" / "wall.py").write_text("brick = 1\n")
    (root / "bad.py").write_text("def (:\n")
    (root / ".ENV").write_text("CODE=77\n")
    (root / "key.pem").write_text("x")
    first = indexing.index_tree(spark, str(root), store)
    assert (first["read"], first["changed"], first["unchanged"]) == (5, 4, 0)
    assert {r["message"] for r in store.read("diagnostics").collect()} == {"line 1: invalid syntax"}
    assert [r["text"] for r in store.read("records").where("path = '.ENV' AND kind <> 'file'").collect()] == ["CODE=<redacted>"]
    assert indexing.status(str(root), store)["fresh"]
    again = indexing.index_tree(spark, str(root), store)
    assert (again["read"], again["unchanged"], again["records"]) == (1, 4, first["records"])  # what is left out is looked at each time
    os.utime(root / "lib" / "wall.py", ns=(5, 5))
    (root / "bad.py").unlink()
    (root / "lib" / "gate.py").write_text("def close_gate():\n    return 2\n")
    assert not indexing.status(str(root), store)["fresh"]
    third = indexing.index_tree(spark, str(root), store)
    assert (third["changed"], third["refreshed"], third["gone"]) == (1, 1, 2)
    assert {r["path"] for r in store.read("files").collect()} == {"lib/gate.py", "lib/wall.py", ".ENV"}
    found = S.search(store.read("records"), "close gate", edges=store.read("edges"), index=indexing.open_index(spark, store))
    assert [r["path"] for r in found.records.orderBy("position").collect()][0] == "lib/gate.py"
    assert S.search(store.read("records"), "open gate", index=indexing.open_index(spark, store)).records.where("excerpt LIKE '%open%'").count() == 0
    where = ["--root", str(root), "--store", store.root]
    assert cli.main(["search", *where, "close gate"]) == 0 and cli.main(["status", *where]) == 0
    assert cli.main(["search", *where, "--mode", "semantic", "close gate"]) == 3 and cli.main(["search", *where, "--limit", "0", "x"]) == 2
    assert cli.main(["search", "--root", str(root), "--store", str(tmp_path / "none"), "close gate"]) == 0 and cli.main(["check", "python", str(root / "lib" / "gate.py")]) == 0
    told = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [t["command"] for t in told] == ["search", "status", "search", "search", "search", "check"]
    assert told[0]["data"]["records"][0]["path"] == "lib/gate.py" and told[1]["data"]["fresh"] and told[4]["data"]["fallbackReason"] == "index-busy"
    assert [r["kind"] for r in told[5]["data"]] == ["python-function", "python-navigation"]
