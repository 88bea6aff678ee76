"""The corpus pipeline on small tables with odd rows and columns."""

import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

WORDS = {"en": ["the", "of", "and", "thing", "house", "water"], "fr": ["le", "de", "et", "chose", "maison", "eau"]}
ITEM = "seven small questions about the colour of old maps and their makers"
KEY = "password = Zk8vQ2mR7tLx0aBc"


def tables(spark, folder):
    """(rows of documents, doc_ids that are to go), with the tables written to ``folder``."""
    r = random.Random(12)
    rows, labels, gone = [], [], set()
    for i in range(300):
        lang = ("en", "fr")[i % 2]
        words = [w + str(r.randrange(90)) for w in r.choices(WORDS[lang], k=40)] + r.choices(WORDS[lang], k=10)
        if i % 5 == 0:
            words = [f"{w.upper()}!!" for w in words]
            gone.add(i)
        rows.append((i, " ".join(words), lang, "s0" if i % 3 else "s1"))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(400, rows[1][1], "fr", "s0"), (401, rows[2][1] + " more", "en", "s0"), (402, f"{rows[3][1]} {ITEM} {rows[4][1]}", "fr", "s1")]
    gone |= {400, 401, 402}
    rows += [(403, f"{rows[6][1][::-1]} {KEY} {rows[7][1][::-1]}", "en", "s0"), (None, rows[8][1], "en", None), (404, None, None, "s1"), (405, "", "en", "s1")]
    rows += [(406, "le de et chose maison eau " + " ".join(r.choices(WORDS["fr"], k=30)), "fr", "s0"), (406, "une autre chose " + " ".join(r.choices(WORDS["fr"], k=30)), "fr", "s0")]
    rows += [rows[11], rows[11]]
    # Columns whose names operators use themselves.
    docs = spark.createDataFrame([(*x, len(x[1] or ""), f"k{x[0]}", f"s{x[0]}") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, keep string, `_rows` string")
    docs = docs.withColumns({c: F.col("keep") for c in ("_bad", "host", "rows", "k1", "block", "rate_in", "order.by")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, gone


def test_pipeline(spark, tmp_path):
    rows, gone = tables(spark, str(tmp_path))
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert [c for c in docs.columns if c in out.columns] == docs.columns and set(out.columns) - set(docs.columns) == {"n_tokens", "posterior", "rate"}
    ids = [x["doc_id"] for x in got]
    blank = {404, 405}  # texts without words: the classifier may take them for junk
    assert sorted(i for i in ids if i is not None and i not in blank) == sorted({i for i, *_ in rows if i is not None} - gone - blank) and ids.count(None) == 1
    texts = {i: t for i, t, *_ in rows}
    texts[406] = min(t for i, t, *_ in rows if i == 406)
    for x in got:
        assert x["n_tokens"] == len((x["text"] or "").split()) and x["rate"] >= 0 and len(x["posterior"]) == 5
        assert x["keep"] == x["order.by"] == x["_bad"] == f"k{x['doc_id']}"
        if x["doc_id"] == 403:
            assert KEY not in x["text"] and "<SECRET>" in x["text"] and x["n_chars"] == len(x["text"])
        elif x["doc_id"] is not None:
            assert x["text"] == texts[x["doc_id"]]


def test_near_duplicates_stage_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choices(words, k=r.randint(3, 30))) for _ in range(40)]
    for _ in range(40):
        w = texts[r.randrange(40)].split()
        w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    rows = [(i * 13 % 97, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, str(tmp_path)).collect()
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in rows}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {x: low if c == high else c for x, c in comp.items()}
    assert {x["doc_id"]: x["text"] for x in kept} == {i: t for i, t in rows if comp[i] == i} and len(kept) < len(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]


HELD = """
import re
import numpy as np
from skarn.llm import common

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def run(batches):
    for _ in batches:
        held = [np.ones(12_500) for _ in range(1500)]  # 150 MB in pieces
        kept.extend(held[::50])  # what lives on stands between them
        yield resident()

kept = []
before = resident()
during = list(common.lean(run)(iter([0])))[0]
print(before, during, resident())
"""


def test_worker_functions_give_memory_back():
    root = Path(__file__).resolve().parents[2]
    before, during, after = map(int, subprocess.run([sys.executable, "-c", HELD], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert during - before > 120 and after - before < 40


def test_pipeline_gives_memory_back_after_each_task(spark, tmp_path, monkeypatch):
    tables(spark, str(tmp_path))
    kind, names = type(spark.range(1)), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, real=kind.mapInArrow, **b: names.append(f.__name__) or real(self, f, *a, **b))
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(names) > 10 and set(names) == {"leanly"}
