import datetime
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from skarn.llm import ann_forest, common, mixing, quality, url_filters


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(900 + k, 901 + k) for k in range(40)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(find(x) == find(y) for y in parent if y != x)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_few_edges_take_one_round(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rounds, keep = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: rounds.append(1) or keep(df))
    path = list(range(60))
    random.Random(3).shuffle(path)
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)) + [(100, 101)], "a long, b long").repartition(4)
    got = {x["node"]: x["component"] for x in common.components(edges).collect()}
    assert got == {**dict.fromkeys(path, 0), 100: 100, 101: 100}
    assert few == 0 or len(rounds) == 2


def test_bounded_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = [r["doc_id"] for r in common.bounded_sample(rows, 100, "doc_id").collect()]
    assert got == [r["doc_id"] for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).limit(100).collect()]
    assert common.bounded_sample(rows, 9000, "doc_id").count() == 5000


def test_nearest_recall_and_odd_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[40:60] = x[40]  # copies
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    odd = [(3000, None, "e"), (3020, [0.0] * 16, "e"), (3040, [float("nan")] * 16, "e"), (3060, [None] * 16, "e"), (None, [1.0] * 16, "e"), (3080, [], "e"), (7, x[7].tolist(), "e")]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, v string")
    got = pd.DataFrame([tuple(y) for y in ann_forest.nearest(df, k=10).collect()], columns=["q", "rank", "vec", "score"])
    z, hits = x.astype(float) @ x.astype(float).T, []
    for q in range(0, 1500, 20):
        z[q, q] = -np.inf
        truth = np.lexsort((np.arange(1500), -z[q]))[:10]
        mine = got[got.q == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, z[q, mine.vec])
        assert sorted(zip(-mine.score, mine.vec)) == list(zip(-mine.score, mine.vec))
        hits.append(len(set(truth) & set(mine.vec)) / 10)
    assert np.mean(hits) >= 0.9 and set(got.q) == set(range(0, 1500, 20))
    few = ann_forest.nearest(df.where("vec_id < 5")).collect()
    assert sorted((y["query_id"], y["rank"]) for y in few) == [(0, k) for k in range(1, 5)]
    assert ann_forest.nearest(df.where("false")).count() == 0


def test_url_filter_equals_brute_force(spark):
    r = random.Random(3)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    keys = ["a.com", "x.a.com", "x.a.com/en", "b.org", "org"]
    entries = [(r.choice(keys), r.choice(["block", "allow", "remove"]), day(r.randrange(60))) for _ in range(40)] + [(None, "block", day(1)), ("a.com", "odd", day(1)), ("b.org", "block", None)]
    urls = ["http://x.a.com/en/1", "https://u@X.a.com:8080/de", "http://b.org", "http://z.b.org/?q", "http://c.net/x", None, "no url", "ftp://localhost/en"]
    rows = [(i, r.choice(urls), day(r.randrange(70)), "k") for i in range(200)] + [(500, urls[0], None, "k"), (None, urls[0], day(3), "k")]
    got = {x["page_id"]: (x["verdict"], x["matched_key"], x["entry_date"]) for x in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetch_date date, key string"), spark.createDataFrame(entries, "key string, action string, date date")).collect()}
    asked = {"http://x.a.com/en/1": ["x.a.com/en", "x.a.com", "a.com"], "https://u@X.a.com:8080/de": ["x.a.com/de", "x.a.com", "a.com"], "http://b.org": ["b.org"], "http://z.b.org/?q": ["z.b.org", "b.org"], "http://c.net/x": ["c.net/x", "c.net"], "ftp://localhost/en": ["localhost/en", "localhost"]}
    for i, url, at, _ in rows:
        expected = ("none", None, None)
        for key in asked.get(url, []) if at else []:
            past = [(d, a) for k, a, d in entries if k == key and a != "odd" and d and d <= at]
            if past and max(past)[1] != "remove":
                expected = (max(past)[1], key, max(past)[0])
                break
        assert got[i] == expected
    none = url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string, fetch_date date, key string"), spark.createDataFrame([], "key string, action string, date date")).collect()
    assert len(none) == len(rows) and {x["verdict"] for x in none} == {"none"}
    assert url_filters.url_filter(spark.createDataFrame([], "page_id long, url string, fetch_date date"), spark.createDataFrame(entries, "key string, action string, date date")).count() == 0


def test_hot_hosts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    test_url_filter_equals_brute_force(spark)


def test_leaves_in_chunks_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.integers(-2, 3, size=(700, 8))  # many equal scores across different vectors
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann_forest.nearest(df, k=10).collect()))
    for q in range(0, 700, 20):
        mine = [w for w in whole if w[0] == q]
        assert [(-s, v) for _, _, v, s in mine] == sorted((-s, v) for _, _, v, s in mine) and all(s == float(x[q] @ x[v]) for _, _, v, s in mine)
    monkeypatch.setattr(ann_forest, "CHUNK_ROWS", 40)
    monkeypatch.setattr(ann_forest, "BLOCK_QUERIES", 10)
    assert sorted(map(tuple, ann_forest.nearest(df, k=10).collect())) == whole


def labelled(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad, lang = i % 5 == 0, ["en", "fr"][i % 2]
        words = r.choices({"en": ["the", "of", "and", "thing"], "fr": ["le", "de", "et", "chose"]}[lang], k=30)
        if bad:
            words = [f"{w.upper()}!!" for w in words]
        rows.append((i, " ".join(words), lang, "s0" if i % 3 else "s1", 1.0))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame([*rows, (900, None, None, None, 1.0), (901, "", "en", "s0", 1.0), (None, "the of", "en", "s9", 1.0)], "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_keeps_clean_documents(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs.where("doc_id < 300"), labels)
    out = quality.quality_scores(docs, model)
    got = {x["doc_id"]: x["keep"] for x in out.collect()}
    assert len(got) == 403 and all(got[i] == (i % 5 != 0) for i in range(300, 400))
    assert out.columns == ["doc_id", "text", "lang", "source", "p_text", "host_rate", "path_rate", "score", "keep"]
    assert quality.quality_scores(docs, model, keep_text=False).columns == [c for c in out.columns if c != "text"]
    assert quality.quality_scores(docs, None).where("keep").count() == 403
    assert quality.train(docs, labels.where("false")) is None
    assert quality.quality_scores(docs.where("false"), model).count() == 0


CLASHING = ["keep", "Score", "p_text", "_bad", "host", "path", "n", "bad", "host_n", "host_bad", "path_rate", "base_rate", "host_rate", "_order", "_rows", "rows", "n_tokens", "Posterior", "rate", "k1", "th", "block", "a.b", "c`d", "e f"]


def clashing(docs):
    return docs.drop("score").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHING})


def test_columns_of_clashing_names_stay(spark):
    docs, labels = labelled(spark)
    docs = clashing(docs.unionByName(docs.where("doc_id IN (0, 1)"))).repartition(3)
    model = quality.train(docs, labels)
    kept = quality.quality_filter(docs, model)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in rows if r["text"]) == sorted(str(r["doc_id"]) for r in docs.collect() if r["text"] and (r["doc_id"] is None or r["doc_id"] % 5))
    assert all(r[c] == c + str("" if r["doc_id"] is None else r["doc_id"]) for r in rows for c in CLASHING)
    scored = quality.quality_scores(docs, model)
    assert [c for c in scored.columns if c.lower() in quality.OUTPUTS] == list(quality.OUTPUTS) and scored.schema["score"].dataType.simpleString() == "double"
    mixed, _ = mixing.mix_to_targets(docs, mixing.train(docs, labels, ["en", "fr"]), {"en": 1.0, "fr": 1.0}, keep_text=True)
    got = mixed.collect()
    assert len(got) == 405 and mixed.columns == [c for c in docs.columns if c.lower() not in ("n_tokens", "posterior", "rate")] + ["n_tokens", "posterior", "rate"]
    assert all(r["a.b"] == "a.b" + str("" if r["doc_id"] is None else r["doc_id"]) and r["rate"] >= 0 for r in got)


def test_many_sites_give_the_same_scores(spark, monkeypatch):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    few = sorted(map(tuple, quality.quality_scores(docs.drop("doc_id"), model).collect()), key=str)
    monkeypatch.setattr(quality, "MAX_BROADCAST_SITES", 0)
    many = sorted(map(tuple, quality.quality_scores(docs.drop("doc_id"), model).collect()), key=str)
    assert len(few) == 403 and few == many


def test_posteriors_equal_brute_force(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    rows = quality.quality_scores(docs, model).toPandas()
    assert np.allclose(rows.p_text, 1 - model.predict(pa.array(rows.text, pa.string()))[:, 0])
    bad = rows.p_text.to_numpy()
    sites = list(zip(rows.source.fillna(""), rows.lang.fillna(""), strict=True))

    def strength(groups, mean):
        n, rate = np.array([len(g) for g in groups], float), np.array([bad[g].mean() for g in groups])
        mean = np.array(mean)
        excess = (n * (rate - mean) ** 2).sum() - (mean * (1 - mean)).sum()
        size = n.sum() - (n * n).sum() / n.sum()
        return min(max(size / excess * (mean * (1 - mean)).max() - 1, 1.0), 1e4) if excess > 0 else 1e4

    base = (bad.sum() + 0.5) / (len(bad) + 1)
    hosts = {h: [i for i, s in enumerate(sites) if s[0] == h] for h in {s[0] for s in sites}}
    paths = {p: [i for i, s in enumerate(sites) if s == p] for p in set(sites)}
    host_k = strength(list(hosts.values()), [base] * len(hosts))
    rate = lambda h: (bad[hosts[h]].sum() + host_k * base) / (len(hosts[h]) + host_k)
    path_k = strength(list(paths.values()), [rate(p[0]) for p in paths])
    logit = lambda x: np.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    for i, (h, p) in enumerate(sites):
        host = (max(bad[hosts[h]].sum() - bad[i], 0) + host_k * base) / (len(hosts[h]) - 1 + host_k)
        path = (max(bad[paths[h, p]].sum() - bad[i], 0) + path_k * host) / (len(paths[h, p]) - 1 + path_k)
        odds = logit(bad[i]) + logit(path) - logit(base)
        assert np.allclose([rows.host_rate[i], rows.path_rate[i], rows.score[i]], [host, path, 1 / (1 + np.exp(-odds))], atol=1e-9)
        assert rows.keep[i] == (rows.score[i] <= 0.5)


def test_site_rates_shrink(spark):
    rows = [("big", "p", 0.9)] * 200 + [("small", "p", 0.9)] + [("good", "p", 0.0)] * 300
    sums, corpus = quality.site_sums(spark.createDataFrame(rows, "host string, path string, bad double"))
    rates = quality.site_rates(corpus, *map(F.col, ("n", "bad", "host_n", "host_bad")))
    got = {x["host"]: x["r"] for x in sums.select("host", rates[0].alias("r")).collect()}
    assert got["good"] < got["small"] < got["big"] < 0.9


def test_training_samples_are_bounded(spark, monkeypatch):
    docs, labels = labelled(spark)
    copies = docs.select("doc_id", "text").where("doc_id = 3").crossJoin(spark.range(5000)).drop("id")
    assert len(common.sample_texts(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").unionByName(copies), 300)) == 300
    monkeypatch.setattr(common, "SAMPLE_BYTES", 2000)
    rows = common.sample_texts(docs.select("doc_id", "text").where("text IS NOT NULL"), 300)
    assert 5 < len(rows) and sum(len(r["text"].encode()) for r in rows) <= 2000
    monkeypatch.setattr(common, "SAMPLE_TEXT", 10)
    assert all(len(r["text"]) <= 10 for r in common.sample_texts(docs.select("doc_id", "text"), 300))


def test_mixing_meets_targets(spark):
    docs, labels = labelled(spark)
    targets = {"en": 0.3, "fr": 0.7, "junk": 0.0}
    model = mixing.train(docs, labels, list(targets))
    out, fitted = mixing.mix_to_targets(docs.select("doc_id", "text"), model, targets)
    rows = out.collect()
    assert len(rows) == 403 and all(r["rate"] >= 0 for r in rows)
    n = np.array([r["n_tokens"] for r in rows])
    p, rate = np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    reached = (rate * n) @ p / n.sum()
    assert np.allclose(reached, [0.3, 0.7, 0.0], atol=0.02)
    assert np.allclose(reached, list(fitted.reached.values())) and fitted.converged and fitted.residual == max(abs(fitted.reached[d] - targets[d]) for d in targets)
    assert mixing.mix_to_targets(docs.select("doc_id", "text").where("false"), model, targets)[0].count() == 0
    assert mixing.mix_to_targets(docs.select("doc_id", "text"), None, targets)[0].count() == 403


def test_mixing_equals_steps_in_numpy(spark):
    """The same steps over all documents at once, and no better rates nearby."""
    r = np.random.default_rng(7)
    p, n = r.dirichlet([0.4, 0.4, 0.4], 200), r.integers(0, 50, 200)
    base = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>").repartition(3)
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    fitted = mixing.fit(base, targets)
    rate = mixing.rates(p, fitted.steps, 1e-3)
    assert fitted.converged and fitted.residual < 1e-3 and np.allclose((rate * n) @ p / n.sum(), list(fitted.reached.values()))
    loss = lambda x: ((((x * n) @ p / n.sum()) - [0.5, 0.3, 0.2]) ** 2).sum()
    assert all(loss(np.maximum(0, rate + 0.2 * r.normal(size=200))) >= loss(rate) for _ in range(200))
    with np.testing.assert_warns(UserWarning):
        assert not mixing.fit(base, targets, steps=1).converged
