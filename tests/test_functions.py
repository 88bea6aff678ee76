import pytest
from pyspark.sql import functions as F
from skarn.functions import query as Q
from skarn.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.rst", "notes/deep/er.rst", True), ("**/*.rst", "top.rst", True), ("lib/*.c", "lib/x.c", True), ("lib/*.c", "lib/y/x.c", False), ("v?.log", "v7.log", True), ("v?.log", "v77.log", False), ("q[1]{2}.z", "q[1]{2}.z", True), ("data/**", "data/a/b", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, path, T.matches_any(F.col("t"), [glob])) is hit


def test_identifiers(spark):
    texts = {"Orchard": True, "[Orchard]": True, "new Orchard(3)": True, "Orchards": False, "OldOrchard": False, "$Orchard": False, "é̂Orchard": False, "Orchard_9": False, "OldOrchard Orchard": True}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.has_identifier(F.col("t"), "Orchard").alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == texts
    assert [Q.is_literal(s) for s in ("PearTree", "orchard-wall", "Q", "SQL", "orchard", "a/b", "old wall")] == [True, True, False, True, False, True, False]


def test_redaction_and_reasons(spark):
    text = "HEDGE_HEIGHT = 12\n  export GATE_CODE:\"77-31\"\n# who wrote this\njust words\nx y=1"
    assert one(spark, text, T.redact_env(F.col("t"))) == "HEDGE_HEIGHT =<redacted>\n  export GATE_CODE:<redacted>\n\n\n"
    files = [("k/gate.pem", b"q", "secret-material"), ("u.txt", b"1\x00\n", "non-text"), ("v.txt", b"\xc3(", "non-text"), ("w.txt", b"\x01\x02", None), ("x.txt", b"z" * 11, "file-too-large"), ("y.PEM", b"z" * 11, "file-too-large")]
    got = spark.createDataFrame([(p, bytearray(c)) for p, c, _ in files], "path string, content binary").select("path", T.skip_reason(F.col("path"), F.length("content"), F.lit(True), F.col("content"), 10).alias("r")).collect()
    assert {r["path"]: r["r"] for r in got} == {p: r for p, _, r in files}


def test_dotenv_names_in_any_case(spark):
    names = {".env": True, "a/.ENV": True, ".Envrc": True, "b/.env.prod": True, "Stage.Env": True, "x.ENV.bak": True, "environment": False, "env.txt": False, ".envx": False}
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", T.is_env(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == names


@pytest.mark.parametrize("most", range(1, 13))
def test_byte_cut_ends_between_characters(spark, most):
    for text in ("aé€😀b", "", "abc", "😀😀"):
        assert one(spark, text, T.byte_cut(F.col("t"), most)) == text.encode()[:most].decode(errors="ignore")


def test_query_analysis():
    assert Q.path_terms("Old pear wall PEAR hedge-rows and four ladders behind walls twice") == ["pear", "wall", "hedge", "rows", "four", "ladders"]
    assert Q.anchors("hedge-row") == [] and Q.anchors("hedge-row then gate_code") == ["hedge-row", "gate_code"] and Q.anchors("where is pearTree") == ["pearTree"] and Q.anchors("one hedge-row") == []
    assert Q.regex_literals(r"(?:pear|plum)\s+tree[s]?_[0-9]+old") == ["p", "ear", "lum", "tree", "s", "old"]  # what branches begin with alike is a literal of its own
    assert Q.camel_parts("XMLReaderTwo") == ["xmlreadertwo", "xml", "reader", "two"]
    assert [T.excerpt_limit(n) for n in (1, 8, 9, 12, 20, 100)] == [280, 280, 266, 200, 120, 120]
    for bad in ("", " \t", "!! --", "w " * 257, "y" * 16_385):
        with pytest.raises(ValueError):
            Q.plan_query(bad)
    for match, pattern in (("regexp", "(?!x)y"), ("regexp", "(unclosed"), ("glob", "x")):
        with pytest.raises((ValueError, Exception)):
            Q.plan_query(pattern, match)
