"""Records inside of texts, second tries and clusters: odd cases by hand."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, retrieval
from palimpsest.sources import records

C = F.col


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(C("x")).alias("y")).first().y


def test_mail_bodies(spark):
    assert one(spark, None, records.mail_body) == "" == one(spark, "", records.mail_body)
    assert one(spark, "Content-Type: text/plain; charset=no-such\n\na  b\n c", records.mail_body) == "a b c"
    assert one(spark, "Content-Type: text/html\n\n<p>a</p>b", records.mail_body) == "a b"


def test_functions_of_source_files(spark):
    assert one(spark, None, records.python_functions) == [] == one(spark, "def (", records.python_functions)
    found = one(spark, "class A:\n  def f(self): pass\ndef g(x, *, y=1):\n  'd'", records.python_functions)
    assert [(f.name, f.line, f.docstring) for f in found] == [("A", 1, ""), ("g", 3, "d"), ("f", 2, "")]
    assert one(spark, None, records.script_functions) == [] == one(spark, "let a = 1", records.script_functions)
    found = one(spark, "class A {}\nlet b = async (x) => 1\nfunction A() {}", records.script_functions)
    assert [(f.kind, f.name) for f in found] == [("function", "A"), ("function", "b")]


def test_json_objects_and_schemas(spark):
    assert one(spark, None, records.first_json_object) is None
    assert one(spark, 'a {"b": "}"} {', records.first_json_object) == '{"b": "}"}'
    assert one(spark, "a {b}", records.first_json_object) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "required": ["b"], "properties": {"b": {"type": "number", "enum": [1, 2]}}}}}
    issues = lambda s: one(spark, s, lambda c: records.schema_issues(c, schema))
    assert issues('{"a": {"b": 2}, "c": null}') == []
    assert issues('{"a": {}}') == ["root.a.b is required"]
    assert issues('{"a": {"b": "x"}}') == ["root.a.b must be number", "root.a.b must be one of [1, 2]"]
    assert issues("[]") == ["root must be object"]
    assert issues("") == issues(None) == ["root is not JSON"]


def test_configuration_chunks(spark):
    got = lambda f, s: [(c.service, c.content) for c in one(spark, s, f)]
    assert got(records.compose_chunks, None) == [("unknown", "")]
    assert got(records.compose_chunks, "services:\nx: 1") == [("unknown", "services:\nx: 1")]
    assert [s for s, _ in got(records.compose_chunks, "services:\n    a:\n        b: 1\n    c: {}\nvolumes: {}")] == ["a", "c", "__volumes__"]
    blocks = lambda c: records.server_blocks(c, F.lit("site"))
    assert got(blocks, None) == [("site", "")]
    assert got(blocks, "a b; http { server { } }\nserver { server_name x y; }") == [("http_global", "http { server { } }"), ("x", "server { server_name x y; }")]
    assert got(blocks, "} server { ")[0][0] == "site"


def test_second_tries(spark):
    q = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.2)], "qid long, s double")
    recall = lambda q: q.select("qid", F.lit(7).alias("id"), C("s").alias("score"), F.lit(1).alias("k"))
    expand = lambda q, hits: q.select("qid", F.when(C("qid") == 2, 0.4).otherwise(0.1).alias("s"))
    got = {r.qid: (r.score, r.hop) for r in retrieval.iterative(q, recall, expand, 0.5).collect()}
    assert got == {1: (0.9, 1), 2: (0.4, 2), 3: (0.2, 1)}


def test_spectral_clusters_and_summary_tree(spark):
    rows = [(i, [1.0, 0.05 * i, 0.0, 0.0]) for i in range(6)] + [(i, [0.0, 0.0, 1.0, 0.05 * (i - 10)]) for i in range(10, 16)]
    p = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert {(r.id, r.cluster) for r in graph.spectral(p).collect()} == {(i, 0 if i < 10 else 10) for i, _ in rows}
    tree = graph.summary_tree(p, [F.when(C("id") < 10, 0).otherwise(1), F.lit(0)])
    got = {(r.level, r.node): r.members for r in tree.collect()}
    assert got == {(1, 0): 6, (1, 1): 6, (2, 0): 12}
    one_point = p.where("id = 3")
    assert [(r.id, r.cluster) for r in graph.spectral(one_point).collect()] == [(3, 3)]
    with pytest.raises(Exception, match="points at most"):
        graph.spectral(spark.range(graph.MOST_SPECTRAL + 1).select("id", F.array(F.lit(1.0)).alias("embedding"))).collect()
