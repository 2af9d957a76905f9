"""Queries on records inside of texts: mails, source files, JSON, configuration files, relations, sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.plans.bindings import ATOMS, atoms
from palimpsest.plans.registry import query
from palimpsest.sources import records

C = F.col

# -- sources


@query("src_mail_bodies", "SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 3 = 1 THEN replace(text, 'e', ' ') ELSE text END, '\\s+', ' ', 'g'))[1:8000] AS body FROM conversations")
def src_mail_bodies(t):
    """A turn as a message: a plain and an HTML part, an HTML part alone, or no parts; base64 throughout. In the HTML, tags
    stand for the letter e."""
    part = lambda kind, s: F.concat(F.lit(f"Content-Type: text/{kind}; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(s, "UTF-8")), F.lit("\n"))
    plain, marked = part("plain", C("text")), part("html", F.regexp_replace("text", "e", "<i>"))
    mixed = lambda *parts: F.concat(F.lit('Content-Type: multipart/mixed; boundary="=b"\n\n'), *[F.concat(F.lit("--=b\n"), p) for p in parts], F.lit("--=b--\n"))
    other = F.lit("Content-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nnot this\n")
    raw = F.when(C("turn") % 3 == 0, mixed(other, marked, plain)).when(C("turn") % 3 == 1, mixed(other, marked)).otherwise(plain)
    return t.conversations.select("conv_id", "turn", records.mail_body(raw).alias("body"))


@query("src_python_functions", "SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 5 = 4 THEN [] ELSE [{'kind': 'class', 'signature': concat('class K', p_partkey), 'line': 1, 'doc': ''}, {'kind': 'async_function', 'signature': 'async def g(x=' || p_partkey || ')', 'line': 5, 'doc': ''}, {'kind': 'function', 'signature': 'def f(self, *a)', 'line': 2, 'doc': p_name}] END, recursive := true) FROM part")
def src_python_functions(t):
    """A file for each part; one in five doesn't parse."""
    key = C("p_partkey").cast("string")
    code = F.concat(F.lit("class K"), key, F.lit(":\n  def f(self, *a):\n    '''"), C("p_name"), F.lit("'''\n    return a\nasync def g(x="), key, F.when(C("p_partkey") % 5 == 4, F.lit("(")).otherwise(F.lit("")), F.lit("):\n  return x\n"))
    f = t.part.select(C("p_partkey").alias("id"), F.explode(records.python_functions(code)).alias("f"))
    return f.select("id", "f.kind", "f.signature", "f.line", C("f.docstring").alias("doc"))


@query("src_script_functions", "SELECT p_partkey AS id, unnest([{'kind': 'function', 'name': 'load' || p_partkey, 'signature': 'export async function load' || p_partkey || '(a, b)'}, {'kind': 'function', 'name': 'get', 'signature': 'const get = (x) =>'}, {'kind': 'class', 'name': 'K', 'signature': 'export class K'}], recursive := true) FROM part")
def src_script_functions(t):
    key = C("p_partkey").cast("string")
    code = F.concat(F.lit("export async function load"), key, F.lit("(a, b) {\n}\nconst get = (x) => x\nexport class K extends B {}\nclass get {}\n"))
    return t.part.select(C("p_partkey").alias("id"), F.explode(records.script_functions(code)).alias("f")).select("id", "f.*")


# -- chunks and texts


@query("fn_compose_chunks", "SELECT n_nationkey AS id, unnest([{'service': lower(n_name), 'lines': 3}, {'service': 'db', 'lines': 2}, {'service': '__networks__', 'lines': 2}], recursive := true) FROM nation WHERE n_nationkey % 7 <> 6 UNION ALL SELECT n_nationkey, 'unknown', 2 FROM nation WHERE n_nationkey % 7 = 6")
def fn_compose_chunks(t):
    """Files of two and four blanks' indentation, and some without services."""
    file = F.concat(F.lit("# made\nversion: '3.9'\n\nservices:\n  "), F.lower("n_name"), F.lit(":\n    image: a\n    # note\n    ports: [1]\n  db:\n    image: b\nnetworks:\n  front: {}\n"))
    file = F.when(C("n_nationkey") % 2 == 0, file).otherwise(F.regexp_replace(file, "(?m)^( +)", "$1$1"))
    file = F.when(C("n_nationkey") % 7 == 6, F.lit("version: '3'\nname: x")).otherwise(file)
    c = t.nation.select(C("n_nationkey").alias("id"), F.explode(records.compose_chunks(file)).alias("c"))
    return c.select("id", "c.service", F.size(F.split("c.content", "\n")).alias("lines"))


@query("fn_server_blocks", "SELECT n_nationkey AS id, unnest([{'service': 'upstream_app', 'locations': 0}, {'service': 'map_$go', 'locations': 0}, {'service': lower(n_name) || '.example.org', 'locations': 2}, {'service': 'default-server', 'locations': 1}], recursive := true) FROM nation WHERE n_nationkey % 6 <> 5 UNION ALL SELECT n_nationkey, lower(n_name), 0 FROM nation WHERE n_nationkey % 6 = 5")
def fn_server_blocks(t):
    host = F.concat(F.lower("n_name"), F.lit(".example.org"))
    file = F.concat(F.lit("# all { hosts\nuser www;\nupstream app { server a:1; }\nmap $host $go { default 0; a 1; }\nserver {\n  server_name "), host, F.lit(" b.example.org;\n  location / { if ($x) { return 1; } }\n  location /b { return 2; } # }\n}\nserver { location / { return 3; } }\n"))
    file = F.when(C("n_nationkey") % 6 == 5, F.lit("# nothing here\nuser www;")).otherwise(file)
    c = t.nation.select(C("n_nationkey").alias("id"), F.explode(records.server_blocks(file, F.lower("n_name"))).alias("c"))
    return c.select("id", "c.service", (F.size(F.split("c.content", "location ")) - 1).alias("locations"))


@query("fn_json_object", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS found FROM events")
def fn_json_object(t):
    said = F.when(C("event_id") % 3 == 0, F.concat(F.lit("It is "), C("props"), F.lit(", not {}."))).when(C("event_id") % 3 == 1, F.concat(F.lit("{ no: "), C("props"))).otherwise("nothing")
    return t.events.select("event_id", records.first_json_object(said).alias("found"))


ANSWER = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer"}, "kind": {"type": "string", "enum": ["a", "b"], "minLength": 1, "pattern": "[a-z]"}}}


@query("fn_schema_issues", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'root.k must be integer' WHEN 2 THEN 'root.k is required' WHEN 3 THEN 'root has unexpected fields|root.kind must be one of [''a'', ''b'']|root.kind does not match pattern [a-z]' WHEN 4 THEN 'root is not JSON' ELSE 'root must be object' END AS issues FROM events")
def fn_schema_issues(t):
    said = F.when(C("event_id") % 6 == 0, C("props")).when(C("event_id") % 6 == 1, F.lit('{"k": "x", "kind": "a"}')).when(C("event_id") % 6 == 2, F.lit('{"kind": "b"}'))
    said = said.when(C("event_id") % 6 == 3, F.lit('{"k": 1, "kind": "Z", "more": [1]}')).when(C("event_id") % 6 == 4, F.lit("{k")).otherwise(F.lit("[1]"))
    return t.events.select("event_id", F.array_join(records.schema_issues(said, ANSWER), "|").alias("issues"))


#: (what is said, its canonical name, status), and the kinds that a relation's ends may have.
RELATIONS = [("src0", "supports", "active"), ("src1", "supports", "alias"), ("src2", "cites", "active"), ("src3", "cites", "deprecated")]
ENDS = [("supports", ["fact", "decision"], ["canonical", "semantic"]), ("cites", None, ["knowledge"])]


@query("fn_relation_issues", f"WITH {ATOMS}, r AS (SELECT * FROM (VALUES ('src0', 'supports', 'active'), ('src1', 'supports', 'alias'), ('src2', 'cites', 'active'), ('src3', 'cites', 'deprecated')) AS r(path, rel, status)) SELECT id, concat_ws('|', CASE WHEN status IS NULL THEN 'relation:warning:unknown' WHEN status = 'deprecated' THEN 'relation:warning:deprecated' WHEN status = 'alias' THEN 'relation:info:alias' END, CASE WHEN rel = 'supports' AND kind NOT IN ('fact', 'decision') THEN 'source_type:warning:not allowed' END, CASE WHEN (rel = 'supports' AND collection NOT IN ('canonical', 'semantic')) OR (rel = 'cites' AND collection <> 'knowledge') THEN 'target_type:warning:not allowed' END) AS issues FROM atoms LEFT JOIN r USING (path)")
def fn_relation_issues(t):
    """Registered names and ends' kinds are two small given tables; without a restriction, any kind may stand there."""
    names = t.spark.createDataFrame(RELATIONS, "path string, rel string, status string")
    ends = t.spark.createDataFrame(ENDS, "rel string, sources array<string>, targets array<string>")
    said = atoms(t).select("id", "path", "kind", "collection").join(F.broadcast(names), "path", "left").join(F.broadcast(ends), "rel", "left")
    status = F.when(C("status").isNull(), "relation:warning:unknown").when(C("status") == "deprecated", "relation:warning:deprecated").when(C("status") == "alias", "relation:info:alias")
    source = F.when(~F.expr("array_contains(sources, kind)"), "source_type:warning:not allowed")
    target = F.when(~F.expr("array_contains(targets, collection)"), "target_type:warning:not allowed")
    return said.select("id", F.concat_ws("|", status, source, target).alias("issues"))


@query("fn_index_text", "SELECT doc_id, md5(concat(text, chr(10), source, chr(10), lang, chr(10), 'kept de', chr(10), regexp_replace(source, '[^A-Za-z0-9가-힣]+', ' ', 'g'))[1:12000]) AS digest FROM documents")
def fn_index_text(t):
    """The text, what is known of it, and the path's words, up to the index's 12,000 characters."""
    tags = F.array_join(F.array(F.lit("kept"), F.lit("de")), " ")
    composed = F.concat_ws("\n", "text", "source", "lang", tags, F.regexp_replace("source", "[^A-Za-z0-9가-힣]+", " "))
    return t.documents.select("doc_id", F.md5(F.substring(composed, 1, 12000)).alias("digest"))


#: A question about a relation's name, and one for a person's own.
OF_RELATION, OWN_NAME = text.edged(r"(?isu)\b(leur|the|la|le)\b.*\b(qui|that)\b"), text.edged(r"(?iu)\b(dans|with)\b")


@query("flt_identity_suppressed", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?is)\\b(leur|the|la|le)\\b.*\\b(qui|that)\\b') AND NOT regexp_matches(text, '(?i)\\b(dans|with)\\b')")
def flt_identity_suppressed(t):
    """Questions on which the owner's own identity must not be served: after a relation's name, and not after theirs. What
    tells them are two patterns, here words of the given texts."""
    return t.conversations.where(C("text").rlike(OF_RELATION) & ~C("text").rlike(OWN_NAME)).select("conv_id", "turn")


# -- sentences

LETTERS = "etaoinsrlu"


def embedded(text):
    """A given embedder's place: counts of ten letters. Any column function from text to vector may stand here."""
    return F.array(*[(F.length(text) - F.length(F.translate(text, x, ""))).cast("double") for x in LETTERS])


DUCK_EMBEDDED = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


@query("fn_embed", f"SELECT item_id, round(sqrt(list_sum(list_transform({DUCK_EMBEDDED.format('p')}, lambda v: v * v))), 6) AS norm, {DUCK_EMBEDDED.format('p')}[2] AS second FROM (SELECT item_id, concat('passage: ', text) AS p FROM benchmark)")
def fn_embed(t):
    """Passages are told from questions by a prefix before they are embedded."""
    from palimpsest.functions.vector import norm

    v = t.benchmark.select("item_id", embedded(F.concat(F.lit("passage: "), C("text"))).alias("v"))
    return v.select("item_id", F.round(norm(C("v")), 6).alias("norm"), F.element_at("v", 2).alias("second"))


@query(
    "fn_semantic_chunks",
    f"WITH s AS (SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS s FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^.!?]+[.!?]*\\s*') AS p FROM conversations)), "
    f"v AS (SELECT *, {DUCK_EMBEDDED.format('s')} AS v FROM s), l AS (SELECT *, lag(v) OVER w AS before FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)), "
    "d AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN list_sum(v) = 0 OR list_sum(before) = 0 THEN 1.0 ELSE round(1 - list_dot_product(v, before) / sqrt(list_dot_product(v, v) * list_dot_product(before, before)), 6) END AS d FROM l), "
    "q AS (SELECT conv_id, turn, quantile_cont(d, 0.9) AS q FROM d GROUP BY ALL), b AS (SELECT d.*, CASE WHEN d > 0 AND d >= q - 1e-9 THEN 1 ELSE 0 END AS b FROM d JOIN q USING (conv_id, turn)), "
    "c AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn ORDER BY place) AS c FROM b), e AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id, turn, c ORDER BY place) AS until FROM c) "
    "SELECT conv_id, turn, CAST(c AS BIGINT) AS chunk, CAST((until - length(s)) // 1800 AS BIGINT) AS part, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM e GROUP BY ALL",
)
def fn_semantic_chunks(t):
    """A chunk ends where a sentence is as far from the next as only a tenth of the text's are; one of over 1,800 characters
    is cut at sentences."""
    from palimpsest.functions.vector import dot

    s = t.conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^.!?]+[.!?]*\s*)"), F.lit(1))).alias("place", "s"))
    w = Window.partitionBy("conv_id", "turn").orderBy("place")
    v = s.withColumn("v", embedded(C("s"))).withColumn("before", F.lag("v").over(w))
    zero = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) == 0
    apart = F.round(1 - dot(C("v"), C("before")) / F.sqrt(dot(C("v"), C("v")) * dot(C("before"), C("before"))), 6)
    d = v.select("conv_id", "turn", "place", "s", F.when(C("before").isNotNull(), F.when(zero(C("v")) | zero(C("before")), 1.0).otherwise(apart)).alias("d"))
    d = d.withColumn("q", F.percentile("d", 0.9).over(Window.partitionBy("conv_id", "turn")))
    c = d.withColumn("chunk", F.sum(F.when((C("d") > 0) & (C("d") >= C("q") - 1e-9), 1).otherwise(0)).over(w))
    c = c.withColumn("until", F.sum(F.length("s")).over(Window.partitionBy("conv_id", "turn", "chunk").orderBy("place")))
    c = c.withColumn("part", F.floor((C("until") - F.length("s")) / 1800))
    return c.groupBy("conv_id", "turn", "chunk", "part").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).cast("long").alias("chars"))
