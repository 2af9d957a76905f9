"""Records inside of texts: mail bodies, functions of source files, JSON objects, services of configuration files.

Python's own parsers (mail, syntax trees, JSON) are called row by row in Arrow batches; all else is columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Characters kept of a mail, a docstring, a function's text and its signature.
MOST_MAIL, MOST_DOCSTRING, MOST_BODY, MOST_SIGNATURE = 8000, 500, 1500, 300

FUNCTIONS = "array<struct<kind:string,name:string,signature:string,docstring:string,body:string,line:int>>"


def _each(f, text: Column, returns: str) -> Column:
    """f of each text, null or not, in Arrow batches."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else None) for x in batch], dtype=object)

    return pandas_udf(run, returns)(text)


def _mail_body(raw: str | None) -> str:
    import email
    import re

    def decoded(part) -> str:
        found = part.get_payload(decode=True) or b""
        try:
            return found.decode(part.get_content_charset() or "utf-8", errors="ignore")
        except LookupError:  # a character set that isn't known
            return found.decode("utf-8", errors="ignore")

    parts = [p for p in email.message_from_string(raw or "").walk() if not p.is_multipart() and "attachment" not in str(p.get("Content-Disposition", ""))]
    plain = next((decoded(p) for p in parts if p.get_content_type() == "text/plain"), None)
    if plain is None:
        marked = next((decoded(p) for p in parts if p.get_content_type() == "text/html"), "")
        plain = re.sub(r"<[^>]+>", " ", marked)
    return " ".join(plain.split())[:MOST_MAIL]


def mail_body(raw: Column) -> Column:
    """The first plain part of a message, else its first HTML part without tags; white space made one space. Attachments
    don't count; a message without such a part gives an empty string."""
    return _each(_mail_body, raw, "string")


def _functions(source: str | None) -> list[dict]:
    import ast

    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            kind, signature = "class", f"class {node.name}"
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            waits = isinstance(node, ast.AsyncFunctionDef)
            kind, signature = ("async_function" if waits else "function"), f"{'async ' * waits}def {node.name}({ast.unparse(node.args)})"
        else:
            continue
        body = ast.get_source_segment(source, node) or ""
        out.append({"kind": kind, "name": node.name, "signature": signature, "docstring": (ast.get_docstring(node) or "")[:MOST_DOCSTRING], "body": body[:MOST_BODY], "line": node.lineno})
    return out


def python_functions(source: Column) -> Column:
    """Classes and functions of a Python file, outer ones first; none of a file that doesn't parse."""
    return _each(_functions, source, FUNCTIONS)


#: How a function or class begins in a script, and what it is; the first group is its name.
SCRIPT_STARTS = (
    ("function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\([^)]*\)"),
    ("function", r"(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    ("class", r"(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"),
)


def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["signature"].alias("signature"))


def script_functions(source: Column) -> Column:
    """Array of (kind, name, signature) in a script, a name once: named functions, then arrows, then classes."""
    found = []
    for kind, pattern in SCRIPT_STARTS:
        whole, name = F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1)), F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
        both = F.zip_with(whole, name, lambda w, n: F.struct(n.alias("name"), F.substring(F.trim(w), 1, MOST_SIGNATURE).alias("signature")))
        found.append(F.transform(both, _of_kind(kind)))
    every = F.coalesce(F.concat(*found), F.array().cast("array<struct<kind:string,name:string,signature:string>>"))
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: y["name"] == x["name"]))


def _first_object(text: str | None) -> str | None:
    import json

    at = (text or "").find("{")
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False) if at >= 0 else None
    except (ValueError, RecursionError):
        return None


def first_json_object(text: Column) -> Column:
    """The JSON object that starts at a text's first brace; null if none does."""
    return _each(_first_object, text, "string")


#: Names that JSON schemas give to types, as patterns of Spark's names for a variant's type.
TYPES = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def schema_issues(payload: Column, schema: dict, path: str = "root") -> Column:
    """What is wrong with a JSON text by a schema of objects (type, required, properties with type, enum, minLength,
    pattern, additionalProperties), as an array of messages; text that isn't JSON has one."""
    v = F.try_parse_json(payload)
    issues = []

    def check(bad: Column, message: str) -> None:
        issues.append(F.when(bad, F.lit(message)))

    def visit(at: str, own: dict, name: str) -> None:
        there = F.try_variant_get(v, at, "variant")
        kind = F.schema_of_variant(there)
        if own.get("type"):
            check(there.isNotNull() & ~kind.rlike(f"^({TYPES[own['type']]})$"), f"{name} must be {own['type']}")
        said = F.try_variant_get(v, at, "string")
        text = F.when(kind == "STRING", said)
        if "enum" in own:
            check(there.isNotNull() & ~F.coalesce(said.isin(*map(str, own["enum"])), F.lit(False)), f"{name} must be one of {sorted(own['enum'])}")
        if own.get("minLength"):
            check(F.length(text) < own["minLength"], f"{name} must be at least {own['minLength']} chars")
        if own.get("pattern"):
            check(~text.rlike("^(?:" + own["pattern"] + ")"), f"{name} does not match pattern {own['pattern']}")
        if own.get("required") or own.get("additionalProperties") is False:
            keys = F.when(kind.startswith("OBJECT"), F.json_object_keys(F.to_json(there)))
            for k in own.get("required", ()):
                check(~F.array_contains(keys, k), f"{name}.{k} is required")
            if own.get("additionalProperties") is False:
                known = F.array(*[F.lit(k) for k in own.get("properties", {})]).cast("array<string>")
                check(F.size(F.array_except(keys, known)) > 0, f"{name} has unexpected fields")
        for k, inner in own.get("properties", {}).items():
            visit(f"{at}.{k}", inner, f"{name}.{k}")

    visit("$", schema, path)
    every = F.filter(F.array(*issues), lambda m: m.isNotNull())
    return F.when(v.isNull(), F.array(F.lit(f"{path} is not JSON"))).otherwise(every)


#: Keys beside the services that get a chunk of their own.
SHARED_SECTIONS = ("networks", "volumes", "secrets", "configs")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def compose_chunks(text: Column) -> Column:
    """Array of (service, content) of a compose file: one for each service, whatever the indentation, and one for each
    section that services share; a file without either is one chunk, `unknown`."""
    lines = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[ \t]*(#.*)?\r?\n", ""))
    sections = F.filter(F.split(lines, r"\n(?=[^\s#])"), lambda s: F.trim(s) != "")
    key = lambda s: F.regexp_extract(s, r"^\s*[\"']?([^\s:\"']+)", 1)
    body = F.element_at(F.concat(F.filter(sections, lambda s: key(s) == "services"), F.array(F.lit(""))), 1)
    indent = F.regexp_extract(body, r"\n([ \t]+)\S", 1)
    cut = F.split(body, F.concat(F.lit(r"\n(?="), indent, F.lit(r"[^\s#])")))
    services = F.when(indent == "", F.array().cast("array<string>")).otherwise(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))))
    chunk = lambda name, content: F.struct(name.alias("service"), content.alias("content"))
    own = F.transform(services, lambda s: chunk(key(s), _stripped(s)))
    shared = F.transform(F.filter(sections, lambda s: key(s).isin(*SHARED_SECTIONS)), lambda s: chunk(F.concat(F.lit("__"), key(s), F.lit("__")), _stripped(s)))
    every = F.concat(own, shared)
    return F.when(F.size(every) > 0, every).otherwise(F.array(chunk(F.lit("unknown"), F.coalesce(text, F.lit("")))))


def server_blocks(text: Column, name: Column) -> Column:
    """Array of (service, content), one for each block of the outermost braces of a server's configuration: a server by its
    first name, maps and upstreams by theirs, others by their kind. A file without blocks is one chunk by its own name.
    Comments go; braces are told from the running count of those opened and closed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)(^|\s)#.*$", "$1")
    pieces = F.split(bare, r"(?<=\})")
    opened = lambda s: F.length(s) - F.length(F.translate(s, "{", ""))
    closed = lambda s: F.length(s) - F.length(F.translate(s, "}", ""))
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, piece: Column) -> Column:
        held, depth = F.concat(state["held"], piece), state["depth"] + opened(piece) - closed(piece)
        ends = (depth <= 0) & held.contains("{")
        done = F.when(ends, F.concat(state["done"], F.array(held))).otherwise(state["done"])
        return F.struct(F.when(ends, "").otherwise(held).alias("held"), F.greatest(depth, F.lit(0)).alias("depth"), done.alias("done"))

    blocks = F.aggregate(pieces, start, step)["done"]

    def chunk(block: Column) -> Column:
        # directives without braces may stand before a block
        content = F.trim(F.regexp_replace(block, r"^(?:[^{};]*;)*\s*", ""))
        kind, arg = F.regexp_extract(content, r"^(\w+)", 1), F.regexp_extract(content, r"^\w+\s+([^\s{]+)", 1)
        host, into = F.regexp_extract(content, r"server_name\s+([^\s;]+)", 1), F.regexp_extract(content, r"^map\s+\S+\s+([^\s{]+)", 1)
        service = F.when(kind == "server", F.when(host == "", "default-server").otherwise(host)).when(kind == "map", F.when(into == "", "map").otherwise(F.concat(F.lit("map_"), into)))
        service = service.when(kind == "upstream", F.when(arg == "", "upstream").otherwise(F.concat(F.lit("upstream_"), arg))).when(kind.isin("http", "events", "stream", "mail"), F.concat(kind, F.lit("_global")))
        return F.struct(service.otherwise(F.when(kind == "", "unknown").otherwise(kind)).alias("service"), content.alias("content"))

    every = F.transform(blocks, chunk)
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.struct(name.alias("service"), F.trim(F.coalesce(text, F.lit(""))).alias("content"))))
