"""Extractors: from a file to facts, and how their results are checked.

An extractor is a function from (path, content) to a list of facts; a fact has kind, title, text,
start_line, end_line and may have metadata and id.  Files run through in batches per task; an
extractor that fails gives a diagnostic for the file and no facts, the others go on.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import model
from ..functions.text import glob_regex

Fact = dict
Extractor = Callable[[str, str], list[Fact]]


def _fact(kind: str, title: str, text: str, start: int, end: int | None = None, **metadata) -> Fact:
    return {"kind": kind, "title": title, "text": cut_text(text), "start_line": start, "end_line": end or start, "metadata": metadata or None}


FACTS = model.MAX_RECORDS - 1


def cut_text(text: str, most: int = model.MAX_RECORD_TEXT - 1) -> str:
    """The start of a text in at most ``most`` bytes, cut between characters."""
    return text.encode()[:most].decode(errors="ignore")


#: What a heading and the marks of a fence look like.
HEADING = re.compile(r"#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*")
FENCES = ("```", "~~~")


def markdown(path: str, content: str) -> list[Fact]:
    """Sections (a heading to before the next heading of any level) and fenced blocks, in order.

    A heading within a fence begins no section, but ends the one that the fence is in."""
    lines, facts, fences, free = content.split("\n"), [], [], 0
    heads = [i for i, line in enumerate(lines) if HEADING.fullmatch(line)]
    for i, line in enumerate(lines):
        mark = line.strip()[:3]
        if i >= free and mark in FENCES:
            free = next((j + 1 for j in range(i + 1, len(lines)) if lines[j].strip().startswith(mark)), len(lines))
            fences.append(range(i, free))
            facts.append(_fact("markdown-fence", line.strip()[3:].strip(), "\n".join(lines[i:free]).strip(), i + 1, free) | {"id": f"fence:{i + 1}"})
    fenced = {i for f in fences for i in f}
    for i, end in zip(heads, [*heads[1:], len(lines)]):
        if i not in fenced:
            facts.append(_fact("markdown-section", HEADING.fullmatch(lines[i])[1].strip(), "\n".join(lines[i:end]).strip(), i + 1, end) | {"id": f"heading:{i + 1}"})
    return sorted(facts, key=lambda f: f["start_line"])[:FACTS]


def python(path: str, content: str) -> list[Fact]:
    """Imports, classes, functions and methods, and one navigation record; SyntaxError is the caller's."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        raise ValueError(f"line {e.lineno}: {e.msg}") from None
    lines, out = content.split("\n"), []

    def define(node, kind: str, title: str) -> None:
        out.append(_fact(kind, title, lines[node.lineno - 1].strip(), node.lineno, node.lineno, semantic=False))

    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                define(node, "python-import", a.name)
        elif isinstance(node, ast.ImportFrom):
            define(node, "python-import", "." * node.level + (node.module or ""))
        elif isinstance(node, ast.ClassDef):
            define(node, "python-class", node.name)
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    define(m, "python-method", f"{node.name}.{m.name}")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            define(node, "python-function", node.name)
    return _navigation("python", path, out, len(lines))


def _navigation(language: str, path: str, facts: list[Fact], lines: int) -> list[Fact]:
    facts = facts[:FACTS]
    if not facts:
        return []
    return [*facts, _fact(f"{language}-navigation", path, "\n".join(f["title"] for f in facts), 1, max(1, lines), lexical=False, facts=len(facts))]


_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def masked(content: str) -> str:
    """The text with comments and string contents blanked, positions kept."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)


def _depths(text: str) -> list[int]:
    """Brace depth at each line's start."""
    out, depth = [], 0
    for line in text.split("\n"):
        out.append(depth)
        depth += line.count("{") + line.count("(") - line.count("}") - line.count(")")
    return out


_TS_MODULE = re.compile(r"^\s*(import|export)\b[^;'\"]*?(?:from\s*)?['\"]([^'\"]+)['\"]")
_TS_DEFINE = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|namespace|const|let|var)\*?\s+([A-Za-z_$][\w$]*)")


def typescript(path: str, content: str) -> list[Fact]:
    lines, clear, out = content.split("\n"), masked(content).split("\n"), []
    depths = _depths("\n".join(clear))
    for i, (line, plain) in enumerate(zip(lines, clear, strict=True)):
        if depths[i]:
            continue
        if re.match(r"\s*(import|export)\b", plain) and (m := _TS_MODULE.match(line)):
            out.append(_fact(f"typescript-{m[1]}", m[2], line.strip(), i + 1, semantic=False))
        elif m := _TS_DEFINE.match(plain):
            out.append(_fact(f"typescript-{m[1]}", m[2], line.strip(), i + 1, semantic=False))
    return _navigation("typescript", path, out, len(lines))


_GO = re.compile(r"^(?:func\s+(?:\((?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)|(type|const|var)\s+(\w+))")


def go(path: str, content: str) -> list[Fact]:
    lines, clear, out = content.split("\n"), masked(content).split("\n"), []
    depths, block = _depths("\n".join(clear)), ""
    for i, (line, plain) in enumerate(zip(lines, clear, strict=True)):
        if depths[i] == 0:
            block = m[1] if (m := re.match(r"(import|const|var|type)\s*\(", plain)) else ""
            if m := re.match(r'import\s+(?:\S+\s+)?"([^"]+)"', line):
                out.append(_fact("go-import", m[1], line.strip(), i + 1, semantic=False))
            elif (m := _GO.match(plain)) and not block:
                kind = ("method" if m[1] else "function") if m[2] else m[3]
                title = (f"{m[1]}.{m[2]}" if m[1] else m[2]) if m[2] else m[4]
                out.append(_fact(f"go-{kind}", title, line.strip().rstrip("{").strip(), i + 1, semantic=False))
        elif depths[i] == 1 and block == "import" and (m := re.match(r'\s*(?:\S+\s+)?"([^"]+)"', line)):
            out.append(_fact("go-import", m[1], line.strip(), i + 1, semantic=False))
        elif depths[i] == 1 and block in ("const", "var", "type") and (m := re.match(r"\s*(\w+)", plain)):
            out.append(_fact(f"go-{block}", m[1], line.strip(), i + 1, semantic=False))
    return _navigation("go", path, out, len(lines))


def manifest(path: str, content: str) -> list[Fact]:
    """Packages and dependencies of package.json, go.mod, Cargo.toml and pyproject.toml."""
    name, lines, out = path.rsplit("/", 1)[-1], content.split("\n"), []

    def add(kind: str, title: str, value: str = "") -> None:
        at = next((i for i, line in enumerate(lines, 1) if title in line), 1)
        out.append(_fact(kind, title, f"{title} {value}".strip(), at))

    if name == "package.json":
        d = json.loads(content)
        if d.get("name"):
            add("npm-package", d["name"], str(d.get("version", "")))
        if d.get("packageManager"):
            add("package-manager", d["packageManager"])
        for field in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            for k, v in (d.get(field) or {}).items():
                add("npm-dependency", k, str(v))
        for k, v in (d.get("scripts") or {}).items():
            add("package-script", k, str(v))
        members = d.get("workspaces") or []
        for k in members if isinstance(members, list) else members.get("packages", []):
            add("workspace-member", k)
    elif name == "go.mod":
        section = ""
        for i, raw in enumerate(lines, 1):
            line = raw.split("//")[0].strip()
            if m := re.match(r"(require|replace|exclude)\s*\($", line):
                section = m[1]
            elif line == ")":
                section = ""
            elif m := re.match(r"(module|go|toolchain)\s+(\S+)", line):
                out.append(_fact({"module": "go-module", "go": "go-version", "toolchain": "go-toolchain"}[m[1]], m[2], line, i))
            elif line and (m := re.match(r"(?:(require|replace|exclude)\s+)?(\S+)", line)) and (m[1] or section):
                out.append(_fact({"require": "go-dependency", "replace": "go-replace", "exclude": "go-exclude"}[m[1] or section], m[2], line, i))
    elif name in ("Cargo.toml", "pyproject.toml"):
        d = tomllib.loads(content)
        if name == "Cargo.toml":
            if d.get("package", {}).get("name"):
                add("cargo-package", d["package"]["name"], str(d["package"].get("version", "")))
            for field in ("dependencies", "dev-dependencies", "build-dependencies"):
                for k in d.get(field, {}):
                    add("cargo-dependency", k)
            for k in d.get("features", {}):
                add("cargo-feature", k)
            for k in d.get("workspace", {}).get("members", []):
                add("workspace-member", k)
        else:
            p = d.get("project", {})
            if p.get("name"):
                add("pypi-project", p["name"], str(p.get("version", "")))
            for k in [*p.get("dependencies", []), *(x for v in p.get("optional-dependencies", {}).values() for x in v)]:
                add("pypi-dependency", re.split(r"[\s<>=!~;\[(]", k)[0], k)
    return out


def terraform(path: str, content: str) -> list[Fact]:
    """Blocks under their dotted context, and attributes with what they refer to."""
    out, context = [], []
    for i, line in enumerate(masked(content).split("\n"), 1):
        raw = content.split("\n")[i - 1]
        if m := re.match(r'\s*(\w+)((?:\s+"[^"]*")*)\s*\{\s*$', raw):
            labels = re.findall(r'"([^"]*)"', m[2])
            context.append(".".join([m[1], *labels]))
            out.append(_fact("terraform-block", ".".join(context), raw.strip(), i, labels=labels))
        elif m := re.match(r"\s*(\w+)\s*=\s*(.+)$", raw):
            refs = sorted(set(re.findall(r"\b(?:var|local|module|data|[a-z]\w*_\w+)\.[\w.]+", re.sub(r"#.*$", "", m[2]))))
            out.append(_fact("terraform-attribute", ".".join([*context, m[1]]), raw.strip(), i, references=refs))
            if line.count("{") > line.count("}"):
                context.append(m[1])
        elif "}" in line and context:
            context.pop()
    return out


_TYPES = re.compile(r"\b(class|interface|enum|record|struct)\s+(\w+)")


def jvm_dotnet(path: str, content: str) -> list[Fact]:
    """Packages or namespaces, imports or usings, and definitions under their enclosing types: a scanner of lines."""
    java = path.endswith(".java")
    kinds = ("java-package", "java-import", "java-definition") if java else ("dotnet-namespace", "dotnet-using", "dotnet-definition")
    first, second = (r"package\s+([\w.]+)", r"import\s+(?:static\s+)?([\w.*]+)\s*;") if java else (r"namespace\s+([\w.]+)", r"(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;")
    out, depth, types = [], 0, []
    for i, (raw, line) in enumerate(zip(content.split("\n"), masked(content).split("\n"), strict=True), 1):
        while types and depth <= types[-1][1]:
            types.pop()
        if m := re.match(rf"\s*{first}", line):
            out.append(_fact(kinds[0], m[1], raw.strip(), i))
        elif m := re.match(rf"\s*{second}", line):
            out.append(_fact(kinds[1], m[1], raw.strip(), i))
        elif m := _TYPES.search(line):
            out.append(_fact(kinds[2], ".".join([*(t for t, _ in types), m[2]]), raw.strip(), i, definitionKind=m[1]))
            types.append((m[2], depth))
        elif types and depth == types[-1][1] + 1 and (m := re.match(r"\s*(?:[\w<>\[\],.?@]+\s+)+(\w+)\s*(\(|\{)", line)) and m[1] not in ("if", "for", "while", "switch", "catch"):
            out.append(_fact(kinds[2], ".".join([*(t for t, _ in types), m[1]]), raw.strip(), i, definitionKind="method" if m[2] == "(" else "property"))
        depth += line.count("{") - line.count("}")
    return out


def clojure(path: str, content: str) -> list[Fact]:
    """One summary of a file: namespace, what it requires, what it defines; bounded."""
    clear = re.sub(r";[^\n]*", "", content)
    ns = m[1] if (m := re.search(r"\(ns\s+(?:\^\S+\s+)?([\w.*+!?<>=-]+)", clear)) else ""
    block = m[1] if (m := re.search(r"\(:require\b(.*?)\)\s*(?:\(:|\)|$)", clear, re.S)) else ""
    requires = re.findall(r"\[?\s*([a-zA-Z][\w.*+!?<>=-]*\.[\w.*+!?<>=-]+)", block)
    definitions = re.findall(r"^\((def\w*-?|deftype|defrecord)\s+(?:\^\S+\s+)*([\w.*+!?<>=-]+)", clear, re.M)
    if not (ns or requires or definitions):
        return []
    cut = len(requires) > 128 or len(definitions) > 128
    text = "\n".join([ns, *requires[:128], *(f"{k} {n}" for k, n in definitions[:128])]).strip()
    return [_fact("clojure-file", ns or path, text, 1, content.count("\n") + 1, namespace=ns, requires=requires[:128], definitions=[n for _, n in definitions[:128]], truncated=cut)]


EXTRACTORS: dict[str, tuple[list[str], Extractor]] = {
    "markdown": (["**/*.md"], markdown),
    "python": (["**/*.py"], python),
    "typescript": (["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx"], typescript),
    "go": (["**/*.go"], go),
    "manifest": (["**/package.json", "**/go.mod", "**/Cargo.toml", "**/pyproject.toml"], manifest),
    "terraform": (["**/*.tf"], terraform),
    "jvm-dotnet": (["**/*.java", "**/*.cs"], jvm_dotnet),
    "clojure": (["**/*.clj", "**/*.cljs", "**/*.cljc"], clojure),
}


def problem(facts: list[Fact], lines: int) -> str | None:
    """Why an extractor's answer is refused as a whole; None if it is not."""
    ids = [f["id"] for f in facts if f.get("id")]
    if len(facts) > model.MAX_RECORDS:
        return "too many records"
    if len(ids) != len(set(ids)):
        return "an id occurs twice"
    for f in facts:
        if not f.get("kind") or not f.get("text") or f.get("source"):
            return "a record lacks kind or text, or names a source"
        if not 1 <= f["start_line"] <= f["end_line"] <= max(1, lines):
            return "a record's lines are not in the file"
        if len(f["text"].encode()) > model.MAX_RECORD_TEXT or len(json.dumps(f.get("metadata")).encode()) > model.MAX_METADATA:
            return "a record's text or metadata is too long"
    return None


def extract(files: DataFrame, extractors: dict[str, tuple[list[str], Extractor]] | None = None) -> DataFrame:
    """Records of files(path, content) with diagnostics: a record's columns, and message where there was a problem."""
    chosen = {name: ([re.compile(glob_regex(g)) for g in globs], f) for name, (globs, f) in (EXTRACTORS if extractors is None else extractors).items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, (globs, f) in chosen.items():
                    if content is None or not any(g.match(path) for g in globs):
                        continue
                    try:
                        facts = f(path, content)
                        facts = facts if name not in EXTRACTORS or len(facts) <= model.MAX_RECORDS else facts[:FACTS]  # our own are cut rather than refused
                        message = problem(facts, content.count("\n") + 1)
                    except Exception as e:  # an extractor's failure is a diagnostic of the file
                        facts, message = [], str(e)[:500] or type(e).__name__
                    if message:
                        rows.append((path, None, None, None, None, None, None, f"plugin:{name}", None, message))
                        continue
                    for k, x in enumerate(facts):
                        rows.append((path, x["start_line"], x["end_line"], x["kind"], x.get("title"), x["text"], json.dumps(x.get("metadata")), f"plugin:{name}", k, None))
            out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in model.RECORD.split(", ")), "message"])
            for c in ("start_line", "end_line", "ordinal"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, model.RECORD + ", message string")


def dry_run(spark: SparkSession, name: str, path: str, content: str) -> list[dict]:
    """What one extractor gives for one file, whether or not its globs take the path."""
    rows = spark.createDataFrame([(path, content)], "path string, content string")
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in extract(rows, {name: (["**"], EXTRACTORS[name][1])}).collect()]
