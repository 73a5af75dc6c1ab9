"""From source texts to nodes, edges, routes, callbacks and data-flow facts.

Python is read with its own grammar; of the other languages declarations,
imports and calls are found by patterns, which is a best effort. A file is one
row of the input and never leaves its task; a file that cannot be read gives
its file node and an error instead of failing the job.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Larger files are left out, as are files without a text.
MAX_BYTES = 1 << 20
# What an extension stands for.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "kt": "kotlin", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "php": "php"}
# Methods that take a callback.
LISTENERS = {"javascript": frozenset("addEventListener on once then catch finally subscribe use listen observe watch".split()), "python": frozenset("subscribe add_callback register on add_listener connect add_handler observe watch".split())}
_TRIGGERS = frozenset("start submit apply_async delay create_task ensure_future run_in_executor Thread Process Timer setTimeout setInterval".split())
_VERBS = "get|post|put|delete|patch|head|options"

RECORD = "rec string, id string, name string, kind string, location string, source string, target string, depth int, delay double, method string, url string, detail array<string>"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]


def module_id(path: str) -> str:
    """The dotted id of a file: no extension, no leading ``./``."""
    p = re.sub(r"^(?:\./|/)+", "", path.replace("\\", "/"))
    p = re.sub(r"\.[A-Za-z0-9]+$", "", p)
    return re.sub(r"(?:/__init__|/index)$", "", p).replace("/", ".")


def _node(out, path, id, name, kind, line=None):
    out.append({"rec": "node", "id": id, "name": name, "kind": kind, "location": path if line is None else f"{path}:{line}"})


def _edge(out, source, target, kind, depth=0, delay=None):
    out.append({"rec": "edge", "source": source, "target": target, "kind": kind, "depth": depth, "delay": delay})


class _Python(ast.NodeVisitor):
    """One file: definitions, imports, calls with what they resolve to, and data flow."""

    def __init__(self, path: str, tree: ast.AST) -> None:
        self.path, self.module = path, module_id(path)
        self.out: list[dict] = []
        self.scope: list[tuple[str, str]] = [(self.module, "module")]
        self.names: dict[str, str] = {}
        self.types: dict[tuple[str, str], str] = {}
        self.flow: dict[str, dict[str, list]] = {}
        self.globals: set[str] = set()
        self.tops = {n.name: n for n in getattr(tree, "body", []) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}

    def facts(self) -> dict[str, list]:
        # Data flow is told by bare scope names; same-named scopes of a file are one.
        name = "<module>" if len(self.scope) == 1 else self.scope[-1][0].rpartition(".")[2]
        return self.flow.setdefault(name, {"reads": [], "writes": [], "triggers": [], "awaits": [], "sequences": []})

    def text(self, n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            base = self.text(n.value)
            return f"{base}.{n.attr}" if base else n.attr
        return self.text(n.func) if isinstance(n, ast.Call) else ""

    def qualified(self, text: str) -> tuple[str, str, float] | None:
        """(what a dotted text names, how it was found, how sure that is)."""
        head, _, rest = text.partition(".")
        owner = next((q for q, k in reversed(self.scope) if k == "class"), None)
        if head in ("self", "cls") and owner and rest:
            return f"{owner}.{rest}", "method", 0.90
        if head == "super" and owner and rest:
            return f"{owner}.{rest}", "super", 0.88
        kind = self.types.get((self.scope[-1][0], head)) or self.types.get((self.module, head))
        if kind and rest:
            return f"{kind}.{rest}", "method", 0.90
        if head in self.tops:
            how = ("constructor", 0.85) if isinstance(self.tops[head], ast.ClassDef) and not rest else ("direct", 0.95)
            return (f"{self.module}.{text}", *how)
        if head in self.names:
            return (self.names[head] + (f".{rest}" if rest else ""), "module_attr" if rest else "direct", 0.92 if rest else 0.95)
        return None

    def define(self, n, kind: str) -> None:
        id = f"{self.scope[-1][0]}.{n.name}"
        _node(self.out, self.path, id, n.name, kind, n.lineno)
        _edge(self.out, self.scope[-1][0], id, "defines")
        for d in n.decorator_list:
            self.visit(d)
        self.scope.append((id, kind))
        if kind == "function":
            self.facts()
        for x in n.body:
            self.visit(x)
        self.scope.pop()

    def visit_FunctionDef(self, n):
        self.define(n, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n):
        id = f"{self.scope[-1][0]}.{n.name}"
        for b in n.bases:
            t = self.text(b)
            if t:
                q = self.qualified(t)
                _edge(self.out, id, q[0] if q else f"{self.module}.{t}", "inherits")
        self.define(n, "class")

    def visit_Import(self, n):
        for a in n.names:
            self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            _edge(self.out, self.module, a.name, "imports")

    def visit_ImportFrom(self, n):
        base = n.module or ""
        if n.level:
            up = self.module.split(".")[: -n.level] or []
            base = ".".join([*up, *([base] if base else [])])
        for a in n.names:
            q = f"{base}.{a.name}" if base else a.name
            self.names[a.asname or a.name] = q
            _edge(self.out, self.module, q, "imports")

    def visit_Global(self, n):
        self.globals.update(n.names)

    def visit_Assign(self, n):
        if isinstance(n.value, ast.Call):
            q = self.qualified(self.text(n.value.func))
            for t in n.targets:
                if isinstance(t, ast.Name) and q and q[0].rpartition(".")[2][:1].isupper():
                    self.types[(self.scope[-1][0], t.id)] = q[0]
        self.generic_visit(n)

    def visit_Name(self, n):
        f = self.facts()
        if isinstance(n.ctx, ast.Store):
            f["writes"].append(n.id)
        elif n.id[:1].islower() and n.id not in ("self", "cls", "print", "len", "range", "str", "int"):
            f["reads"].append(n.id)

    def visit_Await(self, n):
        t = self.text(n.value)
        if t:
            self.facts()["awaits"].append(t)
        self.generic_visit(n)

    def visit_Call(self, n):
        t = self.text(n.func)
        if t:
            caller = self.scope[-1][0]
            q = self.qualified(t)
            _edge(self.out, caller, q[0] if q else t, "calls")
            if q:
                self.out.append({"rec": "resolved", "source": caller, "target": q[0], "kind": q[1], "delay": q[2]})
            last = t.rpartition(".")[2]
            self.facts()["sequences"].append(t)
            if last in _TRIGGERS:
                self.facts()["triggers"].append(t)
            if last in LISTENERS["python"] and "." in t:
                for a in n.args:
                    name = self.text(a) if isinstance(a, (ast.Name, ast.Attribute)) else ""
                    if name:
                        h = self.qualified(name)
                        self.out.append({"rec": "callback", "source": caller, "target": h[0] if h else name, "method": last, "location": f"{self.path}:{n.lineno}"})
                        break
        self.generic_visit(n)


_STRING = r"[rRbBuUfF]{0,2}[\"'`]([^\"'`]*)[\"'`]"
# How frameworks declare routes.
_ROUTES = {
    "django": re.compile(rf"\b(?:path|re_path|url)\(\s*{_STRING}\s*,\s*([\w.]+)"),
    "fastapi": re.compile(rf"@[\w.]+\.({_VERBS}|trace|websocket|api_route)\(\s*{_STRING}[^\n]*\)\s*(?:@[^\n]*\n\s*)*\n\s*(?:async\s+)?def\s+(\w+)"),
    "flask": re.compile(rf"@[\w.]+\.route\(\s*{_STRING}([^\n]*)\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)"),
    "express": re.compile(rf"\b\w+\.({_VERBS}|all|use)\(\s*[\"'`]([^\"'`]*)[\"'`]\s*,\s*([\w.]+)?"),
    "gin": re.compile(r"\b\w+\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Use|Group|Handle)\(\s*\"([^\"]*)\"(?:\s*,\s*([\w.]+))?"),
    "spring": re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?(?:\"([^\"]*)\")?[^)]*\))?\s*(?:@[^\n]*\n\s*)*(?:public|private|protected)?\s*[\w<>\[\], ?]+\s+(\w+)\s*\("),
    "nest": re.compile(r"@(Get|Post|Put|Delete|Patch|Head|Options|All)\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\s*\)\s*(?:async\s+)?(\w+)\s*\("),
    "rails": re.compile(r"^\s*(get|post|put|patch|delete|resources|resource|match|root)\s+[:\"']([\w/:.#-]+)[\"']?(?:.*?(?:to:|=>)\s*[\"']([\w/]+#\w+)[\"'])?", re.M),
}
_CONTROLLER = re.compile(r"@Controller\(\s*(?:[\"'`]([^\"'`]*)[\"'`])?\s*\)")


def find_routes(path: str, source: str, language: str) -> list[tuple[str, str, str, str, int]]:
    """(framework, method, url, handler, line) of the routes of a file; an unnamed handler is ``<inline@line>``.

    Only the quotes and the prefix of a text are taken off its url.
    """
    out = []

    def add(framework, method, url, handler, at):
        line = source.count("\n", 0, at) + 1
        out.append((framework, method, url, handler or f"<inline@{line}>", line))

    if language == "python":
        for m in _ROUTES["django"].finditer(source):
            add("django", "ALL", m[1], m[2], m.start())
        for m in _ROUTES["fastapi"].finditer(source):
            add("fastapi", m[1].upper(), m[2], m[3], m.start())
        for m in _ROUTES["flask"].finditer(source):
            methods = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m[2])
            verbs = ",".join(re.findall(r"[A-Za-z]+", methods[1])).upper() if methods else "GET"
            add("flask", verbs or "GET", m[1], m[3], m.start())
    elif language in ("javascript", "typescript"):
        prefix = _CONTROLLER.search(source)
        if prefix:
            for m in _ROUTES["nest"].finditer(source):
                add("nest", m[1].upper(), "/" + "/".join(x.strip("/") for x in (prefix[1] or "", m[2] or "") if x), m[3], m.start())
        else:
            for m in _ROUTES["express"].finditer(source):
                add("express", m[1].upper(), m[2], m[3], m.start())
    elif language == "go":
        for m in _ROUTES["gin"].finditer(source):
            if m[3] or m[1] not in ("Group", "Use"):
                add("gin", m[1].upper(), m[2], m[3], m.start())
    elif language == "java":
        for m in _ROUTES["spring"].finditer(source):
            add("spring", "ALL" if m[1] == "Request" else m[1].upper(), m[2] or "/", m[3], m.start())
    elif language == "ruby":
        for m in _ROUTES["rails"].finditer(source):
            handler = m[3] or (f"{m[2].capitalize()}Controller" if m[1].startswith("resource") else None)
            if handler:
                add("rails", m[1].upper(), m[2], handler, m.start())
    return out


# Declarations, imports and calls as other languages write them.
_DECLARED = {
    "javascript": [("function", r"\bfunction\s*\*?\s*([\w$]+)\s*\("), ("function", r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*=>|[\w$]+\s*=>)"), ("class", r"\bclass\s+([\w$]+)")],
    "java": [("class", r"\b(?:class|enum|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\([^;{)]*\)\s*(?:throws [\w, .]+)?\{")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("class", r"\b(?:struct|enum|union)\s+(\w+)"), ("interface", r"\btrait\s+(\w+)")],
    "c": [("function", r"^[\w*][\w\s*]*?\b(\w+)\s*\([^;{)]*\)\s*\{"), ("class", r"\b(?:struct|class)\s+(\w+)\s*[:{]")],
}
_DECLARED["typescript"] = [*_DECLARED["javascript"], ("interface", r"\binterface\s+(\w+)"), ("interface", r"\btype\s+(\w+)\s*(?:<[^=]*>)?\s*=")]
for _k in ("cpp", "csharp", "kotlin", "php", "ruby"):
    _DECLARED[_k] = [("class", r"\bclass\s+(\w+)"), ("function", r"\b(?:fun|function|def)\s+(\w+)")]
_DECLARED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARED.items()}
_IMPORTED = {k: re.compile(p, re.M) for k, p in {"javascript": r"(?:\bfrom\s+|\brequire\(\s*|^import\s+)[\"']([^\"']+)[\"']", "typescript": r"(?:\bfrom\s+|\brequire\(\s*|^import\s+)[\"']([^\"']+)[\"']", "java": r"^import\s+(?:static\s+)?([\w.]+)", "go": r"^(?:import\s+|\t)(?:\w+\s+)?\"([^\"]+)\"", "rust": r"\buse\s+([\w:]+)", "c": r"^#include\s+[<\"]([^>\"]+)", "cpp": r"^#include\s+[<\"]([^>\"]+)", "csharp": r"^using\s+([\w.]+)", "kotlin": r"^import\s+([\w.]+)", "php": r"^use\s+([\w\\]+)", "ruby": r"^require(?:_relative)?\s+[\"']([^\"']+)"}.items()}
_EXTENDS = re.compile(r"\b(?:class|interface)\s+(\w+)(?:<[^>{]*>)?\s+(?:extends|implements|:)\s+([\w.,\s<>]+?)\s*\{")
_CALLED = re.compile(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLED = frozenset("if for while switch catch return function class func fn match select def sizeof typeof new await super import package go defer throw else do in of and or not with".split())
_HIDDEN = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_CALLBACK = re.compile(r"\.(" + "|".join(sorted(LISTENERS["javascript"])) + r")\(\s*(?:[\"'`][^\"'`]*[\"'`]\s*,\s*)?([A-Za-z_$][\w$.]*)\s*[,)]")


def _patterns(path: str, source: str, language: str) -> list[dict]:
    out: list[dict] = []
    mod = module_id(path)
    # Comments and texts are blanked at equal length, so places stay.
    code = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    places = []
    for kind, p in _DECLARED.get(language, ()):
        for m in p.finditer(code):
            if m[1] in _NOT_CALLED:
                continue
            id = f"{mod}.{m[1]}"
            _node(out, path, id, m[1], kind, code.count("\n", 0, m.start()) + 1)
            _edge(out, mod, id, "defines")
            places.append((m.start(1), id))
    places.sort()
    for m in _EXTENDS.finditer(code):
        for base in re.split(r"[,\s]+", re.sub(r"<[^>]*>", "", m[2])):
            if base and base not in ("implements", "extends"):
                _edge(out, f"{mod}.{m[1]}", f"{mod}.{base}", "inherits")
    imported = _IMPORTED.get(language)
    for m in imported.finditer(source) if imported else ():
        t = m[1]
        if t.startswith("."):
            parts = mod.split(".")[:-1]
            for x in t.split("/"):
                if x == "..":
                    parts = parts[:-1]
                elif x != ".":
                    parts.append(x)
            t = re.sub(r"\.(?:js|ts|mjs)$", "", ".".join(parts))
        _edge(out, mod, t.replace("::", ".").replace("/", "."), "imports")
    starts = [p for p, _ in places]
    from bisect import bisect_right

    for m in _CALLED.finditer(code):
        name = m[2].replace("::", ".")
        if name in _NOT_CALLED or m.start(2) in starts:
            continue
        k = bisect_right(starts, m.start()) - 1
        _edge(out, places[k][1] if k >= 0 else mod, name, "calls")
    for m in _CALLBACK.finditer(source) if language in ("javascript", "typescript") else ():
        k = bisect_right(starts, m.start()) - 1
        out.append({"rec": "callback", "source": places[k][1] if k >= 0 else mod, "target": m[2], "method": m[1], "location": f"{path}:{source.count(chr(10), 0, m.start()) + 1}"})
    return out


def extract_file(path: str, source: str | None) -> list[dict]:
    """All records of one file."""
    out: list[dict] = []
    mod = module_id(path)
    language = LANGUAGES.get(path.rpartition(".")[2].lower())
    _node(out, path, mod, mod.rpartition(".")[2], "file")
    if language is None or source is None or len(source.encode()) > MAX_BYTES:
        why = "unknown language" if language is None else "no text" if source is None else "too large"
        out.append({"rec": "error", "id": mod, "location": path, "name": why})
        return out
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
            v = _Python(path, tree)
            v.visit(tree)
        except (SyntaxError, ValueError, RecursionError) as x:
            out.append({"rec": "error", "id": mod, "location": path, "name": str(x).split("\n")[0]})
        else:
            out += v.out
            for scope, f in sorted(v.flow.items()):
                for what in ("reads", "writes"):
                    if f[what]:
                        out.append({"rec": "flow", "id": mod, "location": path, "name": scope, "kind": what, "detail": sorted(set(f[what]))})
                for what in ("triggers", "awaits", "sequences"):
                    if f[what]:
                        out.append({"rec": "flow", "id": mod, "location": path, "name": scope, "kind": what, "detail": f[what]})
            for g in sorted(v.globals):
                out.append({"rec": "global", "id": mod, "location": path, "name": g})
    else:
        out += _patterns(path, source, language)
    for framework, method, url, handler, line in find_routes(path, source, language):
        out.append({"rec": "route", "id": f"route_{mod}_{line}", "location": f"{path}:{line}", "kind": framework, "method": method, "url": url, "target": handler})
    return out


_ARROW = {"depth": pa.int32(), "delay": pa.float64(), "detail": pa.list_(pa.string())}
_FILE = pa.list_(pa.struct([(f, _ARROW.get(f, pa.string())) for f in _FIELDS]))


def _records(batches):
    for b in batches:
        paths, texts = b.column("path").to_pylist(), b.column("source").to_pylist()
        for at in range(0, len(paths), 200):
            files = [[{f: r.get(f, 0 if f == "depth" else None) for f in _FIELDS} for r in extract_file(p, s)] for p, s in zip(paths[at : at + 200], texts[at : at + 200])]
            yield pa.RecordBatch.from_arrays([b.column("path").slice(at, 200), b.column("o").slice(at, 200), pa.array(files, _FILE)], names=["path", "o", "records"])


def records(sources: DataFrame) -> DataFrame:
    """All records of the current text of each path; see the functions below for views of them.

    The row with the latest mtime is current (null is the earliest), of equal
    ones that with the longest text. Every row is reduced to records where it
    is read, and only these are shuffled, never texts.
    """
    order = F.struct("mtime", F.length("source").alias("n"), F.xxhash64("source").alias("h"))
    rows = sources.where("path is not null").select("path", "source", order.alias("o"))
    stamp = sources.schema["mtime"].dataType.simpleString()
    fields = ", ".join("{}: {}".format(*c.split()) for c in RECORD.split(", "))
    files = rows.mapInArrow(_records, f"path string, o struct<mtime: {stamp}, n: int, h: bigint>, records array<struct<{fields}>>")
    return files.groupBy("path").agg(F.max_by("records", "o").alias("records")).select(F.explode("records").alias("r")).select("r.*")


def nodes(rec: DataFrame) -> DataFrame:
    """``id, name, kind, location`` of the extracted nodes, routes included."""
    n = rec.where("rec = 'node'").select("id", "name", "kind", "location")
    return n.unionByName(rec.where("rec = 'route'").select("id", F.concat_ws(" ", "method", "url").alias("name"), F.lit("symbol").alias("kind"), "location"))


def edges(rec: DataFrame) -> DataFrame:
    """``source, target, kind, coupling_depth, temporal_delay_sec``: structure, route handlers (depth 1), callbacks (depth 3)."""
    e = rec.where("rec = 'edge'").select("source", "target", "kind", F.col("depth").alias("coupling_depth"), F.col("delay").alias("temporal_delay_sec"))
    r = rec.where("rec = 'route' and target not like '<%'").select(F.col("id").alias("source"), "target", F.lit("calls").alias("kind"), F.lit(1).alias("coupling_depth"), F.lit(None).cast("double").alias("temporal_delay_sec"))
    c = rec.where("rec = 'callback'").select("source", "target", F.lit("calls").alias("kind"), F.lit(3).alias("coupling_depth"), F.lit(0.0).alias("temporal_delay_sec"))
    return e.unionByName(r).unionByName(c)


def routes(rec: DataFrame) -> DataFrame:
    """``framework, method, url, handler, location``."""
    return rec.where("rec = 'route'").select(F.col("kind").alias("framework"), "method", "url", F.col("target").alias("handler"), "location")


def callbacks(rec: DataFrame) -> DataFrame:
    """``source, method, handler, location``."""
    return rec.where("rec = 'callback'").select("source", "method", F.col("target").alias("handler"), "location")


def resolved_calls(rec: DataFrame) -> DataFrame:
    """``caller, callee, strategy, confidence`` of calls whose target is known; of several the surest."""
    r = rec.where("rec = 'resolved'").select(F.col("source").alias("caller"), F.col("target").alias("callee"), F.col("kind").alias("strategy"), F.col("delay").alias("confidence"))
    return r.groupBy("caller", "callee").agg(F.max(F.struct("confidence", "strategy")).alias("x")).select("caller", "callee", "x.strategy", "x.confidence")


def flows(rec: DataFrame) -> DataFrame:
    """``file, scope, what, names``: what each scope reads, writes, triggers, awaits and calls in order."""
    return rec.where("rec = 'flow'").select(F.col("location").alias("file"), F.col("name").alias("scope"), F.col("kind").alias("what"), F.col("detail").alias("names"))


def shared_variables(rec: DataFrame) -> DataFrame:
    """``file, var, readers, writers`` of variables that one scope reads and another writes, that several write, or that are declared global."""
    f = flows(rec).where("what in ('reads', 'writes')").select("file", "scope", "what", F.explode("names").alias("var"))
    per = f.groupBy("file", "var").agg(F.sort_array(F.collect_set(F.when(F.col("what") == "reads", F.col("scope")))).alias("readers"), F.sort_array(F.collect_set(F.when(F.col("what") == "writes", F.col("scope")))).alias("writers"))
    g = rec.where("rec = 'global'").select(F.col("location").alias("file"), F.col("name").alias("var"), F.lit(True).alias("declared")).distinct()
    per = per.join(g, ["file", "var"], "left")
    return per.where((F.size("readers") > 0) & (F.col("declared").isNotNull() | (F.size("writers") > 1) | ((F.size("writers") > 0) & (F.size(F.array_except("writers", "readers")) > 0)))).drop("declared")


def errors(rec: DataFrame) -> DataFrame:
    """``file, error`` of files that gave no records."""
    return rec.where("rec = 'error'").select(F.col("location").alias("file"), F.col("name").alias("error"))


def inherited_methods(rec_nodes: DataFrame, rec_edges: DataFrame, calls: DataFrame, depth: int = 3) -> DataFrame:
    """``caller, callee, found``: method calls led to the nearest class up the bases that defines them.

    Bases are walked at most ``depth`` levels, so a circle of bases ends.
    """
    ids = rec_nodes.select(F.col("id").alias("found")).distinct()
    bases = rec_edges.where("kind = 'inherits'").select(F.col("source").alias("cls"), F.col("target").alias("base")).distinct()
    todo = calls.select("caller", "callee", F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1).alias("cls"), F.substring_index("callee", ".", -1).alias("m")).where("cls <> ''")
    out = None
    for level in range(depth):
        hit = todo.withColumn("found", F.concat_ws(".", "cls", "m")).join(ids, "found", "left_semi").select("caller", "callee", "found", F.lit(level).alias("level"))
        out = hit if out is None else out.unionByName(hit)
        todo = todo.join(bases, "cls").select("caller", "callee", F.col("base").alias("cls"), "m").distinct()
    w = Window.partitionBy("caller", "callee").orderBy("level", "found")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select("caller", "callee", "found")


def handlers(rec: DataFrame) -> DataFrame:
    """``location, handler, id`` of the node that each route leads to: exact id, then name, then a dotted tail; ties by id."""
    r = routes(rec).where("handler not like '<%'").select("location", "handler", F.substring_index("handler", ".", -1).alias("last")).distinct()
    n = rec.where("rec = 'node'").select("id", "name").distinct()
    j = r.join(n, r["last"] == n["name"]).withColumn("class", F.when(F.col("id") == F.col("handler"), 0).when(F.col("id").endswith(F.concat(F.lit("."), F.col("handler"))), 1).otherwise(2))
    w = Window.partitionBy("location", "handler").orderBy("class", "id")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("location", "handler", "id")
