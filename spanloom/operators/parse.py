"""Source files to one table of facts. The one stage that is not a relational plan.

Facts: ``span`` (module, class, function, method, import), ``binding`` (a local name and what an import binds it to), ``call``,
``class`` (what entities are told by), ``route``, ``prefix``, ``registration``, ``exports`` (``__all__``), ``reexport`` and ``gap``.
Facts with more than the common columns carry them as JSON in ``data``.

A call belongs to the function or method whose body it is in, or to the module if it is in no definition; decorators and
defaults belong to nobody. Spans of definitions begin at their first decorator. A file that does not parse gives its module span and a gap.

The interpreter never gives back the names that its parser has seen, so that files are parsed in child processes that end after a few
of them: a worker's memory does not grow with the files that pass through it.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
import traceback
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "path string, module string, fact string, kind string, fq string, name string, target string, receiver string, start_line int, end_line int, fingerprint string, data string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: The decorators that register routes.
VERBS = frozenset({"get", "post", "put", "delete", "patch", "options", "head", "trace"})
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFS = (*_FUNCTIONS, ast.ClassDef)
_SILENT = frozenset({"ctx", "type_comment", "kind", "type_ignores"})
#: What statements can be in, and what has its own fingerprint.
_BLOCKS = (ast.stmt, ast.ExceptHandler, ast.match_case)
_PRINTED = (*_DEFS, ast.Import, ast.ImportFrom)
#: Characters of the sources, and files, that one child process parses, and facts of a batch.
PIECE, FILES, ROWS = 4_000_000, 2_000, 4_000


def _canonical(node: object, known: dict[int, str]) -> str:
    """A text of a node's shape: names, literals and operators count; positions, comments and docstrings do not.

    ``known`` takes the texts of the nodes that have a fingerprint of their own, by identity.
    """
    if isinstance(node, ast.AST):
        if id(node) in known:
            return known[id(node)]
        fields = {k: getattr(node, k) for k in node._fields if k not in _SILENT and hasattr(node, k)}
        if isinstance(node, (*_DEFS, ast.Module)) and ast.get_docstring(node, clean=False) is not None:
            fields["body"] = fields["body"][1:] or [ast.Pass()]
        text = f"{type(node).__name__}({','.join([_canonical(v, known) for v in fields.values()])})"
        if isinstance(node, _PRINTED):
            known[id(node)] = text
        return text
    if isinstance(node, list):
        return f"[{','.join([_canonical(v, known) for v in node])}]"
    return repr(node)


def fingerprint(node: ast.AST, known: dict[int, str] | None = None) -> str:
    return hashlib.sha256(_canonical(node, {} if known is None else known).encode("utf-8", "surrogatepass")).hexdigest()


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes below a node, in order; without those that say how a name is used."""
    out: list[ast.AST] = []
    for k in node._fields:
        v = getattr(node, k, None)
        if type(v) is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST) and k != "ctx":
            out.append(v)
    return out


def _blocks(node: ast.AST) -> list[ast.AST]:
    """The statements, handlers and cases right below a node: definitions and imports are in no others."""
    return [x for k in node._fields if type(v := getattr(node, k, None)) is list for x in v if isinstance(x, _BLOCKS)]


def dotted(node: ast.AST) -> str | None:
    """The text of a chain of names (``a`` or ``a.b.c``); None for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _last(name: str | None) -> str | None:
    return None if name is None else name.rpartition(".")[2]


def absolute(module: str, is_package: bool, level: int, name: str | None) -> str | None:
    """Module that a relative import names; None if it climbs above the root."""
    if not level:
        return name
    base = module.split(".") if module else []
    up = level - (1 if is_package else 0)
    if up > len(base):
        return None
    return ".".join([*base[: len(base) - up], *([name] if name else [])]) or None


def _signature(node: ast.AST) -> str | None:
    if isinstance(node, _FUNCTIONS):
        return f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
    return f"({', '.join(map(ast.unparse, [*node.bases, *node.keywords]))})" if node.bases or node.keywords else None


def _class_facts(node: ast.ClassDef) -> dict:
    """What the direct body of a class assigns, its bases and decorators."""
    fields, relationships, table = [], [], None
    for x in node.body:
        left = x.target if isinstance(x, ast.AnnAssign) else x.targets[0] if isinstance(x, ast.Assign) and len(x.targets) == 1 else None
        if not isinstance(left, ast.Name):
            continue
        call = x.value if isinstance(x.value, ast.Call) else None
        callee = _last(ast.unparse(call.func)) if call else None
        if left.id == "__tablename__":
            table = _literal(x.value)
            continue
        if callee == "relationship":
            first = call.args[0] if call.args else None
            relationships.append({"name": left.id, "target": _literal(first) or _text(first)})
        fields.append({"name": left.id, "annotation": _text(x.annotation) if isinstance(x, ast.AnnAssign) else None, "has_default": x.value is not None, "callee": callee})
    decorators = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
    return {"decorators": decorators, "bases": [_last(ast.unparse(b)) for b in node.bases], "tablename": table, "fields": fields, "relationships": relationships}


def _parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    a = node.args
    placed = [*a.posonlyargs, *a.args]
    least = len(placed) - len(a.defaults)
    rows = [(x, i >= least) for i, x in enumerate(placed)] + [(x, d is not None) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    return [{"name": x.arg, "annotation": _text(x.annotation), "has_default": d} for x, d in rows if x.arg not in ("self", "cls")]


def _routes(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[dict]:
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS):
            continue
        path = next((p for a in d.args if (p := _literal(a)) is not None), None)
        if path is None:  # computed paths are a known gap
            continue
        model, status, shown = _keyword(d, "response_model"), _keyword(d, "status_code"), _keyword(d, "include_in_schema")
        names = [n.id for n in ast.walk(model) if isinstance(n, ast.Name)] if model is not None else []
        attributes = [n.attr for n in ast.walk(model) if isinstance(n, ast.Attribute)] if model is not None else []
        code = status.value if isinstance(status, ast.Constant) and isinstance(status.value, int) else None
        yield {
            "method": d.func.attr.upper(), "raw_path": path, "decorator_object": ast.unparse(d.func.value), "response_model": _text(model),
            "response_model_base": (attributes or names or [None])[-1], "status_code": code, "include_in_schema": shown is None or (isinstance(shown, ast.Constant) and shown.value is True),
            "return_type": _text(node.returns), "params": _parameters(node),
        }


def _registrations(node: ast.FunctionDef | ast.AsyncFunctionDef, is_method: bool) -> Iterator[dict]:
    row = {"form": "decorator", "event": None, "fields": [], "mode": None, "target": None, "decorator_object": None, "registration_module": None, "registration_line": None}
    for d in node.decorator_list:
        if not isinstance(d, ast.Call):
            continue
        name, owner = _last(ast.unparse(d.func)), ast.unparse(d.func.value) if isinstance(d.func, ast.Attribute) else None
        missing: list[str] = []
        if name in ("field_validator", "model_validator") and is_method:
            mode = _keyword(d, "mode")
            if mode is not None and _literal(mode) is None:
                missing.append("dynamic_mode")
            fields = [_literal(a) for a in d.args] if name == "field_validator" else []
            if None in fields:
                missing.append("dynamic_field_names")
            yield row | {"family": f"pydantic_{name}", "fields": [f for f in fields if f is not None], "mode": _literal(mode), "limitations": missing}
        elif name == "on_event" and owner is not None:
            event = next((e for a in d.args if (e := _literal(a)) is not None), None)
            if event is not None:
                yield row | {"family": "fastapi_on_event", "event": event, "decorator_object": owner, "limitations": []}
        elif name == "listens_for" and d.args:
            event = _literal(d.args[1]) if len(d.args) > 1 else None
            yield row | {"family": "sqlalchemy_listens_for", "event": event, "target": ast.unparse(d.args[0]), "decorator_object": owner, "limitations": [] if event is not None else ["dynamic_event_name"]}


def _prefixes(tree: ast.Module) -> Iterator[tuple[str, ast.AST, int, str]]:
    """(variable, prefix, order, line's node) of routers that are included or made with a prefix: includes first."""
    for x in ast.walk(tree):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "include_router":
            target, value = next((a.id for a in x.args if isinstance(a, ast.Name)), None), _keyword(x, "prefix")
            if target and value is not None:
                yield target, value, 0, x
        elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and isinstance(x.value, ast.Call) and dotted(x.value.func) == "APIRouter":
            value = _keyword(x.value, "prefix")
            if value is not None:
                yield x.targets[0].id, value, 1, x


def _exports(tree: ast.Module) -> dict | None:
    """The last ``__all__`` of a module; names is null where it is not a literal list of strings."""
    found = None
    for x in tree.body:
        left = x.targets[0] if isinstance(x, ast.Assign) else x.target if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else None
        if not (isinstance(left, ast.Name) and left.id == "__all__"):
            continue
        if isinstance(x, ast.AugAssign):
            found = {"names": found["names"] if found else None, "dynamic": True}
            continue
        names = [_literal(e) for e in x.value.elts] if isinstance(x.value, (ast.List, ast.Tuple, ast.Set)) else [None]
        found = {"names": None, "dynamic": True} if None in names else {"names": sorted(set(names)), "dynamic": False}
    return found


class _File:
    def __init__(self, path: str, module: str, source: str, only: Collection[str] | None = None, prints: bool = True):
        self.path, self.module, self.source = path, module, source
        self.only, self.prints = only, prints
        self.rows: list[tuple] = []
        self.known: dict[int, str] = {}
        self.is_package = path.endswith("__init__.py")

    def wanted(self, fact: str, *kinds: str) -> bool:
        """Whether a fact, of any of the kinds, is asked for."""
        return self.only is None or fact in self.only or any(f"{fact}:{k}" in self.only for k in kinds)

    def print_(self, node: ast.AST) -> str | None:
        return fingerprint(node, self.known) if self.prints else None

    def put(self, fact: str, kind: str, fq: str, name: str | None = None, target: str | None = None, receiver: str | None = None, at: tuple[int, int] = (1, 1), print_: str | None = None, data: dict | None = None) -> None:
        self.rows.append((self.path, self.module, fact, kind, fq, name, target, receiver, *at, print_, None if data is None else json.dumps(data, ensure_ascii=False)))

    def facts(self) -> list[tuple]:
        whole = (1, self.source.count("\n") + 1)
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError):
            if self.wanted("span", "module"):
                self.put("span", "module", self.module, self.module, at=whole, print_=hashlib.sha256(self.source.encode("utf-8", "replace")).hexdigest() if self.prints else None)
            if self.wanted("gap"):
                self.put("gap", "has_error", self.module)
            return self.rows
        if self.wanted("span", "module"):
            self.put("span", "module", self.module, self.module, at=whole, print_=self.print_(tree))
        if self.wanted("span", "import") or self.wanted("binding") or self.wanted("reexport"):
            self._imports(tree)
        if self.wanted("call") or self.wanted("listen"):
            self._calls(tree.body, self.module, "module")
        # A name in letters of other scripts may stand for these.
        if self.wanted("prefix") and (not self.source.isascii() or "include_router" in self.source or "APIRouter" in self.source):
            for name, value, order, x in _prefixes(tree):
                self.put("prefix", "include" if order == 0 else "constructor", self.module, name, _literal(value), at=(x.lineno, x.end_lineno), data={"order": order})
        if self.wanted("exports") and (exports := _exports(tree)) is not None:
            self.put("exports", "all", self.module, data=exports)
        self._definitions(tree, self.module, False)
        return self.rows

    def _imports(self, tree: ast.Module) -> None:
        top = set(map(id, tree.body))
        found, todo = [], list(tree.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                found += [x] if getattr(x, "module", None) != "__future__" else []
            else:
                todo += _blocks(x)
        spans, bindings, reexports = self.wanted("span", "import"), self.wanted("binding"), self.wanted("reexport")
        for i, x in enumerate(sorted(found, key=lambda x: (x.lineno, x.col_offset))):
            fq, at = f"{self.module}::import@{i}", (x.lineno, x.end_lineno)
            if spans:
                self.put("span", "import", fq, at=at, print_=self.print_(x))
            if isinstance(x, ast.Import):
                for a in x.names if bindings else ():
                    self.put("binding", "module", fq, a.asname or a.name, a.name, at=at)
                    if not a.asname and "." in a.name:  # ``import x.y`` binds x as well
                        self.put("binding", "root", fq, a.name.partition(".")[0], a.name.partition(".")[0], at=at)
                continue
            target = absolute(self.module, self.is_package, x.level, x.module)
            for a in x.names:
                if a.name == "*":
                    continue
                if target and bindings:
                    self.put("binding", "symbol", fq, a.asname or a.name, a.name, target, at)
                if reexports and self.is_package and id(x) in top:
                    self.put("reexport", "symbol", fq, a.asname or a.name, a.name, target, at)

    def _calls(self, body: list[ast.stmt], owner: str, kind: str) -> None:
        """Calls of a body, without those of the definitions in it."""
        calls, listens = self.wanted("call"), kind == "module" and self.wanted("listen")
        todo: list[ast.AST] = list(reversed(body))
        while todo:
            x = todo.pop()
            if isinstance(x, _DEFS):
                continue
            if isinstance(x, ast.Call):
                at = (x.lineno, x.end_lineno)
                name = dotted(x.func)
                attribute = x.func.attr if isinstance(x.func, ast.Attribute) else name
                if calls and attribute is not None:
                    self.put("call", kind, owner, attribute, name, name.rpartition(".")[0] or None if name else None, at, data=None if name else {"dynamic": True})
                if listens and attribute is not None and len(x.args) >= 3 and isinstance(x.args[2], ast.Name):
                    # What may be listen(target, "event", handler): a join with the bindings tells.
                    event = _literal(x.args[1])
                    data = {"family": "sqlalchemy_listen", "form": "call", "event": event, "fields": [], "mode": None, "target": ast.unparse(x.args[0]), "decorator_object": None, "registration_module": self.module, "registration_line": x.lineno, "limitations": [] if event is not None else ["dynamic_event_name"]}
                    self.put("listen", "attribute" if isinstance(x.func, ast.Attribute) else "name", owner, attribute, x.args[2].id, None, at, data=data)
            todo += reversed(_children(x))

    def _definitions(self, node: ast.AST, prefix: str, in_class: bool) -> None:
        for child in _blocks(node):
            if not isinstance(child, _DEFS):
                self._definitions(child, prefix, in_class)
                continue
            kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
            fq = f"{prefix}.{child.name}" if prefix else child.name
            at = (min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno)
            if self.wanted("span", kind):
                self.put("span", kind, fq, child.name, None, prefix if kind == "method" else None, at, self.print_(child), {"signature": _signature(child), "top": prefix == self.module})
            if kind == "class":
                if self.wanted("class"):
                    self.put("class", kind, fq, child.name, at=at, data=_class_facts(child))
            else:
                if self.wanted("call") or self.wanted("listen"):
                    self._calls(child.body, fq, kind)
                for r in _routes(child) if self.wanted("route") else ():
                    self.put("route", kind, fq, child.name, r["raw_path"], r["decorator_object"], at, data=r)
                for r in _registrations(child, kind == "method") if self.wanted("registration") else ():
                    self.put("registration", kind, fq, child.name, r["family"], prefix if kind == "method" else None, at, data=r)
            self._definitions(child, fq, kind == "class")


def file_facts(path: str, module: str, source: str, only: Collection[str] | None = None, prints: bool = True) -> list[tuple]:
    """All facts of a file, in the order of :data:`FACTS`; those of ``only`` ('fact' or 'fact:kind'), without fingerprints unless ``prints``."""
    return _File(path, module, source, only, prints).facts()


_SCHEMA = pa.schema([(c, pa.int32() if c.endswith("_line") else pa.string()) for c in COLUMNS])


def _batches(files: list[tuple[str, str, str]], only: Collection[str] | None, prints: bool) -> Iterator[pa.RecordBatch]:
    """The facts of files, of few files at a time."""
    rows: list[tuple] = []
    for i, (p, m, s) in enumerate(files, 1):
        rows += file_facts(p, m, s or "", only, prints)
        if rows and (len(rows) >= ROWS or i == len(files)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows = []


def _apart(files: list[tuple[str, str, str]], only: Collection[str] | None, prints: bool) -> Iterator[pa.RecordBatch]:
    """The same, made by a child process that ends with them."""
    if not hasattr(os, "fork"):
        yield from _batches(files, only, prints)
        return
    (out, into), (said, say) = os.pipe(), os.pipe()
    child = os.fork()
    if not child:
        code = 1
        try:
            os.close(out)
            os.close(said)
            with os.fdopen(into, "wb") as f, pa.ipc.new_stream(f, _SCHEMA) as stream:
                for b in _batches(files, only, prints):
                    stream.write_batch(b)
            code = 0
        except BaseException:  # noqa: BLE001: the parent raises it
            os.write(say, traceback.format_exc()[-4000:].encode("utf-8", "replace"))
        finally:
            os._exit(code)  # nothing of the parent's is flushed or closed
    os.close(into)
    os.close(say)
    ended = False
    with os.fdopen(said, "rb") as errors:
        try:
            with os.fdopen(out, "rb") as f:
                try:
                    for b in pa.ipc.open_stream(f):
                        yield b
                    ended = True
                except (pa.ArrowInvalid, OSError):  # it broke off: the reason follows
                    ended = True
        finally:
            code = os.waitpid(child, 0)[1]
        if ended and code:
            raise RuntimeError(f"parsing failed ({code}): {errors.read().decode('utf-8', 'replace')}")


def facts(files: DataFrame, only: Collection[str] | None = None, prints: bool = True) -> DataFrame:
    """Rows of (path, module, source) to one table of facts; see :data:`FACTS`.

    ``only`` names the facts that are wanted, as 'fact' or 'fact:kind'; without ``prints`` fingerprints are null, which spares most of the time.
    """
    only = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece, size = [], 0
            for row in zip(*b.columns, strict=True):
                piece.append(tuple(x.as_py() for x in row))
                size += len(piece[-1][2] or "")
                if size >= PIECE or len(piece) >= FILES:
                    yield from _apart(piece, only, prints)
                    piece, size = [], 0
            if piece:
                yield from _apart(piece, only, prints)

    return files.select("path", "module", "source").mapInArrow(run, FACTS)
