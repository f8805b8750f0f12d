"""Python source files as model tables, parsed with the standard library in Arrow batches.

A file gives one row of nested arrays; ``Model`` explodes them into tables. A file
that does not parse gives a row with empty arrays and the message in ``error``.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.shipping import ship
from sparkloom.plans.tables import materialize

SCHEMA = """path string, module string, error string,
functions array<struct<name:string,signature:string,line:int,end_line:int,uses:array<string>,params:array<string>,returns:string,cyclomatic:int,cognitive:int>>,
types array<struct<name:string,line:int,bases:array<string>,methods:array<string>,fields:array<struct<name:string,type:string>>,used_by:array<string>>>,
variables array<struct<name:string,type:string,line:int>>,
imports array<struct<raw:string,module:string,star:boolean,line:int>>,
calls array<struct<src:string,dst:string>>,
nodes array<struct<id:int,parent:int,kind:string,field:string,name:string,text:string,start_line:int,end_line:int,depth:int>>"""

_BUILTINS = {x for x in dir(builtins) if x[0].islower()}
_LITERALS = {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Tuple: "tuple"}


def value_type(node: ast.expr | None) -> str:
    """Type of a literal, the callee of a call, otherwise empty."""
    if isinstance(node, ast.Constant):
        return "None" if node.value is None else type(node.value).__name__
    if isinstance(node, ast.Call):
        return ast.unparse(node.func)
    return _LITERALS.get(type(node), "")


def cyclomatic(fn: ast.AST) -> int:
    """1, and 1 for each branch, loop, handler, case and boolean operator."""
    total = 1
    for n in ast.walk(fn):
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.match_case, ast.comprehension)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
    return total


def cognitive(fn: ast.AST) -> int:
    """Branches and loops count 1 and their nesting; else and runs of boolean operators count 1."""

    def walk(n: ast.AST, nesting: int) -> int:
        total = 0
        for child in ast.iter_child_nodes(n):
            if isinstance(child, (ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Match, ast.Lambda)):
                total += 1 + nesting + walk(child, nesting + 1)
            elif isinstance(child, ast.If):
                chained = isinstance(n, ast.If) and n.orelse == [child]
                total += (1 if chained else 1 + nesting) + walk(child, nesting if chained else nesting + 1)
                if child.orelse and not (len(child.orelse) == 1 and isinstance(child.orelse[0], ast.If)):
                    total += 1
            else:
                total += isinstance(child, ast.BoolOp)
                total += walk(child, nesting + isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)))
        return total

    return walk(fn, 0)


def _calls(fn: ast.AST, module: str, own: str) -> list[tuple[str, str]]:
    out: dict[str, None] = {}
    for n in ast.walk(fn):
        if not isinstance(n, ast.Call):
            continue
        f = n.func
        if isinstance(f, ast.Name) and f.id not in _BUILTINS:
            out.setdefault(f"{module}.{f.id}")
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            out.setdefault(f"{module}.{f.attr}" if f.value.id == "self" else f"{f.value.id}.{f.attr}")
    return [(own, x) for x in out if x != own]


def _function(n: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
    returns = ast.unparse(n.returns) if n.returns else ""
    signature = f"{n.name}({ast.unparse(n.args)})" + (f" -> {returns}" if returns else "")
    return {"name": n.name, "signature": signature, "line": n.lineno, "end_line": n.end_lineno, "uses": [ast.unparse(d) for d in n.decorator_list], "params": [a.arg for a in args], "returns": returns, "cyclomatic": cyclomatic(n), "cognitive": cognitive(n)}


def parse(path: str, module: str, text: str | None) -> dict:
    out: dict = {"path": path, "module": module, "error": None, "functions": [], "types": [], "variables": [], "imports": [], "calls": [], "nodes": []}
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        return out | {"error": str(e)}
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(_function(n))
            out["calls"] += [{"src": a, "dst": b} for a, b in _calls(n, module, f"{module}.{n.name}")]
        elif isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            fields = {}
            for m in methods:
                if m.name == "__init__":
                    for a in ast.walk(m):
                        targets = a.targets if isinstance(a, ast.Assign) else [a.target] if isinstance(a, ast.AnnAssign) else []
                        for t in targets:
                            if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                fields.setdefault(t.attr, value_type(a.value))
                out["calls"] += [{"src": a, "dst": b} for a, b in _calls(m, module, f"{module}.{n.name}.{m.name}")]
            out["types"].append({"name": n.name, "line": n.lineno, "bases": [ast.unparse(b) for b in n.bases], "methods": [m.name for m in methods], "fields": [{"name": k, "type": v} for k, v in fields.items()], "used_by": [ast.unparse(d) for d in n.decorator_list]})
        elif isinstance(n, ast.Import):
            out["imports"] += [{"raw": a.name, "module": a.name, "star": False, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            out["imports"].append({"raw": ast.unparse(n), "module": base, "star": any(a.name == "*" for a in n.names), "line": n.lineno})
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and (not t.id.startswith("_") or t.id == "__all__"):
                    out["variables"].append({"name": t.id, "type": value_type(n.value), "line": n.lineno})
    todo: list[tuple[ast.AST, int, str, int]] = [(tree, -1, "", 0)]
    while todo:
        n, parent, field, depth = todo.pop()
        k = len(out["nodes"])
        name = getattr(n, "name", None) or getattr(n, "id", None) or getattr(n, "attr", None) or getattr(n, "arg", None)
        short = ast.unparse(n)[:200] if isinstance(n, (ast.expr, ast.Global, ast.Import, ast.ImportFrom)) and depth < 60 else None
        out["nodes"].append({"id": k, "parent": parent, "kind": type(n).__name__, "field": field, "name": name if isinstance(name, str) else None, "text": short, "start_line": getattr(n, "lineno", None), "end_line": getattr(n, "end_lineno", None), "depth": depth})
        below = [(c, k, f, depth + 1) for f, v in ast.iter_fields(n) for c in (v if isinstance(v, list) else [v]) if isinstance(c, ast.AST) and not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
        todo += reversed(below)
    return out


def parsed(files: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``files`` (``path, module, text``)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(p, m, t) for p, m, t in zip(batch["path"], batch["module"], batch["text"], strict=True)]
            frame = pd.DataFrame(rows)
            yield frame

    return files.select("path", "module", "text").mapInPandas(run, SCHEMA)


@dataclass
class Model:
    """Tables of a code base; each is a lazy view of the parsed files, which are written once."""

    files: DataFrame
    rows: DataFrame

    @classmethod
    def of(cls, files: DataFrame) -> Model:
        return cls(files, materialize(parsed(files), "python-model"))

    def _table(self, name: str) -> DataFrame:
        return self.rows.select("path", F.col("module").alias("pkg"), F.explode(name).alias("x")).select("path", "pkg", "x.*")

    @property
    def functions(self) -> DataFrame:
        return self._table("functions").withColumn("fq", F.concat_ws(".", "pkg", "name"))

    @property
    def types(self) -> DataFrame:
        return self._table("types").withColumn("kind", F.when(F.array_contains("bases", "Protocol") | F.array_contains("bases", "ABC"), "interface").otherwise("struct"))

    @property
    def variables(self) -> DataFrame:
        return self._table("variables")

    @property
    def imports(self) -> DataFrame:
        return self._table("imports").withColumn("imp", F.col("module"))

    @property
    def calls(self) -> DataFrame:
        return self._table("calls").select("src", "dst")

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def packages(self) -> DataFrame:
        return self.rows.select(F.col("module").alias("pkg")).distinct()
