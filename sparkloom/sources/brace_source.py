"""Go and TypeScript files as model tables, read by a small tokenizer in Arrow batches.

The tokenizer knows comments, strings and brackets, which is enough for declarations,
signatures, calls and statement-level findings. It does not resolve types; rules that
need resolved types work on their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.plans.shipping import ship

SCHEMA = """path string, pkg string, name string, error string,
functions array<struct<name:string,receiver:string,signature:string,line:int,end_line:int,exported:boolean,params:array<struct<name:string,type:string>>,results:array<string>,named_results:boolean,cyclomatic:int,cognitive:int,uses:array<string>,shape:string,size:int>>,
types array<struct<name:string,kind:string,line:int,methods:array<string>,fields:array<struct<name:string,type:string>>>>,
variables array<struct<name:string,type:string,line:int>>,
imports array<struct<module:string,raw:string,names:int,line:int>>,
calls array<struct<src:string,dst:string,line:int,arg:string,last:string>>,
flags array<struct<category:string,line:int>>"""

_TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>=>|:=|\|\||&&|\?\?|\?\.|\.\.\.|!==?|===?|<=|>=|\+\+|--|[^\s\w])""", re.S)
_GO_WORDS = {"if", "for", "switch", "select", "return", "func", "go", "defer", "range", "case", "map", "chan", "struct", "interface", "else", "type", "var", "const"}
_GO_BUILTINS = {"append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover", "string", "int", "byte", "error", "float64", "int64", "bool"}
_TS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "else", "do", "super", "constructor", "import", "async", "case", "in", "of", "throw", "delete", "void", "yield"}
#: What changes the document by hand.
DOM_METHODS = {"querySelector", "querySelectorAll", "getElementById", "getElementsByClassName", "getElementsByTagName", "createElement", "appendChild", "removeChild", "insertBefore"}
DOM_PROPERTIES = {"innerHTML", "outerHTML", "innerText", "textContent"}

Token = tuple[str, str, int]


def tokens(text: str) -> list[Token]:
    """Words, marks, strings and numbers with their lines; comments are left out."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        if m.lastgroup != "comment":
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


def closing(ts: list[Token], at: int) -> int:
    """Position of the bracket that closes the one at ``at``; the end if none does."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    opening, end = ts[at][1], pairs[ts[at][1]]
    for i in range(at, len(ts)):
        if ts[i][0] == "mark":
            depth += (ts[i][1] == opening) - (ts[i][1] == end)
            if not depth:
                return i
    return len(ts) - 1


def joined(ts: list[Token]) -> str:
    out = ""
    for kind, t, _ in ts:
        out += (" " if out and kind in ("word", "number") and (out[-1].isalnum() or out[-1] in "_,:)]") else "") + t
    return out


def split_commas(ts: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in ts:
        if t[0] == "mark":
            depth += (t[1] in "({[<") - (t[1] in ")}]>")
            if t[1] == "," and depth <= 0:
                out.append([])
                continue
        out[-1].append(t)
    return [x for x in out if x]


def measure(body: list[Token], words: set[str]) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a body."""
    cyclo, cog, nesting, depth = 1, 0, [], 0
    for i, (kind, t, _) in enumerate(body):
        if kind == "mark" and t == "{":
            depth += 1
        elif kind == "mark" and t == "}":
            depth -= 1
            while nesting and nesting[-1] >= depth:
                nesting.pop()
        elif kind == "word" and t in words:
            chained = t == "if" and i and body[i - 1][1] == "else"
            cyclo += t not in ("switch", "select")
            cog += 1 if chained else 1 + len(nesting)
            if not chained:
                nesting.append(depth)
        elif kind == "word" and t == "else" and not (i + 1 < len(body) and body[i + 1][1] == "if"):
            cog += 1
        elif kind == "word" and t == "case":
            cyclo += 1
        elif kind == "mark" and t in ("&&", "||"):
            cyclo += 1
            last = next((x for k, x, _ in reversed(body[:i]) if k == "mark" and x in ("&&", "||", "{", ";", "=", ":=")), "")
            cog += last != t
    return cyclo, cog


def shape(body: list[Token], words: set[str]) -> tuple[str, int]:
    """Digest of a body with names, strings and numbers made alike, and its number of tokens."""
    alike = [t if kind == "mark" or t in words else {"word": "x", "string": "s", "number": "0"}[kind] for kind, t, _ in body]
    return hashlib.sha256(" ".join(alike).encode()).hexdigest()[:24], len(body)


def _called(body: list[Token], skip: set[str]) -> list[tuple[str, int, str | None, str | None]]:
    """Callees once each, with the line, the first argument if it is a string, and the last one if it is a name."""
    out: dict[str, tuple] = {}
    for i, (kind, t, line) in enumerate(body):
        if kind != "word" or i + 1 >= len(body) or body[i + 1][1] != "(" or t in skip:
            continue
        name, k = t, i
        while k >= 2 and body[k - 1][1] in (".", "?.") and body[k - 2][0] == "word":
            k -= 2
            name = body[k][1] + "." + name
        key = name if body[i + 2 : i + 3] == [] or body[i + 2][0] != "string" else name + body[i + 2][1]
        if key not in out:
            args = split_commas(body[i + 2 : closing(body, i + 1)])
            first = args[0][0][1].strip("\"'`") if args and args[0][0][0] == "string" else None
            last = joined(args[-1]) if args and args[-1][-1][0] == "word" else None
            out[key] = (name, line, first, last)
    return list(out.values())


def _go_params(ts: list[Token]) -> list[dict]:
    parts, out, waiting = split_commas(ts), [], []
    named = any(len(p) > 1 and p[0][0] == "word" and p[1][1] not in (".", "[") for p in parts)
    for p in parts:
        if not named:
            out.append({"name": "", "type": joined(p)})
        elif len(p) == 1:
            waiting.append(p[0][1])
        else:
            kind = joined(p[1:])
            out += [{"name": n, "type": kind} for n in [*waiting, p[0][1]]]
            waiting = []
    return out + [{"name": "", "type": n} for n in waiting]


def _empty(path: str, pkg: str) -> dict:
    return {"path": path, "pkg": pkg, "name": "", "error": None, "functions": [], "types": [], "variables": [], "imports": [], "calls": [], "flags": []}


def parse_go(path: str, pkg: str, text: str | None) -> dict:
    out, ts, i = _empty(path, pkg), tokens(text or ""), 0
    flag = lambda category, line: out["flags"].append({"category": category, "line": line})

    def type_spec(i: int) -> int:
        name, line = ts[i][1], ts[i][2]
        k = i + 1
        if k < len(ts) and ts[k][1] == "[" and k + 1 < len(ts) and ts[k + 1][0] == "word":
            k = closing(ts, k) + 1
        if k + 1 < len(ts) and ts[k][1] in ("struct", "interface") and ts[k + 1][1] == "{":
            end, kind = closing(ts, k + 1), ts[k][1]
            rows: dict[int, list[Token]] = {}
            depth = 0
            for t in ts[k + 2 : end]:
                depth += (t[1] in "({") - (t[1] in ")}") if t[0] == "mark" else 0
                rows.setdefault(t[2], []).append(t)
            methods, fields = [], []
            for row in rows.values():
                if kind == "interface" and len(row) > 1 and row[0][0] == "word" and row[1][1] == "(":
                    methods.append(row[0][1])
                elif kind == "struct" and row[0][0] == "word":
                    row = [t for t in row if t[0] != "string"]
                    names = [row[0][1]]
                    k2 = 1
                    while k2 + 1 < len(row) and row[k2][1] == ",":
                        names.append(row[k2 + 1][1])
                        k2 += 2
                    kind_text = joined(row[k2:]) or row[0][1]
                    if len(row) > 1 and row[1][1] == ".":
                        names, kind_text = [joined(row)], joined(row)
                    fields += [{"name": n, "type": kind_text} for n in names]
                elif kind == "struct":
                    fields.append({"name": joined(row), "type": joined(row)})
            out["types"].append({"name": name, "kind": kind, "line": line, "methods": methods, "fields": fields})
            return end + 1
        out["types"].append({"name": name, "kind": "alias", "line": line, "methods": [], "fields": []})
        while k < len(ts) and ts[k][2] == line:
            k += 1
        return k

    while i < len(ts):
        kind, t, line = ts[i]
        if kind == "word" and t == "package" and i + 1 < len(ts) and not out["name"]:
            out["name"], i = ts[i + 1][1], i + 2
        elif kind == "word" and t == "import" and i + 1 < len(ts):
            end = closing(ts, i + 1) if ts[i + 1][1] == "(" else i + (2 if ts[i + 1][0] == "word" or ts[i + 1][1] in "._" else 1)
            out["imports"] += [{"module": x[1].strip('"`'), "raw": x[1], "names": 0, "line": x[2]} for x in ts[i + 1 : end + 1] if x[0] == "string"]
            i = end + 1
        elif kind == "word" and t == "type" and i + 1 < len(ts):
            if ts[i + 1][1] == "(":
                end, i = closing(ts, i + 1), i + 2
                while i < end:
                    i = type_spec(i) if ts[i][0] == "word" else i + 1
            else:
                i = type_spec(i + 1)
        elif kind == "word" and t in ("var", "const") and i + 1 < len(ts):
            block = ts[i + 1][1] == "("
            end = closing(ts, i + 1) if block else i + 1
            rows, k, depth = {}, i + 2 if block else i + 1, 0
            while k < (end if block else len(ts)) and (block or ts[k][2] == line or depth):
                if ts[k][0] == "mark":
                    depth += (ts[k][1] in "({[") - (ts[k][1] in ")}]")
                rows.setdefault(ts[k][2] if not depth else None, []).append(ts[k])
                k += 1
            for n, row in rows.items():
                if n is not None and row[0][0] == "word" and row[0][1] != "_":
                    stop = next((j for j, x in enumerate(row) if x[1] == "="), len(row))
                    out["variables"].append({"name": row[0][1], "type": joined(row[1:stop]), "line": n})
            i = max(k, i + 1)
        elif kind == "word" and t == "func" and i + 1 < len(ts):
            start, receiver, k = line, "", i + 1
            if ts[k][1] == "(":
                end = closing(ts, k)
                receiver = joined([x for x in ts[k + 1 : end] if x[0] == "word"][-1:])
                k = end + 1
            name = ts[k][1] if k < len(ts) else ""
            while k < len(ts) and ts[k][1] not in "({":
                k = closing(ts, k) + 1 if ts[k][1] == "[" else k + 1
            if k >= len(ts):
                break
            end = closing(ts, k)
            params, k, r0 = _go_params(ts[k + 1 : end]), end + 1, end + 1
            head = ts[i:k]
            while k < len(ts) and not (ts[k][1] == "{" and ts[k - 1][1] not in ("interface", "struct")) and (ts[k][2] == ts[k - 1][2] or ts[k - 1][1] in "(,"):
                k = closing(ts, k) + 1 if ts[k][1] in "({[" else k + 1
            res = ts[r0:k]
            inner = _go_params(res[1:-1]) if res and res[0][1] == "(" else [{"name": "", "type": joined(res)}] if res else []
            named = bool(inner and inner[0]["name"])
            end = closing(ts, k) if k < len(ts) and ts[k][1] == "{" else k - 1
            body = ts[k + 1 : end] if end >= k else []
            cyclo, cog = measure(body, {"if", "for", "switch", "select"})
            stop = ts[min(end, len(ts) - 1)][2]
            own = f"{pkg}.{receiver}.{name}" if receiver else f"{pkg}.{name}"
            out["functions"].append({"name": name, "receiver": receiver, "signature": joined([*head[1:], *res]), "line": start, "end_line": stop, "exported": name[:1].isupper(), "params": params, "results": [x["type"] for x in inner], "named_results": named, "cyclomatic": cyclo, "cognitive": cog, "uses": [], "shape": (sh := shape(body, _GO_WORDS))[0], "size": sh[1]})
            for c, n, first, last in _called(body, _GO_WORDS | _GO_BUILTINS):
                dst = c if "." in c else f"{pkg}.{c}"
                if dst != own:
                    out["calls"].append({"src": own, "dst": dst, "line": n, "arg": first, "last": last})
            library = out["name"] != "main" and "/cmd" not in pkg
            for j, (k2, x, n) in enumerate(body):
                nxt = body[j + 1] if j + 1 < len(body) else ("", "", 0)
                if x == "panic" and k2 == "word" and nxt[1] == "(" and library:
                    flag("style/panic-in-library", n)
                if x == "return" and named and stop - start > 10 and nxt[2] != n:
                    flag("style/naked-return", n)
                if x == "else" and nxt[1] == "{" and j and body[j - 1][1] == "}":
                    back, depth = j - 1, 0
                    while back >= 0:
                        depth += (body[back][1] == "}") - (body[back][1] == "{")
                        if not depth:
                            break
                        back -= 1
                    lines_ = [y for y in body[back + 1 : j - 1]]
                    last = [y for y in lines_ if lines_ and y[2] == lines_[-1][2]]
                    if last and last[0][1] in ("return", "break", "continue", "goto"):
                        flag("style/unnecessary-else", n)
                if x == "map" and [y[1] for y in body[j + 1 : j + 4]] == ["[", "string", "]"]:
                    k3 = j + 4
                    if k3 < len(body) and body[k3][1] in ("any", "interface"):
                        k3 += 1 if body[k3][1] == "any" else 3
                        if k3 < len(body) and body[k3][1] == "{" and len(split_commas(body[k3 + 1 : closing(body, k3)])) >= 3:
                            flag("style/untyped-map", n)
            if name == "init" and not receiver:
                for c, n, _, _ in _called(body, set()):
                    if c.startswith(("http.", "sql.", "net.", "io.")) or c.startswith("os.Open"):
                        flag("style/init-side-effects", n)
            i = end + 1
        else:
            i += 1
    for x in out["imports"]:
        if "crypto/md5" in x["module"] or "crypto/sha1" in x["module"]:
            flag("security/weak-crypto", x["line"])
    return out


def parse_ts(path: str, pkg: str, text: str | None) -> dict:
    out, ts, waiting = _empty(path, pkg), tokens(text or ""), []
    flag = lambda category, line: out["flags"].append({"category": category, "line": line})

    def param(p: list[Token]) -> dict:
        at = next((k for k, x in enumerate(p) if x[1] == ":"), len(p))
        return {"name": joined(p[:at]).rstrip("?"), "type": joined(p[at + 1 :])}

    def function(name: str, receiver: str, line: int, k: int, exported: bool) -> int:
        """``k`` is at the opening parenthesis of the parameters; returns the position after the body."""
        end = closing(ts, k)
        params = [param(p) for p in split_commas(ts[k + 1 : end])]
        r0 = k2 = end + 1
        while k2 < len(ts) and ts[k2][1] not in ("{", "=>", ";") and ts[k2][0] != "string":
            k2 = closing(ts, k2) + 1 if ts[k2][1] in "([" else k2 + 1
        ret = joined([x for x in ts[r0:k2] if x[1] != ":"])
        if k2 < len(ts) and ts[k2][1] == "=>":
            k2 += 1
        stop = closing(ts, k2) if k2 < len(ts) and ts[k2][1] == "{" else k2
        body = ts[k2 + 1 : stop]
        cyclo, cog = measure(body, {"if", "for", "while", "switch", "catch"})
        own = f"{pkg}.{receiver}.{name}" if receiver else f"{pkg}.{name}"
        out["functions"].append({"name": name, "receiver": receiver, "signature": f"{name}({joined(ts[k + 1 : end])})" + (f": {ret}" if ret else ""), "line": line, "end_line": ts[min(stop, len(ts) - 1)][2], "exported": exported, "params": params, "results": [ret] if ret else [], "named_results": False, "cyclomatic": cyclo, "cognitive": cog, "uses": waiting[:], "shape": (sh := shape(body, _TS_WORDS))[0], "size": sh[1]})
        waiting.clear()
        for c, n, first, last in _called(body, _TS_WORDS):
            dst = f"{pkg}.{receiver}.{c[5:]}" if c.startswith("this.") and receiver else c if "." in c else f"{pkg}.{c}"
            if dst != own:
                out["calls"].append({"src": own, "dst": dst, "line": n, "arg": first, "last": last})
        return stop + 1

    i, exported = 0, False
    while i < len(ts):
        kind, t, line = ts[i]
        nxt = ts[i + 1] if i + 1 < len(ts) else ("", "", 0)
        if kind == "word" and t == "export":
            exported, i = True, i + 1
            continue
        if kind == "word" and t in ("default", "async", "declare", "abstract"):
            i += 1
            continue
        if kind == "word" and t == "import":
            k = i + 1
            while k < len(ts) and ts[k][0] != "string" and ts[k][1] != ";":
                k += 1
            if k < len(ts) and ts[k][0] == "string":
                names = sum(x[0] == "word" and x[1] not in ("from", "as", "type") for x in ts[i + 1 : k])
                module = ts[k][1].strip("\"'`")
                out["imports"].append({"module": module, "raw": joined(ts[i : k + 1]), "names": names, "line": line})
                if names > 5 and not module.startswith((".", "/")) and "/" not in module.lstrip("@"):
                    flag("perf/barrel-import", line)
            i = k + 1
        elif kind == "word" and t == "function" and nxt[0] == "word":
            k = i + 2
            if k < len(ts) and ts[k][1] == "<":
                while k < len(ts) and ts[k][1] != "(":
                    k += 1
            i = function(nxt[1], "", line, k, exported) if k < len(ts) and ts[k][1] == "(" else i + 1
        elif kind == "word" and t in ("const", "let", "var") and nxt[0] == "word":
            k = i + 2
            while k < len(ts) and ts[k][1] not in ("=", ";") and ts[k][2] == line:
                k += 1
            arrow = k + 1
            if arrow < len(ts) and ts[arrow][1] == "async":
                arrow += 1
            if k < len(ts) and ts[k][1] == "=" and arrow < len(ts) and ts[arrow][1] == "(" and "=>" in [x[1] for x in ts[closing(ts, arrow) : closing(ts, arrow) + 12]]:
                i = function(nxt[1], "", line, arrow, exported)
            else:
                out["variables"].append({"name": nxt[1], "type": joined(ts[i + 3 : k]), "line": line})
                i = k + 1
        elif kind == "word" and t in ("class", "interface") and nxt[0] == "word":
            k = i + 2
            while k < len(ts) and ts[k][1] != "{":
                k += 1
            if k >= len(ts):
                break
            end, j, methods, fields = closing(ts, k), k + 1, [], []
            while j < end:
                if ts[j][1] == "@" and j + 1 < end:
                    j2 = closing(ts, j + 2) if j + 2 < end and ts[j + 2][1] == "(" else j + 1
                    waiting.append(joined(ts[j + 1 : j2 + 1]))
                    j = j2 + 1
                elif ts[j][0] == "word" and j + 1 < end and ts[j + 1][1] == "(" and ts[j][1] not in ("if", "for"):
                    methods.append(ts[j][1])
                    if t == "class":
                        j = function(ts[j][1], nxt[1], ts[j][2], j + 1, exported)
                    else:
                        j = closing(ts, j + 1) + 1
                        while j < end and ts[j][1] not in (";", ",") and not (ts[j][0] == "word" and ts[j][2] > ts[j - 1][2]):
                            j += 1
                elif ts[j][0] == "word" and j + 1 < end and ts[j + 1][1] in (":", "?", "=") or ts[j][0] == "word" and j + 2 < end and ts[j + 2][1] == ":":
                    name, row = ts[j][1], ts[j][2]
                    while j < end and ts[j][1] not in (":", "="):
                        j += 1
                    f0 = j + 1
                    while j < end and ts[j][2] == row and ts[j][1] not in (";", ","):
                        j = closing(ts, j) + 1 if ts[j][1] in "({[" else j + 1
                    fields.append({"name": name, "type": joined(ts[f0:j])})
                else:
                    j += 1
            out["types"].append({"name": nxt[1], "kind": t, "line": line, "methods": methods, "fields": fields})
            i = end + 1
        elif kind == "word" and t in ("enum", "type") and nxt[0] == "word" and (t == "enum" or i + 2 < len(ts) and ts[i + 2][1] in ("=", "<")):
            out["types"].append({"name": nxt[1], "kind": "enum" if t == "enum" else "alias", "line": line, "methods": [], "fields": []})
            if t == "enum":
                flag("style/enum-usage", line)
            i += 2
        else:
            i += 1
        exported = False
    casts = [x for k, x in enumerate(ts) if x[1] == "as" and k and k + 1 < len(ts) and ts[k + 1][0] == "word" and ts[k + 1][1] != "const" and ts[k - 1][1] not in ("*", ",", "{")]
    casts = [x for x in casts if not any(m["line"] == x[2] for m in out["imports"])]
    if len(casts) > 3:
        flag("style/as-assertion-overuse", casts[0][2])
    bangs = [x for k, x in enumerate(ts) if x[1] == "!" and k and (ts[k - 1][0] == "word" or ts[k - 1][1] in ")]") and k + 1 < len(ts) and ts[k + 1][1] in ".);,"]
    if len(bangs) > 5:
        flag("style/non-null-assertion-overuse", bangs[0][2])
    for k, (kind, t, line) in enumerate(ts):
        if kind == "string" and re.match(r"[\"'`]https?://", t) and not re.search(r"localhost|127\.0\.0\.1|example\.com", t):
            flag("style/hardcoded-url", line)
        if t == "document" and kind == "word" and k + 2 < len(ts) and ts[k + 1][1] == "." and ts[k + 2][1] in DOM_METHODS:
            flag("react/direct-dom", line)
        if t in DOM_PROPERTIES and kind == "word" and k and k + 1 < len(ts) and ts[k - 1][1] == "." and ts[k + 1][1] == "=":
            flag("react/direct-dom", line)
        if t == "dangerouslySetInnerHTML" and kind == "word":
            flag("security/xss", line)
        if t == "console" and k + 2 < len(ts) and ts[k + 2][1] in ("log", "warn", "error") and not re.search("test|spec", path):
            flag("style/console-log", line)
    return out


_PARSERS = {"go": parse_go, "typescript": parse_ts}


def parsed(files: DataFrame, language: str) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``files`` (``path, pkg, text``); null texts give empty arrays."""
    ship(files.sparkSession)
    parser = _PARSERS[language]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parser(p, m, t) for p, m, t in zip(batch["path"], batch["pkg"], batch["text"], strict=True)])

    return files.select("path", "pkg", "text").mapInPandas(run, SCHEMA)
