"""React and Next.js sources: a scanner of TypeScript with JSX, and what the component rules find in a file.

The scanner blanks comments, strings, templates and the text of elements, so that
brackets pair up and patterns meet code alone. It lists elements with their attributes.
Sources that end in the middle of something are read as far as they go.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.plans.shipping import ship

FACTS = ("client", "server", "metadata", "static_params", "async_export", "async_page", "suspense", "next_import")
SCHEMA = "path string, pkg string, flags array<struct<line: int, category: string>>, " + ", ".join(f"{x} boolean" for x in FACTS)

#: Elements and hook calls of one function, and states of one component, from which rules speak.
MAX_ELEMENTS, MAX_HOOKS, MIN_STATES = 50, 8, 5
#: Objects of the browser, request functions that make a page dynamic, words that tell a validating call.
BROWSER = ("window", "document", "navigator", "localStorage", "sessionStorage", "location")
DYNAMIC = ("cookies", "headers", "searchParams")
VALIDATING = ("safeParse", "parse", "validate", "Validate", "schema", "Schema")

_PIECES = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[\w$]+|=>|\S", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_ELEMENT = re.compile(r"<(?:>|([A-Za-z_$][\w$.:-]*)(?=[\s/>])(?!\s+extends\b))")
_ATTRIBUTE = re.compile(r"([A-Za-z_$][\w$.:-]*)(\s*=\s*)?")
_GENERIC = r"\s*(?:<[^();]*?>)?\s*\("
_BEFORE_VALUE = set("(,=?:;{}[&|!") | {"", "=>", "return", "default", "case", "yield", "await"}
_STATEMENT = re.compile(r"\s*\n\s*(?:const|let|var|function|export|return|if|for|import|class|async|type|interface)\b")


@dataclass
class Attribute:
    """``text`` is the value of a string; ``start`` and ``end`` enclose an expression in braces."""

    name: str
    at: int
    text: str | None = None
    start: int = -1
    end: int = -1


@dataclass
class Element:
    name: str
    at: int
    attributes: list[Attribute] = field(default_factory=list)


@dataclass
class Function:
    """``params`` and ``body`` are spans; ``block`` tells a body in braces."""

    at: int
    params: tuple[int, int]
    body: tuple[int, int]
    declared: bool
    is_async: bool
    block: bool


def scan(text: str, jsx: bool = True) -> tuple[str, list[Element], set[int]]:
    """Code with blanked text, elements, and places of braces that JSX opens."""
    out, elements, braces = list(text), [], set()
    # frames: code (open braces, attribute), tag (element), children, template
    stack: list[list] = [["code", 0, None]]
    i, last, n = 0, "", len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def element(m: re.Match) -> None:
        found = Element(m.group(1) or "", m.start())
        elements.append(found)
        stack.append(["tag", found] if m.group(1) else ["children"])

    while i < n:
        frame, c = stack[-1], text[i]
        if frame[0] == "template":
            if c == "\\":
                blank(i, i + 2)
                i += 2
            elif c == "`":
                stack.pop()
                last, i = ")", i + 1
            elif text.startswith("${", i):
                stack.append(["code", 0, None])
                out[i], last, i = " ", "", i + 2
            else:
                blank(i, i + 1)
                i += 1
        elif frame[0] == "children":
            m = _ELEMENT.match(text, i) if c == "<" else None
            if text.startswith("</", i):
                stop = text.find(">", i)
                stack.pop()
                last, i = ")", n if stop < 0 else stop + 1
            elif m:
                element(m)
                i = m.end()
            elif c == "{":
                braces.add(i)
                stack.append(["code", 0, None])
                last, i = "", i + 1
            else:
                blank(i, i + 1)
                i += 1
        elif frame[0] == "tag":
            m = _ATTRIBUTE.match(text, i)
            if text.startswith("/>", i):
                stack.pop()
                last, i = ")", i + 2
            elif c == ">":
                stack[-1] = ["children"]
                i += 1
            elif c == "{":
                braces.add(i)
                stack.append(["code", 0, None])
                last, i = "", i + 1
            elif m:
                found = Attribute(m.group(1), i)
                frame[1].attributes.append(found)
                i = m.end()
                if m.group(2) and i < n and text[i] in "\"'":
                    stop = text.find(text[i], i + 1)
                    stop = n if stop < 0 else stop
                    found.text = text[i + 1 : stop]
                    blank(i + 1, stop)
                    i = stop + 1
                elif m.group(2) and i < n and text[i] == "{":
                    found.start = i + 1
                    braces.add(i)
                    stack.append(["code", 0, found])
                    last, i = "", i + 1
            else:
                i += 1
        else:
            m = _PIECES.match(text, i)
            piece = m.group() if m else c
            if c.isspace():
                i += 1
                continue
            if piece.startswith(("//", "/*")):
                blank(i, i + len(piece))
            elif c in "\"'":
                blank(i + 1, i + len(piece) - 1)
                last = ")"
            elif c == "`":
                stack.append(["template"])
            elif c == "/" and last in _BEFORE_VALUE and _PATTERN.match(text, i):
                piece = _PATTERN.match(text, i).group()
                blank(i, i + len(piece))
                last = ")"
            elif jsx and c == "<" and last in _BEFORE_VALUE and _ELEMENT.match(text, i):
                found = _ELEMENT.match(text, i)
                element(found)
                piece = found.group()
            elif c == "}" and frame[1] == 0 and len(stack) > 1:
                if frame[2] is not None:
                    frame[2].end = i
                stack.pop()
                if stack[-1][0] == "template":
                    out[i] = " "
            else:
                frame[1] += (c == "{") - (c == "}" and frame[1] > 0)
                last = piece
            i += len(piece)
    for e in elements:
        for a in e.attributes:
            if a.start >= 0 and a.end < 0:
                a.end = n
    return "".join(out), elements, braces


class Source:
    """A scanned file with its pairs of brackets and its functions."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.text = path, text
        self.code, self.elements, self.braces = scan(text, not path.endswith(".ts"))
        self.starts = [m.end() for m in re.finditer("\n", text)]
        self.pairs, opened = {}, []
        for i, c in enumerate(self.code):
            if c in "([{":
                opened.append(i)
            elif c in ")]}" and opened:
                self.pairs[opened.pop()] = i
        self.opens = {b: a for a, b in self.pairs.items()}
        self.functions = sorted([*self._declared(), *self._arrows()], key=lambda f: f.at)
        self.by_start = {f.at: f for f in self.functions}
        self.places = [f.at for f in self.functions]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) + 1

    def close(self, at: int) -> int:
        return self.pairs.get(at, len(self.code))

    def find(self, pattern: str, start: int = 0, end: int | None = None) -> list[re.Match]:
        return list(re.compile(pattern).finditer(self.code, start, len(self.code) if end is None else end))

    def calls(self, name: str, start: int = 0, end: int | None = None) -> list[re.Match]:
        """Calls whose function is exactly a ``name`` (a pattern); a match ends behind the bracket."""
        return [m for m in self.find(rf"(?<![\w$.])(?:{name}){_GENERIC}", start, end) if not re.search(r"function\s*\Z", self.code[max(0, m.start() - 12) : m.start()])]

    def skip(self, at: int) -> int:
        m = re.compile(r"\s*").match(self.code, at)
        return m.end()

    def end_of(self, at: int, stops: str) -> int:
        """Where an expression or statement ends: at one of ``stops``, a closing bracket or a line that begins a statement."""
        while at < len(self.code):
            c = self.code[at]
            if c in "([{":
                at = self.close(at)
            elif c in stops or c in ")]}" or c in "\n" and _STATEMENT.match(self.code, at):
                return at
            at += 1
        return len(self.code)

    def split(self, start: int, end: int) -> list[str]:
        """Parts between the commas of a list, as they are written."""
        out = []
        while start < end:
            stop = min(self.end_of(start, ","), end)
            out.append(self.text[start:stop].strip())
            start = stop + 1
        return [x for x in out if x]

    def _declared(self) -> Iterator[Function]:
        for m in self.find(r"(?<![\w$.])(async\s+)?function\b\s*\*?\s*([\w$]*)\s*(?:<[^<>(){}]*>\s*)?\("):
            close = self.close(m.end() - 1)
            start = self.code.find("{", close)
            while start >= 0 and re.match(r"\s*[>\[]", self.code[self.close(start) + 1 : self.close(start) + 9]):
                start = self.code.find("{", self.close(start))
            if start >= 0:
                before = self.code[max(0, m.start() - 16) : m.start()].rstrip()
                declared = before == "" or before[-1] in ";{}" or before.endswith(("export", "default")) or (m.group(2) != "" and before[-1] not in "=(,:?&|[>")
                yield Function(m.start(), (m.end(), close), (start, self.close(start)), declared, bool(m.group(1)), True)

    def _arrows(self) -> Iterator[Function]:
        for m in self.find("=>"):
            j = m.start() - 1
            while j >= 0 and self.code[j].isspace():
                j -= 1
            typed = re.search(r"\)\s*:\s*[^=;{}()]*\Z", self.code[max(0, j - 200) : j + 1])
            if typed:
                j = max(0, j - 200) + typed.start()
            if j >= 0 and self.code[j] == ")":
                at = self.opens.get(j, j)
                params = (at + 1, j)
            else:
                word = re.search(r"[\w$]*\Z", self.code[max(0, j - 100) : j + 1]).group()
                at = j + 1 - len(word)
                params = (at, j + 1)
            before = re.search(r"(?<![\w$.])async\s*\Z", self.code[max(0, at - 16) : at])
            start = self.skip(m.end())
            block = self.code.startswith("{", start)
            stop = self.close(start) if block else self.end_of(start, ",;")
            yield Function(at - len(before.group()) if before else at, params, (start, stop), False, bool(before), block)

    def statements(self, f: Function) -> int:
        """Statements of a block, by lines and semicolons; lines that carry on are not counted."""
        parts, i, start = [], f.body[0] + 1, f.body[0] + 1
        flat = ""
        while i < f.body[1]:
            if self.code[i] in "([{" and self.close(i) < f.body[1]:
                flat += self.code[start:i] + "()"
                i = start = self.close(i) + 1
            else:
                i += 1
        parts = [x.strip() for x in re.split(r"[;\n]", flat + self.code[start : f.body[1]])]
        return sum(1 for x in parts if x and not re.match(r"[.?:&|+*/=<>,-]|else\b|catch\b|finally\b", x))

    def chain_start(self, at: int) -> int:
        """First place of the expression whose member is named at ``at``."""
        while at > 0:
            c = self.code[at - 1]
            if c in ")]" and at - 1 in self.opens:
                at = self.opens[at - 1]
            elif c.isalnum() or c in "_$.?!" or c.isspace() and re.match(r"\s*[.?]", self.code[at : at + 80]):
                at -= 1
            else:
                break
        return self.skip(at)


def _effects(s: Source) -> list[tuple[int, Function, list[str]]]:
    """Place, callback and dependencies of each effect."""
    out = []
    for m in s.calls("useEffect"):
        f = s.by_start.get(s.skip(m.end()))
        if f is not None:
            deps = re.compile(r"\}?\s*,\s*\[").match(s.code, f.body[1])
            out.append((m.start(), f, s.split(deps.end(), s.close(deps.end() - 1)) if deps else []))
    return out


def _literal(s: Source, start: int, end: int) -> bool:
    """Whether an object or array literal stands in an expression."""
    params = [f.params for f in s.functions[bisect_left(s.places, start) : bisect_left(s.places, end)]]
    for m in s.find(r"[\[{]", start, end):
        i = m.start()
        if i in s.braces or any(a <= i < b for a, b in params):
            continue
        before = s.code[start:i].rstrip()
        word = re.search(r"[\w$]+\Z", before)
        if word and word.group() in ("return", "in", "of") or not before or before[-1] in "(,=:?&|[{!" or m.group() == "[" and before.endswith(("=>", ";", "}")):
            return True
    return False


def react_flags(s: Source) -> list[tuple[str, int]]:
    """Category and place of what the component rules find in a file."""
    out: list[tuple[str, int]] = []
    named = [e.at for e in s.elements if e.name]
    hooks, states = ([m.start() for m in s.calls(x)] for x in (r"use[\w$.]*", "useState"))

    def count(places: list[int], start: int, end: int) -> int:
        return bisect_left(places, end) - bisect_left(places, start)

    for f in s.functions:
        if f.declared or f.body[0] > f.params[1] and s.code[f.params[1] : f.body[0]].rstrip().endswith("=>"):
            out += [("react/god-component", f.at)] * ((count(named, f.at, f.body[1]) > MAX_ELEMENTS) + (count(hooks, f.at, f.body[1]) > MAX_HOOKS))
            if count(states, *f.body) >= MIN_STATES:
                out.append(("react/too-many-usestate", f.at))
    setters = {m.group(2) for m in s.find(rf"\[\s*([\w$]+)\s*,\s*([\w$]+)[^\]=]*\]\s*(?::[^=]+)?=\s*useState{_GENERIC}")}
    effects, sets = _effects(s), []
    for at, f, _ in effects:
        names = "|".join(re.escape(x) for x in sorted(setters)) or "(?!)"
        sets.append([re.match(r"[\w$]+", m.group()).group() for m in s.calls(names, *f.body)])
        if sets[-1] and f.block and s.statements(f) <= len(sets[-1]):
            out.append(("react/derived-state-in-effect", at))
    for i, (at, _, _) in enumerate(effects):
        for name in sets[i]:
            state = name[3].lower() + name[4:] if name.startswith("set") and len(name) > 3 else name
            out += [("react/effect-chain", at) for j, (_, _, deps) in enumerate(effects) if j != i for d in deps if d == state]
    for a in (a for e in s.elements for a in e.attributes if a.start >= 0):
        if a.name.startswith("on") and s.find(r"=>|(?<![\w$.])function\b", a.start, a.end):
            out.append(("react/inline-function-jsx", a.at))
        if a.name != "key" and _literal(s, a.start, a.end):
            out.append(("react/object-literal-jsx", a.at))
    keys = [a for e in s.elements for a in e.attributes if a.name == "key" and a.start >= 0]
    for m in s.find(rf"\.\s*map{_GENERIC}"):
        f = s.by_start.get(s.skip(m.end()))
        params = s.split(*f.params) if f else []
        if len(params) >= 2:
            index = params[1].split(":")[0].strip()
            if any(f.body[0] <= k.at < f.body[1] and index in s.text[k.start : k.end] for k in keys):
                out.append(("react/index-as-key", s.chain_start(m.start())))
    out += [("react/missing-query-invalidation", m.start()) for m in s.calls("useMutation") if "invalidate" not in s.text[m.start() : s.close(m.end() - 1)]]
    return out


def _statements_of(s: Source, word: str) -> list[tuple[int, int]]:
    """Spans of the statements that begin with a word at the start of a line."""
    return [(m.start(1), s.end_of(m.end(), ";")) for m in s.find(rf"(?m)^[ \t]*({word})\b")]


def _directive(s: Source, words: str) -> bool:
    return re.search(rf"(?m)^[ \t]*([\"']){words}\1[ \t]*;?[ \t]*$", s.text) is not None


def next_flags(s: Source) -> tuple[list[tuple[str, int]], dict[str, bool]]:
    """Category and place of what the Next.js rules find in a file, and facts for rules on routes."""
    imports = [s.text[a:b] for a, b in _statements_of(s, "import")]
    exports = [(s.text[a:b], a, b) for a, b in _statements_of(s, "export")]
    client, server, inside_app = _directive(s, "use client"), _directive(s, "use server"), "/app/" in s.path
    out: list[tuple[str, int]] = []
    if not any("next/image" in x for x in imports):
        out += [("nextjs/no-img-element", e.at) for e in s.elements if e.name == "img"]
    links = [(e.at, next((a.text for a in e.attributes if a.name == "href" and a.text is not None), "")) for e in s.elements if e.name == "a"]
    out += [("nextjs/no-html-link", at) for at, href in links if href.startswith("/") and not href.startswith("//")]
    events = any(a.name.startswith("on") for e in s.elements for a in e.attributes)
    if client and not events and not s.calls(r"use[\w$.]*") and not s.find(rf"(?<![\w$.])(?:{'|'.join(BROWSER)})\s*\??\."):
        out.append(("nextjs/unnecessary-use-client", 0))
    if inside_app and not client:
        out += [("nextjs/fetch-in-effect", at) for at, f, _ in _effects(s) if s.calls("fetch", *f.body)]
        out += [("nextjs/server-fetch-api-route", m.start()) for m in s.calls("fetch") if "/api/" in s.text[m.end() : s.end_of(m.end(), ",")]]
    if re.search(r"(?:^|/)app/layout\.tsx?$", s.path):
        out += [("nextjs/dynamic-in-root-layout", m.start()) for m in s.calls("|".join(DYNAMIC))]
    if server:
        for f in s.functions:
            validates = any(w in m.group(1) for m in s.find(r"([\w$.?\[\]]+)\s*\(", *f.body) for w in VALIDATING)
            if f.declared and f.is_async and re.search("[Ff]ormData", s.text[slice(*f.params)]) and not validates:
                out.append(("nextjs/server-action-no-validation", f.at))
    facts = {
        "client": client,
        "server": server,
        "metadata": any("metadata" in x or "generateMetadata" in x for x, _, _ in exports),
        "static_params": any("generateStaticParams" in x for x, _, _ in exports),
        "async_export": any(f.declared and f.is_async and a <= f.at < b for _, a, b in exports for f in s.functions),
        "async_page": any(f.is_async or "Promise" in s.code[f.params[1] : f.body[0]] for f in s.functions),
        "suspense": any("Suspense" in x for x in imports),
        "next_import": any(re.search(r"[\"']next(?:/|[\"'])", x) for x in imports),
    }
    return out, facts


def parse_web(path: str, pkg: str, text: str | None) -> dict:
    """A row of ``SCHEMA``; a null text has no flags and no facts."""
    s = Source(path or "", text or "")
    found, facts = next_flags(s)
    return {"path": path, "pkg": pkg, "flags": [{"line": s.line(at), "category": c} for c, at in [*react_flags(s), *found]], **facts}


def parsed(files: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``files`` (``path, pkg, text``)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_web(p, m, t) for p, m, t in zip(batch["path"], batch["pkg"], batch["text"], strict=True)])

    return files.select("path", "pkg", "text").mapInPandas(run, SCHEMA)
