from collections import Counter

import pytest

from sparkloom.operators import web_rules as W
from sparkloom.sources import jsx_source as J

FORM = """import { useState, useEffect } from "react";
// don't open <b>
export default function Form({ a, items }: Props) {
  const [x, setX] = useState<string>("");
  const [y, setY] = useState(0);
  useEffect(() => {
    setX(a + "b");
  }, [a]);
  useEffect(() => {
    const r = f(x);
    console.log(r);
    setY(1);
  }, [x]);
  const m = useMutation({ mutationFn: save });
  const n = useMutation({ mutationFn: save, onSuccess: () => q.invalidateQueries() });
  return (
    <div className="k" onClick={() => go(1)} style={{ a: 1 }}>
      Don't {items.map((it, i) => <li key={i}>{it.name}</li>)}
      {items.map((it) => (<li key={it.id} onClick={handle} icon={<I a={1} />} />))}
      <C v={[1]} w={rows[0]} f={`a${b}`} g={({ k }) => k} />
    </div>
  );
}
"""


def flags(path, text, pkg="p"):
    return sorted((f["category"], f["line"]) for f in J.parse_web(path, pkg, text)["flags"])


def test_react():
    assert flags("w/form.tsx", FORM) == [
        ("react/derived-state-in-effect", 6), ("react/effect-chain", 6), ("react/index-as-key", 18), ("react/inline-function-jsx", 17),
        ("react/missing-query-invalidation", 14), ("react/object-literal-jsx", 17), ("react/object-literal-jsx", 20),
    ]


def test_god_component_and_states():
    many = "const A = () => (<div>" + "<b/>" * 50 + "</div>);\nconst B = () => (<div>" + "<b/>" * 49 + "</div>);\n"
    assert flags("a.tsx", many) == [("react/god-component", 1)]
    hooks = "function C() {\n" + "  useThing();\n" * 9 + "  return null;\n}\nfunction D() {\n" + "  useThing();\n" * 8 + "}\n"
    assert flags("a.ts", hooks) == [("react/god-component", 1)]
    states = "function E() {\n" + "".join(f"  const [a{k}, s{k}] = useState(0);\n" for k in range(5)) + "}\nfunction G() {\n" + "".join(f"  const [b{k}, t{k}] = useState(0);\n" for k in range(4)) + "}\n"
    assert flags("a.tsx", states) == [("react/too-many-usestate", 1)]


def test_next_files():
    links = 'export default () => (<p><img src="/a.png" /><a href="/home">x</a><a href="//cdn">y</a><a href="https://z">z</a></p>);\n'
    assert flags("w/x.tsx", links) == [("nextjs/no-html-link", 1), ("nextjs/no-img-element", 1)]
    assert flags("w/x.tsx", 'import Image from "next/image";\n' + links) == [("nextjs/no-html-link", 2)]
    assert flags("w/x.tsx", '"use client";\nexport const A = () => <p>on</p>;\n') == [("nextjs/unnecessary-use-client", 1)]
    assert flags("w/x.tsx", '"use client";\nexport const A = () => <p onClick={go}>on</p>;\n') == []
    assert flags("w/x.tsx", '"use client";\nexport const A = () => <p>{window.name}</p>;\n') == []
    effect = "function A() {\n  useEffect(() => {\n    fetch('/x');\n  }, []);\n  const r = fetch(`/api/users`, { a: 1 });\n}\n"
    assert flags("w/app/a/x.tsx", effect) == [("nextjs/fetch-in-effect", 2), ("nextjs/server-fetch-api-route", 5)]
    assert flags("w/lib/x.tsx", effect) == [] and flags("w/app/a/x.tsx", '"use client"\n' + effect) == []
    layout = "export default function L() {\n  const c = cookies();\n  return <html/>;\n}\n"
    assert flags("w/app/layout.tsx", layout) == [("nextjs/dynamic-in-root-layout", 2)] and flags("w/app/a/layout.tsx", layout) == []
    action = "'use server'\nexport async function save(formData: FormData) {\n  await db.put(formData.get('a'));\n}\nexport async function ok(formData: FormData) {\n  S.safeParse(formData);\n}\n"
    assert flags("w/actions.ts", action) == [("nextjs/server-action-no-validation", 2)]


def test_generics_strings_and_patterns_do_not_open_elements():
    text = "const f = <T,>(x: T) => x;\nconst g = useState<Map<string, number>>(1);\nif (a < b && c > d) { s = 'it' + /[\"'<]\\/x/.test(y); }\nconst h = <p>{a}</p>;\n"
    code, elements, _ = J.scan(text)
    assert [e.name for e in elements] == ["p"] and len(code) == len(text) and code.count("\n") == 4
    assert J.scan("const a = <Foo>x;\n", jsx=False)[1] == []


@pytest.mark.parametrize("text", ["", None, "<", "<a", "return <a b={", "{", "`${", "</", "a => ", "function f(", "=>" * 50, "'", "}" * 9, "<a>" * 2000, "é <ü>"])
def test_broken_sources(text):
    assert J.parse_web("x.tsx", "p", text)["path"] == "x.tsx"


def test_project(spark):
    page = "export default async function Page() {\n  return <p/>;\n}\n"
    good = 'import { Suspense } from "react";\nexport const metadata = {};\nexport function generateStaticParams() { return []; }\n' + page
    rows = [("w/app/[id]/page.tsx", "w/app/[id]", page), ("w/app/b/[x]/page.tsx", "w/app/b/[x]", good), ("w/app/b/[x]/error.tsx", "w/app/b/[x]", None), ("w/app/b/[x]/loading.tsx", "w/app/b/[x]", ""), ("w/app/not-found.ts", "w/app", ""), ("w/a.d.ts", "w", page), (None, None, None)]
    files = spark.createDataFrame(rows, "path string, pkg string, text string")
    got = Counter((r["file"], r["category"].removeprefix("nextjs/")) for r in W.check_files(files).collect())
    at = "w/app/[id]"
    assert got == Counter([(f"{at}/page.tsx", "missing-metadata"), (f"{at}/page.tsx", "missing-generate-static-params"), (f"{at}/page.tsx", "missing-suspense"), (at, "missing-error-boundary"), (at, "missing-loading-ui"), ("w/app", "missing-global-error")])
    outside = spark.createDataFrame([("w/x/page.tsx", "w/x", page)], "path string, pkg string, text string")
    assert W.check_files(outside).count() == 0
    assert W.check_files(files.limit(0)).count() == 0


def test_next_routes(spark):
    files = spark.createDataFrame([("w/app/a/page.tsx",), ("w/app/a/error.tsx",), ("w/app/not-found.tsx",)], "path string")
    assert sorted((r["dir"], r["category"]) for r in W.next_routes(files).collect()) == [("w/app", "nextjs/missing-global-error"), ("w/app/a", "nextjs/missing-loading-ui")]
    known = spark.createDataFrame([("w/app/a/page.tsx", False), ("w/app/a/error.tsx", False)], "path string, async_page boolean")
    assert W.next_routes(known).count() == 0
