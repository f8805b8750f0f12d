from sparkloom.operators import brace_rules as B
from sparkloom.operators import design as D
from sparkloom.operators import entry_points as E
from sparkloom.sources import brace_source as S

GO = '''package store

import (
	"context"
	"crypto/md5"
)

type Saver interface {
	Put(x int) error
}

type Store struct {
	name, other string
	items map[string]int
	*Base
}

var once sync.Once

func (s *Store) GetName() string { return s.name }

func StoreNew(a, b bool, n int, x any, c, d string) (int, string, error) {
	if a && b || n > 1 {
		for i := 0; i < n; i++ {
			helper(i) // comment()
		}
		return 0, "", nil
	} else {
		panic("no")
	}
}

func Run(n int, ctx context.Context) (error, int) {
	fmt.Println("x")
	m := map[string]any{"a": 1, "b": 2, "c": 3}
	return nil, len(m)
}
'''

TS = '''import { a, b, c, d, e, f } from "lodash";
export interface IUser { name: string; extra: any; go(x: number): void }
export enum Color { Red }
export class Service {
  private url: string = "https://api.real.com";
  async load(id: string): Promise<User> { if (id) { console.log(id); } return this.fetch(id); }
}
export function run(x: any) { return document.getElementById(x); }
export const arrow = async (y: number): Promise<void> => { run(y); };
'''


def test_go(spark):
    row = S.parse_go("store/store.go", "app/store", GO)
    f = {x["name"]: x for x in row["functions"]}
    assert set(f) == {"GetName", "StoreNew", "Run"} and f["GetName"]["receiver"] == "Store"
    assert [p["type"] for p in f["StoreNew"]["params"]] == ["bool", "bool", "int", "any", "string", "string"] and f["StoreNew"]["results"] == ["int", "string", "error"]
    assert f["StoreNew"]["cyclomatic"] == 5
    assert {(t["name"], t["kind"]) for t in row["types"]} == {("Saver", "interface"), ("Store", "struct")}
    assert [x["name"] for t in row["types"] if t["name"] == "Store" for x in t["fields"]] == ["name", "other", "items", "*Base"]
    assert {c["dst"] for c in row["calls"]} == {"app/store.helper", "fmt.Println"}
    assert [(v["name"], v["type"]) for v in row["variables"]] == [("once", "sync.Once")]
    files = spark.createDataFrame([("store/store.go", "app/store", GO), ("n.go", "n", None)], "path string, pkg string, text string")
    rows = S.parsed(files, "go").cache()
    got = {r["category"] for r in B.check_go(rows).collect()}
    assert got == {
        "complexity/too-many-params", "complexity/too-many-returns", "complexity/bool-params", "style/context-first-param", "style/error-last-return", "style/empty-interface",
        "naming/stutter", "naming/interface", "naming/redundant-getter", "style/panic-in-library", "style/unnecessary-else", "style/untyped-map", "security/weak-crypto",
    }
    assert D.singletons(B.table(rows, "variables")).count() == 1


def test_typescript(spark):
    files = spark.createDataFrame([("src/a.ts", "src/a", TS)], "path string, pkg string, text string")
    rows = S.parsed(files, "typescript").cache()
    row = rows.first()
    assert {(f["name"], f["receiver"]) for f in row["functions"]} == {("load", "Service"), ("run", ""), ("arrow", "")}
    assert {(t["name"], t["kind"]) for t in row["types"]} == {("IUser", "interface"), ("Color", "enum"), ("Service", "class")}
    assert ("src/a.Service.load", "src/a.Service.fetch") in {(c["src"], c["dst"]) for c in row["calls"]}
    got = {r["category"] for r in B.check_typescript(rows).collect()}
    assert got == {"style/any-type", "style/missing-return-type", "naming/interface-prefix", "perf/barrel-import", "style/enum-usage", "style/hardcoded-url", "react/direct-dom", "style/console-log"}


def test_design(spark):
    methods = spark.createDataFrame([("T", "Put"), ("T", "Get"), ("U", "Put"), ("U", "Put")], "type string, method string")
    wanted = spark.createDataFrame([("Saver", "Put"), ("Both", "Put"), ("Both", "Get")], "iface string, method string")
    got = D.implementations(methods, wanted)
    assert sorted((r["type"], r["iface"]) for r in got.collect()) == [("T", "Both"), ("T", "Saver"), ("U", "Saver")]
    assert [r["iface"] for r in D.strategies(got).collect()] == ["Saver"]
    uses = spark.createDataFrame([("T", "a", "x"), ("T", "b", "x"), ("T", "c", "y"), ("T", "d", None), ("V", "a", "x")], "type string, method string, member string")
    assert {r["type"]: r["lcom4"] for r in D.lack_of_cohesion(uses).collect()} == {"T": 3, "V": 1}


def test_entry_points_and_shapes(spark):
    go = 'package main\nimport "github.com/go-chi/chi"\nfunc routes() {\n r.Get("/users", listUsers)\n r.Mount("/api", api)\n}\n'
    ts = 'class C {\n @Get("/x")\n list(): void { return one(1); }\n}\nfunction setup(app: any): void { app.post("/y", h); }\n'
    one = S.parsed(spark.createDataFrame([("m.go", "m", go)], "path string, pkg string, text string"), "go")
    assert sorted((r["handler"], r["route"]) for r in E.go_entry_points(one).collect()) == [("api", "GROUP /api"), ("listUsers", "GET /users")]
    two = S.parsed(spark.createDataFrame([("c.ts", "c", ts)], "path string, pkg string, text string"), "typescript")
    assert sorted((r["handler"], r["route"]) for r in E.ts_entry_points(two).collect()) == [("c.list", "GET /x"), ("c.setup", "POST /y")]
    copies = "package p\n" + "".join(f"func F{n}(a int) int {{ x := a + {n}; y := x * a; z := y - {n}; return g{n}(x, y, z, a) }}\n" for n in range(3))
    rows = B.table(S.parsed(spark.createDataFrame([("p.go", "p", copies)], "path string, pkg string, text string"), "go"), "functions").selectExpr("concat(pkg, '.', name) as fq", "shape", "size")
    assert sorted(r["member"] for r in E.duplicate_shapes(rows, 20).collect()) == ["p.F0", "p.F1", "p.F2"]
