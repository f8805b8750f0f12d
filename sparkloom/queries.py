"""Registered queries of the core operators over whole tables, each with its SQL for DuckDB.

The driver's tables stand for the code model: parts are functions of packages
``brand/size``, a part calls the part on the next line of an order, and nations,
brands and users make small graphs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import scalars as S
from sparkloom.operators import file_rules as X
from sparkloom.operators import graph as G
from sparkloom.operators import line_rules as L
from sparkloom.operators import relational as R
from sparkloom.operators import score as C
from sparkloom.operators import sequence as Q
from sparkloom.plans.tables import materialize
from sparkloom.sources.lines import lines_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- bindings -----------------------------------------------------------------

_LINES = """lines as (select doc_id as file, unnest(range(1, 1 + len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from documents)"""
_PARTS = "parts as (select p_partkey, concat(p_brand, '/', p_size) as pkg, concat(p_brand, '/', p_size, '.P', p_partkey) as fq, p_type, p_name, p_retailprice from part)"
_CALLS = _PARTS + """, steps as (select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as b from lineitem),
    calls as (select distinct x.fq as src, y.fq as dst, x.pkg as src_pkg, y.pkg as dst_pkg from steps join parts x on a = x.p_partkey join parts y on b = y.p_partkey where a <> b),
    imports as (select distinct src_pkg as pkg, dst_pkg as imp from calls), packages as (select distinct pkg from parts)"""
_NATIONS = """trade as (select concat('n', s_nationkey) as src, concat('n', c_nationkey) as dst, count(*) as w
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
        where s_nationkey <> c_nationkey group by all),
    edges as (select src, dst from trade where w > 1.2 * (select avg(w) from trade))"""
_NODES = "nodes as (select src as node from edges union select dst from edges)"
_REACH = "reach as (select src as s, dst as t from edges union select s, dst from reach join edges on t = src)"
_BRANDS = """brands as (select p_brand as src, lead(p_brand) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem join part on p_partkey = l_partkey),
    edges as (select src, dst from brands where dst is not null and src <> dst)"""


#: Sources beside the driver's tables, which hold no code: one file or more for every rule that reads lines.
_CODE = [
    ("app/models.py", "from django.db import models\nclass A(models.Model):\n    b = models.ForeignKey(B)\n\nclass C(models.Model):\n    d = models.ForeignKey(D, on_delete=X)\n    class Meta:\n        pass\n    def __str__(self):\n        return 'c'\n\nfor x in xs:\n    y = A.objects.get(x)\nz = A.objects.all()\nw = A.objects.raw(f\"select {x}\")\n"),
    ("app/settings.py", "SECRET_KEY = 'abc'\nSECRET_KEY = os.environ['K']\n"), ("app/views.py", "SECRET_KEY = 'abc'\nassert x\nt = \"aB3kL9mN2pQr5tUv8wXy1zAcDeFgHiJoKsMqRuTw7Z4\"\n"),
    ("app/test_views.py", "password = 'hunter22'\nassert x == 86400\ndef test_a():\n    pass\ndef test_b():\n    assert y\n"),
    ("api/main.py", "from fastapi import FastAPI\n@app.get('/a')\nasync def a(x: dict):\n    time.sleep(1)\n@app.post('/b', response_model=B,\n  status_code=201)\ndef b(x): pass\n@app.put('/c')\ndef c(x): pass\napp.add(allow_origins=['*'])\n"),
    ("api/load.py", "x = eval(text)\ny = yaml.load(f)\nz = yaml.load(f, Loader=L)\nw = pickle.loads(b)\nif type(x) == int:\n    f = open(p)\nif y is 'a':\n    os.system(c)\n# TODO: later\ntry:\n    a()\nexcept E:\n    pass\n"),
    ("web/page.ts", "apiKey = \"abcdefghijkl\"\nel.innerHTML = x\ndb.query(`select ${x}`)\nk = process.env.NEXT_PUBLIC_SECRET_KEY\ntry { a() } catch (e) {}\n\t\t\t\t\t\t\tdeep()\n"),
    ("web/page.test.ts", "it('x', () => {\n})\ntest('y', () => {\n  render(z)\n})\n"), ("go/a_test.go", "func TestA(t *testing.T) {\n}\nn := 86400\n"), ("go/a.go", "if true {\nn := 86400\n}\n"),
]
_CODE_LINES = "code(file, text) as (values " + ", ".join("('" + f + "', '" + t.replace("'", "''") + "')" for f, t in _CODE) + "), code_lines as (select file, unnest(range(1, 1 + len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from code)"
#: The lines of documents and of the sources.
_ALL_LINES = _LINES + ", " + _CODE_LINES + ", all_lines as (select cast(file as varchar) as file, n, line from lines union all select * from code_lines)"


def code_lines(spark: SparkSession) -> DataFrame:
    return lines_of(spark.createDataFrame(_CODE, "file string, text string"), "file", "text")


def all_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("file", F.col("file").cast("string")).unionByName(code_lines(spark))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(_t(spark, d, "documents"), "doc_id", "text")


def parts(spark: SparkSession, d: str) -> DataFrame:
    pkg = F.concat("p_brand", F.lit("/"), "p_size")
    return _t(spark, d, "part").select("p_partkey", pkg.alias("pkg"), F.concat(pkg, F.lit(".P"), "p_partkey").alias("fq"), "p_type", "p_name", "p_retailprice")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """``a, b``: each part that another one follows on the next line of an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(by).alias("b")).where("a <> b")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``src, dst``; packages are looked up by the operators' own join."""
    p = parts(spark, d)
    rows = steps(spark, d).distinct().join(p.select(F.col("p_partkey").alias("a"), F.col("fq").alias("src")), "a").join(p.select(F.col("p_partkey").alias("b"), F.col("fq").alias("dst")), "b")
    return R.with_packages(rows.select("src", "dst"), p.select("fq", "pkg"))


def packages(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("pkg").distinct()


def imports(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select(F.col("src_pkg").alias("pkg"), F.col("dst_pkg").alias("imp")).distinct()


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every import of one package by another, as of ``imports``; no other row is left out."""
    p = parts(spark, d)
    rows = steps(spark, d).join(p.select(F.col("p_partkey").alias("a"), F.col("pkg").alias("src")), "a").join(p.select(F.col("p_partkey").alias("b"), F.col("pkg").alias("dst")), "b")
    return materialize(rows.where("src <> dst").select("src", "dst").distinct(), "imports")


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation where trade is well above the average; 25 nodes."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    rows = rows.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    trade = rows.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("w"))
    trade = materialize(trade.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), "w"), "trade")
    return trade.join(F.broadcast(trade.agg(F.avg("w").alias("m"))), F.col("w") > 1.2 * F.col("m")).select("src", "dst")


def brand_edges(spark: SparkSession, d: str) -> DataFrame:
    """One edge for each step from a brand to another within an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rows.withColumnRenamed("p_partkey", "l_partkey").select(F.col("p_brand").alias("src"), F.lead("p_brand").over(by).alias("dst")).where("src <> dst")


# --- scalars ------------------------------------------------------------------


@query("short_names", """select page_id, case when len(p) > 2 then array_to_string(p[-2:], '/') else url end as short, p[-1] as last
    from (select page_id, url, string_split(url, '/') as p from pages)""")
def short_names(spark, d):
    return _t(spark, d, "pages").select("page_id", S.short_name(F.col("url")).alias("short"), S.last_segment(F.col("url")).alias("last"))


@query("entropy", """with c as (select p_partkey, p_name, unnest(string_split(p_name, '')) as ch from part),
    k as (select p_partkey, p_name, ch, count(*) as n from c group by all)
    select p_partkey, round(sum(-(n / strlen(p_name)) * log2(n / strlen(p_name))), 6) as bits from k group by p_partkey""")
def entropy(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(S.entropy(F.col("p_name")), 6).alias("bits"))


@query("noisy_or", """select o_orderkey, round(1 - product(1 - l_discount), 6) as score,
    case when round(1 - product(1 - l_discount), 6) >= 0.8 then 'high' when round(1 - product(1 - l_discount), 6) >= 0.5 then 'medium' else 'low' end as label
    from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey""")
def noisy_or(spark, d):
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_discount").alias("s"))
    score = F.round(S.noisy_or(F.col("s")), 6)
    return rows.join(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", score.alias("score"), S.confidence_label(score).alias("label"))


@query("package_of", f"with {_PARTS} select fq, regexp_extract(fq, '^(.*)\\.[^.]*$', 1) as pkg, regexp_extract(fq, '[^.]*$') as name from parts")
def package_of(spark, d):
    return parts(spark, d).select("fq", S.package_of(F.col("fq")).alias("pkg"), S.last_segment(F.col("fq"), ".").alias("name"))


@query("path_filter", f"with {_PARTS} select distinct pkg from parts where pkg = 'Brand#1/7' or ends_with(pkg, '/3')")
def path_filter(spark, d):
    return packages(spark, d).where(S.matches_filter(F.col("pkg"), ["Brand#1/7", "/3"]))


@query("jaccard", """with s as (select l_orderkey, list_distinct(list(p_brand)) as b from lineitem join part on p_partkey = l_partkey group by all),
    x as (select l_orderkey, b, lead(b) over (order by l_orderkey) as c from s)
    select l_orderkey, round(len(list_intersect(b, c)) / len(list_distinct(list_concat(b, c))), 6) as similarity from x where c is not null""")
def jaccard(spark, d):
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("b"))
    # neighbours by a self-join on the rank within ranges instead of one global window
    ranked = materialize(rows.repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey").withColumn("part", F.spark_partition_id()), "jaccard")
    by = Window.partitionBy("part").orderBy("l_orderkey")
    inner = ranked.withColumn("c", F.lead("b").over(by))
    # one row per partition that has rows; the first row of each follows the last row of the one before
    heads = ranked.groupBy("part").agg(F.min(F.struct("l_orderkey", "b")).alias("h")).select(F.lag("part").over(Window.orderBy("part")).alias("part"), F.col("h.b").alias("hb"))
    return inner.join(heads, "part", "left").select("l_orderkey", "b", F.coalesce("c", "hb").alias("c")).where("c is not null").select("l_orderkey", F.round(S.jaccard(F.col("b"), F.col("c")), 6).alias("similarity"))


# --- lines --------------------------------------------------------------------


@query("line_rules", f"with {_ALL_LINES}, pages_lines as (select -1 - page_id as file, unnest(range(1, 1 + len(string_split(html, chr(10))))) as n, unnest(string_split(html, chr(10))) as line from pages), every as (select * from all_lines union all select cast(file as varchar), n, line from pages_lines) " + " union ".join(f"select file, cast(n as int) as n, '{r.category}' as category from every where {r.sql()}" for r in L.ALL))
def line_rules(spark, d):
    pages = lines_of(_t(spark, d, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html"), "page_id", "html")
    return L.scan(all_lines(spark, d).union(pages.withColumn("file", F.col("file").cast("string"))), L.ALL)


@query("file_rules")
def file_rules(spark, d):
    """Rules over several lines of documents and sources; tests hold them to known findings."""
    every = all_lines(spark, d)
    return reduce(DataFrame.union, [rule(every) for rule in (X.django_rules, X.fastapi_rules, X.empty_tests, X.tests_without_assertions, X.empty_except)])


_NO_TESTS = _CODE_LINES + ", f as (select split_part(file, '/', 1) as pkg, split_part(file, '/', -1) as base from code union all select source, concat('doc', doc_id) from documents where source is not null)"


@query("missing_tests", f"with {_NO_TESTS} select pkg, 'test/missing-tests' as category from f group by pkg having not bool_or(regexp_matches(base, '_test\\.go$|^test_|\\.test\\.|\\.spec\\.|_test\\.py'))")
def missing_tests(spark, d):
    own = spark.createDataFrame([(f.split("/")[0], f) for f, _ in _CODE], "pkg string, file string")
    return X.packages_without_tests(own.union(_t(spark, d, "documents").where("source is not null").select("source", F.concat(F.lit("doc"), "doc_id"))))


for _name, _least in (("high_entropy", 4.5), ("high_entropy_low_limit", 3.5)):

    @query(_name, f"""with {_ALL_LINES}, s as (select file, cast(n as int) as n, unnest(regexp_extract_all(line, '["'']([A-Za-z0-9+/=_-]{{40,}})["'']', 1)) as string from all_lines),
        c as (select *, unnest(string_split(string, '')) as ch, row_number() over () as r from s), k as (select file, n, string, r, ch, count(*) as m from c group by all)
        select file, n, string, round(sum(-(m / strlen(string)) * log2(m / strlen(string))), 6) as bits from k group by file, n, string, r having bits > {_least}""")
    def _high_entropy(spark, d, least=_least):
        return L.high_entropy_strings(all_lines(spark, d), least).select("file", "n", "string", F.round("bits", 6).alias("bits"))


@query("magic_numbers", f"""with {_LINES}, m as (select file, cast(n as int) as n, list_filter(regexp_extract_all(line, '\\b[0-9]{{3,}}\\b'), lambda x: x not in ({", ".join(repr(x) for x in L.ALLOWED_NUMBERS)})) as f
    from lines where not regexp_matches(line, '^[\\t\\n\\f\\r ]*(const|#|//|/\\*|\\*)') and not contains(line, '0x'))
    select file, n, f[1] as number from m where len(f) > 0""")
def magic_numbers(spark, d):
    return L.magic_numbers(lines(spark, d))


@query("deep_nesting", f"""with {_ALL_LINES}, i as (select file, n, regexp_extract(line, '^[\\t ]*') as w from all_lines where trim(replace(line, chr(9), ' ')) <> ''),
    x as (select file, n, len(replace(w, ' ', '')) + len(replace(w, chr(9), '')) // 4 as depth from i)
    select file, cast(arg_min(n, (-depth, n)) as int) as n, cast(max(depth) as int) as depth from x group by file having max(depth) > 0""")
def deep_nesting(spark, d):
    return L.deep_nesting(all_lines(spark, d), 0)


@query("next_line", f"with {_LINES} select file, cast(n as int) as n, lead(line) over (partition by file order by n) as next from lines")
def next_line(spark, d):
    return Q.with_next(lines(spark, d)).select("file", "n", "next")


@query("call_in_loop", f"""with {_LINES}, x as (select file, n, line, min(case when regexp_matches(line, '\\bof\\b') then n end) over (partition by file order by n rows between 1 following and 9 following) as hit from lines)
    select file, cast(n as int) as n, cast(hit as int) as "at" from x where regexp_matches(line, '^[A-Z][a-z]+[\\t\\n\\f\\r ]') and hit is not null""")
def call_in_loop(spark, d):
    return Q.call_in_loop(lines(spark, d), "\\bof\\b", "^[A-Z][a-z]+\\s")


@query("gathered_statements", f"""with {_LINES}, x as (select file, n, line, list(line) over (partition by file order by n rows between current row and 4 following) as s from lines),
    y as (select file, n, list_position(list_transform(s, lambda t: contains(t, ')')), true) as k, s from x where contains(line, ','))
    select file, cast(n as int) as n from y where not contains(array_to_string(s[1:coalesce(nullif(k, 0), 5)], chr(10)), 'the')""")
def gathered_statements(spark, d):
    return Q.gathered(lines(spark, d), ",", "the")


@query("brace_depth", f"""with {_LINES} select file, cast(n as int) as n, cast(sum(len(regexp_replace(line, '[^(]', '', 'g')) - len(regexp_replace(line, '[^)]', '', 'g'))) over (partition by file order by n) as bigint) as depth from lines""")
def brace_depth(spark, d):
    return Q.brace_depth(lines(spark, d), "(", ")")


@query("blocks_lacking", f"""with {_LINES}, x as (select file, n, line, max(case when regexp_matches(line, '^[^\\t\\n\\f\\r ]') then n end) over (partition by file order by n) as block from lines)
    select file, cast(block as int) as n from x group by file, block having bool_or(n = block and regexp_matches(line, '^[A-Z]')) and not bool_or(contains(line, 'and'))""")
def blocks_lacking(spark, d):
    return Q.blocks_lacking(lines(spark, d), "^[A-Z]", "and")


@query("finding_summary", f"""with {_ALL_LINES}, f as ({" union ".join(f"select file, n, '{r.category}' as category from all_lines where {r.sql()}" for r in L.ALL)})
    select category, cast(0.3 as double) as confidence, 'low' as label, count(*) as n, count(distinct file) as files from f group by category""")
def finding_summary(spark, d):
    return C.summary(L.scan(all_lines(spark, d), L.ALL))


# --- relations ----------------------------------------------------------------


@query("pkg_metrics", f"""with {_CALLS}, i as (select * from imports where pkg <> imp), a as (select imp as pkg, count(*) as ca from i group by 1), e as (select pkg, count(*) as ce from i group by 1),
    t as (select pkg, count(*) filter (where starts_with(p_name, 'red')) / count(*) as a from parts group by pkg),
    x as (select pkg, coalesce(ca, 0) as ca, coalesce(ce, 0) as ce, a from packages left join a using (pkg) left join e using (pkg) left join t using (pkg)),
    y as (select *, case when ca + ce = 0 then 0 else ce / (ca + ce) end as i from x)
    select pkg, ca, ce, floor(i * 100 + 0.5) / 100 as instability, floor(a * 100 + 0.5) / 100 as abstractness, floor(abs(a + i - 1) * 100 + 0.5) / 100 as distance from y""")
def pkg_metrics(spark, d):
    types = parts(spark, d).select("pkg", F.when(F.col("p_name").startswith("red"), "interface").otherwise("struct").alias("kind"), F.array("p_name").alias("methods"))
    return R.coupling(imports(spark, d), packages(spark, d), types)


@query("feature_envy", f"""with {_CALLS}, k as (select src, src_pkg, dst_pkg, count(*) as n from calls group by all),
    o as (select src, src_pkg, coalesce(max(n) filter (where src_pkg = dst_pkg), 0) as own_calls from k group by all),
    f as (select src, dst_pkg, n, row_number() over (partition by src order by n desc, dst_pkg) as r from k where src_pkg <> dst_pkg)
    select src, src_pkg as own_pkg, dst_pkg as envied, n as foreign_calls, own_calls from o join f using (src) where r = 1 and n >= 2 and n > own_calls""")
def feature_envy(spark, d):
    return R.feature_envy(calls(spark, d), 2)


@query("shotgun_surgery", f"with {_CALLS} select dst, count(*) as n_callers, count(distinct src_pkg) as n_packages from calls group by dst having count(*) > 5 and count(distinct src_pkg) >= 3")
def shotgun_surgery(spark, d):
    return R.shotgun_surgery(calls(spark, d))


@query("middle_man", """with e as (select event_id, user_id, event_type from events), x as (select distinct concat(event_type, '.U', user_id) as src, concat(event_type, '.E', event_type) as dst, event_type as src_pkg, concat(event_type, '2') as dst_pkg from e),
    y as (select distinct concat('root.R', event_id % 3), concat(event_type, '.U', user_id), 'root', event_type from e), calls as (select * from x union all select * from y),
    o as (select src as fq, min(dst) as callee from calls group by src having count(*) = 1), i as (select dst as fq, count(*) as n_callers from calls group by dst having count(*) >= 2)
    select fq, callee, n_callers from o join i using (fq)""")
def middle_man(spark, d):
    e = _t(spark, d, "events")
    user = F.concat("event_type", F.lit(".U"), "user_id")
    down = e.select(user.alias("src"), F.concat("event_type", F.lit(".E"), "event_type").alias("dst"), F.col("event_type").alias("src_pkg"), F.concat("event_type", F.lit("2")).alias("dst_pkg")).distinct()
    up = e.select(F.concat(F.lit("root.R"), F.col("event_id") % 3).alias("src"), user.alias("dst"), F.lit("root").alias("src_pkg"), F.col("event_type").alias("dst_pkg")).distinct()
    return R.middle_man(down.union(up))


@query("god_packages", f"""with {_CALLS}, a as (select dst_pkg as pkg, count(distinct src_pkg) as ca from calls where src_pkg <> dst_pkg group by 1), e as (select pkg, count(*) as ce from imports group by 1),
    t as (select pkg, count(*) filter (where starts_with(p_name, 'red')) / count(*) as abstractness from parts group by pkg)
    select pkg, ca, ce, abstractness from a join e using (pkg) join t using (pkg) where ca >= 5 and ce >= 5 and abstractness < 0.2""")
def god_packages(spark, d):
    types = parts(spark, d).select("pkg", F.when(F.col("p_name").startswith("red"), "interface").otherwise("struct").alias("kind"))
    return R.god_packages(calls(spark, d), imports(spark, d), packages(spark, d), types)


@query("dead_exports", "select concat('main.Doc', doc_id) as fq from documents where doc_id not in (select doc_id from labels)")
def dead_exports(spark, d):
    """Documents stand for exported functions, labels for calls of them."""
    used = _t(spark, d, "labels").select(F.lit("main").alias("src"), F.concat(F.lit("main.Doc"), "doc_id").alias("dst"))
    return R.dead_exports(_t(spark, d, "documents").select(F.concat(F.lit("main.Doc"), "doc_id").alias("fq")), used)


@query("shared_items", """with m as (select distinct l_orderkey as id, l_partkey as item from lineitem)
    select x.id as a, y.id as b, cast(list_sort(list(x.item)) as varchar) as shared from m x join m y on x.item = y.item and x.id < y.id group by all having count(*) >= 2""".replace("group by all", "group by x.id, y.id"))
def shared_items(spark, d):
    members = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item")).distinct()
    return R.shared_items(members, 2).select("a", "b", F.concat(F.lit("["), F.array_join(F.col("shared").cast("array<string>"), ", "), F.lit("]")).alias("shared"))


@query("duplicated_sets", """with s as (select o_custkey as id, list_sort(list_distinct(list(o_orderpriority))) as items from orders group by 1),
    k as (select id, substr(sha256(array_to_string(items, ',')), 1, 16) as digest from s where len(items) >= 3)
    select digest, min(id) over (partition by digest) as representative, id as member, count(*) over (partition by digest) as n from k qualify n > 1""")
def duplicated_sets(spark, d):
    return R.duplicated_sets(_t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("item")))


_LAYERS = [("core", ["Brand#1"]), ("service", ["Brand#2"]), ("edge", ["#25", "#7/"])]
_ALLOWED = {"edge": ["service"], "service": ["core"], "core": []}


@query("layer_violations", f"""with {_CALLS}, l as (select pkg, case when contains(pkg, '#7/') or contains(pkg, '#25') then 'edge' when contains(pkg, 'Brand#2') then 'service' when contains(pkg, 'Brand#1') then 'core' end as layer from packages)
    select i.pkg, i.imp, a.layer as from_layer, b.layer as to_layer from imports i join l a on i.pkg = a.pkg join l b on i.imp = b.pkg
    where a.layer is not null and b.layer is not null and a.layer <> b.layer and not (a.layer = 'edge' and b.layer = 'service') and not (a.layer = 'service' and b.layer = 'core')""")
def layer_violations(spark, d):
    return R.layer_violations(imports(spark, d), R.package_layers(packages(spark, d), _LAYERS), _ALLOWED)


_ROLES = _CALLS + """, im as (select * from imports where pkg <> imp and ends_with(imp, '/7') union all select distinct pkg, concat('lib.', p_type) from parts where starts_with(p_name, 'small')),
    f as (select pkg, bool_or(imp in (select pkg from packages)) as inner_, bool_or(imp not in (select pkg from packages) and contains(imp, '.')) as outer_ from im group by pkg),
    roles as (select p.pkg, case when exists (select 1 from parts q where q.pkg = p.pkg and p_name = 'red ring') then 'root' when coalesce(outer_, false) then 'bridge'
        when not coalesce(inner_, false) and (exists (select 1 from parts q where q.pkg = p.pkg and starts_with(p_name, 'blue')) or p.pkg in (select imp from im)) then 'leaf'
        when inner_ then 'orchestrator' else 'unknown' end as role from packages p left join f using (pkg))"""


def _role_tables(spark, d):
    p = parts(spark, d)
    outside = p.where("startswith(p_name, 'small')").select("pkg", F.concat(F.lit("lib."), "p_type").alias("imp")).distinct()
    im = imports(spark, d).where(F.col("imp").endswith("/7") & (F.col("pkg") != F.col("imp"))).union(outside)
    return im, R.package_roles(packages(spark, d), im, p.where("p_name = 'red ring'"), p.where("startswith(p_name, 'blue')"))


@query("package_roles", f"with {_ROLES} select pkg, role from roles")
def package_roles(spark, d):
    return _role_tables(spark, d)[1]


@query("role_violations", f"""with {_ROLES} select distinct i.pkg, i.imp, a.role as from_role, b.role as to_role from im i join roles a on i.pkg = a.pkg join roles b on i.imp = b.pkg
    where concat(a.role, '>', b.role) in ('leaf>bridge', 'leaf>orchestrator', 'orchestrator>root')""")
def role_violations(spark, d):
    return R.role_violations(*_role_tables(spark, d))


@query("boundaries", """with u as (select concat(p_type, '/', p_name) as module, p_brand as pkg from part),
    k as (select module, pkg, case when module = 'ECONOMY/small ring' or starts_with(module, 'ECONOMY/small ring/') then 'queue' when starts_with(module, 'PROMO/') then 'db' when starts_with(module, 'SMALL/') then 'cache' end as kind from u)
    select module, kind, min(pkg) as pkg from k where kind is not null group by module, kind""")
def boundaries(spark, d):
    uses = _t(spark, d, "part").select(F.concat("p_type", F.lit("/"), "p_name").alias("module"), F.col("p_brand").alias("pkg"))
    return R.boundaries(uses, [("ECONOMY/small ring", "queue"), ("PROMO", "db"), ("SMALL", "cache")])


@query("verb_consistency", """with c as (select p_type as role, string_split(p_name, ' ')[1] as verb, count(*) as n from part group by all), t as (select role, sum(n) as total, arg_min(verb, (-n, verb)) as dominant, max(n) as top from c group by role)
    select role, verb, n, dominant from c join t using (role) where total >= 5 and top / total >= 0.1 and verb <> dominant and n >= 2""")
def verb_consistency(spark, d):
    return R.verb_consistency(_t(spark, d, "part").select(F.col("p_type").alias("role"), F.substring_index("p_name", " ", 1).alias("verb")), 5, 0.1)


@query("outliers", "with c as (select l_partkey, count(*) as n from lineitem group by 1) select l_partkey, n from c where n > (select avg(n) + 2 * stddev_pop(n) from c)")
def outliers(spark, d):
    return R.outliers(_t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "n")


# --- graphs -------------------------------------------------------------------


def _pagerank_sql(edges: str, rounds: int) -> str:
    out = f"with {edges}, {_NODES}, w as (select src, dst, count(*) / sum(count(*)) over (partition by src) as p from edges group by src, dst), c as (select count(*) as n from nodes), r0 as (select node, 1.0 / n as rank from nodes, c)"
    for k in range(1, rounds + 1):
        out += f", r{k} as materialized (select node, 0.15 / n + 0.85 * coalesce(s, 0) as rank from nodes cross join c left join (select dst as node, sum(rank * p) as s from w join r{k - 1} on src = node group by dst) using (node))"
    return out


@query("pagerank", _pagerank_sql(_BRANDS, 20) + " select node, round(rank, 8) as rank from r20")
def pagerank(spark, d):
    return G.pagerank(brand_edges(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query("blast_radius", f"with recursive {_NATIONS}, {_NODES}, {_REACH} select node, count(s) as blast from nodes left join reach on t = node and s <> node group by node")
def blast_radius(spark, d):
    return G.blast_radius(nation_edges(spark, d))


@query("hotspots", _pagerank_sql(_NATIONS, 30).replace("with ", "with recursive ", 1) + f""", {_REACH}, b as (select node, count(s) as blast from nodes left join reach on t = node and s <> node group by node)
    select node, round(rank, 4) as rank, blast from r30 join b using (node) where rank >= 0.001 or blast >= 3 order by round(rank, 4) desc, node limit 20""")
def hotspots(spark, d):
    return G.hotspots(nation_edges(spark, d))


_SCC = f"{_REACH}, comps as (select node, least(node, coalesce(min(a.t), node)) as component from nodes left join reach a on a.s = node and exists (select 1 from reach b where b.s = a.t and b.t = node) group by node)"


@query("strong_components", f"with recursive {_NATIONS}, {_NODES}, {_SCC} select node, component from comps")
def strong_components(spark, d):
    return G.strong_components(nation_edges(spark, d))


@query("clusters", f"""with recursive {_NATIONS}, {_NODES}, {_SCC}, inner_ as (select a.component, src, count(*) as k, min(dst) as dst from edges join comps a on src = a.node join comps b on dst = b.node where a.component = b.component group by all),
    cut as (select component, arg_min(concat(src, ' → ', dst), (-k, src)) as cut from inner_ group by component)
    select component, count(*) as size, list_sort(list(node)) as nodes, any_value(cut) as cut from comps join cut using (component) group by component having count(*) >= 2 order by size desc, component limit 10""")
def clusters(spark, d):
    edges = nation_edges(spark, d)
    return G.clusters(edges, G.strong_components(edges))


_LAYER_SQL = f"""{_SCC}, links as (select distinct a.component as c, b.component as d from edges join comps a on src = a.node join comps b on dst = b.node where a.component <> b.component),
    walk as (select distinct component as d, 0 as depth from comps union select links.d, depth + 1 from walk join links on walk.d = links.c),
    levels as (select node, cast(max(depth) as int) as depth_from_roots from comps join walk on component = walk.d group by node)"""


@query("layers", f"with recursive {_NATIONS}, {_NODES}, {_LAYER_SQL} select node, depth_from_roots from levels")
def layers(spark, d):
    edges = nation_edges(spark, d)
    return G.layers(edges, G.strong_components(edges))


@query("layer_skips", f"with recursive {_NATIONS}, {_NODES}, {_LAYER_SQL} select src, dst, b.depth_from_roots - a.depth_from_roots as skipped from edges join levels a on src = a.node join levels b on dst = b.node where b.depth_from_roots - a.depth_from_roots > 1")
def layer_skips(spark, d):
    edges = nation_edges(spark, d)
    return G.layer_skips(edges, G.layers(edges, G.strong_components(edges)))


@query("henry_kafura", f"""with {_CALLS}, i as (select dst as node, count(*) as fan_in from calls group by 1), o as (select src as node, count(*) as fan_out from calls group by 1),
    x as (select fq as node, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out from parts left join i on i.node = fq left join o on o.node = fq)
    select node, fan_in, fan_out, 10.0 * pow(fan_in * fan_out, 2) as flow from x where 10.0 * pow(fan_in * fan_out, 2) > 1000 order by flow desc, node limit 20""")
def henry_kafura(spark, d):
    return G.henry_kafura(calls(spark, d), parts(spark, d).select(F.col("fq").alias("node"), F.lit(0).alias("length")))


@query("dependency_matrix", f"with {_BRANDS} select src, dst, count(*) as n from edges group by all")
def dependency_matrix(spark, d):
    return G.dependency_cells(brand_edges(spark, d))


@query("matrix_order", f"with recursive {_NATIONS}, {_NODES}, {_LAYER_SQL} select node, row_number() over (order by depth_from_roots, node) - 1 as position from levels")
def matrix_order(spark, d):
    edges = nation_edges(spark, d)
    return G.matrix_order(edges, G.layers(edges, G.strong_components(edges)))


@query("betweenness", f"""with recursive {_NATIONS}, {_NODES},
    walk as (select src as s, dst as t, 1 as depth, count(*) as k, [src, dst] as seen from edges group by src, dst
        union all select s, dst, depth + 1, k, list_append(seen, dst) from walk join edges on t = src where depth < 4 and not list_contains(seen, dst)),
    d as (select s, t, min(depth) as depth from walk group by s, t), sg as (select w.s, w.t, d.depth, sum(k) as sigma from walk w join d on w.s = d.s and w.t = d.t and w.depth = d.depth group by all),
    b as (select x.t as node, sum(x.sigma * y.sigma / z.sigma) as score from sg x join sg y on x.t = y.s join sg z on z.s = x.s and z.t = y.t and z.depth = x.depth + y.depth group by x.t)
    select node, round(coalesce(score, 0), 6) as score from nodes left join b using (node)""")
def betweenness(spark, d):
    return G.betweenness(nation_edges(spark, d)).select("node", F.round("score", 6).alias("score"))


@query("communities")
def communities(spark, d):
    return G.communities(nation_edges(spark, d)).select("node", "community")


@query("modularity", f"""with {_NATIONS}, both_ as (select src, dst from edges union all select dst, src from edges), k as (select src as node, count(*) as k from both_ group by 1), m as (select count(*) as m2 from both_),
    h as (select k.node, k, n_regionkey as c from k join nation on concat('n', n_nationkey) = k.node)
    select round(sum((1 - a.k * b.k / m2) / m2), 8) as q from both_ join h a on src = a.node join h b on dst = b.node cross join m where a.c = b.c""")
def modularity(spark, d):
    homes = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return G.modularity(nation_edges(spark, d), homes).select(F.round("q", 8).alias("q"))


@query("misplaced", """with m as (select concat('s', s_suppkey) as node, s_nationkey % 5 as community, concat('p', s_nationkey % 2) as pkg from supplier), k as (select community, pkg, count(*) as here from m group by all),
    t as (select community, arg_min(pkg, (-here, pkg)) as suggested, max(here) as there from k group by community)
    select node, pkg, suggested, here, there from m join k using (community, pkg) join t using (community) where pkg <> suggested and there > here and there >= 3""")
def misplaced(spark, d):
    s = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("community"), F.concat(F.lit("p"), F.col("s_nationkey") % 2).alias("pkg"))
    return G.misplaced(s.select("node", "community"), s.select("node", "pkg"))


@query("import_cycles")
def import_cycles(spark, d):
    edges = nation_edges(spark, d)
    return G.import_cycles(edges, G.strong_components(edges))


_ENDS = "starts as (select concat('n', n_nationkey) as start from nation where n_regionkey = 0), sinks as (select concat('n', n_nationkey) as node from nation where n_regionkey = 3)"


# the SQL lists walks, so it ends at 5 nodes; a sink that is farther away would show as a difference
@query("trace", f"""with recursive {_NATIONS}, {_ENDS}, walk as (select start, start as node, [start] as chain from starts
        union all select start, dst, list_append(chain, dst) from walk join edges on node = src where len(chain) < 10 and not list_contains(chain, dst) and (len(chain) = 1 or node not in (select node from sinks)) and len(chain) < 5),
    best as (select start, node, chain, row_number() over (partition by start, node order by len(chain), chain) as r from walk where len(chain) > 1 and node in (select node from sinks))
    select start, node as sink, chain from best where r = 1""")
def trace(spark, d):
    n = _t(spark, d, "nation").withColumn("node", F.concat(F.lit("n"), "n_nationkey"))
    return G.trace(nation_edges(spark, d), n.where("n_regionkey = 0").select(F.col("node").alias("start")), n.where("n_regionkey = 3"), 10)


@query("focus", f"""with recursive {_NATIONS}, both_ as (select src, dst from edges union select dst, src from edges),
    walk as (select 'n7' as node, 0 as depth where exists (select 1 from both_ where src = 'n7') union select dst, depth + 1 from walk join both_ on node = src where depth < 2)
    select node, cast(min(depth) as int) as depth from walk group by node""")
def focus(spark, d):
    return G.focus(nation_edges(spark, d), "n7", 2)


# The same operators on the whole import graph, where recursive SQL is too slow; tests hold them to brute force.
# Packages of Brand#1 stand for entry points and those of Brand#25 for sinks; a brand is a community.


def _brand(e: DataFrame, brand: str) -> DataFrame:
    return G.nodes_of(e).where(F.col("node").startswith(f"{brand}/"))


_ON_IMPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "blast_radius": G.blast_radius,
    "hotspots": G.hotspots,
    "strong_components": G.strong_components,
    "clusters": lambda e: G.clusters(e, G.strong_components(e)),
    "layers": lambda e: G.layers(e, G.strong_components(e)),
    "layer_skips": lambda e: G.layer_skips(e, G.layers(e, G.strong_components(e))),
    "matrix_order": lambda e: G.matrix_order(e, G.layers(e, G.strong_components(e))),
    "betweenness": lambda e: G.betweenness(e).select("node", F.round("score", 6).alias("score")),
    "communities": lambda e: G.communities(e).select("node", "community"),
    "modularity": lambda e: G.modularity(e, G.nodes_of(e).withColumn("community", F.substring_index("node", "/", 1))).select(F.round("q", 8).alias("q")),
    "import_cycles": lambda e: G.import_cycles(e, G.strong_components(e)),
    "trace": lambda e: G.trace(e, _brand(e, "Brand#1").select(F.col("node").alias("start")), _brand(e, "Brand#25")),
    "focus": lambda e: G.focus(e, "Brand#1/7", 2),
}
for _name, _run in _ON_IMPORTS.items():

    @query(f"{_name}_imports")
    def _on_imports(spark, d, run=_run):
        return run(import_edges(spark, d))


# --- design -------------------------------------------------------------------

from sparkloom.operators import design as D  # noqa: E402


@query("implementations", """with m as (select distinct o_custkey as type, o_orderpriority as method from orders), w as (select distinct concat('seg-', c_mktsegment) as iface, o_orderpriority as method from orders join customer on o_custkey = c_custkey where o_orderpriority < '4'),
    s as (select iface, count(*) as size from w group by 1)
    select cast(m.type as varchar) as type, w.iface from m join w using (method) join s on s.iface = w.iface group by m.type, w.iface, s.size having count(*) = s.size""")
def implementations(spark, d):
    o = _t(spark, d, "orders")
    methods = o.select(F.col("o_custkey").cast("string").alias("type"), F.col("o_orderpriority").alias("method"))
    seg = o.where("o_orderpriority < '4'").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("seg-"), "c_mktsegment").alias("iface"), F.col("o_orderpriority").alias("method"))
    return D.implementations(methods, seg)


@query("strategies", """with m as (select distinct p_type as type, p_brand as method from part), w as (select distinct concat('if-', p_size) as iface, p_brand as method from part where p_size > 45),
    s as (select iface, count(*) as size from w group by 1), i as (select m.type, w.iface from m join w using (method) join s on s.iface = w.iface group by m.type, w.iface, s.size having count(*) = s.size)
    select iface, count(*) as n, list_sort(list(type)) as types from i group by iface having count(*) >= 2""")
def strategies(spark, d):
    p = _t(spark, d, "part")
    wanted = p.where("p_size > 45").select(F.concat(F.lit("if-"), "p_size").alias("iface"), F.col("p_brand").alias("method"))
    return D.strategies(D.implementations(p.select(F.col("p_type").alias("type"), F.col("p_brand").alias("method")), wanted))


@query("lack_of_cohesion", """with recursive u as (select distinct l_orderkey as t, l_linenumber as m, l_suppkey % 10 as f from lineitem), e as (select distinct a.t, a.m as x, b.m as y from u a join u b on a.t = b.t and a.f = b.f),
    r as (select t, x, y from e union select r.t, r.x, e.y from r join e on r.t = e.t and r.y = e.x), c as (select t, x, min(y) as root from r group by t, x)
    select t as type, count(distinct root) as lcom4 from c group by t""")
def lack_of_cohesion(spark, d):
    uses = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("type"), F.col("l_linenumber").alias("method"), (F.col("l_suppkey") % 10).alias("member")).distinct()
    return D.lack_of_cohesion(uses)


@query("god_types", "select concat(p_brand, '/', p_type) as type, count(*) as n from part group by 1 having count(*) > 15")
def god_types(spark, d):
    return D.god_types(_t(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("type")))


@query("error_styles", """with c as (select user_id as pkg, event_type as style, count(*) as n from events group by all), t as (select pkg, arg_min(style, (-n, style)) as style, max(n) as n from c group by pkg),
    g as (select style, sum(n) as n from t group by style), u as (select arg_min(style, (-n, style)) as usual from g)
    select pkg, style, usual from t cross join u where style <> usual and (select count(*) from t) >= 2""")
def error_styles(spark, d):
    return D.error_styles(_t(spark, d, "events").select(F.col("user_id").alias("pkg"), F.col("event_type").alias("style")))


@query("builders", """with m as (select p_brand as type, case when p_size > 20 then p_brand else p_type end as result from part)
    select type, count(*) filter (where result = type) as chainable, count(*) as n from m group by type having count(*) filter (where result = type) >= 3 and count(*) filter (where result = type) / count(*) >= 0.5""")
def builders(spark, d):
    return D.builders(_t(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("method"), F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(F.col("p_type")).alias("result")))
