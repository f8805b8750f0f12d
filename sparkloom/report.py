"""The whole analysis: options, thresholds, sections of a report, sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scalars import matches_filter
from sparkloom.operators import entry_points, file_rules, graph, line_rules, python_rules, relational, score
from sparkloom.sources.config import Config
from sparkloom.sources.lines import lines_of
from sparkloom.sources.python_source import Model


@dataclass(frozen=True)
class Options:
    """``focus``: a function around which structure is cut out; ``format``: compact or json."""

    packages: list[str] = field(default_factory=list)
    focus: str = ""
    depth: int = 3
    format: str = "compact"
    rules_only: bool = False
    structure_only: bool = False
    config: Config = Config()

    def __post_init__(self) -> None:
        if self.format not in ("compact", "json"):
            raise ValueError(f"unknown format {self.format!r}")


def analyze(model: Model, options: Options = Options()) -> dict[str, DataFrame]:
    """Lazy sections of the report."""
    t, out = options.config.thresholds, {}
    calls = relational.with_packages(model.calls, model.functions.select("fq", "pkg"))
    edges, packages, imports = model.calls, model.packages, model.imports.select("pkg", "imp")
    if not options.rules_only:
        structure = model.functions.select("fq", "pkg", "signature", "line")
        if options.packages:
            structure = structure.where(matches_filter(F.col("pkg"), options.packages))
        if options.focus:
            around = graph.focus(edges, options.focus, options.depth).select(F.col("node").alias("fq"))
            structure = structure.join(around, "fq", "left_semi")
        out["structure"] = structure
    if options.structure_only:
        return out
    lines = lines_of(model.files, "path", "text")
    python = [python_rules.check(model, t), line_rules.scan(lines, line_rules.SECURITY + line_rules.QUALITY + line_rules.PYTHON), file_rules.empty_tests(lines), file_rules.tests_without_assertions(lines), file_rules.empty_except(lines)]
    python += [file_rules.of_framework(found, imports, name) for name, found in (("django", line_rules.scan(lines, line_rules.DJANGO)), ("django", file_rules.django_rules(lines)), ("fastapi", line_rules.scan(lines, line_rules.FASTAPI)), ("fastapi", file_rules.fastapi_rules(lines)))]
    python += [line_rules.magic_numbers(lines).withColumn("category", F.lit("quality/magic-number")), line_rules.deep_nesting(lines).withColumn("category", F.lit("quality/deep-nesting")), line_rules.high_entropy_strings(lines).withColumn("category", F.lit("security/hardcoded-secret"))]
    findings = reduce(DataFrame.union, [x.select("file", "n", "category") for x in python])
    if options.packages:
        files = model.rows.where(matches_filter(F.col("module"), options.packages)).select(F.col("path").alias("file"))
        findings = findings.join(files, "file", "left_semi")
    out["findings"] = score.scored(findings)
    out["metrics"] = relational.coupling(imports, packages, model.types)
    out["feature_envy"] = relational.feature_envy(calls)
    out["shotgun_surgery"] = relational.shotgun_surgery(calls)
    out["middle_man"] = relational.middle_man(calls)
    out["missing_tests"] = file_rules.packages_without_tests(model.rows.select(F.col("module").alias("pkg"), F.col("path").alias("file")))
    out["god_packages"] = relational.god_packages(calls, imports, packages, model.types)
    out["dead_exports"] = relational.dead_exports(model.functions.where(~F.col("name").startswith("_")).select("fq"), edges)
    homes = graph.communities(edges).select("node", "community")
    out["communities"] = homes
    out["modularity"] = graph.modularity(edges, homes)
    out["misplaced"] = graph.misplaced(homes, model.functions.select(F.col("fq").alias("node"), "pkg"))
    out["duplicates"] = relational.duplicated_sets(edges.select(F.col("src").alias("id"), F.col("dst").alias("item")), t.dup_callgraph_min_calls)
    out["entry_points"] = python_rules.entry_points(model)
    out["boundaries"] = relational.boundaries(imports.select(F.col("imp").alias("module"), "pkg"), entry_points.rules_of(entry_points.PYTHON_BOUNDARIES), ".")
    if options.config.layers:
        out["layer_violations"] = relational.layer_violations(imports, relational.package_layers(packages, options.config.layers), options.config.allowed)
    out["hotspots"] = graph.hotspots(edges)
    comps = graph.strong_components(edges)
    out["clusters"] = graph.clusters(edges, comps)
    levels = graph.layers(edges, comps)
    out["layers"], out["layer_skips"] = levels, graph.layer_skips(edges, levels)
    out["bottlenecks"] = relational.outliers(graph.betweenness(edges), "score").orderBy(F.desc("score"), "node").limit(15)
    internal = imports.join(packages.select(F.col("pkg").alias("imp")), "imp", "left_semi").select(F.col("pkg").alias("src"), F.col("imp").alias("dst"))
    out["cycles"] = graph.import_cycles(internal, graph.strong_components(internal))
    out["matrix"] = graph.dependency_cells(internal)
    out["summary"] = summary(model, out)
    return out


def summary(model: Model, sections: dict[str, DataFrame]) -> DataFrame:
    """One row of totals."""
    counts = [model.packages.agg(F.count(F.lit(1)).alias("packages")), model.functions.agg(F.count(F.lit(1)).alias("functions")), model.types.agg(F.count(F.lit(1)).alias("types"))]
    counts += [sections[name].agg(F.count(F.lit(1)).alias(name)) for name in ("findings", "duplicates", "cycles")]
    rows = [c.withColumn("_one", F.lit(1)) for c in counts]
    return reduce(lambda a, b: a.join(b, "_one"), rows).drop("_one")


def to_json(sections: dict[str, DataFrame]) -> str:
    """All sections as one JSON text. For results of report size."""
    return json.dumps({name: [json.loads(x) for x in df.toJSON().collect()] for name, df in sections.items()}, indent=2, ensure_ascii=False)


def to_text(sections: dict[str, DataFrame], rows: int = 50) -> str:
    """Non-empty sections as text; the summary always. ``rows`` of each section are shown."""
    out = []
    for name, df in sections.items():
        got = df.limit(rows + 1).collect()
        if got or name == "summary":
            out.append(f"## {name}")
            out += ["  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in got[:rows]]
            if len(got) > rows:
                out.append("  …")
    return "\n".join(out) + "\n"
