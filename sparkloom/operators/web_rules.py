"""React and Next.js rules over ``sources.jsx_source``: findings of single files, and rules on routes and their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources import jsx_source

_FOLDER, _NAME = "^(?:(.*)/)?[^/]*$", "([^/]*)$"


def next_routes(files: DataFrame) -> DataFrame:
    """``dir, category``: route folders without an error or loading file, ``app`` folders without not-found or global-error file.

    ``files`` has ``path`` and, where it is known, ``async_page``: whether a page waits
    for something, without which it needs no loading file. Of ``app`` folders only the
    first that lacks a file is named.
    """
    waits = F.coalesce(F.col("async_page"), F.lit(False)) if "async_page" in files.columns else F.lit(True)
    rows = files.select(F.regexp_extract("path", _FOLDER, 1).alias("dir"), F.regexp_extract("path", _NAME, 1).alias("base"), waits.alias("waits")).where("path is not null")
    page = F.col("base").isin("page.tsx", "page.ts")
    dirs = rows.groupBy("dir").agg(F.collect_set("base").alias("bases"), F.max(page & F.col("waits")).alias("waits"))

    def has(*names: str) -> Column:
        return F.arrays_overlap("bases", F.array(*[F.lit(x) for x in names]))

    pages, apps = dirs.where(has("page.tsx", "page.ts")), dirs.where(F.col("dir").rlike("(^|/)app$"))
    out = [
        pages.where(~has("error.tsx", "error.ts")).select("dir", F.lit("nextjs/missing-error-boundary").alias("category")),
        pages.where(F.col("waits") & ~has("loading.tsx", "loading.ts")).select("dir", F.lit("nextjs/missing-loading-ui").alias("category")),
    ]
    alone = {
        "nextjs/missing-not-found": ("not-found.tsx", "not-found.ts", "global-not-found.tsx", "global-not-found.ts"),
        "nextjs/missing-global-error": ("global-error.tsx", "global-error.ts", "global-error.jsx", "global-error.js"),
    }
    for category, names in alone.items():
        out.append(apps.where(~has(*names)).agg(F.min("dir").alias("dir")).where("dir is not null").select("dir", F.lit(category).alias("category")))
    return reduce(DataFrame.union, out)


def check_web(rows: DataFrame) -> DataFrame:
    """``file, n, category`` of the React and Next.js rules; ``rows`` are those of ``jsx_source.parsed``.

    Next.js rules speak only in projects that import Next.js or have an ``app`` or
    ``pages`` folder. A route is named by its folder, with line 1.
    """
    name = F.regexp_extract("path", _NAME, 1)
    page, layout = name.isin("page.tsx", "page.ts"), name.isin("layout.tsx", "layout.ts")
    flags = rows.select(F.col("path").alias("file"), F.explode("flags").alias("x")).select("file", F.col("x.line").alias("n"), "x.category")
    whole = {
        "nextjs/missing-metadata": page & ~F.col("metadata"),
        "nextjs/missing-generate-static-params": page & F.col("pkg").contains("[") & F.col("pkg").contains("]") & ~F.col("static_params"),
        "nextjs/missing-suspense": (page | layout) & ~F.col("client") & F.col("async_export") & ~F.col("suspense"),
    }
    found = [rows.where(c).select(F.col("path").alias("file"), F.lit(1).alias("n"), F.lit(k).alias("category")) for k, c in whole.items()]
    found.append(next_routes(rows).select(F.col("dir").alias("file"), F.lit(1).alias("n"), "category"))
    is_next = F.col("category").startswith("nextjs/")
    used = rows.where(F.col("next_import") | F.concat("pkg", F.lit("/")).rlike("(app|pages)/")).select(F.lit(1).alias("_used")).limit(1)
    every = reduce(DataFrame.union, [flags.where(is_next), *found]).withColumn("_used", F.lit(1)).join(used, "_used", "left_semi").drop("_used")
    return flags.where(~is_next).union(every)


def check_files(files: DataFrame) -> DataFrame:
    """The rules over ``files`` (``path, pkg, text``); other sources than TypeScript and JSX are passed over."""
    return check_web(jsx_source.parsed(files.where(F.col("path").rlike("\\.(ts|tsx|jsx)$") & ~F.col("path").endswith(".d.ts"))))
