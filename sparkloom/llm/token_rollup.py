"""Token counts as delta-maintained rollups.

A change is an insert, a delete or a revised count of one document under one
tokenizer version. A batch of changes is reduced to signed sums by source, language
and tokenizer version (map-side first, so a hot source is no burden) and written as
one folder of the ledger. A batch counts once its folder is complete; committing its
name again changes nothing, and a folder that a lost driver left incomplete is
written anew. Totals are the sums over all complete batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches
from sparkloom.llm.piece_bpe import codec

DELTA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"
_KEY = ["source", "lang", "tokenizer"]

#: Tokenizer versions that SQL can count: the pattern of a token.
PATTERNS = {"words-1": "[^ \\t-\\r]+", "pieces-2": "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]"}


def counted(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a whole text under one of ``PATTERNS``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PATTERNS[tokenizer])).cast("long")


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add the documents of ``counts`` (``source, lang, tokenizer, n_tokens``)."""
    return counts.select(*_KEY, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Changes that take the documents of ``counts`` away again."""
    return counts.select(*_KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).cast("long").alias("d_tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Changes that replace ``old_tokens`` by ``n_tokens``; the key stays."""
    return counts.select(*_KEY, F.lit(0).cast("long").alias("d_docs"), (F.col("n_tokens") - F.col("old_tokens")).cast("long").alias("d_tokens"))


class TokenLedger:
    """Batches of signed sums under ``path``, a folder in any store that Spark reaches.

    Null sources, languages and tokenizers are keys like others. Null counts are
    zero. Repeated rows are changes of their own. One writer at a time per batch name
    is assumed; a name that is there is not written again, whatever the changes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch name has letters, digits, - and _")
        return f"{self.path}/batch-{batch}"

    def committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self._folder(batch)}/_SUCCESS")
        return fs.exists(p)

    def batches(self) -> list[str]:
        """Names of the complete batches."""
        fs, p = self._fs(f"{self.path}/batch-*/_SUCCESS")
        found = fs.globStatus(p) or []
        return sorted(x.getPath().getParent().getName().removeprefix("batch-") for x in found)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the signed sums of ``changes`` unless the batch is there; tell whether it was written."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*_KEY).agg(F.sum(F.coalesce("d_docs", F.lit(0))).alias("d_docs"), F.sum(F.coalesce("d_tokens", F.lit(0))).alias("d_tokens"))
        sums.where("d_docs <> 0 or d_tokens <> 0").coalesce(1).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` where not both are zero."""
        names = self.batches()
        rows = self.spark.read.schema(DELTA).parquet(*[self._folder(b) for b in names]) if names else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*_KEY).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def _counts(documents: DataFrame, n: Column, tokenizer: str, source_col: str, lang_col: str, keep: tuple[Column, ...]) -> DataFrame:
    return documents.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"), *keep)


def with_counts(documents: DataFrame, tokenizer: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``source, lang, tokenizer, n_tokens`` of every row and the columns ``keep``, counted by one of ``PATTERNS``."""
    return _counts(documents, counted(F.col(text_col), tokenizer), tokenizer, source_col, lang_col, keep)


def with_piece_counts(documents: DataFrame, model_file: str, tokenizer: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep: tuple[Column, ...] = ()) -> DataFrame:
    """The same with a sentencepiece model, begin and end ids left out."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for some in batches:
            texts = [t or "" for t in some]
            raw = c.encode_bytes(texts)
            c.check(texts, raw)
            yield pd.Series([len(x) // 4 - 2 for x in raw])

    return _counts(documents, run(F.col(text_col)), tokenizer, source_col, lang_col, keep)
