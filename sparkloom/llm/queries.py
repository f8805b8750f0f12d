"""Thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.piece_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.exact_dedup import exact_dedup

    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.language_id import identify, train

    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents))


#: Production weights of the labelled domains.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sparkloom.llm.mixing import label_domain

    return table(spark, sf_dir, "labels").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sparkloom.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents"), labelled(spark, sf_dir), TARGETS, cap=math.inf, anchor="good")
    names = [F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return found.select(F.col("_id").alias("doc_id"), "tokens", *names, "rate", "copies")


def _rollup(spark: SparkSession, counts: list[DataFrame]) -> DataFrame:
    """Load counts (``chars`` beside them) once and again, revise them by a begin and an end token, withdraw texts of under 200 characters and put them back with the revised counts."""
    from pyspark.sql import functions as F

    from sparkloom.llm.token_rollup import TokenLedger, deleted, inserted, revised
    from sparkloom.plans.tables import materialize, new_path

    ledger = TokenLedger(spark, new_path(spark, "token-ledger"))
    for one in counts:
        one = materialize(one, "token-counts")
        name = one.select("tokenizer").first()
        name = name["tokenizer"] if name else "none"
        ledger.commit(f"load-{name}", inserted(one))
        ledger.commit(f"load-{name}", inserted(one))
        short = one.where("chars < 200")
        ledger.commit(f"withdraw-{name}", deleted(short))
        more = F.col("n_tokens") + 2
        ledger.commit(f"revise-{name}", revised(one.where("chars >= 200").withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", more)))
        ledger.commit(f"restore-{name}", inserted(short.withColumn("n_tokens", more)))
    return ledger.totals()


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the piece vocabulary and of blank-separated words."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from sparkloom.llm.token_rollup import with_counts, with_piece_counts

    documents, chars = table(spark, sf_dir, "documents"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    return _rollup(spark, [with_piece_counts(documents, public_tokenizers.path("piece_bpe_32k.model"), "piece-bpe-32k", keep=(chars,)), with_counts(documents, "words-1", keep=(chars,))])


def token_rollup_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger for tokenizers that SQL can count."""
    from pyspark.sql import functions as F

    from sparkloom.llm.token_rollup import with_counts

    documents, chars = table(spark, sf_dir, "documents"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    return _rollup(spark, [with_counts(documents, name, keep=(chars,)) for name in ("words-1", "pieces-2")])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.html_text import learn, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.pivot_index import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.warc import archive_round_trip
    from sparkloom.plans.tables import new_path

    return archive_round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_mixing": op4_mixing,
    "op5_token_rollup": op5_token_rollup,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_pivot_index": op8_pivot_index,
    "op9_warc": op9_warc,
    "op10_license_scan": op10_license_scan,
    "token_rollup_patterns": token_rollup_patterns,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g') as norm from documents),
        w as (select *, first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from w""",
    "token_rollup_patterns": r"""
        with d as (select source, lang,
            cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) as bigint) as words,
            cast(len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) as bigint) as pieces from documents),
        u as (select source, lang, 'words-1' as tokenizer, 1 as n, words + 2 as t from d
            union all select source, lang, 'pieces-2', 1, pieces + 2 from d)
        select source, lang, tokenizer, cast(sum(n) as bigint) as n_docs, cast(sum(t) as bigint) as n_tokens from u group by all""",
    "op9_warc": r"""
        with p as (select page_id, coalesce(html, '') as h from pages),
        w as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as top from p)
        select page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
                ((cast(('0x' || substr(x, 1 + 10 * (i // 8), 10)) as bigint) >> (35 - 5 * (i % 8))) & 31) as int), 1)), '') as payload_digest,
            case when page_id = top then 'response' else 'revisit' end as record_type,
            case when page_id = top then null else top end as refers_to
        from w""",
}
