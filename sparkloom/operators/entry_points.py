"""Entry points of Go and TypeScript sources, and outside boundaries by import.

The tokenizer does not resolve receivers, so a Go call counts if its file imports a
package of the kind and the method has a telling name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.brace_rules import table

#: Router packages and the methods that add routes.
ROUTERS = ["net/http", "github.com/go-chi/chi", "github.com/gin-gonic/gin", "github.com/labstack/echo", "github.com/gofiber/fiber", "github.com/gorilla/mux"]
ROUTE_METHODS = ["Get", "Post", "Put", "Delete", "Patch", "Head", "Options", "Handle", "HandleFunc", "Method", "Connect", "Trace", "Any", "Group", "Route", "Mount"]
#: Packages and methods of message consumers and schedulers.
CONSUMERS = ["nats", "sarama", "amqp", "kafka"]
CONSUME_METHODS = ["Subscribe", "QueueSubscribe", "Consume", "ConsumePartition", "ChanSubscribe"]
SCHEDULERS = ["cron", "scheduler"]
SCHEDULE_METHODS = ["AddFunc", "AddJob"]
#: HTTP decorators and route calls of TypeScript.
TS_METHODS = ["Get", "Post", "Put", "Delete", "Patch", "Head", "Options"]
TS_CALLS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "use": "MIDDLEWARE", "route": "ALL", "all": "ALL"}

#: Outside modules by kind.
PYTHON_BOUNDARIES = {
    "database": ["sqlalchemy", "psycopg2", "psycopg", "asyncpg", "databases", "django.db", "tortoise", "peewee", "pymongo", "motor", "aiosqlite", "sqlite3"],
    "cache": ["redis", "aioredis", "memcache", "pymemcache", "diskcache"],
    "message-queue": ["pika", "aiokafka", "confluent_kafka", "kombu", "aio_pika", "nats"],
    "task-queue": ["celery", "dramatiq", "huey", "rq", "arq"],
    "object-storage": ["boto3", "minio", "google.cloud.storage"],
    "http-client": ["httpx", "requests", "aiohttp", "urllib3"],
    "grpc": ["grpc", "grpcio"],
}
TS_BOUNDARIES = {
    "database": ["prisma", "@prisma/client", "typeorm", "sequelize", "knex", "mongoose", "mongodb", "pg", "mysql2", "better-sqlite3", "drizzle-orm", "mikro-orm"],
    "cache": ["ioredis", "redis", "node-cache", "keyv", "catbox"],
    "message-queue": ["kafkajs", "amqplib", "bullmq", "bull", "nats", "@google-cloud/pubsub", "sqs-consumer"],
    "object-storage": ["@aws-sdk/client-s3", "aws-sdk", "minio", "@google-cloud/storage", "@azure/storage-blob"],
    "http-client": ["axios", "node-fetch", "got", "undici", "ky"],
    "grpc": ["@grpc/grpc-js", "@grpc/proto-loader", "grpc"],
    "graphql": ["@apollo/server", "@apollo/client", "graphql", "type-graphql", "nexus", "pothos"],
}


def rules_of(kinds: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(prefix, kind) in the order of the table, as ``relational.boundaries`` takes them."""
    return [(module, kind) for kind, modules in kinds.items() for module in modules]


def _any(module: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | module.contains(w)
    return out


def go_entry_points(rows: DataFrame) -> DataFrame:
    """``handler, kind, route, file, n`` of HTTP, message, schedule and gRPC registrations."""
    m = F.col("module")
    uses = table(rows, "imports").groupBy("path").agg(F.max(_any(m, ROUTERS)).alias("http"), F.max(_any(m, CONSUMERS)).alias("mq"), F.max(_any(m, SCHEDULERS)).alias("cron"), F.max(_any(m, ["google.golang.org/grpc"])).alias("grpc"))
    method = F.substring_index("dst", ".", -1)
    calls = table(rows, "calls").join(uses, "path").withColumn("m", method).where(F.col("dst").contains("."))
    kind = (
        F.when(F.col("http") & F.col("m").isin(*ROUTE_METHODS) & F.col("arg").startswith("/"), "http")
        .when(F.col("grpc") & F.col("m").rlike("^Register.+Server$"), "grpc")
        .when(F.col("mq") & F.col("m").isin(*CONSUME_METHODS), "mq")
        .when(F.col("cron") & F.col("m").isin(*SCHEDULE_METHODS), "cron")
    )
    verb = F.when(F.col("m").isin("Handle", "HandleFunc"), "ALL").when(F.col("m").isin("Group", "Route", "Mount"), "GROUP").otherwise(F.upper("m"))
    arg = F.coalesce("arg", F.lit("?"))
    route = F.when(F.col("kind") == "http", F.concat_ws(" ", verb, arg)).when(F.col("kind") == "grpc", F.concat(F.lit("grpc "), F.regexp_extract("m", "^Register(.+)Server$", 1))).when(F.col("kind") == "mq", F.concat(F.lit("consume "), arg)).otherwise(F.concat(F.lit("cron "), arg))
    return calls.withColumn("kind", kind).where("kind is not null").select(F.coalesce("last", F.lit("?")).alias("handler"), "kind", route.alias("route"), F.col("path").alias("file"), F.col("line").alias("n"))


def ts_entry_points(rows: DataFrame) -> DataFrame:
    """``handler, kind, route, file, n`` of decorated methods and of route calls whose first argument is a path."""
    decorated = table(rows, "functions").select("path", "pkg", "name", "line", F.explode("uses").alias("use"))
    name, target = F.regexp_extract("use", r"^(\w+)\(", 1), F.regexp_extract("use", "[\"'`]([^\"'`]*)[\"'`]", 1)
    one = decorated.where(name.isin(*TS_METHODS)).select(F.concat_ws(".", "pkg", "name").alias("handler"), F.lit("http").alias("kind"), F.concat_ws(" ", F.upper(name), F.when(target == "", "/").otherwise(target)).alias("route"), F.col("path").alias("file"), F.col("line").alias("n"))
    verbs = F.create_map(*[F.lit(x) for kv in TS_CALLS.items() for x in kv])
    verb = verbs[F.lower(F.substring_index("dst", ".", -1))]
    two = table(rows, "calls").where(F.col("arg").startswith("/") & verb.isNotNull()).select("src", F.lit("http"), F.concat_ws(" ", verb, "arg"), "path", "line")
    return one.union(two)


def duplicate_shapes(functions: DataFrame, least: int = 25) -> DataFrame:
    """``shape, representative, member, n``: functions of at least ``least`` tokens with one shape, one row per member.

    ``functions``: ``fq, shape, size``. Classes instead of pairs: copies are not expanded.
    """
    rows = functions.where(F.col("size") >= least).select("fq", "shape")
    groups = rows.groupBy("shape").agg(F.min("fq").alias("representative"), F.count_distinct("fq").alias("n")).where("n > 1")
    return rows.distinct().join(groups, "shape").select("shape", "representative", F.col("fq").alias("member"), "n")
