"""Source and sink queries: tables are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.functions.columns import words
from sparkdense.registry import query, table
from sparkdense.session import broadcast_if_small, scratch_path
from sparkdense.sources import readers as S
from sparkdense.sources.writers import write_csv


@query(
    "src_text_words",
    r"""SELECT count(*) AS lines, sum(len(w))::BIGINT AS words FROM (
          SELECT list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    documents = table(spark, sf, "documents")
    documents.select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    lines = S.read_lines(spark, path)
    return lines.agg(F.count("*").alias("lines"), F.sum(F.size(words("value"))).alias("words"))


@query(
    "src_text_min_partitions",
    "SELECT (length(c_name) > 10) AS long_name, count(*) AS n FROM customer GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "names")
    table(spark, sf, "customer").select("c_name").write.text(path)
    lines = S.read_lines(spark, path, min_partitions=8)
    return lines.groupBy((F.length("value") > 10).alias("long_name")).agg(F.count("*").alias("n"))


@query("src_csv_header", "SELECT p_brand, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY p_brand")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "part")
    part = table(spark, sf, "part")
    write_csv(part, path)
    read = S.read_csv_header(spark, path, part.schema)
    return read.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


@query("src_csv_inferred", "SELECT p_size, count(*) AS n, max(p_retailprice) AS top FROM part GROUP BY p_size")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "part")
    write_csv(table(spark, sf, "part"), path)
    read = S.read_csv_header(spark, path)
    return read.groupBy("p_size").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


@query("src_csv_positional", "SELECT s_suppkey::INTEGER AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "supplier")
    table(spark, sf, "supplier").write.csv(path)
    return S.read_csv_positional(spark, path, {0: "id", 1: "name", 3: "balance"})


JSON_SCHEMA = "event_id bigint, dimensions struct<height: double>, tags array<string>, k bigint"


def write_event_json(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "events")
    table(spark, sf, "events").select(
        "event_id",
        F.struct(F.col("value").alias("height")).alias("dimensions"),
        F.array("event_type").alias("tags"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ).write.json(path)
    return path


@query("src_json_nested", "SELECT event_id, value AS height FROM events WHERE event_type = 'error' AND value < 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    read = S.read_json(spark, write_event_json(spark, sf), JSON_SCHEMA)
    cold = read.where((F.get("tags", F.lit(0)) == "error") & (F.col("dimensions.height") < 100))
    return cold.select("event_id", "dimensions.height")


@query(
    "src_json_props",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    read = S.read_json(spark, write_event_json(spark, sf))
    return read.groupBy("k").agg(F.count("*").alias("n"), F.max("dimensions.height").alias("top"))


@query(
    "src_literal",
    """SELECT meaning, count(*) AS n FROM lineitem JOIN (VALUES ('R', 'returned'), ('A', 'accepted'), ('N', 'open'))
       c(flag, meaning) ON l_returnflag = flag GROUP BY meaning""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    codes = S.literal_table(
        spark, [("R", "returned"), ("A", "accepted"), ("N", "open")], "flag string, meaning string"
    )
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("k"))
    return counts.join(broadcast_if_small(codes), "flag").groupBy("meaning").agg(F.sum("k").alias("n"))


@query(
    "src_conflict_to_null",
    "SELECT doc_id, TRY_CAST(regexp_extract(source, '[0-9]$') AS BIGINT) AS digit, "
    "TRY_CAST(source AS BIGINT) AS as_number FROM documents",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source")
    digit = F.regexp_extract("source", "[0-9]$", 0)
    return documents.select(
        "doc_id", S.conforming(digit, "bigint").alias("digit"), S.conforming("source", "bigint").alias("as_number")
    )


@query(
    "src_range",
    """SELECT r.k, count(l_orderkey) AS n FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) r(k)
       LEFT JOIN lineitem ON l_suppkey = r.k GROUP BY r.k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0]
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    keys = S.range_table(spark, 0, top + 1, 8, "k")
    return keys.join(counts, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_hash_keys")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "orders").select(S.hashed_key("o_orderkey", 100).alias("waybill"), "o_custkey")
    return keyed.groupBy("waybill").agg(F.max("o_custkey").alias("customer"))


@query("src_random_keys")
def _(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "orders").select(S.random_key(100, seed=7).alias("waybill"), "o_custkey")
    return keyed.groupBy("waybill").agg(F.max("o_custkey").alias("customer"))


@query(
    "src_parse_lines",
    "SELECT c_name AS name, c_nationkey AS age FROM customer WHERE c_nationkey BETWEEN 13 AND 19",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "people")
    table(spark, sf, "customer").select(F.concat_ws(",", "c_name", "c_nationkey")).write.text(path)
    people = S.read_lines(spark, path).select(
        S.delimited_field("value", ",", 0).alias("name"), S.delimited_field("value", ",", 1, "int").alias("age")
    )
    return people.where(F.col("age").between(13, 19))


@query(
    "src_parse_vectors",
    "SELECT vec_id AS id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(64)) + " FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    numbers = F.transform("embedding", lambda v: v.cast("double").cast("string"))
    lines = F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(numbers, " "))
    table(spark, sf, "embeddings").select(lines).write.text(path)
    parsed = S.read_lines(spark, path).select(S.vector_of_line("value").alias("v"))
    return parsed.select(F.col("v")[0].cast("bigint").alias("id"), *[F.col("v")[i + 1].alias(f"v{i}") for i in range(64)])


@query("sink_csv_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_csv(orders, path)
    return S.read_csv_header(spark, path, orders.schema)


@query(
    "src_named_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS customer,
              TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE substr(o_orderpriority, 1, 1) END AS BIGINT) AS rank,
              o_orderpriority AS priority FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of named values: some lack a name, and one name holds numbers in some rows and letters in others."""
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))
    pairs = F.create_map(F.lit("rank"), mixed, F.lit("priority"), F.col("o_orderpriority"), F.lit("unread"), F.lit("x"))
    customer = F.create_map(F.lit("customer"), F.col("o_custkey").cast("string"))
    named = F.when(F.col("o_orderkey") % 3 > 0, F.map_concat(pairs, customer)).otherwise(pairs)
    records = table(spark, sf, "orders").select("o_orderkey", named.alias("fields"))
    return S.named_rows(records, "fields", {"customer": "bigint", "rank": "bigint", "priority": "string"})
