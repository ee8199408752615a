"""Relational queries: projection, filters, joins, aggregates, sorts, sets, UDF and SQL surface.

``lineitem`` plays the order detail, ``part`` the product (its brand the colour), ``orders`` the header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from sparkdense.functions import columns as C
from sparkdense.operators import relational as R
from sparkdense.registry import query, table
from sparkdense.session import broadcast_if_small, spread_if_small

BRAND = "Brand#2"
NET = "l_extendedprice * (1 - l_discount)"
NET_SUM = f"CAST(sum(CAST({NET} AS DECIMAL(18,4))) AS DOUBLE)"


def net_price() -> F.Column:
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


# --- projection, filter, scalar functions -----------------------------------------------------------------


@query("rel_project_star_lit", "SELECT *, 'OK' AS status FROM supplier WHERE s_nationkey = 7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where("s_nationkey = 7").select("*", F.lit("OK").alias("status"))


@query(
    "rel_project_columns",
    "SELECT p_partkey, p_name, p_retailprice, p_retailprice * 2 AS double_price FROM part WHERE p_brand = 'Brand#2'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.where(part.p_brand == BRAND).select(
        part.p_partkey, part["p_name"], "p_retailprice", (part.p_retailprice * 2).alias("double_price")
    )


@query(
    "rel_net_price",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST({NET} AS DECIMAL(18,4)) AS DOUBLE) AS netprice "
    "FROM lineitem",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net_price().cast("double").alias("netprice")
    )


@query(
    "rel_filter_string",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 100000",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .filter("(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice >= 100000")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query(
    "rel_filter_expr",
    "SELECT p_partkey, p_name, p_retailprice * 2 AS double_price FROM part WHERE p_retailprice * 2 > 1900",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    doubled = F.col("p_retailprice") * 2
    return table(spark, sf, "part").where(doubled > 1900).select("p_partkey", "p_name", doubled.alias("double_price"))


@query(
    "rel_null_test",
    "SELECT count(quality) AS labelled, count(*) - count(quality) AS unlabelled "
    "FROM documents LEFT JOIN labels USING (doc_id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.agg(
        F.count_if(F.col("quality").isNotNull()).alias("labelled"),
        F.count_if(F.col("quality").isNull()).alias("unlabelled"),
    )


@query(
    "rel_case_when",
    """SELECT o_orderkey, label FROM (
         SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 END AS label
         FROM orders) WHERE label >= 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label")).where("label >= 0")


@query(
    "rel_case_otherwise",
    "SELECT event_type, sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END)::BIGINT AS large, count(*) AS n "
    "FROM events GROUP BY event_type",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    large = F.when(F.col("value") >= 100, 1).otherwise(0)
    return (
        table(spark, sf, "events").groupBy("event_type").agg(F.sum(large).alias("large"), F.count("*").alias("n"))
    )


@query(
    "rel_filter_dropped_col",
    """SELECT l_orderkey, l_linenumber, p_name, l_extendedprice, l_quantity
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # The filter names a column that the projection dropped; the analyzer still resolves it below the Project.
    detail, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        detail.join(part, detail.l_partkey == part.p_partkey)
        .select("l_orderkey", "l_linenumber", "p_name", "l_extendedprice", "l_quantity")
        .filter(F.col("p_brand") == BRAND)
    )


@query(
    "rel_nested_field",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, value
       FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "k bigint").alias("p"),
        F.struct(F.col("event_type").alias("kind"), "value").alias("e"),
    )
    return nested.where("p.k >= 50").select("event_id", "p.k", "e.*")


@query(
    "rel_array_struct_pred",
    """SELECT page_id, len(url)::INTEGER AS url_length FROM pages
       WHERE string_split(url, '/')[1] = 'http:' AND len(string_split(url, '/')[3]) < 20""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.split("url", "/").alias("parts"),
        F.struct(F.length(F.get(F.split("url", "/"), F.lit(2))).alias("length")).alias("host"),
    )
    return pages.where((F.get("parts", F.lit(0)) == "http:") & (F.col("host.length") < 20)).select(
        "page_id", F.length("url").alias("url_length")
    )


@query("rel_reverse", "SELECT p_partkey, reverse(p_name) AS eman FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.reverse("p_name").alias("eman"))


@query("rel_len_filter", "SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.length("p_name") <= 10).select("p_partkey", "p_name")


@query(
    "rel_explode_chars",
    "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> '' GROUP BY ch",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .select(F.explode(C.characters("p_name")).alias("ch"))
        .groupBy("ch")
        .agg(F.count("*").alias("n"))
    )


@query(
    "rel_two_word_lines",
    r"""SELECT doc_id, line_no, w[1] AS first, w[2] AS second FROM (
          SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
        WHERE len(w) = 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return R.two_word_lines(lines, "line").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "first", "second"
    )


@query(
    "rel_two_word_lines_single_space",
    """SELECT doc_id, count(*) AS n FROM (
         SELECT doc_id, string_split(unnest(string_split(text, chr(10))), ' ') AS w FROM documents)
       WHERE len(w) = 2 GROUP BY doc_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.two_word_lines(lines, "line", runs=False).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "rel_concat_between",
    "SELECT p_partkey, 'Name: ' || p_name AS label FROM part WHERE p_size BETWEEN 13 AND 19",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .where(F.col("p_size").between(13, 19))
        .select("p_partkey", F.concat(F.lit("Name: "), "p_name").alias("label"))
    )


@query(
    "rel_log2_floor",
    "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, round(log2(value), 6) AS bits FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.floor("value").alias("whole"), F.round(F.log2("value"), 6).alias("bits")
    )


@query(
    "rel_distance",
    """SELECT e.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, c.embedding),
              lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))), 6) AS dist
       FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings").select("vec_id", "embedding")
    first = embeddings.agg(F.min_by("embedding", "vec_id")).scalar()
    return embeddings.withColumn("origin", first).select(
        "vec_id", F.round(C.vector_distance("embedding", "origin"), 6).alias("dist")
    )


@query(
    "rel_least_cap",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "least(l_quantity, l_extendedprice / 1000) AS smaller, least(l_extendedprice, 50000.0::DOUBLE) AS bounded FROM lineitem",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.least("l_quantity", F.col("l_extendedprice") / 1000).alias("smaller"),
        C.capped("l_extendedprice", 50000.0).alias("bounded"),
    )


@query(
    "rel_argmin_candidates",
    """SELECT p_partkey, min_by(bound, abs(p_retailprice - bound) * 1000 + bound / 1000000) AS nearest
       FROM part, (SELECT unnest([900.0::DOUBLE, 1100, 1300, 1500, 1700, 1900, 2100]) AS bound) GROUP BY p_partkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    bounds = F.array(*[F.lit(900.0 + 200 * i) for i in range(7)])
    nearest = F.array_min(
        F.transform(bounds, lambda b: F.struct(F.abs(F.col("p_retailprice") - b).alias("gap"), b.alias("bound")))
    )
    return table(spark, sf, "part").select("p_partkey", nearest["bound"].alias("nearest"))


@query("rel_string_literal_cmp", "SELECT p_partkey, p_size FROM part WHERE p_size > 36")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size > '36'").select("p_partkey", "p_size")


@query(
    "rel_int_div",
    "SELECT l_partkey // ((SELECT max(l_partkey) + 1 FROM lineitem) // 8) AS block, count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").select("l_partkey")
    n_keys = keys.agg(F.max("l_partkey") + 1).scalar()
    block = F.expr("l_partkey div (n_keys div 8)")
    return keys.withColumn("n_keys", n_keys).groupBy(block.alias("block")).agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------------------------------------


@query(
    "join_using",
    """SELECT orderkey, count(*) AS lines, max(o_totalprice) AS o_totalprice
       FROM (SELECT l_orderkey AS orderkey FROM lineitem) JOIN (SELECT o_orderkey AS orderkey, o_totalprice FROM orders)
       USING (orderkey) GROUP BY orderkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    header = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    return (
        detail.join(header, "orderkey")
        .groupBy("orderkey")
        .agg(F.count("*").alias("lines"), F.max("o_totalprice").alias("o_totalprice"))
    )


@query(
    "join_cond",
    "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "s_name", "n_name")


@query(
    "join_three_way",
    """SELECT c_mktsegment, o_orderstatus, l_returnflag, count(*) AS n FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Lines are reduced to one row per (order, flag) before the join, so a hot order stays one small group.
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("k"))
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_mktsegment", "o_orderstatus", "l_returnflag")
        .agg(F.sum("k").alias("n"))
    )


@query(
    "join_left_agg",
    """SELECT c_custkey, c_name, qty FROM customer LEFT JOIN (
         SELECT o_custkey, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey AND p_brand = 'Brand#2'
         JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return customer_quantity(spark, sf)


def customer_quantity(spark: SparkSession, sf: str) -> DataFrame:
    detail = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").where(F.col("p_brand") == BRAND).select("p_partkey")
    header = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    bought = (
        detail.join(part, detail.l_partkey == part.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("qty"))
        .join(header, F.col("l_orderkey") == header.o_orderkey)
        .groupBy("o_custkey")
        .agg(F.sum("qty").alias("qty"))
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return customer.join(bought, customer.c_custkey == bought.o_custkey, "left_outer").select(
        "c_custkey", "c_name", "qty"
    )


@query(
    "join_full_unmatched",
    """SELECT o_orderkey AS orderkey FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem)
       ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    header = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"))
    degree = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.count("*").alias("n"))
    return header.join(degree, "orderkey", "full_outer").where("n is null").select("orderkey")


@query(
    "join_semi",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (
         SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail, part = table(spark, sf, "lineitem"), table(spark, sf, "part").where(F.col("p_brand") == BRAND)
    with_brand = detail.join(part, detail.l_partkey == part.p_partkey, "left_semi").select("l_orderkey").distinct()
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(with_brand, orders.o_orderkey == with_brand.l_orderkey, "left_semi")


@query(
    "join_anti",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti")


@query(
    "join_pair_struct",
    """SELECT p_partkey AS k, p_name AS name, l_orderkey AS amount_order, l_returnflag AS status
       FROM part JOIN lineitem ON p_partkey = l_partkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    right = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.struct(F.col("l_orderkey").alias("amount_order"), F.col("l_returnflag").alias("status")).alias("r"),
    )
    pairs = left.join(right, "k").select("k", F.struct("name", "r").alias("pair"))
    return pairs.select("k", "pair.name", "pair.r.*")


@query(
    "join_broadcast",
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    places = nation.join(broadcast_if_small(region), nation.n_regionkey == region.r_regionkey)
    places = places.select("n_nationkey", "n_name", "r_name")
    return customer.join(broadcast_if_small(places), customer.c_nationkey == places.n_nationkey).select(
        "c_custkey", "n_name", "r_name"
    )


@query(
    "join_broadcast_missing",
    """SELECT count(*) AS n, count(p_partkey) AS found FROM lineitem
       LEFT JOIN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') ON l_partkey = p_partkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # A lookup that reports keys without an entry instead of failing or dropping them.
    brand = table(spark, sf, "part").where(F.col("p_brand") == BRAND).select("p_partkey")
    detail = table(spark, sf, "lineitem").select("l_partkey")
    found = detail.join(broadcast_if_small(brand), detail.l_partkey == brand.p_partkey, "left")
    return found.agg(F.count("*").alias("n"), F.count("p_partkey").alias("found"))


@query(
    "join_copartitioned",
    """SELECT a.k, a.bought, b.supplied FROM
         (SELECT l_partkey AS k, sum(l_quantity) AS bought FROM lineitem GROUP BY 1) a JOIN
         (SELECT p_partkey AS k, sum(p_size)::BIGINT AS supplied FROM part GROUP BY 1) b USING (k)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("bought"))
    right = table(spark, sf, "part").groupBy(F.col("p_partkey").alias("k")).agg(F.sum("p_size").alias("supplied"))
    return left.join(right, "k")


@query(
    "join_positional",
    """SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM part)
       JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier) USING (pos)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.zip_by_position(
        table(spark, sf, "part").select("p_partkey"), "p_partkey", table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey"
    ).select("p_partkey", "s_suppkey")


# --- aggregation -------------------------------------------------------------------------------------------


@query("agg_count", "SELECT count(*) AS n FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("agg_group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg_sum_expr", f"SELECT l_orderkey, {NET_SUM} AS totalprice FROM lineitem GROUP BY l_orderkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return order_totals(table(spark, sf, "lineitem"))


def order_totals(detail: DataFrame) -> DataFrame:
    return detail.groupBy("l_orderkey").agg(F.sum(net_price()).cast("double").alias("totalprice"))


@query("agg_max", "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))


@query(
    "rel_order_total_having",
    f"SELECT l_orderkey, {NET_SUM} AS totalprice FROM lineitem GROUP BY l_orderkey HAVING {NET_SUM} > 200000",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return order_totals(table(spark, sf, "lineitem")).where("totalprice > 200000")


@query(
    "agg_join_having",
    f"""SELECT l_orderkey, {NET_SUM} AS totalprice FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_brand = 'Brand#2' GROUP BY l_orderkey HAVING {NET_SUM} > 10000""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail, part = table(spark, sf, "lineitem"), table(spark, sf, "part").where(F.col("p_brand") == BRAND)
    return order_totals(detail.join(part, detail.l_partkey == part.p_partkey)).where("totalprice > 10000")


@query(
    "agg_customer_qty",
    """SELECT c_custkey, c_name, sum(l_quantity) AS qty FROM customer LEFT JOIN (
         orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey AND p_brand = 'Brand#2')
         ON c_custkey = o_custkey GROUP BY ALL ORDER BY qty DESC NULLS LAST, c_custkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return customer_quantity(spark, sf).orderBy(F.desc_nulls_last("qty"), "c_custkey")


@query(
    "agg_distinct",
    "SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    detail, part = table(spark, sf, "lineitem"), table(spark, sf, "part").where(F.col("p_brand") == BRAND)
    return detail.join(part, detail.l_partkey == part.p_partkey).select("l_orderkey").distinct()


@query(
    "agg_distinct_with_null",
    """WITH q AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id))
       SELECT (SELECT count(*) FROM (SELECT DISTINCT quality FROM q)) AS distinct_rows,
              (SELECT count(DISTINCT quality) FROM q) AS distinct_values""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.agg(
        R.distinct_with_null("quality").alias("distinct_rows"), F.count_distinct("quality").alias("distinct_values")
    )


@query(
    "agg_word_count",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents)
        WHERE word <> '' GROUP BY word""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.word_count(spread_if_small(table(spark, sf, "documents").select("text")), "text")


@query(
    "agg_word_length_histogram",
    r"""SELECT length(word)::INTEGER AS len, count(*) AS n
        FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = spread_if_small(table(spark, sf, "documents").select("text"))
    tokens = texts.select(F.explode(C.words("text")).alias("word"))
    return tokens.groupBy(F.length("word").alias("len")).agg(F.count("*").alias("n"))


@query(
    "agg_collect",
    """SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, count(*) AS n
       FROM nation GROUP BY n_regionkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "nation").groupBy("n_regionkey")
    return grouped.agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n")
    )


@query("agg_global_sum", "SELECT sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query(
    "agg_char_set",
    "SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Each text is reduced to its own character set first, so the shuffle carries sets and not texts.
    per_text = F.array_distinct(C.characters("text"))
    texts = spread_if_small(table(spark, sf, "documents").select("text"))
    return texts.select(F.explode(per_text).alias("ch")).distinct()


AXES = [f"v{i}" for i in range(64)]  # the width of the embeddings


@query(
    "agg_moments",
    "SELECT count(*) AS n, "
    + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 9) AS mean_{c}, round(var_pop(embedding[{i + 1}]::DOUBLE), 9) AS var_{c}" for i, c in enumerate(AXES))
    + " FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = C.unpack(table(spark, sf, "embeddings").select("embedding"), "embedding", AXES)
    return points.agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(c), 9).alias(f"mean_{c}") for c in AXES],
        *[F.round(F.var_pop(c), 9).alias(f"var_{c}") for c in AXES],
    )


@query(
    "agg_bbox",
    "SELECT "
    + ", ".join(f"min(embedding[{i + 1}]::DOUBLE) AS lower_{c}, max(embedding[{i + 1}]::DOUBLE) AS upper_{c}" for i, c in enumerate(AXES))
    + " FROM embeddings",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = C.unpack(table(spark, sf, "embeddings").select("embedding"), "embedding", AXES)
    return points.agg(*[f(c).alias(f"{name}_{c}") for c in AXES for f, name in ((F.min, "lower"), (F.max, "upper"))])


@query(
    "agg_argmin_row",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cheapest = F.min(F.struct("o_totalprice", "o_orderkey")).alias("row")
    return (
        table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(cheapest)
        .select("o_custkey", "row.o_orderkey", "row.o_totalprice")
    )


@query(
    "agg_hit_ratio",
    """SELECT round(4 * avg(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END), 9) AS ratio, count(*) AS n FROM (
         SELECT embedding[1]::DOUBLE * 8 AS x, embedding[2]::DOUBLE * 8 AS y FROM embeddings)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = C.unpack(table(spark, sf, "embeddings"), "embedding", ("x", "y"))
    scaled = points.select((F.col("x") * 8).alias("x"), (F.col("y") * 8).alias("y"))
    return scaled.agg(F.round(R.hit_ratio("x", "y"), 9).alias("ratio"), F.count("*").alias("n"))


@query("agg_observe", "SELECT count(*) AS rows_seen, sum(l_quantity) AS quantity_seen FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # The counter rides along with the action that drains the rows; it is read once that action is done.
    observation = Observation("quantity")
    watched = table(spark, sf, "lineitem").select("l_quantity").observe(
        observation, F.count(F.lit(1)).alias("rows_seen"), F.sum("l_quantity").alias("quantity_seen")
    )
    watched.write.format("noop").mode("overwrite").save()
    seen = observation.get
    return spark.createDataFrame([(seen["rows_seen"], seen["quantity_seen"])], "rows_seen bigint, quantity_seen double")


@query("agg_partition_sizes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.partition_sizes(table(spark, sf, "lineitem").select("l_quantity"), F.sum("l_quantity").alias("quantity"))


# --- partitioning ------------------------------------------------------------------------------------------


@query("part_rebalance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    characters = table(spark, sf, "documents").select(F.explode(C.words("text")).alias("word"))
    return R.partition_sizes(characters.repartition(8))


@query("part_hash")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.partition_sizes(table(spark, sf, "orders").select("o_custkey").repartition(6, "o_custkey"))


@query(
    "part_range_block",
    """SELECT l_orderkey // ((SELECT max(l_orderkey) + 1 FROM lineitem) // 8) AS block, count(*) AS n,
              count(DISTINCT l_orderkey) AS n_keys FROM lineitem GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # Range blocks: one aggregate per key within the block, then per block; no key is seen by two blocks.
    keys = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    n_keys = keys.agg(F.max("l_orderkey") + 1).scalar()
    blocks = keys.withColumn("n_keys", n_keys).withColumn("block", F.expr("l_orderkey div (n_keys div 8)"))
    return blocks.groupBy("block").agg(F.sum("k").alias("n"), F.count("*").alias("n_keys"))


@query("part_range_physical")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.partition_sizes(table(spark, sf, "lineitem").select("l_orderkey").repartitionByRange(8, "l_orderkey"))


# --- sort, limit, top-k, sample ----------------------------------------------------------------------------


@query(
    "sort_asc",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#2' ORDER BY p_retailprice, p_partkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    brand = table(spark, sf, "part").where(F.col("p_brand") == BRAND)
    return brand.select("p_partkey", "p_name", "p_retailprice").orderBy("p_retailprice", "p_partkey")


@query("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(
    "sort_by_key",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey ORDER BY l_orderkey",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return counts.repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey")


@query(
    "sort_composite",
    """SELECT doc_id, quality, source FROM documents LEFT JOIN labels USING (doc_id)
       ORDER BY quality NULLS LAST, source, doc_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return (
        documents.join(labels, "doc_id", "left")
        .select("doc_id", "quality", "source")
        .orderBy(F.asc_nulls_last("quality"), "source", "doc_id")
    )


@query(
    "topk_desc",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(10)


@query(
    "k_smallest_per_key",
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ranked = R.smallest_per_key(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], 3)
    return ranked.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("k_smallest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(5)


@query("limit_ordered", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type").orderBy("event_id").limit(5)


@query(
    "sample_hash",
    "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id::VARCHAR || ':1'), vec_id LIMIT 20",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return R.sample_rows(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 20, seed=1)


# --- sets --------------------------------------------------------------------------------------------------


@query(
    "set_union",
    "SELECT n_nationkey AS k, 'n' AS side FROM nation UNION ALL SELECT c_nationkey, 'c' FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.lit("n").alias("side"))
    customer = table(spark, sf, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("k"))
    return nation.unionByName(customer)


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    return customer.intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_suppkey FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(
        table(spark, sf, "lineitem").select("l_suppkey")
    )


@query(
    "set_anti_bag",
    "SELECT l_partkey AS k FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#2' AND p_partkey = l_partkey)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    right = table(spark, sf, "part").where(F.col("p_brand") == BRAND).select(F.col("p_partkey").alias("k"))
    return R.bag_difference(left, right, "k")


@query(
    "set_primes",
    """WITH n AS (SELECT p_partkey AS k FROM part WHERE p_partkey >= 2)
       SELECT k FROM n WHERE NOT EXISTS (
         SELECT 1 FROM range(2, (SELECT CAST(floor(sqrt(max(p_partkey))) AS BIGINT) + 1 FROM part)) d(d)
         WHERE d * d <= k AND k % d = 0)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).where("k >= 2")
    top = keys.agg(F.max("k")).first()[0] or 1
    return keys.join(R.composites(spark, top + 1), keys.k == F.col("composite"), "left_anti")


@query(
    "set_orders_without_lines",
    """SELECT k FROM range((SELECT min(o_orderkey) FROM orders), (SELECT max(o_orderkey) + 1 FROM orders)) r(k)
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    low, high = table(spark, sf, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return R.missing_keys(spark, table(spark, sf, "lineitem"), "l_orderkey", low, high + 1)


# --- UDF and SQL surface -----------------------------------------------------------------------------------


@query("udf_len", "SELECT p_partkey, (length(p_name) + 2)::INTEGER AS slen FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.text_length_plus_two("p_name").alias("slen"))


@query("udf_builtin_len", "SELECT p_partkey, (length(p_name) + 2)::INTEGER AS slen FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.length("p_name") + 2).alias("slen"))


@query("udf_sql", "SELECT p_partkey, (length(p_name) + 2)::INTEGER AS slen FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spark.udf.register("slen", C.text_length_plus_two)
    return spark.sql("SELECT p_partkey, slen(p_name) AS slen FROM {part}", part=table(spark, sf, "part"))


@query("sql_view", "SELECT * FROM part WHERE p_size >= 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("sparkdense_part")
    return spark.sql("SELECT * FROM sparkdense_part WHERE p_size >= 10")


@query("sql_mixed", "SELECT p_type, count(*) AS n FROM part WHERE p_size >= 10 GROUP BY p_type")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").where("p_size >= 10").createOrReplaceTempView("sparkdense_large_part")
    return spark.sql("SELECT p_type, count(*) AS n FROM sparkdense_large_part GROUP BY p_type")


@query("sql_then_frame", "SELECT p_type, count(*) AS n FROM part WHERE p_size >= 10 GROUP BY p_type")
def _(spark: SparkSession, sf: str) -> DataFrame:
    large = spark.sql("SELECT * FROM {part} WHERE p_size >= 10", part=table(spark, sf, "part"))
    return large.groupBy("p_type").agg(F.count("*").alias("n"))
