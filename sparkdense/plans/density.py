"""Density clustering queries. Points are the leading two coordinates of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdense.density.labels import density_labels, labels_at
from sparkdense.density.metric import range_join, vector_core_distances, vector_counts, vector_labels
from sparkdense.density.neighbours import core_distances, neighbour_counts
from sparkdense.density.ordering import best_copies, exact_ordering, partitioned_ordering, reachability_series
from sparkdense.density.partition import BOUNDARY_FACTORS, balance, box_range_join, build_kdtree, split_statistics
from sparkdense.functions import columns as C
from sparkdense.functions.columns import unpack
from sparkdense.registry import query, table
from sparkdense.session import cut_lineage, scratch_path
from sparkdense.sources.readers import read_csv_header
from sparkdense.sources.writers import cluster_report, write_csv

MIN_PTS = 4
EPS = 0.03
SMALLER = 0.02

POINTS_SQL = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
DISTANCE_SQL = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
NEAR_SQL = f"near AS (SELECT a.id AS a, b.id AS b, {DISTANCE_SQL} AS dist FROM pt a JOIN pt b ON {DISTANCE_SQL} <= {EPS})"
CORE_SQL = f"""core AS (SELECT a AS id, dist AS core_dist FROM (
  SELECT a, dist, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM near WHERE a <> b) WHERE rn = {MIN_PTS})"""


def labels_sql(radius: float, near: str = f"{POINTS_SQL}, {NEAR_SQL}, {CORE_SQL}") -> str:
    return f"""WITH RECURSIVE {near},
c AS (SELECT * FROM core WHERE core_dist <= {radius}),
link AS (SELECT a, b FROM near WHERE dist <= {radius} AND a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
r AS (SELECT id, id AS root FROM c UNION SELECT link.b, r.root FROM r JOIN link ON r.id = link.a),
cl AS (SELECT id, min(root) AS cluster_id FROM r GROUP BY id),
border AS (SELECT id, cluster_id FROM (
  SELECT near.a AS id, cl.cluster_id, row_number() OVER (PARTITION BY near.a
           ORDER BY greatest(c.core_dist, near.dist), c.id) AS rn
  FROM near JOIN c ON near.b = c.id JOIN cl ON cl.id = c.id
  WHERE near.dist <= {radius} AND near.a NOT IN (SELECT id FROM c)) WHERE rn = 1),
labels AS (SELECT pt.id, c.core_dist, c.id IS NOT NULL AS is_core, coalesce(cl.cluster_id, border.cluster_id, -1) AS cluster_id
  FROM pt LEFT JOIN c USING (id) LEFT JOIN cl USING (id) LEFT JOIN border USING (id))
"""


def plane(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return unpack(embeddings, "embedding", ("x", "y")).drop("embedding")


@query("dens_neighbour_count", f"WITH {POINTS_SQL}, {NEAR_SQL} SELECT a AS id, count(*) AS n_near FROM near GROUP BY a")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_counts(plane(spark, sf), EPS)


@query(
    "join_eps",
    f"WITH {POINTS_SQL}, {NEAR_SQL} SELECT n_near, count(*) AS points FROM (SELECT count(*) AS n_near FROM near GROUP BY a) GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_counts(plane(spark, sf), EPS).groupBy("n_near").agg(F.count("*").alias("points"))


@query(
    "dens_core_distance",
    f"WITH {POINTS_SQL}, {NEAR_SQL}, {CORE_SQL} SELECT id, core_dist FROM pt LEFT JOIN core USING (id)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return core_distances(plane(spark, sf), MIN_PTS, EPS).select("id", "core_dist")


@query(
    "dens_core_components",
    labels_sql(EPS) + "SELECT cluster_id, count(*) AS n_core, min(core_dist) AS densest FROM labels WHERE is_core GROUP BY 1",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    core = density_labels(plane(spark, sf), MIN_PTS, EPS).where("is_core")
    return core.groupBy("cluster_id").agg(F.count("*").alias("n_core"), F.min("core_dist").alias("densest"))


@query("dens_labels_exact", labels_sql(EPS) + "SELECT * FROM labels")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return density_labels(plane(spark, sf), MIN_PTS, EPS)


@query("dens_reextract", labels_sql(SMALLER) + "SELECT * FROM labels")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cores = cut_lineage(core_distances(plane(spark, sf), MIN_PTS, EPS))
    return labels_at(cores, SMALLER)


# --- boxes and partitions ----------------------------------------------------------------------------------

BOX_SQL = """b AS (SELECT label, min(embedding[1]::DOUBLE) AS lx, min(embedding[2]::DOUBLE) AS ly,
  max(embedding[1]::DOUBLE) AS ux, max(embedding[2]::DOUBLE) AS uy FROM embeddings GROUP BY label)"""


def label_boxes(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings").select("label", "embedding")
    points = unpack(embeddings, "embedding", ("x", "y"))
    return points.groupBy("label").agg(
        F.array(F.min("x"), F.min("y")).alias("lower"), F.array(F.max("x"), F.max("y")).alias("upper")
    )


@query(
    "dens_box_ops",
    f"""WITH {BOX_SQL}, o AS (SELECT * FROM b WHERE label = (SELECT min(label) FROM b)),
        w AS (SELECT min(lx) AS lx, max(ux) AS ux FROM b)
      SELECT b.label, least(b.lx, o.lx) AS union_lower_x, greatest(b.uy, o.uy) AS union_upper_y,
        greatest(b.lx, o.lx) AS common_lower_x, least(b.uy, o.uy) AS common_upper_y,
        (w.lx + w.ux) / 2 AS left_upper_x, b.lx AS left_lower_x, b.ly - 0.03 AS grown_lower_y,
        b.ux + 0.5 * (b.ux - b.lx) AS scaled_upper_x,
        (b.lx <= o.lx AND b.ly <= o.ly AND b.ux >= o.lx AND b.uy >= o.ly) AS has_corner
      FROM b, o, w""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    boxes = label_boxes(spark, sf).select("label", C.box(F.col("lower"), F.col("upper")).alias("b"))
    other = boxes.agg(F.min_by("b", "label")).scalar()
    middle = boxes.agg((F.min(F.col("b.lower")[0]) + F.max(F.col("b.upper")[0])) / 2).scalar()
    both = boxes.withColumns({"o": other, "m": middle})
    b, o = F.col("b"), F.col("o")
    left, _ = C.box_split(b, 0, F.col("m"))
    return both.select(
        "label",
        C.box_union(b, o)["lower"][0].alias("union_lower_x"),
        C.box_union(b, o)["upper"][1].alias("union_upper_y"),
        C.box_intersection(b, o)["lower"][0].alias("common_lower_x"),
        C.box_intersection(b, o)["upper"][1].alias("common_upper_y"),
        left["upper"][0].alias("left_upper_x"),
        left["lower"][0].alias("left_lower_x"),
        C.box_expand(b, EPS)["lower"][1].alias("grown_lower_y"),
        C.box_expand(b, 0.5, "multiply")["upper"][0].alias("scaled_upper_x"),
        C.box_contains(b, o["lower"]).alias("has_corner"),
    )


@query(
    "join_box_halo",
    f"""WITH {POINTS_SQL}, {BOX_SQL} SELECT id, label FROM pt JOIN b
        ON x >= lx - {EPS} AND x <= ux + {EPS} AND y >= ly - {EPS} AND y <= uy + {EPS}""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return box_range_join(plane(spark, sf), label_boxes(spark, sf), ("x", "y"), EPS).select("id", "label")


BOUNDS_SQL = "[" + ", ".join(f"mean + ({f}) * sqrt(var)" for f in BOUNDARY_FACTORS) + "]"


def kd_sql(levels: int) -> str:
    """The KD tree of 2^levels leaves, level by level: statistics, candidates, best boundary, new boxes."""
    parts = [
        f"WITH {POINTS_SQL}, q0 AS (SELECT id, x, y, 0 AS part FROM pt), "
        "k0 AS (SELECT 0 AS part, min(x) AS lx, max(x) AS ux, min(y) AS ly, max(y) AS uy FROM pt)"
    ]
    queue = [0]
    for level in range(levels):
        right = {part: 2**level + i for i, part in enumerate(queue)}
        queue = [p for part in queue for p in (part, right[part])]
        rights = ", ".join(f"({part}, {new})" for part, new in right.items())
        parts.append(f""",
s{level} AS (SELECT part, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM q{level} GROUP BY part),
a{level} AS (SELECT part, vx >= vy AS on_x, CASE WHEN vx >= vy THEN mx ELSE my END AS mean, greatest(vx, vy) AS var
  FROM s{level}),
c{level} AS (SELECT part, on_x, unnest({BOUNDS_SQL}) AS bound, unnest(range(7)) AS i FROM a{level}),
d{level} AS (SELECT c.part, any_value(on_x) AS on_x, i, any_value(bound) AS bound,
  sum(CASE WHEN (CASE WHEN on_x THEN x ELSE y END) < bound THEN 1 ELSE -1 END)::BIGINT AS balance
  FROM q{level} q JOIN c{level} c ON q.part = c.part GROUP BY c.part, i),
t{level} AS (SELECT d.*, new_part FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY abs(balance), i) AS rn
  FROM d{level}) d JOIN (VALUES {rights}) r(part, new_part) ON r.part = d.part WHERE rn = 1),
q{level + 1} AS (SELECT id, x, y, CASE WHEN (CASE WHEN on_x THEN x ELSE y END) >= bound THEN new_part ELSE t.part END AS part
  FROM q{level} q JOIN t{level} t ON q.part = t.part),
k{level + 1} AS (SELECT k.part, lx, CASE WHEN on_x THEN bound ELSE ux END AS ux, ly, CASE WHEN on_x THEN uy ELSE bound END AS uy
    FROM k{level} k JOIN t{level} t ON k.part = t.part
  UNION ALL SELECT new_part, CASE WHEN on_x THEN bound ELSE lx END, ux, CASE WHEN on_x THEN ly ELSE bound END, uy
    FROM k{level} k JOIN t{level} t ON k.part = t.part)""")
    return "".join(parts)


@query(
    "agg_balance7",
    kd_sql(1) + " SELECT i::INTEGER AS candidate, on_x, round(bound, 9) AS bound, balance FROM d0",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = plane(spark, sf)
    stats = split_statistics(points.withColumn("part_id", F.lit(0)), ("x", "y"))
    on_x = F.col("var0") >= F.col("var1")
    chosen = stats.select(
        F.struct(
            on_x.alias("on_x"),
            F.when(on_x, F.col("mean0")).otherwise(F.col("mean1")).alias("mean"),
            F.sqrt(F.greatest("var0", "var1")).alias("deviation"),
        )
    ).scalar()
    bounds = [F.col("mean") + F.lit(f) * F.col("deviation") for f in BOUNDARY_FACTORS]
    value = F.when(F.col("on_x"), F.col("x")).otherwise(F.col("y"))
    chosen_side = points.withColumn("s", chosen).select("x", "y", "s.*")
    counted = chosen_side.groupBy("on_x", "mean", "deviation").agg(*balance(value, bounds))
    candidates = F.array(*[F.struct(b.alias("bound"), F.col(f"b{i}").alias("balance")) for i, b in enumerate(bounds)])
    listed = counted.select("on_x", F.posexplode(candidates).alias("candidate", "c"))
    return listed.select("candidate", "on_x", F.round("c.bound", 9).alias("bound"), "c.balance")


@query(
    "dens_kd_split_stats",
    kd_sql(3) + """ SELECT part AS part_id, count(*) AS n, round(avg(x), 9) AS mean0, round(avg(y), 9) AS mean1,
        round(var_pop(x), 9) AS var0, round(var_pop(y), 9) AS var1 FROM q3 GROUP BY part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = plane(spark, sf)
    stats = split_statistics(build_kdtree(points, max_partitions=8).assign(points), ("x", "y"))
    return stats.select("part_id", "n", *[F.round(c, 9).alias(c) for c in ("mean0", "mean1", "var0", "var1")])


@query(
    "dens_kd_leaves",
    kd_sql(3) + """ SELECT k3.part AS part_id, round(lx, 9) AS lower_x, round(ly, 9) AS lower_y, round(ux, 9) AS upper_x,
        round(uy, 9) AS upper_y, n FROM k3 JOIN (SELECT part, count(*) AS n FROM q3 GROUP BY 1) USING (part)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    leaves = build_kdtree(plane(spark, sf), max_partitions=8).leaf_table(spark)
    corners = {f"{side}_{c}": F.round(F.col(side)[i], 9) for side in ("lower", "upper") for i, c in enumerate("xy")}
    return leaves.select("part_id", *[v.alias(name) for name, v in corners.items()], "n")


@query(
    "part_kd_leaf",
    kd_sql(3) + " SELECT part AS part_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM q3 GROUP BY part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # One leaf per physical partition, then aggregates without another shuffle.
    points = plane(spark, sf)
    placed = build_kdtree(points, max_partitions=8).assign(points).repartitionById(8, F.col("part_id").cast("int"))
    return placed.groupBy("part_id").agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]
    )


@query("dens_kd_rotation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return build_kdtree(plane(spark, sf), max_partitions=8, split_method="rotation").leaf_table(spark)


@query(
    "dens_halo",
    kd_sql(3) + f""" SELECT k.part AS part_id, count(*) AS n, sum((q.part = k.part)::INT)::BIGINT AS n_home
        FROM q3 q JOIN k3 k ON x >= lx - {EPS} AND x <= ux + {EPS} AND y >= ly - {EPS} AND y <= uy + {EPS} GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = plane(spark, sf)
    tree = build_kdtree(points, max_partitions=8)
    copies = tree.with_halo(points, dict.fromkeys(tree.leaves, EPS))
    return copies.groupBy("part_id").agg(F.count("*").alias("n"), F.count_if("is_home").alias("n_home"))


# --- orderings ---------------------------------------------------------------------------------------------


@query("dens_order_exact")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact_ordering(plane(spark, sf), MIN_PTS, EPS)


@query(
    "dens_order_core",
    labels_sql(EPS) + "SELECT id, core_dist, cluster_id FROM labels",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ordered = exact_ordering(plane(spark, sf), MIN_PTS, EPS)
    return ordered.select("id", "core_dist", "cluster_id")


@query("dens_order_partitioned")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return partitioned_ordering(plane(spark, sf), MIN_PTS, EPS).ordered()


@query(
    "dens_labels_partitioned",
    labels_sql(EPS) + "SELECT id, is_core, cluster_id FROM labels",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    labels = partitioned_ordering(plane(spark, sf), MIN_PTS, EPS).labels()
    return labels.select("id", "is_core", "cluster_id")


@query(
    "dens_labels_partitioned_smaller",
    labels_sql(SMALLER) + "SELECT id, is_core, cluster_id FROM labels",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    labels = partitioned_ordering(plane(spark, sf), MIN_PTS, EPS).labels(SMALLER)
    return labels.select("id", "is_core", "cluster_id")


@query("dens_extract")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ordering = partitioned_ordering(plane(spark, sf), MIN_PTS, EPS)
    local = ordering.local_labels(SMALLER)
    return local.groupBy("part_id", "local_cluster").agg(
        F.count("*").alias("n"), F.min("order_id").alias("first"), F.max("order_id").alias("last")
    )


@query("dens_best_copy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    ordering = partitioned_ordering(plane(spark, sf), MIN_PTS, EPS)
    return best_copies(ordering.local_labels(EPS)).select("id", "part_id", "is_home", "local_cluster", "reach_dist")


@query("dens_reach_series")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reachability_series(exact_ordering(plane(spark, sf), MIN_PTS, EPS), cap=2 * EPS)


@query(
    "sink_cluster_result",
    f"WITH {POINTS_SQL} SELECT id AS \"Pid\", x AS \"Px\", y AS \"Py\" FROM pt",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = plane(spark, sf)
    path = scratch_path(spark, "clusters")
    report = cluster_report(partitioned_ordering(points, MIN_PTS, EPS).labels(), points, cap=2 * EPS)
    write_csv(report, path)
    return read_csv_header(spark, path, report.schema).select("Pid", "Px", "Py")


# --- vectors of any number of axes ------------------------------------------------------------------------

WIDE_MIN_PTS = 2
# Radius of the queries over the leading 8 and over all 64 axes.
WIDE_EPS = {8: 0.2, 64: 1.12}
PAIR_EPS = 1.05


def wide_sql(axes: int, eps: float, core: bool = True) -> str:
    """The points as lists of doubles, all pairs within ``eps`` and the core distances."""
    dist = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    near = f"""pt AS (SELECT vec_id AS id, list_transform(embedding[1:{axes}], lambda e: e::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT a.id AS a, b.id AS b, {dist} AS dist FROM pt a CROSS JOIN pt b),
near AS (SELECT * FROM pairs WHERE dist <= {eps})"""
    ranked = CORE_SQL.replace(f"rn = {MIN_PTS}", f"rn = {WIDE_MIN_PTS}")
    return near + (f", {ranked}" if core else "")


def wide(spark: SparkSession, sf: str, axes: int) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return embeddings.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, axes).alias("vector"))


@query(
    "join_range_vectors",
    f"WITH {wide_sql(64, PAIR_EPS, core=False)} SELECT a AS left_id, b AS right_id, dist FROM near",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = wide(spark, sf, 64)
    return range_join(points, points, PAIR_EPS)


def _register_wide(axes: int) -> None:
    eps = WIDE_EPS[axes]

    @query(
        f"dens_neighbour_count_{axes}",
        f"WITH {wide_sql(axes, eps, core=False)} SELECT a AS id, count(*) AS n_near FROM near GROUP BY a",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return vector_counts(wide(spark, sf, axes), eps)

    @query(
        f"dens_core_distance_{axes}",
        f"WITH {wide_sql(axes, eps)} SELECT id, core_dist FROM pt LEFT JOIN core USING (id)",
    )
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return vector_core_distances(wide(spark, sf, axes), WIDE_MIN_PTS, eps)

    @query(f"dens_labels_{axes}", labels_sql(eps, wide_sql(axes, eps)) + "SELECT * FROM labels")
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return vector_labels(wide(spark, sf, axes), WIDE_MIN_PTS, eps)


for _axes in WIDE_EPS:
    _register_wide(_axes)
