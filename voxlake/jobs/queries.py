"""Registered voxel queries and the SQL that each is checked against.

All read the volume VOX: quantities of ``lineitem`` summed on a grid of 32 voxels a side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions import pointwise as P
from voxlake.functions.shared import materialise, new_folder
from voxlake.functions.volume import Shape, coordinates, densify, flat_index, in_box
from voxlake.operators import bricks as B
from voxlake.operators import components as C
from voxlake.operators import diffusion as D
from voxlake.operators import histograms as H
from voxlake.operators import stats as S
from voxlake.sources import images, store
from voxlake.streaming.histogram import read_histograms, stored_histograms

N, COARSE = 32, 8
SHAPE, FIELD = Shape(N, N, N), Shape(COARSE, COARSE, COARSE)
PLANES = 8  # of a chunk
BRICK = Shape(13, 10, 31)
LOW, HIGH, BINS = 20, 200, 16
CENTER, MOST_RADIUS = (16, 16), 20
FIELD_LOW, FIELD_HIGH = 1, 1000
KERNEL = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]  # sums are exact in binary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

VOX_SQL = "vox AS (SELECT CAST(l_suppkey % 32 AS BIGINT) AS z, CAST(l_partkey % 32 AS BIGINT) AS y, CAST(l_orderkey % 32 AS BIGINT) AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"
GRID_SQL = f"{VOX_SQL}, grid AS (SELECT a.z, b.y, c.x FROM (SELECT unnest(range(0, 32)) AS z) a, (SELECT unnest(range(0, 32)) AS y) b, (SELECT unnest(range(0, 32)) AS x) c)"
# bright voxels: above one and a half times the mean
MASK_SQL = f"{VOX_SQL}, mean AS (SELECT sum(v) AS s, count(*) AS n FROM vox), bright AS (SELECT vox.* FROM vox, mean WHERE 2 * v * n > 3 * s)"
STATE_SQL = f"{GRID_SQL}, mean AS (SELECT sum(v) AS s, count(*) AS n FROM vox), u0 AS (SELECT z, y, x, CASE WHEN 2 * coalesce(v, 0) * n > 3 * s THEN 1.0e0 ELSE 0.0e0 END AS u FROM grid LEFT JOIN vox USING (z, y, x), mean)"


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [(F.col(c) % N).cast("long").alias(a) for a, c in (("z", "l_suppkey"), ("y", "l_partkey"), ("x", "l_orderkey"))]
    return lines.groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("v"))


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = vox(spark, sf_dir)
    mean = volume.agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return volume.join(F.broadcast(mean), 2 * F.col("v") * F.col("n") > 3 * F.col("s")).select("z", "y", "x", "v")  # one row is broadcast


def dense_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(bright(spark, sf_dir), SHAPE)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {VOX_SQL} SELECT * FROM vox")
def voxelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir)


@query(f"WITH {VOX_SQL} SELECT CAST((z * 32 + y) * 32 + x AS BIGINT) AS id, z, y, x FROM vox")
def flat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).select(flat_index(SHAPE).alias("id")).select("id", *coordinates(F.col("id"), SHAPE))


@query(f"WITH {STATE_SQL} SELECT * FROM u0")
def mask_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_mask(spark, sf_dir).select("z", "y", "x", P.binarize(F.col("v")).alias("u"))


@query(f"WITH {VOX_SQL} SELECT z, y, x, CAST(least(greatest(floor(v / 256.0e0 * 255.0e0), 0), 255) AS SMALLINT) AS g FROM vox")
def grey_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).select("z", "y", "x", P.quantize(F.col("v") / F.lit(256.0)).alias("g"))


@query(f"WITH {VOX_SQL} SELECT z, y, x, v / 64.0e0 = 1.0e0 AS mask FROM vox")
def source_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).select("z", "y", "x", P.is_source(F.col("v") / F.lit(64.0)).alias("mask"))


@query(f"WITH {VOX_SQL} SELECT z, y, x, CASE WHEN v > 64 THEN 1.0e0 ELSE v / 64.0e0 END AS u FROM vox")
def illuminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).select("z", "y", "x", P.illuminate(F.col("v") / F.lit(64.0), F.col("v") > 64).alias("u"))


@query(f"WITH {VOX_SQL} SELECT * FROM vox WHERE z >= 8 AND z < 16 AND y >= 4 AND y < 28 AND x >= 0 AND x < 32")
def slab_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).where(in_box(Shape(8, 4, 0), Shape(16, 28, 32)))


@query(f"WITH {VOX_SQL} SELECT * FROM vox WHERE z = 7")
def plane_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.plane(vox(spark, sf_dir), "z", PLANES - 1)


@query(f"WITH {VOX_SQL} SELECT 'z' AS plane, y AS r, x AS c, v FROM vox WHERE z = 16 UNION ALL SELECT 'y', z, x, v FROM vox WHERE y = 16 UNION ALL SELECT 'x', z, y, v FROM vox WHERE x = 16")
def mid_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.middle_planes(vox(spark, sf_dir), SHAPE)


@query(f"WITH {GRID_SQL} SELECT y AS row, string_agg(CAST(CAST(floor(least(coalesce(v, 0), 1024) / 1024.0e0 * 255.0e0) AS BIGINT) AS VARCHAR), ' ' ORDER BY x) AS line FROM grid LEFT JOIN vox USING (z, y, x) WHERE z = 16 GROUP BY y")
def pgm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = images.plane(densify(vox(spark, sf_dir), SHAPE), "z", N // 2)
    return images.pgm_rows(middle, F.least(F.col("v"), F.lit(1024)) / F.lit(1024.0), "y", "x")


BIN_SQL = "CAST(floor(15.0e0 * ((CAST(v AS DOUBLE) - 20.0e0) / 180.0e0)) AS BIGINT)"
IN_SQL = "v <> 0 AND v BETWEEN 20 AND 200"
R_SQL = "CAST(floor(sqrt(CAST((y - 16) * (y - 16) + (x - 16) * (x - 16) AS DOUBLE))) AS BIGINT)"


@query(f"WITH {VOX_SQL} SELECT z, y, x, {BIN_SQL} AS bin FROM vox WHERE {IN_SQL}")
def value_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).where((F.col("v") != 0) & F.col("v").between(LOW, HIGH)).select("z", "y", "x", P.value_bin(F.col("v"), LOW, HIGH, BINS).alias("bin"))


@query(f"WITH {VOX_SQL} SELECT z, y, x, {R_SQL} AS r FROM vox")
def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox(spark, sf_dir).select("z", "y", "x", P.radius(F.col("y"), F.col("x"), *CENTER).alias("r"))


@query(f"WITH {VOX_SQL} SELECT coalesce(v BETWEEN 0 AND 100, false) AS inside, count(*) AS n FROM vox GROUP BY 1")
def label_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.check_labels(vox(spark, sf_dir).withColumnRenamed("v", "label"), 100)


def _axis_query(axis: str, pos: str, also: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return H.axis_histogram(vox(spark, sf_dir), axis, LOW, HIGH, BINS, CENTER, MOST_RADIUS)

    QUERIES[f"axis_hist_{axis}"] = run
    ORACLE_SQL[f"axis_hist_{axis}"] = f"WITH {VOX_SQL} SELECT '{axis}' AS axis, {pos} AS pos, {BIN_SQL} AS bin, count(*) AS n FROM vox WHERE {IN_SQL}{also} GROUP BY ALL"


for _axis in ("z", "y", "x"):
    _axis_query(_axis, _axis)
_axis_query("r", R_SQL, f" AND {R_SQL} < {MOST_RADIUS}")
ALL_AXES_SQL = " UNION ALL ".join(ORACLE_SQL[f"axis_hist_{a}"].removeprefix(f"WITH {VOX_SQL} ") for a in "zyxr")


@query(f"WITH {VOX_SQL} {ALL_AXES_SQL}")
def axis_hist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.axis_histograms(vox(spark, sf_dir), LOW, HIGH, BINS, CENTER, MOST_RADIUS)


@query(ORACLE_SQL["axis_hist_all"])
def stream_hist_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that ends halfway, and from another that goes on with what came since."""
    folder = new_folder(spark, "vox-stream")
    volume = materialise(vox(spark, sf_dir), "vox")
    for half in ("z < 16", "z >= 16"):
        volume.where(half).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(volume.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        stored_histograms(stream, folder, LOW, HIGH, BINS, CENTER, MOST_RADIUS).awaitTermination()
    return read_histograms(spark, folder)


@query(ORACLE_SQL["axis_hist_y"])
def hist_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = vox(spark, sf_dir)
    parts = [H.axis_histogram(volume.where(c), "y", LOW, HIGH, BINS) for c in ("z < 11", "z >= 11 and z < 20", "z >= 20")]
    return H.add_histograms(*parts)


FIELD_SQL = "field AS (SELECT CAST(o_custkey % 8 AS BIGINT) AS fz, CAST(o_orderkey % 8 AS BIGINT) AS fy, CAST(CAST(floor(o_orderkey / 8.0e0) AS BIGINT) % 8 AS BIGINT) AS fx, CAST(sum(o_orderkey) % 1000 AS BIGINT) AS f FROM orders GROUP BY 1, 2, 3)"


@query(
    f"WITH {VOX_SQL}, {FIELD_SQL} SELECT CAST(floor(15.0e0 * ((CAST(f AS DOUBLE) - 1.0e0) / 999.0e0)) AS BIGINT) AS fbin, {BIN_SQL} AS vbin, CAST(count(*) AS BIGINT) AS n FROM vox JOIN field "
    f"ON fz = CAST(floor(z * 0.25e0) AS BIGINT) AND fy = CAST(floor(y * 0.25e0) AS BIGINT) AND fx = CAST(floor(x * 0.25e0) AS BIGINT) WHERE {IN_SQL} AND f > 0 AND f BETWEEN 1 AND 1000 GROUP BY ALL"
)
def field_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.field_histogram(vox(spark, sf_dir), SHAPE, _field(spark, sf_dir), FIELD, BINS, LOW, HIGH, FIELD_LOW, FIELD_HIGH)


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = [(F.col("o_custkey") % COARSE).cast("long").alias("z"), (F.col("o_orderkey") % COARSE).cast("long").alias("y"), (F.floor(F.col("o_orderkey") / F.lit(8.0)).cast("long") % COARSE).alias("x")]
    return orders.groupBy(*keys).agg((F.sum("o_orderkey") % 1000).cast("long").alias("f"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pack_values(vox(spark, sf_dir), SHAPE, BRICK)


@query(f"WITH {VOX_SQL} {ALL_AXES_SQL}")
def packed_hist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from packed bricks."""
    return H.packed_histograms(_values(spark, sf_dir), LOW, HIGH, BINS, CENTER, MOST_RADIUS)


@query(ORACLE_SQL["field_hist"])
def packed_field_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.packed_field_histogram(_values(spark, sf_dir), SHAPE, _field(spark, sf_dir), FIELD, BINS, LOW, HIGH, FIELD_LOW, FIELD_HIGH)


@query(f"WITH {VOX_SQL} SELECT z, y, x, CASE WHEN z >= 8 AND z < 16 THEN 2 * v ELSE v END AS v FROM vox WHERE z >= 4 AND z < 20 AND y >= 9 AND y < 31 AND x >= 3 AND x < 32")
def stored_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a store of bricks in which one slab was written again."""
    path = new_folder(spark, "vox-store")
    store.store_volume(vox(spark, sf_dir), path, SHAPE, BRICK)
    slab = store.read_store(spark, path, Shape(8, 0, 0), Shape(16, N, N), BRICK)
    store.update_store(slab.withColumn("v", 2 * F.col("v")), path, SHAPE, BRICK)
    return store.read_store(spark, path, Shape(4, 9, 3), Shape(20, 31, N), BRICK)


def _conv_sql(source: str, axis: str, name: str, keep: str = "") -> str:
    """One axis pass of the kernel over the table ``source``."""
    taps = " + ".join(f"coalesce({f} OVER w, 0.0e0) * {k}e0" for f, k in (("lag(u, 2)", 0.0625), ("lag(u, 1)", 0.25)))
    taps += " + u * 0.375e0 + " + " + ".join(f"coalesce({f} OVER w, 0.0e0) * {k}e0" for f, k in (("lead(u, 1)", 0.25), ("lead(u, 2)", 0.0625)))
    others = ", ".join(a for a in "zyx" if a != axis)
    return f"{name} AS (SELECT z, y, x{keep}, {taps} AS u FROM {source} WINDOW w AS (PARTITION BY {others} ORDER BY {axis}))"


def _repetition_sql(source: str, name: str) -> str:
    steps = [f"{name}m AS (SELECT *, u = 1.0e0 AS m FROM {source})"]
    steps += [_conv_sql(f"{name}{a}", b, f"{name}{b}", ", m") for a, b in (("m", "z"), ("z", "y"), ("y", "x"))]
    return ", ".join([*steps, f"{name} AS (SELECT z, y, x, CASE WHEN m THEN 1.0e0 ELSE u END AS u FROM {name}x)"])


def _conv_query(axis: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.correlate_axis(mask_binarize(spark, sf_dir), axis, KERNEL)

    QUERIES[f"conv_axis_{axis}"] = run
    ORACLE_SQL[f"conv_axis_{axis}"] = f"WITH {STATE_SQL}, {_conv_sql('u0', axis, 'c')} SELECT * FROM c"


for _axis in ("z", "y", "x"):
    _conv_query(_axis)
TWICE_SQL = f"WITH {STATE_SQL}, {_repetition_sql('u0', 'once_')}, {_repetition_sql('once_', 'twice_')}"
CORNER, SMALL = "z < 9 AND y < 9 AND x < 9", 6  # sources of one corner, bricks of 6 voxels a side
CORNER_SQL = f"WITH {STATE_SQL}, corner AS (SELECT z, y, x, CASE WHEN {CORNER} THEN u ELSE 0.0e0 END AS u FROM u0), {_repetition_sql('corner', 'once_')}, {_repetition_sql('once_', 'twice_')}"


@query(f"WITH {STATE_SQL}, {_conv_sql('u0', 'x', 'c')} SELECT * FROM c WHERE u <> 0")
def conv_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = bright(spark, sf_dir).select("z", "y", "x", P.binarize(F.col("v")).alias("u"))
    return D.scatter_axis(lit, SHAPE, "x", KERNEL).where("u <> 0")


@query(f"WITH {STATE_SQL}, {_repetition_sql('u0', 'once_')} SELECT * FROM once_")
def diffuse_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diffuse(dense_mask(spark, sf_dir), KERNEL, 1)


@query(f"{TWICE_SQL} SELECT * FROM twice_")
def diffuse_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diffuse(dense_mask(spark, sf_dir), KERNEL, 2)


@query(f"{TWICE_SQL} SELECT z, y, x, CAST(least(greatest(floor(u * 255.0e0), 0), 255) AS SMALLINT) AS g FROM twice_")
def diffuse_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.to_grey(D.diffuse(dense_mask(spark, sf_dir), KERNEL, 2))


@query(f"WITH {STATE_SQL}, {_repetition_sql('u0', 'once_')} SELECT * FROM once_")
def diffuse_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = D.to_blocks(bright(spark, sf_dir), SHAPE, PLANES)
    return D.from_blocks(D.diffuse_blocks(blocks, SHAPE, KERNEL, 1, PLANES), SHAPE, PLANES)


@query(f"{TWICE_SQL} SELECT * FROM twice_")
def diffuse_bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bricks cut on all axes, at the end of an axis smaller than the kernel."""
    blocks = D.to_blocks(bright(spark, sf_dir), SHAPE, BRICK)
    return D.from_blocks(D.diffuse_blocks(blocks, SHAPE, KERNEL, 2, BRICK), SHAPE, BRICK)


@query(f"{CORNER_SQL} SELECT z // {SMALL} AS bz, y // {SMALL} AS \"by\", x // {SMALL} AS bx, count(*) FILTER (WHERE u <> 0) AS lit, sum(u) AS total FROM twice_ GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE u <> 0) > 0")
def diffuse_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright voxels of one corner only: the bricks that values have reached, and what they hold."""
    small = Shape(SMALL, SMALL, SMALL)
    blocks = D.to_blocks(bright(spark, sf_dir).where(CORNER), SHAPE, small, sparse=True)
    found = D.from_blocks(D.diffuse_blocks(blocks, SHAPE, KERNEL, 2, small, sparse=True), SHAPE, small)
    place = [F.expr(f"{a} div {SMALL}").alias(f"b{a}") for a in ("z", "y", "x")]
    return found.groupBy(*place).agg(F.count_if(F.col("u") != 0).alias("lit"), F.sum("u").alias("total"))


@query(f"{TWICE_SQL} SELECT * FROM twice_")
def diffuse_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that stops after one repetition, and one that goes on from its state."""
    state = new_folder(spark, "vox-state")
    blocks = D.to_blocks(bright(spark, sf_dir), SHAPE, BRICK)
    D.diffuse_blocks(blocks, SHAPE, KERNEL, 1, BRICK, state)
    return D.from_blocks(D.diffuse_blocks(blocks, SHAPE, KERNEL, 2, BRICK, state), SHAPE, BRICK)


@query(
    f"WITH {STATE_SQL}, t AS (SELECT unnest(range(0, 4)) AS t), w AS (SELECT t, greatest(t * 8 - 2, 0) AS lo, least(t * 8 + 10, 32) AS hi FROM t) "
    "SELECT CAST(t AS BIGINT) AS slab, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high, CAST(sum(CASE WHEN z < t * 8 OR z >= t * 8 + 8 THEN u ELSE 0 END) AS BIGINT) AS halo, CAST(sum(u) AS BIGINT) AS total FROM w JOIN u0 ON z >= lo AND z < hi GROUP BY t, lo, hi"
)
def halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slab gets: sums of the values in its own and in its halo planes."""
    parts = D.exchange_halo(D.to_blocks(bright(spark, sf_dir), SHAPE, PLANES), SHAPE, 2, PLANES)

    def sums(batches):  # noqa: ANN001, ANN202
        for b in batches:
            b["total"] = [int(np.frombuffer(d, np.float32).sum()) for d in b["data"]]
            yield b[["bz", "z0", "nz", "total"]]

    own = (F.col("z0") >= F.col("bz") * PLANES) & (F.col("z0") < (F.col("bz") + 1) * PLANES)
    summed = parts.mapInPandas(sums, "bz long, z0 long, nz long, total long")
    return summed.groupBy(F.col("bz").alias("slab")).agg(F.min("z0").alias("low"), F.max(F.col("z0") + F.col("nz")).alias("high"), F.sum(F.when(~own, F.col("total")).otherwise(0)).alias("halo"), F.sum("total").alias("total"))


# Components by reachability over faces; a label is the smallest flat index it reaches.
def _reach_sql(name: str, same: str) -> str:
    steps = " UNION ALL ".join(f"SELECT a.id AS f, b.id AS t FROM cell a JOIN cell b ON {k}{same}" for k in ("a.z = b.z AND a.y = b.y AND a.x = b.x + {d}", "a.z = b.z AND a.x = b.x AND a.y = b.y + {d}", "a.y = b.y AND a.x = b.x AND a.z = b.z + {d}"))
    edges = " UNION ALL ".join(steps.format(d=d) for d in (1, -1))
    return f"{name}_e AS ({edges}), {name}_r(id, root) AS (SELECT id, id FROM cell UNION SELECT e.t, r.root FROM {name}_r r JOIN {name}_e e ON e.f = r.id WHERE r.root < e.t), {name} AS (SELECT id, min(root) AS root FROM {name}_r GROUP BY id)"


CELL_SQL = f"WITH RECURSIVE {MASK_SQL}, cell AS (SELECT CAST((z * 32 + y) * 32 + x AS BIGINT) AS id, z, y, x, CAST(floor(z / 8.0e0) AS BIGINT) AS chunk FROM bright)"
LABEL_SQL = f"{CELL_SQL}, {_reach_sql('whole', '')}, lab AS (SELECT z, y, x, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS label FROM cell JOIN whole USING (id))"
CHUNK_SQL = f"{CELL_SQL}, {_reach_sql('part', ' AND a.chunk = b.chunk')}, lab AS (SELECT chunk, z, y, x, CAST(dense_rank() OVER (PARTITION BY chunk ORDER BY root) AS BIGINT) AS label FROM cell JOIN part USING (id))"
NAMES_SQL = "names AS (SELECT label, CAST(min((z * 32 + y) * 32 + x) AS BIGINT) AS id, count(*) AS size FROM lab GROUP BY label)"
EDGE_SQL = "edge AS (SELECT DISTINCT a.chunk, a.label AS la, b.label AS lb FROM lab a JOIN lab b ON a.z = b.z - 1 AND a.y = b.y AND a.x = b.x AND a.chunk = b.chunk - 1)"
ZYX_SQL = "CAST(id // 1024 AS BIGINT) AS z, CAST(id // 32 % 32 AS BIGINT) AS y, CAST(id % 32 AS BIGINT) AS x"


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(C.label_chunks(bright(spark, sf_dir), PLANES), "chunk-voxels")


@query(f"{CHUNK_SQL} SELECT * FROM lab")
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_chunks(bright(spark, sf_dir), PLANES)


@query(f"{CHUNK_SQL}, {EDGE_SQL} SELECT * FROM edge")
def seam_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.seam_edges(_chunked(spark, sf_dir), PLANES)


@query(
    f"{CHUNK_SQL}, {EDGE_SQL} SELECT chunk, 'a' AS side, la AS label, count(*) AS n, string_agg(CAST(lb AS VARCHAR), ' ' ORDER BY lb) AS neighbours FROM edge GROUP BY ALL"
    " UNION ALL SELECT chunk, 'b', lb, count(*), string_agg(CAST(la AS VARCHAR), ' ' ORDER BY la) FROM edge GROUP BY ALL"
)
def seam_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.seam_mappings(C.seam_edges(_chunked(spark, sf_dir), PLANES))
    words = F.concat_ws(" ", F.transform("neighbours", lambda v: v.cast("string")))
    return found.select("chunk", "side", "label", F.size("neighbours").cast("long").alias("n"), words.alias("neighbours"))


@query(
    f"{CHUNK_SQL}, {EDGE_SQL}, n AS (SELECT chunk, 'a' AS side, la AS label, CASE WHEN lb % 3 = 0 THEN lb // 3 + chunk + 1 ELSE lb END AS one FROM edge UNION ALL SELECT chunk, 'b', lb, CASE WHEN la % 3 = 0 THEN la // 3 + chunk ELSE la END FROM edge), d AS (SELECT DISTINCT * FROM n)"
    " SELECT chunk, side, label, count(*) AS n, string_agg(CAST(one AS VARCHAR), ' ' ORDER BY one) AS neighbours FROM d GROUP BY ALL"
)
def rename_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _chunked(spark, sf_dir)
    lut = labels.where("label % 3 = 0").select("chunk", "label").distinct().withColumn("new", (F.col("label") / 3).cast("long") + F.col("chunk"))
    found = C.rename_sets(C.seam_mappings(C.seam_edges(labels, PLANES)), lut)
    words = F.concat_ws(" ", F.transform("neighbours", lambda v: v.cast("string")))
    return found.select("chunk", "side", "label", F.size("neighbours").cast("long").alias("n"), words.alias("neighbours"))


@query(f"{LABEL_SQL} SELECT * FROM lab")
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.components(bright(spark, sf_dir), PLANES)


@query(f"{LABEL_SQL} SELECT * FROM lab")
def brick_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from bricks cut on all axes."""
    return C.components(bright(spark, sf_dir), BRICK)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = materialise(B.label_bricks(B.pack_masks(bright(spark, sf_dir), SHAPE, BRICK)), "label-bricks")
    return B.merge_bricks(labelled)


@query(f"{LABEL_SQL} SELECT * FROM lab")
def packed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from packed bricks: labels meet by boundary planes, not by voxels."""
    return B.unpack(_packed(spark, sf_dir))


@query(f"{LABEL_SQL}, {NAMES_SQL} SELECT label, {ZYX_SQL}, size FROM names")
def packed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.packed_names(_packed(spark, sf_dir)).where("label <> 0")


HALVES_SQL = f"{CELL_SQL}, {_reach_sql('whole', '')}, {_reach_sql('part', ' AND a.chunk = b.chunk')}".replace("z / 8.0e0", "z / 16.0e0")


@query(
    f"{HALVES_SQL}, lab AS (SELECT chunk, CAST(dense_rank() OVER (PARTITION BY chunk ORDER BY part.root) AS BIGINT) AS label, whole.root AS g FROM cell JOIN part USING (id) JOIN whole USING (id)), "
    "kinds AS (SELECT g, CASE WHEN count(DISTINCT chunk) = 2 THEN 0 ELSE 1 + min(chunk) END AS kind, coalesce(min(label) FILTER (chunk = 0), min(label)) AS first FROM lab GROUP BY g), "
    "numbered AS (SELECT g, row_number() OVER (ORDER BY kind, first) AS new FROM kinds) SELECT DISTINCT CASE WHEN chunk = 0 THEN 'a' ELSE 'b' END AS side, label, new FROM lab JOIN numbered USING (g)"
)
def pair_renaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower and the upper half, labelled apart, get one numbering."""
    halves = materialise(C.label_chunks(bright(spark, sf_dir), N // 2), "halves")
    labels = halves.select(F.when(F.col("chunk") == 0, "a").otherwise("b").alias("side"), "label")
    return C.pair_renaming(labels, C.seam_edges(halves, N // 2).select("la", "lb"))


OTHER_CELLS_SQL = f"{CELL_SQL.removesuffix(')')} WHERE NOT (z >= 16 AND z < 24 AND v % 2 = 1)), {_reach_sql('whole', '')}, {_reach_sql('part', ' AND a.chunk = b.chunk')}"


@query(
    f"{OTHER_CELLS_SQL}, lab AS (SELECT chunk, CAST(dense_rank() OVER (PARTITION BY chunk ORDER BY part.root) AS BIGINT) AS label, whole.root AS g FROM cell JOIN part USING (id) JOIN whole USING (id))"
    " SELECT DISTINCT chunk, label, min(chunk * 1000000 + label) OVER (PARTITION BY g) AS least FROM lab"
)
def chunk_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk label with the least one of its component, after one chunk of merged ones was
    replaced by another."""
    volume = bright(spark, sf_dir)
    labels = materialise(C.label_chunks(volume, PLANES), "chunk-voxels")
    edges = lambda of: C.seam_edges(of, PLANES).select("chunk", "la", (F.col("chunk") + 1).alias("other"), "lb")
    state = C.merged_chunks(labels.groupBy("chunk", "label").agg(F.min(F.struct("z", "y", "x")).alias("first")), edges(labels))
    other = materialise(C.label_chunks(volume.where("z >= 16 and z < 24 and v % 2 = 0"), PLANES), "chunk-voxels")
    near = labels.where("chunk in (1, 3)").unionByName(other)
    found = C.replace_chunk(state, 2, other.select("label"), edges(near)).labels
    return found.select("chunk", "label", F.min(F.col("chunk") * 1000000 + F.col("label")).over(Window.partitionBy("new")).alias("least"))


UNEQUAL = (0, 5, 6, 20, 23, 32)  # where z-slabs of unequal heights begin, and the end


@query(f"{LABEL_SQL} SELECT * FROM lab")
def given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that come with the chunks, slabs of unequal heights, merge to those of the whole."""
    parts = []
    for k, (a, b) in enumerate(zip(UNEQUAL[:-1], UNEQUAL[1:], strict=True)):
        own = C.label_chunks(bright(spark, sf_dir).where(F.col("z").between(a, b - 1)), N)
        parts.append(own.withColumn("chunk", F.lit(k).cast("long")).withColumn("label", F.col("label") * 10))
    return C.merge_labels(materialise(reduce(DataFrame.unionByName, parts), "given-labels"))


@query(f"{LABEL_SQL} SELECT count(DISTINCT label) AS components, count(*) AS voxels FROM lab")
def components_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = C.label_sizes(C.components(bright(spark, sf_dir), PLANES))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("voxels"))  # no bright voxel: 0, not null


@query(f"{LABEL_SQL}, {NAMES_SQL} SELECT label, {ZYX_SQL}, size FROM names")
def component_names_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.names_and_sizes(C.components(bright(spark, sf_dir), PLANES))


@query(f"{LABEL_SQL}, full_lab AS (SELECT (z * 32 + y) * 32 + x AS i, coalesce(label, 0) AS label FROM grid_all LEFT JOIN lab USING (z, y, x)) SELECT CAST(label AS BIGINT) AS label, CAST(min(i) // 1024 AS BIGINT) AS z, CAST(min(i) // 32 % 32 AS BIGINT) AS y, CAST(min(i) % 32 AS BIGINT) AS x, count(*) AS size FROM full_lab GROUP BY label".replace("grid_all", "(SELECT a.z, b.y, c.x FROM (SELECT unnest(range(0, 32)) AS z) a, (SELECT unnest(range(0, 32)) AS y) b, (SELECT unnest(range(0, 32)) AS x) c) g"))
def names_with_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.names_and_sizes(C.with_background(C.components(bright(spark, sf_dir), PLANES), SHAPE))


@query(f"{LABEL_SQL} SELECT label, count(*) AS size FROM lab GROUP BY label")
def label_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_sizes(C.components(bright(spark, sf_dir), PLANES))


@query(f"{CHUNK_SQL} SELECT chunk, z, y, x, CASE WHEN label <= 100 THEN label + 1000 * chunk ELSE label END AS label FROM lab")
def apply_renaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _chunked(spark, sf_dir)
    lut = labels.where("label <= 100").select("chunk", "label").distinct().withColumn("new", F.col("label") + 1000 * F.col("chunk"))
    return C.apply_renaming(labels, lut)


@query(f"{CHUNK_SQL}, named AS (SELECT CASE WHEN label <= 100 THEN label + 1000 * chunk ELSE label END AS label FROM lab) SELECT count(*) AS voxels, count(*) FILTER (WHERE label > 1050) AS rejects, max(label) AS largest FROM named")
def relabel_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a relabelling saw while it was written."""
    labels = _chunked(spark, sf_dir)
    lut = labels.where("label <= 100").select("chunk", "label").distinct().withColumn("new", F.col("label") + 1000 * F.col("chunk"))
    _, seen = C.relabel_observed(labels, lut, 1050)
    return spark.createDataFrame([tuple(seen[k] for k in ("voxels", "rejects", "largest"))], "voxels long, rejects long, largest long")


@query(f"{CHUNK_SQL} SELECT DISTINCT chunk, label, CASE WHEN (label + 1) % 3 = 0 THEN (label + 1) * 10 ELSE label + 1 END AS new FROM lab")
def lut_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _chunked(spark, sf_dir).select("chunk", "label").distinct()
    first = known.withColumn("new", F.col("label") + 1)
    then = first.where("new % 3 = 0").select("chunk", F.col("new").alias("label"), (F.col("new") * 10).alias("new"))
    return C.compose_renaming(first, then)


@query(f"WITH {VOX_SQL}, c AS (SELECT DISTINCT CAST(floor(z / 2.0e0) AS BIGINT) AS j FROM vox) SELECT CAST(CASE WHEN j % 2 = 0 THEN 0 WHEN j % 4 = 1 THEN 1 WHEN j % 8 = 3 THEN 2 ELSE 3 END AS BIGINT) AS layer, j AS l, j + 1 AS r FROM c WHERE j < (SELECT max(j) FROM c)")
def merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_tree(vox(spark, sf_dir).select(F.floor(F.col("z") / 2.0).cast("long").alias("chunk")))


@query(f"WITH {VOX_SQL}, a AS (SELECT v AS label, min((z * 32 + y) * 32 + x) AS id FROM vox WHERE z < 16 GROUP BY v), b AS (SELECT v AS label, min((z * 32 + y) * 32 + x) AS id FROM vox WHERE z >= 16 GROUP BY v), m AS (SELECT label, coalesce(a.id, b.id) AS id FROM a FULL JOIN b USING (label)) SELECT label, {ZYX_SQL} FROM m")
def merge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vox(spark, sf_dir).withColumnRenamed("v", "label")
    return C.merge_names(C.names_and_sizes(labels.where("z < 16")), C.names_and_sizes(labels.where("z >= 16")))


@query(f"{LABEL_SQL}, {NAMES_SQL}, n AS (SELECT {ZYX_SQL}, size FROM names) SELECT z, y, x, size, 'left' AS side FROM n WHERE size % 7 = 0 UNION ALL SELECT z, y, x, size + 1, 'right' FROM n WHERE size % 7 = 0")
def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialise(C.names_and_sizes(C.components(bright(spark, sf_dir), PLANES)), "names")
    return S.names_differ(names, names.withColumn("size", F.when(F.col("size") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))))


@query(f"WITH {VOX_SQL}, b AS (SELECT z, x AS y, y AS x, v FROM vox), d AS (SELECT abs(coalesce(vox.v, 0) - coalesce(b.v, 0)) AS d FROM vox FULL JOIN b USING (z, y, x)) SELECT round(avg(d), 6) AS mean, max(d) AS max, min(d) AS min, round(stddev_pop(d), 6) AS stddev FROM d")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vox(spark, sf_dir)
    found = S.difference_stats(a, a.select("z", F.col("x").alias("y"), F.col("y").alias("x"), "v"))
    return found.select(F.round("mean", 6).alias("mean"), "max", "min", F.round("stddev", 6).alias("stddev"))


@query(f"WITH {VOX_SQL} SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM vox")
def mean_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.mean_stddev(vox(spark, sf_dir))
    return found.select(F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query(f"WITH {VOX_SQL} SELECT max(v) AS max, bool_and(v = 0) AS all_zero FROM vox")
def value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_check(vox(spark, sf_dir))
