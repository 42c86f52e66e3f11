"""Driver queries, one or more for each operator, and equal SQL for another engine.

The arrays are cubes over the driver's tables: ``embeddings`` as (y = vec_id, x = dimension), events as a time
series, lineitem as a sparse cube. All run over whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import expr, kernels
from gridloom.array import NamedArray
from gridloom.operators.matching import compare_segmentations, iou_pairs
from gridloom.operators.segmentation import label_objects
from gridloom.operators.traces import label_counts, trace_cells
from gridloom.plans.partitions import SpatialTilePlan, TimeWindowPlan, as_table, deal
from gridloom.sources.frames import from_cells, from_vectors

DIM = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str, rows: int | None = None) -> NamedArray:
    """As many rows as the largest id asks for (or ``rows``): ids may leave gaps. Null and short vectors have
    null cells, as in the SQL."""
    df = read(spark, sf_dir, "embeddings")
    if rows is None:
        rows = df.agg(F.greatest(F.max("vec_id") + 1, F.lit(0))).first()[0]
    padded = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.get("embedding", i))
    df = df.withColumn("embedding", F.when(F.size("embedding") >= DIM, F.col("embedding")).otherwise(padded))
    return from_vectors(df, "vec_id", "embedding", ("y", "x"), (rows, DIM), "f4", uri=f"{sf_dir}/embeddings.parquet", chunks=(64, 16))


def doubles(spark: SparkSession, sf_dir: str, rows: int | None = None) -> NamedArray:
    return cube(spark, sf_dir, rows).astype("f8")


def labels(spark: SparkSession, sf_dir: str) -> NamedArray:
    df = read(spark, sf_dir, "embeddings")
    cells = df.select(F.col("vec_id").cast("bigint").alias("y"), F.col("label").alias("value"))
    return from_cells(cells, ("y",), (df.count(),), "i4", uri=f"{sf_dir}/embeddings.parquet", name="labels", chunks=(64,))


# One text for all: the cube in the other engine. CAST keeps FLOAT and DOUBLE apart.
E = "WITH c AS (SELECT vec_id, label, unnest(range(64)) d, unnest(embedding) v0 FROM embeddings), e AS (SELECT vec_id AS y, d::BIGINT AS x, label, v0, v0::DOUBLE v FROM c) "

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cte: str = E):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = cte + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _elementwise(name: str, build, sql: str, digits: int | None = 9, null: float | None = None) -> None:
    """``null``: what the SQL makes of a null cell, of which NumPy knows nothing, where that isn't null."""

    def run(spark, sf_dir):
        df = build(doubles(spark, sf_dir)).cells()
        if null is not None:
            df = df.withColumn("value", F.coalesce("value", F.lit(null)))
        return df if digits is None else rounded(df, "value", digits=digits)

    run.__name__ = f"ufunc_{name}"
    value = sql if digits is None else f"round({sql}, {digits})"
    query(f"SELECT y, x, {value} AS value FROM e")(run)


T = "0.1::DOUBLE"
_elementwise("absolute", lambda a: abs(a), "abs(v)")
_elementwise("add", lambda a: a + 0.1, f"v + {T}")
_elementwise("subtract", lambda a: a - 0.1, f"v - {T}")
_elementwise("multiply", lambda a: a * 0.1, f"v * {T}")
_elementwise("divide", lambda a: a / 0.1, f"v / {T}")
_elementwise("divide_by_zero", lambda a: a / 0.0, "CASE WHEN v = 0 THEN 'nan'::DOUBLE WHEN v > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END", None, -np.inf)
_elementwise("floor_divide", lambda a: a // 0.1, f"floor(v / {T})", None)
_elementwise("remainder", lambda a: a % -0.07, "CASE WHEN v % (-0.07)::DOUBLE > 0 THEN v % (-0.07)::DOUBLE - 0.07::DOUBLE ELSE v % (-0.07)::DOUBLE END")
_elementwise("power", lambda a: a**2.0, "power(v, 2)")
_elementwise("negative", lambda a: -a, "-v")
_elementwise("positive", lambda a: +a, "v")
_elementwise("maximum", lambda a: np.maximum(a, 0.05), "greatest(v, 0.05::DOUBLE)")
_elementwise("minimum", lambda a: np.minimum(a, 0.05), "least(v, 0.05::DOUBLE)")
_elementwise("sqrt", lambda a: np.sqrt(abs(a)), "sqrt(abs(v))")
_elementwise("exp", lambda a: np.exp(a), "exp(v)")
_elementwise("expm1", lambda a: np.expm1(a), "exp(v) - 1")
_elementwise("log", lambda a: np.log(a), "CASE WHEN v < 0 THEN 'nan'::DOUBLE WHEN v = 0 THEN '-inf'::DOUBLE ELSE round(ln(CASE WHEN v > 0 THEN v ELSE 1 END), 9) END")
_elementwise("log1p", lambda a: np.log1p(abs(a)), "ln(1 + abs(v))")
_elementwise("sin", lambda a: np.sin(a), "sin(v)")
_elementwise("cos", lambda a: np.cos(a), "cos(v)")
_elementwise("tan", lambda a: np.tan(a), "tan(v)")
for _name, _op in (("equal", "="), ("not_equal", "<>"), ("greater", ">"), ("greater_equal", ">="), ("less", "<"), ("less_equal", "<=")):
    _elementwise(_name, lambda a, _n=_name: getattr(np, _n)(a, 0.1), f"v {_op} {T}", None)
_elementwise("isnan", lambda a: np.isnan(np.log(a)), "v < 0", None)
_elementwise("isinf", lambda a: np.isinf(a / 0.0), "v <> 0", None)
_elementwise("isfinite", lambda a: np.isfinite(np.log(a)), "v > 0", None)
_elementwise("cast_truncate", lambda a: (a * 100.0).astype("i4"), "trunc(v * 100::DOUBLE)::INT", None)


@query("SELECT y, x, v0 + 0.1::FLOAT AS a, v0 * v0 AS m, (v0 / 0.1::FLOAT)::FLOAT AS q FROM e")
def float32_arithmetic(spark, sf_dir):
    a = cube(spark, sf_dir)
    parts = [(a + 0.1).cells().withColumnRenamed("value", "a"), (a * a).cells().withColumnRenamed("value", "m"), (a / 0.1).cells().withColumnRenamed("value", "q")]
    return parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])


@query("SELECT vec_id AS y, (((vec_id + 128) % 256 + 256) % 256 - 128)::TINYINT AS value FROM embeddings", "")
def cast_wrap(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("y"), F.col("vec_id").cast("int").alias("value"))
    return from_cells(df, ("y",), (df.count(),), "i4").astype("i1").cells()


@query("SELECT y - 100 AS y, x - 8 AS x, v0 AS value FROM e WHERE y >= 100 AND y < 200 AND x >= 8 AND x < 16")
def slice_cube(spark, sf_dir):
    return cube(spark, sf_dir)[100:200, 8:16].cells()


@query("SELECT 0::BIGINT AS y, x, round(sum(v), 9) AS sum, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean FROM e GROUP BY x")
def reduce_keepdims(spark, sf_dir):
    a = doubles(spark, sf_dir)
    frames = [getattr(a, n)("y", keepdims=True).cells().withColumnRenamed("value", n) for n in ("sum", "min", "max", "mean")]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, ["y", "x"])
    return rounded(out, "sum", "mean")


@query("SELECT x, round(max(v) - min(v) + avg(v), 9) AS value FROM e GROUP BY x")
def reduce_fused(spark, sf_dir):
    a = doubles(spark, sf_dir)
    return rounded((a.max("y") - a.min("y") + a.mean("y")).cells(), "value")


@query("SELECT x, median(v)::FLOAT AS value FROM e GROUP BY x")
def temporal_median(spark, sf_dir):
    return np.median(doubles(spark, sf_dir), axis="y").astype("f4").cells()


@query("SELECT x, round(quantile_cont(v, 0.9), 9) AS value FROM e GROUP BY x")
def percentile(spark, sf_dir):
    return rounded(doubles(spark, sf_dir).percentile(90, "y").cells(), "value")


@query("SELECT x, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS value FROM e GROUP BY x")
def quantile_range(spark, sf_dir):
    a = doubles(spark, sf_dir)
    return rounded((a.quantile(0.75, "y") - a.quantile(0.25, "y")).cells(), "value")


@query("SELECT x, CASE WHEN bool_or(v < 0) THEN 'nan'::DOUBLE ELSE round(median(ln(CASE WHEN v > 0 THEN v ELSE 1 END)), 9) END AS value FROM e GROUP BY x")
def reduce_nan(spark, sf_dir):
    return rounded(np.median(np.log(doubles(spark, sf_dir)), axis="y").cells(), "value")


@query("SELECT round(sum(v), 6) AS value FROM e")
def reduce_all(spark, sf_dir):
    return rounded(doubles(spark, sf_dir).sum().cells(), "value", digits=6)


@query("SELECT round(max(m), 6) AS value FROM (SELECT x, sum(v) AS m FROM e GROUP BY x)")
def reduce_nested(spark, sf_dir):
    return rounded(doubles(spark, sf_dir).sum("y").max().cells(), "value", digits=6)


@query("SELECT y, x, round((v - mn) / (mx - mn), 9) AS value FROM e CROSS JOIN (SELECT max(v) mx, min(v) mn FROM e)")
def staged_scalar(spark, sf_dir):
    a = doubles(spark, sf_dir)
    return rounded(((a - a.min()) / (a.max() - a.min())).cells(), "value")


HALO = """SELECT a.ty * 2 + b.tx AS tile, count(*) AS n_read, sum(CASE WHEN y >= ty*100 AND y < ty*100+100 AND x >= tx*32 AND x < tx*32+32 THEN 1 ELSE 0 END)::BIGINT AS n_own, round(max(v), 6) AS mx
FROM (SELECT unnest(range((SELECT (count(*)+99)//100 FROM embeddings))) ty) a CROSS JOIN (SELECT unnest(range(2)) tx) b JOIN e ON y >= ty*100-5 AND y < ty*100+105 AND x >= tx*32-4 AND x < tx*32+36 GROUP BY 1"""


@query(HALO)
def tiles_with_halo(spark, sf_dir):
    a = doubles(spark, sf_dir, read(spark, sf_dir, "embeddings").count())  # the SQL's tiles end there
    parts = SpatialTilePlan({"y": 100, "x": 32}, {"y": 5, "x": 4}).build(a.metadata)
    cells = deal(a.cells(), parts, a.axes)
    return cells.groupBy("tile").agg(F.count(F.lit(1)).alias("n_read"), F.sum(F.col("owned").cast("bigint")).alias("n_own"), F.round(F.max("value"), 6).alias("mx"))


def series(spark, sf_dir) -> NamedArray:
    """Events in order of their ids as a time series with irregular timestamps."""
    df = read(spark, sf_dir, "events")
    cells = df.select(F.col("event_id").cast("bigint").alias("time"), F.col("value"))
    times = df.select(F.col("event_id").cast("bigint").alias("time"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return from_cells(cells, ("time",), (df.count(),), "f8", uri=f"{sf_dir}/events.parquet", name="events", chunks=(1000,), times=times)


@query("""SELECT w AS tile, count(*) AS n_read, sum(CASE WHEN event_id // 1000 = w THEN 1 ELSE 0 END)::BIGINT AS n_own, round(sum(value), 4) AS total
FROM (SELECT unnest(range((SELECT (count(*)+999)//1000 FROM events))) w) JOIN events ON event_id >= w*1000-100 AND event_id < w*1000+1100 GROUP BY w""", "")
def time_windows(spark, sf_dir):
    a = series(spark, sf_dir)
    cells = deal(a.cells(), TimeWindowPlan(1000, 100).build(a.metadata), a.axes)
    return cells.groupBy("tile").agg(F.count(F.lit(1)).alias("n_read"), F.sum(F.col("owned").cast("bigint")).alias("n_own"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id // 1000 AS block, round(min(epoch_us(ts) / 1e6), 6) AS start, count(*) AS n FROM events GROUP BY 1", "")
def irregular_timestamps(spark, sf_dir):
    times = series(spark, sf_dir).selection.timestamps(spark)
    return times.groupBy(F.floor(F.col("time") / 1000).alias("block")).agg(F.round(F.min("t"), 6).alias("start"), F.count(F.lit(1)).alias("n"))


PARTS = "(SELECT i, i*1000 AS s, least((i+1)*1000, n) AS e, n FROM (SELECT unnest(range((n+999)//1000)) i, n FROM (SELECT count(*) n FROM events)))"


@query(f"SELECT i AS tile, greatest(0, s-100) AS read_start, least(n, e+100) AS read_stop, s AS start, e AS stop FROM {PARTS}", "")
def partition_plan(spark, sf_dir):
    a = series(spark, sf_dir)
    t = as_table(spark, TimeWindowPlan(1000, 100).build(a.metadata), a.axes)
    return t.select("tile", F.col("time_read_start").alias("read_start"), F.col("time_read_stop").alias("read_stop"), F.col("time_start").alias("start"), F.col("time_stop").alias("stop"))


@query(f"SELECT i AS tile, (least(n, e+100)-1)//64 - greatest(0, s-100)//64 + 1 AS chunks FROM {PARTS}", "")
def chunk_touches(spark, sf_dir):
    t = partition_plan(spark, sf_dir)
    return t.select("tile", (F.floor((F.col("read_stop") - 1) / 64) - F.floor(F.col("read_start") / 64) + 1).alias("chunks"))


@query("SELECT x AS time, label::BIGINT AS cell, round(avg(v)::FLOAT::DOUBLE, 5) AS value FROM e WHERE label <> 0 GROUP BY ALL")
def label_traces(spark, sf_dir):
    movie = cube(spark, sf_dir).cells().withColumnRenamed("x", "time")
    out = trace_cells(movie, labels(spark, sf_dir).cells(), ["y"])
    return out.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("SELECT vec_id // 64 AS chunk, label::BIGINT AS label, count(*) AS voxels FROM embeddings WHERE label <> 0 GROUP BY ALL", "")
def label_discovery(spark, sf_dir):
    return label_counts(labels(spark, sf_dir))


@query("""SELECT ((tile+1)::BIGINT << 32) + 1 AS label_id, 1::BIGINT AS local_label_id, tile, count(*) AS voxel_count, round(avg(y), 6) AS centroid_0, round(avg(x), 6) AS centroid_1,
min(y) AS bbox_min_0, max(y)+1 AS bbox_max_0, min(x) AS bbox_min_1, max(x)+1 AS bbox_max_1 FROM (SELECT y, x, (y//100)*2 + x//32 AS tile FROM e WHERE v > 0.1::DOUBLE) GROUP BY tile""")
def segmentation_objects(spark, sf_dir):
    a = doubles(spark, sf_dir)
    cells = (a > 0.1).astype("i4").cells()
    tiles = deal(cells, SpatialTilePlan({"y": 100, "x": 32}).build(a.metadata), a.axes)
    return rounded(label_objects(tiles, a.axes), "centroid_0", "centroid_1", digits=6)


IOU = "l AS (SELECT y, x, (CASE WHEN v > 0.1::DOUBLE THEN 1 + y//64 ELSE 0 END)::BIGINT p, (CASE WHEN v > 0.05::DOUBLE THEN 1 + label ELSE 0 END)::BIGINT r FROM e)"


@query(f"SELECT i.p, i.r, round(i.n / (a.n + b.n - i.n), 9) AS iou FROM (SELECT p, r, count(*) n FROM l WHERE p<>0 AND r<>0 GROUP BY ALL) i JOIN (SELECT p, count(*) n FROM l WHERE p<>0 GROUP BY p) a USING (p) JOIN (SELECT r, count(*) n FROM l WHERE r<>0 GROUP BY r) b USING (r)", E.rstrip() + ", " + IOU + " ")
def iou_matrix(spark, sf_dir):
    return iou_pairs(*_segmentations(spark, sf_dir), ("y", "x")).select("p", "r", F.round("iou", 9).alias("iou"))


def _segmentations(spark, sf_dir):
    cells = doubles(spark, sf_dir).cells()
    p = cells.select("y", "x", F.when(F.col("value") > 0.1, 1 + F.floor(F.col("y") / 64)).otherwise(0).alias("value"))
    named = labels(spark, sf_dir).cells().withColumnRenamed("value", "label")
    r = cells.join(named, "y").select("y", "x", F.when(F.col("value") > 0.05, 1 + F.col("label")).otherwise(0).cast("bigint").alias("value"))
    return p, r


@query(
    """, l AS (SELECT y, x, CASE WHEN v > 0.1::DOUBLE THEN 1 + y//64 ELSE 0 END p, CASE WHEN v > 0.05::DOUBLE THEN 1 + (y + 16)//64 ELSE 0 END r FROM e),
s AS (SELECT (SELECT count(DISTINCT p) FROM l WHERE p > 0) np, (SELECT count(DISTINCT r) FROM l WHERE r > 0) nr, (SELECT count(*) FROM l WHERE p > 0) vp, (SELECT count(*) FROM l WHERE r > 0) vr, (SELECT count(*) FROM l WHERE p > 0 AND r > 0) b),
i AS (SELECT k, (SELECT count(*) FROM l WHERE p = k AND r = k) / (SELECT count(*) FROM l WHERE p = k OR r = k) iou FROM (SELECT DISTINCT p k FROM l WHERE p > 0)),
m AS (SELECT count(*) n, avg(iou) a FROM i WHERE iou >= 0.2)
SELECT round(n/np, 9) AS precision, round(n/nr, 9) AS recall, round(2*(n/np)*(n/nr)/(n/np + n/nr), 9) AS f1, round(a, 9) AS mean_iou, round(2*b/(vp + vr), 9) AS dice, np AS predicted, nr AS reference FROM s, m""",
    E.rstrip(),
)
def segmentation_metrics(spark, sf_dir):
    """Bands of 64 rows against bands that lie 16 rows higher: each shares most with the one of its own number,
    which is hence the best matching."""
    cells = doubles(spark, sf_dir).cells()
    band = lambda low, shift: cells.select("y", "x", F.when(F.col("value") > low, 1 + F.floor((F.col("y") + shift) / 64)).otherwise(0).cast("long").alias("value"))
    m = compare_segmentations(band(0.1, 0), band(0.05, 16), ("y", "x"), 0.2)
    made = spark.createDataFrame([(m.precision, m.recall, m.f1, m.mean_matched_iou, m.foreground_dice, m.predicted, m.reference)], "precision double, recall double, f1 double, mean_iou double, dice double, predicted long, reference long")
    return rounded(made, "precision", "recall", "f1", "mean_iou", "dice")


@query("""SELECT d.t::BIGINT AS day, u.user_id AS user_id, coalesce(g.cents, 0)::BIGINT AS cents FROM (SELECT unnest(range(0, 30)) t) d CROSS JOIN (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT datediff('day', DATE '2024-01-01', ts::DATE) t, user_id, sum(round(value*100)::BIGINT) cents FROM events GROUP BY 1, 2) g ON g.t = d.t AND g.user_id = u.user_id""", "")
def event_grid(spark, sf_dir):
    """A dense (day, user) array from events, zero filled; the grid is days times the distinct users. The days
    are 0 to 29, as in the SQL, and on to the first and the last day that events have."""
    df = read(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    span = df.agg(F.least(F.min(day), F.lit(0)).cast("bigint").alias("first"), F.greatest(F.max(day), F.lit(29)).cast("bigint").alias("last"))
    users = df.select("user_id").distinct().crossJoin(F.broadcast(span))
    days = F.explode(F.sequence("first", "last"))
    sums = df.groupBy(day.alias("day"), "user_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return users.select(days.alias("day"), "user_id").join(sums, ["day", "user_id"], "left").select("day", "user_id", F.coalesce("cents", F.lit(0)).cast("bigint").alias("cents"))


@query("SELECT l_orderkey // 1000 AS ob, l_linenumber AS ln, sum(round(l_quantity*100)::BIGINT)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2", "")
def line_cube(spark, sf_dir):
    """A sparse cube whose coordinates repeat: aggregated before it is an array."""
    df = read(spark, sf_dir, "lineitem")
    return df.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("ob"), F.col("l_linenumber").alias("ln")).agg(F.sum(F.round(F.col("l_quantity") * 100).cast("bigint")).alias("q"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY event_type", "")
def table_query(spark, sf_dir):
    from gridloom.run import Table

    return Table(read(spark, sf_dir, "events")).query("value > 100").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below the session's checkpoint folder, else (on one
    machine) temporary."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=name) + "/out"


@query("SELECT 0::BIGINT AS y, x, round(max(v) - min(v), 9) AS value FROM e GROUP BY x")
def persisted_array(spark, sf_dir):
    """Written as chunk blocks with manifests, verified, and read again as a source."""
    a = doubles(spark, sf_dir)
    made = (a.max("y", keepdims=True) - a.min("y", keepdims=True)).persist(_folder(spark, "persisted"))
    return rounded(made.cells(), "value")


def _window_summary(block):
    return pd.DataFrame({"minimum": [float(block.min())], "maximum": [float(block.max())], "n": [block.size]})


def _windows_run(spark, sf_dir, folder):
    from gridloom.run import run
    from gridloom.storage.outputs import ParquetOutput

    a = series(spark, sf_dir)
    adapter = kernels.FunctionAdapter(_window_summary, kernels.OutputSchema("table", "summary"), requirements=kernels.Requirements(output_kinds=("table",)))
    return run(selection=a.selection, adapter=adapter, partition=TimeWindowPlan(1000), output=ParquetOutput(folder), spark=spark)


@query("SELECT min(value) AS minimum, max(value) AS maximum, count(*) AS n FROM events GROUP BY event_id // 1000", "")
def function_table(spark, sf_dir):
    return _windows_run(spark, sf_dir, _folder(spark, "windows")).execute().table().df


@query("SELECT true AS valid, ceil(count(*)/1000.0)::BIGINT AS partitions, 2::BIGINT AS attempts, 'complete' AS status FROM events", "")
def verify_and_resume(spark, sf_dir):
    """A finished run resumed computes nothing, and verifies."""
    folder = _folder(spark, "resume")
    done = _windows_run(spark, sf_dir, folder).execute()
    _windows_run(spark, sf_dir, folder).execute()
    report, record = done.verify(), done.record
    return spark.createDataFrame([(report["valid"], report["partitions"], record["attempts"], done.status)], "valid boolean, partitions long, attempts long, status string")


@query("SELECT ceil(count(*)/1000.0)::BIGINT AS tasks, 4*8*least(1000, count(*))::BIGINT AS memory, 1.0::DOUBLE AS amplification, 64::BIGINT AS identity FROM events", "")
def workflow_plan(spark, sf_dir):
    """Preflight numbers of a windowed workflow, without reading the values."""
    p = _windows_run(spark, sf_dir, _folder(spark, "plan")).plan
    return spark.createDataFrame([(p.task_count, p.memory_per_task, float(p.read_amplification), len(p.workflow_id))], "tasks long, memory long, amplification double, identity long")


@query("SELECT x, round(avg(v), 9) AS value, true AS same FROM e GROUP BY x")
def portable_expression(spark, sf_dir):
    """An expression rebuilt from its JSON, with the same identity and rows."""
    a = doubles(spark, sf_dir)
    first = a.mean("y").expression
    e = expr.from_dict(expr.to_dict(first))
    return rounded(NamedArray(a.selection, e, spark).cells(), "value").withColumn("same", F.lit(expr.identity(e) == expr.identity(first)))


@query("SELECT time, time // 1000 AS window_no, min(time) OVER w = time AS opens, value FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS time, value FROM events) WINDOW w AS (PARTITION BY time // 1000)", "")
def repaired_array(spark, sf_dir):
    """A persisted array of which outputs are damaged and lost: what is broken is computed again, and all of it read."""
    import os

    from gridloom.run import open_array, persist_workflow
    from gridloom.storage.outputs import ZarrOutput

    folder = _folder(spark, "repaired")
    a = series(spark, sf_dir)
    made = persist_workflow(a, ZarrOutput(folder), chunks=(1000,)).execute()
    root = made.root
    keys = made.keys()
    os.remove(f"{root}/arrays/result/0")
    os.remove(f"{root}/manifests/{keys[-1]}.json")
    wrong = set(made.verify()["problems"])
    if wrong != {keys[0], keys[-1]} or made.status == "complete" and len(keys) > 1:
        raise AssertionError(f"damage went unnoticed: {wrong}")
    persist_workflow(a, ZarrOutput(folder), chunks=(1000,)).execute()
    cells = open_array(folder, spark=spark).cells()
    return cells.select("time", F.floor(F.col("time") / 1000).alias("window_no"), (F.col("time") % 1000 == 0).alias("opens"), "value")


def _store(spark, name):
    """A store of one small movie and its labels, closed-form values: 10 x 3 x 4 numbers in order."""
    from gridloom.sources.zarr import local_path, write_object

    root = local_path(_folder(spark, name))
    movie = np.arange(120, dtype="f4").reshape(10, 3, 4)
    write_object(root, "acquisition/movie", movie, (2, 3, 4), rate=2.0, attributes={"neurodata_type": "ImageSeries", "type_hierarchy": ["TimeSeries"]}, compressor="zlib")
    write_object(root, "acquisition/other", movie[:2], (1, 3, 4), rate=1.0)
    write_object(root, "processing/irregular", movie[:4], (2, 3, 4), timestamps=[0.0, 0.4, 1.1, 2.0])
    write_object(root, "processing/labels", np.array([[1, 1, 0, 0], [1, 1, 2, 2], [0, 0, 2, 2]], "u4"), (3, 2), attributes={"axes": ["y", "x"]})
    return root


GRID = "WITH g AS (SELECT t::BIGINT AS time, y::BIGINT AS y, x::BIGINT AS x, (t*12 + y*4 + x)::FLOAT AS value FROM (SELECT unnest(range(10)) t) CROSS JOIN (SELECT unnest(range(3)) y) CROSS JOIN (SELECT unnest(range(4)) x)) "


@query("SELECT time, y, x, value FROM g WHERE time BETWEEN 2 AND 6", GRID)
def zarr_scan(spark, sf_dir):
    """load, select by name, a bounded scan of chunks."""
    from gridloom.run import load

    return load(_store(spark, "scan"), name="movie", spark=spark)[2:7].cells().selectExpr("time + 2 AS time", "y", "x", "value")


@query("SELECT * FROM (VALUES ('/acquisition/movie', 'movie', 3::BIGINT, 120::BIGINT, 'time,y,x'), ('/acquisition/other', 'other', 3, 24, 'time,y,x'), ('/processing/irregular', 'irregular', 3, 48, 'time,y,x'), ('/processing/labels', 'labels', 2, 12, 'y,x')) v(path, name, rank, cells, axes)", "")
def source_catalogue(spark, sf_dir):
    """inspect: what a store holds, from its metadata alone."""
    from gridloom.sources import open_source

    table = open_source(_store(spark, "catalogue")).objects_table(spark)
    return table.select("path", "name", F.size("shape").cast("long").alias("rank"), F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b).alias("cells"), F.concat_ws(",", "axes").alias("axes"))


def _outcomes(spark, cases: dict) -> DataFrame:
    """(name, outcome): what each call gives, or the name of its error."""
    rows = []
    for name, call in cases.items():
        try:
            rows.append((name, str(call())))
        except Exception as e:  # the outcome is the error
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, outcome string")


def _values(**cases: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cases.items()) + ") v(name, outcome)"


@query(_values(by_name="/acquisition/movie", by_path="/acquisition/other", by_type="/acquisition/movie", missing="ObjectNotFoundError", ambiguous="AmbiguousSelectionError", by_attribute="/processing/labels", nothing="SourceResolutionError", version="ValueError", archive="DANDI:000042@0.1", conflict="ValueError", hdf5="UnsupportedBackendError"), "")
def semantic_selection(spark, sf_dir):
    """Queries for objects and addresses of sources: what is found, and which error each failure is."""
    from gridloom.sources import open_source

    root = _store(spark, "selection")
    source = open_source(root)
    path = lambda **q: source.select(**q).metadata.path
    return _outcomes(spark, {
        "by_name": lambda: path(name="movie"), "by_path": lambda: path(path="/acquisition/other/"), "by_type": lambda: path(neurodata_type="TimeSeries"), "missing": lambda: path(name="none"),
        "ambiguous": lambda: source.select(), "by_attribute": lambda: path(where={"axes": ["y", "x"]}), "nothing": lambda: open_source(root + "/nothing"), "version": lambda: open_source(root, version="1"),
        "archive": lambda: (lambda i: f"{i.uri}@{i.version}")(open_source("DANDI:42@0.1").identity), "conflict": lambda: open_source("DANDI:42@0.1", version="0.2"), "hdf5": lambda: open_source("none.nwb"),
    })


@query("SELECT asset_id, path, size, checksum FROM (VALUES ('1', 'a.nwb', 3::BIGINT, 'sha2-256:s'), ('2', 'b.nwb', NULL, NULL)) v(asset_id, path, size, checksum)", "")
def archive_listing(spark, sf_dir):
    """All pages of an archive's assets, through an injected fetch function."""
    from gridloom.sources.archive import API, ArchiveSource

    pages = {"one": {"results": [{"asset_id": "1", "path": "a.nwb", "size": 3, "metadata": {"digest": {"dandi:sha2-256": "s"}}}], "next": f"{API}/two"}, "two": {"results": [{"asset_id": "2", "path": "b.nwb"}], "next": None}}
    source = ArchiveSource("42", fetch=lambda url: pages["two" if url.endswith("two") else "one"])
    return spark.createDataFrame([(a.asset_id, a.path, a.size, a.checksum) for a in source.assets()], "asset_id string, path string, size long, checksum string")


@query("SELECT CASE min(time) WHEN 0 THEN 0.0 WHEN 4 THEN 1.5 ELSE 3.5 END::DOUBLE AS start, least(9, max(time) + 1) / 2.0::DOUBLE AS stop, (least(9, max(time) + 1) - greatest(0, min(time) - 1) + 1)::BIGINT AS samples FROM (SELECT DISTINCT time FROM g) GROUP BY time // 4", GRID)
def time_series_windows(spark, sf_dir):
    """A time-series function on windows of 4 samples that overlap by 1, with the times of each."""
    from gridloom.run import load, run
    from gridloom.storage.outputs import ParquetOutput

    movie = load(_store(spark, "series"), name="movie", spark=spark)
    adapter = kernels.TimeSeriesAdapter(_times_summary, kernels.OutputSchema("table", "s"), requires_overlap=1)
    out = run(selection=movie.selection, adapter=adapter, partition=TimeWindowPlan(4, 1), output=ParquetOutput(_folder(spark, "series")), spark=spark, execute=True)
    return out.table().df.select("start", "stop", F.col("samples").cast("long").alias("samples"))


def _times_summary(series):
    t, v = series
    return {"start": float(t[0]), "stop": float(t[-1]), "samples": len(v)}


def _bright(block, level=50):
    from gridloom.operators.segmentation import objects_of

    found = (block > level).astype("u8")
    return found, objects_of(found)


@query("SELECT time, y, x, CASE WHEN value > 50 THEN ((time // 4 + 1)::BIGINT << 32) + 1 ELSE 0 END::BIGINT AS label FROM g", GRID)
def segmentation_run(spark, sf_dir):
    """A segmentation function on tiles with a halo: labels unique across tiles, written and read again."""
    from gridloom.operators.segmentation import SegmentationAdapter
    from gridloom.run import load
    from gridloom.storage.outputs import SegmentationOutput

    movie = load(_store(spark, "segments"), name="movie", spark=spark)
    work = movie.segment(SegmentationAdapter(_bright), tile={"time": 4}, halo={"time": 1}, output=SegmentationOutput(_folder(spark, "segments")), execute=True)
    return work.array("labels").cells().select("time", "y", "x", F.col("value").cast("long").alias("label"))


@query("SELECT time, c.cell::BIGINT AS cell, avg(value)::FLOAT AS value FROM g JOIN (VALUES (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 2, 2), (2, 3, 2)) c(y, x, cell) ON c.y = g.y AND c.x = g.x GROUP BY ALL", GRID)
def stored_traces(spark, sf_dir):
    """Traces of labelled cells, window by window, written and read again."""
    from gridloom.run import load

    root = _store(spark, "traces")
    movie, found = (load(root, name=n, spark=spark) for n in ("movie", "labels"))
    made = movie.extract_traces(found, output=_folder(spark, "traces")).matrix()
    rows = [(t, c + 1, float(made[t, c])) for t in range(made.shape[0]) for c in range(made.shape[1])]  # a fixture of 20 numbers
    return spark.createDataFrame(rows, "time long, cell long, value float")


@query(_values(gap="PartitionValidationError", overlap="PartitionValidationError", twice="PartitionValidationError", step="PartitionValidationError", rank="PartitionValidationError", bounds="PartitionValidationError", trim="PartitionValidationError", chunks="PartitionValidationError", halo="PartitionValidationError", reduced="PartitionValidationError", whole="None", asset="1", session="1", json="True", report="True,1", touched="3"), "")
def partition_rules(spark, sf_dir):
    """The proofs that partitions tile an array: malformed ones are refused, each for its own reason."""
    from gridloom.plans import partitions as P

    meta = series(spark, sf_dir).metadata
    n = meta.shape[0]

    def p(key, a, b, trim=None):
        return P.Partition(key, ((a, b),), ((a, b),), (trim or (0, b - a),))

    good, cover, shape = [p("a", 0, 5), p("b", 5, 10)], P.check_cover, (10,)
    late = TimeWindowPlan(n + 1).validate(meta)
    return _outcomes(spark, {
        "gap": lambda: cover([p("a", 0, 4), p("b", 5, 10)], shape), "overlap": lambda: cover([p("a", 0, 6), p("b", 5, 10)], shape), "twice": lambda: P.check_descriptors([p("a", 0, 5), p("a", 5, 10)], shape),
        "step": lambda: P.Partition.from_dict({"key": "a", "read": [[0, 4, 2]], "output": [[0, 4]], "trim": [[0, 4]]}), "rank": lambda: P.check_descriptors([P.Partition("a", (), (), ())], shape),
        "bounds": lambda: P.check_descriptors([p("a", 0, 11)], shape), "trim": lambda: P.check_descriptors([p("a", 0, 5, (1, 5))], shape), "chunks": lambda: P.check_chunks(good, (3,), [0]),
        "halo": lambda: P.check_halo(TimeWindowPlan(4), {"time": 2}), "reduced": lambda: P.check_reduced(good, meta, meta.axes), "whole": lambda: cover(good, shape),
        "asset": lambda: len(P.AssetPlan().build(meta)), "session": lambda: len(P.SessionPlan().build(meta)), "json": lambda: P.Partition.from_dict(good[1].to_dict()) == good[1],
        "report": lambda: f"{late.valid},{len(late.warnings)}", "touched": lambda: P.touched_chunks(((3, 9),), ((0, 10),), (4,)),
    })


@query(_values(gib=str(2 << 30), kb="1500", half="50", workers="4", none="MemoryError", word="ValueError", requests="384", unknown="None", guard="MemoryError"), "")
def memory_rules(spark, sf_dir):
    """Byte counts, budgets, workers that fit, requests of a transport, and results too large for the driver."""
    from gridloom.plans import memory as M
    from gridloom.plans.execution import transport_bytes

    a = series(spark, sf_dir)
    return _outcomes(spark, {
        "gib": lambda: M.parse_bytes("2 GiB"), "kb": lambda: M.parse_bytes("1.5 KB"), "half": lambda: M.resolve_budget(100).task_bytes, "workers": lambda: M.workers(M.resolve_budget("1 GiB"), 1 << 20, None, 4),
        "none": lambda: M.workers(M.resolve_budget(100), 1000, None, 4), "word": lambda: M.parse_bytes("much"), "requests": lambda: transport_bytes(3, 100, 64), "unknown": lambda: transport_bytes(None, 1, 1), "guard": lambda: (a + 1).compute("1 KB"),
    })


@query(_values(inside="OutputConflictError", root="OutputConflictError", other="ProvenanceMismatchError", append="ValueError", unfinished="IncompletePartitionError", reopened="complete", same="True", changed="False", escape="True"), "")
def storage_rules(spark, sf_dir):
    """Outputs stay apart from inputs and from other workflows; a changed manifest is noticed."""
    from gridloom.run import load, open_result, persist_workflow
    from gridloom.storage.manifest import manifest_path, problem, read_json
    from gridloom.storage.outputs import ZarrOutput, guard_overwrite

    root, out = _store(spark, "rules"), ZarrOutput(_folder(spark, "rules"))
    movie = load(root, name="movie", spark=spark)
    first = persist_workflow(movie * 2, out).execute()
    before = first.content_identity()
    data = read_json(manifest_path(out.root, first.keys()[0]))

    def identity_without_one():
        import os

        os.remove(manifest_path(out.root, first.keys()[1]))
        return first.content_identity() == before

    return _outcomes(spark, {
        "inside": lambda: movie.persist(root + "/inside"), "root": lambda: guard_overwrite("/"), "other": lambda: movie.persist(out), "append": lambda: ZarrOutput("x", "append"), "unfinished": lambda: open_result(root, spark),
        "reopened": lambda: open_result(out.uri, spark).status, "same": lambda: open_result(out.uri, spark).content_identity() == before, "changed": identity_without_one,
        "escape": lambda: "leaves" in problem(out.root, data | {"outputs": {"result:0": "../x"}}, first.workflow_id, ["result"]),
    })


@query(_values(reproduce="0", verify="0", status="0", plan="0", broken="2", again="WorkflowSpecError", values="119.0"), "")
def workflow_files(spark, sf_dir):
    """A portable workflow file: written, planned, reproduced and verified by the command line."""
    import contextlib
    import io

    from gridloom.cli import main
    from gridloom.run import load, open_array
    from gridloom.spec import WorkflowSpec
    from gridloom.storage.outputs import ZarrOutput

    out, root = ZarrOutput(_folder(spark, "spec")).root, _store(spark, "spec")
    spec = WorkflowSpec.from_array(load(root, name="movie", spark=spark).max("time"), out)
    path = root + "-workflow.json"
    spec.to_json(path)

    def command(*words):
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            return main(list(words))

    return _outcomes(spark, {
        "plan": lambda: command("plan", path), "reproduce": lambda: command("reproduce", path), "verify": lambda: command("verify", out), "status": lambda: command("status", out), "broken": lambda: command("reproduce", path + "x"),
        "again": lambda: spec.to_json(path), "values": lambda: open_array(out, spark=spark).compute().max(),
    })


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_median(spark, sf_dir)
