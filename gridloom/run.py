"""Workflows: plan, execute partition by partition, resume, verify, reopen."""

from __future__ import annotations

import math
import os
import platform
import shutil
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import __version__, expr, kernels
from gridloom.array import ArrayMeta, NamedArray, Selection, SourceIdentity
from gridloom.exceptions import IncompletePartitionError, OutputConflictError, ProvenanceMismatchError
from gridloom.lower import Lowering
from gridloom.plans.execution import ExecutionPlan, build_plan
from gridloom.plans.memory import resolve_budget, workers
from gridloom.plans.partitions import Partition, automatic_tiles, deal
from gridloom.storage.manifest import Manifest, check_all, check_one, manifest_path, read_json, write_json
from gridloom.storage.outputs import Output, ZarrOutput, guard_overwrite, separate


class ExpressionAdapter(kernels.Adapter):
    """An expression evaluated natively; its partitions are ranges of the result."""

    name, version = "expression", "1"

    def __init__(self, expression: expr.Expression, output: kernels.OutputSchema):
        self.expression, self.output = expression, output

    def identity(self) -> dict:
        return {"name": self.name, "version": self.version, "expression": expr.identity(self.expression)}

    def run(self, part):
        return expr.evaluate(self.expression, part.data, part.axes)

    def memory(self, block_bytes: int) -> int:
        nodes = max(1, expr.memory(self.expression))
        return max(block_bytes, min(nodes, 8 * block_bytes))

    def stages(self) -> list[dict]:
        return [{"id": expr.identity(s), "operation": s.name, "axes": list(s.reduced)} for s in expr.staged(self.expression)]


def environment(spark: SparkSession) -> dict:
    return {"gridloom": __version__, "python": platform.python_version(), "numpy": np.__version__, "spark": spark.version, "platform": platform.platform()}


class Result:
    """A workflow's output: planned, running, complete, partial or failed."""

    def __init__(self, root: str, plan: ExecutionPlan | None = None, execute=None, spark: SparkSession | None = None):
        self.root, self.plan, self._execute, self.spark = root, plan, execute, spark
        self._running = False

    @property
    def record(self) -> dict:
        path = os.path.join(self.root, "provenance.json")
        return read_json(path) if os.path.exists(path) else {}

    @property
    def workflow_id(self) -> str:
        return self.plan.workflow_id if self.plan else self.record["workflow_id"]

    def keys(self) -> list[str]:
        return [p.key for p in self.plan.partitions] if self.plan else [p["key"] for p in self.record["partitions"]]

    def manifests(self) -> dict[str, dict]:
        out = {}
        for k in self.keys():
            path = manifest_path(self.root, k)
            if os.path.exists(path):
                try:
                    out[k] = read_json(path)
                except ValueError:
                    pass
        return out

    @property
    def status(self) -> str:
        if self._running:
            return "running"
        if not self.record or self.record.get("workflow_id") != self.workflow_id:
            return "planned"
        done = sum(m.get("status") == "complete" and m.get("workflow_id") == self.workflow_id for m in self.manifests().values())
        if done == len(self.keys()):
            return "complete"
        if done:
            return "partial"
        return "failed" if self.record.get("attempts") else "planned"

    def verify(self, checksums: bool = True) -> dict:
        """Checks each partition on the executors, and staged scalars on the driver."""
        spark = self.spark or SparkSession.builder.getOrCreate()
        record = self.record
        if not record:
            return {"valid": False, "problems": {"*": "no provenance"}}
        problems = check(spark, self.root, record["workflow_id"], self.keys(), record["components"], checksums)
        for s in record.get("stages", []):
            path = os.path.join(self.root, "stages", s["id"] + ".json")
            if os.path.exists(path):
                data = read_json(path)
                if expr.stable_hash(data["value"]) != data["checksum"]:
                    problems[f"stage:{s['id']}"] = "checksum differs"
        return {"valid": not problems, "problems": problems, "partitions": len(self.keys())}

    def execute(self) -> Result:
        if self._execute is None:
            raise IncompletePartitionError("a reopened result has no function and can't resume")
        self._running = True
        try:
            self._execute(self)
        finally:
            self._running = False
        return self

    def content_identity(self) -> str:
        """Hash of workflow, schema and all manifests; a different result never shares it."""
        record = self.record
        return expr.stable_hash({"workflow": self.workflow_id, "schema": record.get("schema"), "manifests": [m for _, m in sorted(self.manifests().items())]})

    def array(self, component: str | None = None) -> NamedArray:
        return open_array(self.root, component=component, verify=False, spark=self.spark)

    def table(self, component: str | None = None) -> Table:
        spark = self.spark or SparkSession.builder.getOrCreate()
        name = component or next(c for c in self.record["components"] if self.record["schema"][c]["kind"] == "table")
        return Table(spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/tables/{name}"))


class Table:
    """A result's rows. ``query`` takes conditions as a data-frame user writes them (``value > 3 and kind == "low"``,
    ``1 < x <= 4``, ``kind in ["a", "b"]``, ``not``, ``&``, ``|``, ``~``) or as SQL writes them."""

    def __init__(self, df: DataFrame):
        self.df = df

    def query(self, condition: str) -> DataFrame:
        from gridloom.conditions import column_of

        return self.df.where(column_of(condition, self.df.columns))


def _initialise(spark, root: str, plan: ExecutionPlan, output: Output, adapter, meta: ArrayMeta, components: dict[str, dict], resume: bool) -> None:
    separate(root, [meta.source.uri])
    path = os.path.join(root, "provenance.json")
    have = read_json(path) if os.path.exists(path) else None
    attempts = 0
    if os.path.isdir(root) and os.listdir(root):
        if have and have["workflow_id"] == plan.workflow_id and resume:
            attempts = have["attempts"]
        elif output.mode == "overwrite":
            guard_overwrite(root)
            shutil.rmtree(root)
        elif have and have["workflow_id"] != plan.workflow_id:
            raise ProvenanceMismatchError(f"{root} holds another workflow")
        else:
            raise OutputConflictError(f"{root} isn't empty")
    record = {
        "schema_version": "1", "workflow_id": plan.workflow_id, "components": sorted(components), "schema": components,
        "source": {"uri": meta.source.uri, "version": meta.source.version, "asset_id": meta.source.asset_id, "checksum": meta.source.checksum},
        "selection": {"path": meta.path, "bounds": [list(b) for b in meta.bounds], "axes": list(meta.axes), "shape": list(meta.shape), "dtype": np.dtype(meta.dtype).str, "rate": meta.rate, "starting_time": meta.starting_time},
        "adapter": adapter.identity(), "partitions": [p.to_dict() for p in plan.partitions], "stages": list(plan.stages), "environment": environment(spark),
        "attempts": attempts + 1, "application": spark.sparkContext.applicationId,
    }
    write_json(path, record)
    for name, schema in components.items():
        if schema["kind"] == "array":
            write_json(os.path.join(root, "arrays", name, ".zarray"), {"zarr_format": 2, "shape": schema["shape"], "chunks": schema["chunks"], "dtype": schema["dtype"], "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": output.codec, "level": 1} if output.codec else None})


#: So few partitions are checked where they are planned: a job would cost more.
FEW = 16


def check(spark: SparkSession, root: str, workflow_id: str, keys: list[str], components: list[str], checksums: bool = True) -> dict[str, str]:
    """What is wrong with partitions, by key; checked by the executors but for a few."""
    if len(keys) <= FEW:
        return {k: p for k in keys if (p := check_one(root, k, workflow_id, components, checksums)) is not None}
    table = check_all(spark, root, workflow_id, keys, components, checksums)
    return {r.partition_id: r.problem for r in table.where("problem IS NOT NULL").collect()}


def pending(spark: SparkSession, root: str, plan: ExecutionPlan, components: list[str]) -> list[int]:
    """Numbers of partitions without a valid manifest."""
    if not os.path.isdir(os.path.dirname(manifest_path(root, "x"))):
        return list(range(len(plan.partitions)))
    bad = check(spark, root, plan.workflow_id, [p.key for p in plan.partitions], components)
    return [i for i, p in enumerate(plan.partitions) if p.key in bad]


REPORT = "partition_id string, status string, message string"


def _report(key: str, status: str, message: str | None = None) -> pa.Table:
    return pa.table({"partition_id": pa.array([key]), "status": pa.array([status]), "message": pa.array([message], pa.string())})


def _finish(result: Result, reports: list, began: float) -> None:
    failures = {r.partition_id: r.message for r in reports if r.status != "complete"}
    run = uuid.uuid4().hex
    for k, message in failures.items():
        write_json(os.path.join(result.root, "failures", f"{k}-{run}.json"), {"partition_id": k, "run": run, "message": message})
    write_json(os.path.join(result.root, "result.json"), {"workflow_id": result.workflow_id, "status": result.status if not result._running else ("failed" if failures else "complete"), "seconds": round(time.time() - began, 3), "computed": len(reports), "failed": len(failures), "content_identity": result.content_identity()})
    if failures:
        k, message = next(iter(failures.items()))
        raise IncompletePartitionError(f"{len(failures)} partitions failed, first {k}: {message}")


def times_of(meta: ArrayMeta, read) -> np.ndarray | None:
    """Times of a partition's samples from the rate (stored ones are joined as a column)."""
    if "time" not in meta.axes or not meta.rate:
        return None
    lo, hi = read[meta.axes.index("time")]
    return (meta.starting_time or 0.0) + np.arange(lo, hi) / meta.rate


def _limit(spark: SparkSession, plan: ExecutionPlan, max_workers: int | None, memory_limit) -> int:
    cores = spark.sparkContext.defaultParallelism
    if memory_limit is None:
        return min(cores, max_workers or cores)
    return workers(resolve_budget(memory_limit), plan.memory_per_task, max_workers, cores)


def run(*, source=None, selection: Selection, adapter: kernels.Adapter, partition, output: Output, resume: bool = True, execute: bool = False, max_workers: int | None = None, memory_limit=None, spark: SparkSession | None = None) -> Result:
    """A workflow of a user function over partitions; nothing happens before ``execute()``."""
    meta = selection.metadata
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    plan = build_plan(meta, adapter, partition, output)
    granted = _limit(spark, plan, max_workers, memory_limit)
    schema = adapter.output
    retained = [i for i, a in enumerate(meta.axes) if a not in schema.reduced_axes]
    chunks = schema.chunks or tuple(plan.partition_shape[i] for i in retained)
    components = {schema.name: {"kind": "table"}} if schema.kind == "table" else {schema.name: {"kind": "array", "shape": list(plan.output_shape), "chunks": list(chunks), "dtype": np.dtype(schema.dtype).str, "axes": list(plan.output_axes)}}
    if schema.kind == "segmentation":
        components["objects"] = {"kind": "table"}
    parts, root = plan.partitions, output.root

    def go(result: Result) -> None:
        began = time.time()
        _initialise(spark, root, plan, output, adapter, meta, components, resume)
        todo = pending(spark, root, plan, list(components))
        if not todo:
            return _finish(result, [], began)
        cells = deal(selection.cells(spark), list(parts), meta.axes).where(F.col("tile").isin(todo)) if len(todo) < len(parts) else deal(selection.cells(spark), list(parts), meta.axes)
        times = selection.timestamps(spark) if selection._times is not None else None
        names = [*meta.axes, "value", "tile"]
        if times is not None:
            cells = cells.join(times, "time", "left")
            names.append("t")

        def kernel(group: pa.Table) -> pa.Table:
            number = group.column("tile")[0].as_py()
            p: Partition = parts[number]
            try:
                block = kernels.block_of(group, meta.axes, p.read, np.dtype(meta.dtype))
                stamps = times_of(meta, p.read)
                if "t" in group.column_names:
                    at = group.column("time").to_numpy() - p.read[meta.axes.index("time")][0]
                    stamps = np.zeros(p.read[meta.axes.index("time")][1] - p.read[meta.axes.index("time")][0])
                    stamps[at] = group.column("t").to_numpy()
                adapter.prepare()
                got = adapter.run(kernels.Loaded(block, p.key, p.read, p.output, p.trim, meta.axes, stamps, dict(adapter.parameters), int(expr.stable_hash([plan.workflow_id, p.key])[:8], 16)))
                if schema.kind == "table":
                    made = kernels.write_table(root, schema.name, got, p.key, tuple(output.partition_on))
                elif schema.kind == "segmentation":
                    from gridloom.operators.segmentation import global_labels

                    labels, objects = global_labels(got, p, number, meta.axes)
                    made = kernels.write_blocks(root, schema.name, labels, tuple(o[0] for o in p.output), chunks, output.codec)
                    made = tuple({**a, **b} for a, b in zip(made, kernels.write_table(root, "objects", objects, p.key, ())))
                else:
                    data = kernels.trimmed(got, p, retained).astype(schema.dtype)
                    made = kernels.write_blocks(root, schema.name, data, tuple(p.output[i][0] for i in retained), chunks, output.codec)
                write_json(manifest_path(root, p.key), Manifest(p.key, plan.workflow_id, "complete", *made).to_dict())
                return _report(p.key, "complete")
            except Exception as e:  # recorded for the partition; others go on
                return _report(p.key, "failed", f"{type(e).__name__}: {e}")

        done = cells.select(*names).repartition(max(1, min(granted * 4, len(todo))), "tile").groupBy("tile").applyInArrow(kernel, REPORT).collect()
        _finish(result, done, began)

    result = Result(root, plan, go, spark)
    return result.execute() if execute else result


def plan(*, source=None, selection: Selection, adapter, partition, output) -> ExecutionPlan:
    return build_plan(selection.metadata, adapter, partition, output)


def _block_axes(array: NamedArray, parts, most: int = 256 << 20) -> set[str] | None:
    """Axes along which the tiles of a result can be evaluated each on its own from the source's blocks; None
    where they can't, or where a tile's input is over ``most`` bytes."""
    if array._tiles() is None:
        return None
    meta, e = array.metadata, array.expression
    kept = array.kept_axes()
    if any(len({p.output[i] for p in parts}) > 1 for i, a in enumerate(e.axes) if a not in kept):
        return None
    size = dict(zip(e.axes, (b - a for a, b in parts[0].output)))
    bytes_ = np.dtype(meta.dtype).itemsize * math.prod(size[a] if a in kept else n for a, n in zip(meta.axes, meta.shape))
    return kept if bytes_ <= most else None


def persist_workflow(array: NamedArray, output: Output | str, chunks=None, max_workers=None, memory_limit=None, resume: bool = True) -> Result:
    """The result of an expression, chunk by chunk: native columns, a kernel only to write."""
    spark, e, meta = array._session(), array.expression, array.metadata
    output = ZarrOutput(output) if isinstance(output, str) else output
    retained = tuple(a for a in meta.axes if a in e.axes and e.shape[e.axes.index(a)] == meta.shape[meta.axes.index(a)])
    wanted = dict(zip(e.axes, chunks)) if chunks else None
    tiles = automatic_tiles(meta, retained, wanted)
    sizes = tuple(tiles.tile.get(a, n) for a, n in zip(e.axes, e.shape))
    schema = kernels.OutputSchema("array", "result", e.dtype.str, (), tuple((wanted or {}).get(a, s) for a, s in zip(e.axes, sizes)) or None)
    adapter = ExpressionAdapter(e, schema)
    shown = ArrayMeta(meta.source, meta.path, meta.name, e.shape or (1,), e.axes or ("value_axis",), e.dtype, sizes or (1,), bounds=meta.bounds if e.shape == meta.shape else ())
    from dataclasses import replace

    from gridloom.plans.partitions import SpatialTilePlan

    regular = SpatialTilePlan({a: s for a, s in zip(shown.axes, sizes or (1,))})
    made = build_plan(shown, adapter, regular, output)
    made = replace(made, workflow_id=expr.stable_hash([made.workflow_id, [list(b) for b in meta.bounds], meta.dtype.str]), output_shape=e.shape, output_axes=e.axes)
    if memory_limit is not None:
        _limit(spark, made, max_workers, memory_limit)
    components = {"result": {"kind": "array", "shape": list(e.shape), "chunks": list(schema.chunks or ()), "dtype": e.dtype.str, "axes": list(e.axes)}}
    root, parts, dtype, block = output.root, made.partitions, e.dtype, tuple(schema.chunks or ())
    read, whole = array.selection._block, _block_axes(array, parts)
    part_at = regular.numbered(shown)  # tasks compute their partition from its number

    def go(result: Result) -> None:
        began = time.time()
        _initialise(spark, root, made, output, adapter, meta, components, resume)
        todo = pending(spark, root, made, ["result"])
        if not todo:
            return _finish(result, [], began)
        scalars = {}
        for x in expr.staged(e):
            row = Lowering(array.selection.cells(spark), expr.Input(meta.shape, meta.axes, np.dtype(meta.dtype))).run(x).first()
            scalars[expr.identity(x)] = x.dtype.type(row["value"])
            value = expr.to_dict(expr.scalar(row["value"]))
            write_json(os.path.join(root, "stages", expr.identity(x) + ".json"), {"value": value, "checksum": expr.stable_hash(value), "operation": x.name})

        def write(number: int, data: np.ndarray) -> pa.Table:
            p = part_at(number)
            made_ = kernels.write_blocks(root, "result", data, tuple(o[0] for o in p.output) if e.axes else (), block, output.codec)
            write_json(manifest_path(root, p.key), Manifest(p.key, made.workflow_id, "complete", *made_).to_dict())
            return _report(p.key, "complete")

        if whole is not None:
            # One task a tile: its block is read, evaluated and written; nothing is shuffled.
            numbers = np.array(todo, np.int64)

            def blocks(batches):
                for b in batches:
                    for i in b.column(0).to_pylist():
                        p = part_at(int(numbers[i]))
                        own = dict(zip(e.axes, p.output))
                        bounds = [(lo + own[a][0], lo + own[a][1]) if a in whole else (lo, lo + n) for a, (lo, _), n in zip(meta.axes, meta.bounds, meta.shape)]
                        value = expr.evaluate(e, read(bounds), meta.axes, scalars)
                        yield from write(int(numbers[i]), np.ascontiguousarray(value, dtype=dtype)).to_batches()

            done = spark.range(0, len(todo), 1, min(len(todo), 4096)).mapInArrow(blocks, REPORT).collect()
            return _finish(result, done, began)
        if e.axes:
            cells = deal(Lowering(array.selection.cells(spark), expr.Input(meta.shape, meta.axes, np.dtype(meta.dtype))).run(e), list(parts), e.axes)
            cells = cells.where(F.col("tile").isin(todo)) if len(todo) < len(parts) else cells
        else:
            cells = array.cells().withColumn("tile", F.lit(0).cast("bigint"))

        def kernel(group: pa.Table) -> pa.Table:
            number = group.column("tile")[0].as_py()
            return write(number, kernels.block_of(group, e.axes, part_at(number).output, dtype) if e.axes else np.array(group.column("value")[0].as_py(), dtype))

        done = cells.select(*e.axes, "value", "tile").repartition(max(1, min(1024, len(todo))), "tile").groupBy("tile").applyInArrow(kernel, REPORT).collect()
        _finish(result, done, began)

    return Result(root, made, go, spark)


def persist_expression(array: NamedArray, output, **how) -> NamedArray:
    persist_workflow(array, output, **how).execute()
    made = ZarrOutput(output) if isinstance(output, str) else output
    return open_array(made.root, verify=False, spark=array._session())


def open_result(uri: str, spark: SparkSession | None = None) -> Result:
    out = Output(uri)
    record, path = Result(out.root).record, os.path.join(out.root, "result.json")
    if not record or not os.path.exists(path):
        raise IncompletePartitionError(f"{uri} holds no finished result")
    if read_json(path)["workflow_id"] != record["workflow_id"]:
        raise ProvenanceMismatchError("result and provenance name different workflows")
    return Result(out.root, spark=spark)


def open_array(uri: str, *, component: str | None = None, axes: tuple[str, ...] | None = None, verify: bool = True, spark: SparkSession | None = None) -> NamedArray:
    """A persisted array as a source again: complete, checked, with the identity of its content."""
    from functools import partial

    from gridloom.sources.zarr import load_cells, read_region

    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    result = open_result(uri, spark)
    if result.status != "complete":
        raise IncompletePartitionError(f"the result is {result.status}")
    record = result.record
    arrays = [c for c in record["components"] if record["schema"][c]["kind"] == "array"]
    name = component or (arrays[0] if len(arrays) == 1 else None)
    if name not in arrays:
        raise ProvenanceMismatchError(f"component {component!r} is none of {arrays}")
    schema, root = record["schema"][name], os.path.join(result.root, "arrays", name)
    stored = read_json(os.path.join(root, ".zarray"))
    if [stored["shape"], stored["chunks"], stored["dtype"]] != [schema["shape"], schema["chunks"], schema["dtype"]]:
        raise ProvenanceMismatchError("the stored array differs from what its record declares")
    if verify and not (report := result.verify())["valid"]:
        raise IncompletePartitionError(f"the result isn't intact: {report['problems']}")
    names = tuple(axes or schema["axes"])
    if len(names) != len(schema["shape"]):
        raise ValueError("one name an axis is needed")
    selection = record["selection"]
    timed = "time" in names and selection["axes"] and selection["shape"][selection["axes"].index("time")] == schema["shape"][names.index("time")] if "time" in selection["axes"] and "time" in names else False
    meta = ArrayMeta(SourceIdentity(result.root, None, name, result.content_identity()), f"arrays/{name}", name, tuple(schema["shape"]), names, np.dtype(schema["dtype"]), tuple(schema["chunks"]) or None, rate=selection["rate"] if timed else None, starting_time=selection["starting_time"] if timed else None, attributes={"backend": "result"})
    return NamedArray(Selection(meta, load_cells(root, names, meta.dtype), block=partial(read_region, root)), spark=spark)


def load(source: str, *, name: str | None = None, asset: str | None = None, version: str | None = None, storage_options: dict | None = None, spark: SparkSession | None = None) -> NamedArray:
    from gridloom.sources import open_source

    opened = open_source(source, version=version, storage_options=storage_options)
    return NamedArray(opened.select(name=name, asset=asset), spark=spark)


