"""Partitions, durable results, resume and repair, segmentation, traces, metrics, files and the CLI."""

import json
import os

import numpy as np
import pandas as pd
import pytest

import gridloom as gl
from gridloom import expr, kernels
from gridloom.array import ArrayMeta, NamedArray, SourceIdentity
from gridloom.benchmarking import tables, validate
from gridloom.cli import main
from gridloom.operators.matching import assignment, compare_segmentations
from gridloom.operators.segmentation import SegmentationAdapter, label_objects, objects_of, resolve_device
from gridloom.plans import memory, partitions
from gridloom.plans.execution import transport_bytes
from gridloom.plans.partitions import Partition, SpatialTilePlan, TimeWindowPlan
from gridloom.run import open_array, open_result, persist_workflow, run
from gridloom.sources.archive import ArchiveSource
from gridloom.sources.base import redacted
from gridloom.sources.frames import from_cells
from gridloom.sources.hdf5 import transport_options, usable
from gridloom.sources.zarr import ZarrSource, write_array, write_object
from gridloom.spec import WorkflowSpec
from gridloom.storage.outputs import ParquetOutput, SegmentationOutput, ZarrOutput, separate

MOVIE = np.arange(120, dtype="f4").reshape(10, 3, 4)


def meta(shape=(10,), axes=("time",), rate=2.0, chunks=None):
    return ArrayMeta(SourceIdentity("u"), "/m", "m", shape, axes, np.dtype("f4"), chunks, rate=rate, starting_time=0.0)


@pytest.fixture
def movie(spark, tmp_path):
    root = str(tmp_path / "in.zarr")
    write_object(root, "acquisition/movie", MOVIE, (2, 3, 4), rate=2.0)
    return NamedArray(ZarrSource(root).select(name="movie"), spark=spark)


def test_windows_and_tiles():
    parts = TimeWindowPlan(4, 1).build(meta())
    assert [(p.read[0], p.output[0], p.trim[0]) for p in parts] == [((0, 5), (0, 4), (0, 4)), ((3, 9), (4, 8), (1, 5)), ((7, 10), (8, 10), (1, 3))]
    assert len(TimeWindowPlan("2 s").build(meta())) == 3 and partitions.samples("500 ms", 4.0) == 2 and partitions.samples("1 min", 1.0) == 60
    for bad in (TimeWindowPlan(4, 4), TimeWindowPlan("2 s")):
        with pytest.raises(gl.PartitionValidationError):
            bad.build(meta(rate=None) if bad.size == "2 s" else meta())
    with pytest.warns(UserWarning):
        TimeWindowPlan(50).build(meta())
    tiles = SpatialTilePlan({"y": 2}, {"y": 1}).build(meta((5, 3), ("y", "x")))
    assert [t.output for t in tiles] == [((0, 2), (0, 3)), ((2, 4), (0, 3)), ((4, 5), (0, 3))]
    assert len(partitions.AssetPlan().build(meta())) == len(partitions.SessionPlan().build(meta())) == 1
    assert Partition.from_dict(parts[1].to_dict()) == parts[1]
    for plan in (TimeWindowPlan(4, 1), SpatialTilePlan({"y": 2}), partitions.AssetPlan("f"), partitions.SessionPlan("g")):
        assert partitions.plan_from_dict(plan.to_dict()) == plan


def test_malformed_partitions():
    def p(key, a, b, read=None, trim=None):
        read = read or (a, b)
        return Partition(key, (read,), ((a, b),), (trim or (a - read[0], b - read[0]),))

    good = [p("a", 0, 5), p("b", 5, 10)]
    partitions.check_descriptors(good, (10,))
    partitions.check_cover(good, (10,))
    for bad in ([p("a", 0, 4), p("b", 5, 10)], [p("a", 0, 6), p("b", 5, 9)], [p("a", 0, 6), p("b", 6, 10), p("c", 0, 1)]):
        with pytest.raises(gl.PartitionValidationError):
            partitions.check_cover(bad, (10,))
    for bad in ([p("a", 0, 5), p("a", 5, 10)], [p("a", 0, 11)], [p("a", 0, 5, trim=(1, 5))], [Partition("a", (), (), ())], []):
        with pytest.raises(gl.PartitionValidationError):
            partitions.check_descriptors(bad, (10,))
    with pytest.raises(gl.PartitionValidationError):
        Partition.from_dict({"key": "a", "read": [[0, 4, 2]], "output": [[0, 4]], "trim": [[0, 4]]})
    with pytest.raises(gl.PartitionValidationError):
        partitions.check_chunks(good, (3,), [0])
    with pytest.raises(gl.PartitionValidationError):
        partitions.check_reduced(good, meta(), ("time",))
    with pytest.raises(gl.PartitionValidationError):
        partitions.check_halo(TimeWindowPlan(4), {"time": 2})
    assert partitions.touched_chunks(((3, 9),), ((0, 10),), (4,)) == 3 and transport_bytes(3, 100, 64) == 384 and transport_bytes(None, 1, 1) is None


def test_memory_budget():
    assert memory.parse_bytes("2 GiB") == 2 << 30 and memory.parse_bytes("1.5 KB") == 1500
    last = 0
    for k in range(1, 36):
        b = memory.resolve_budget(1 << k)
        assert b.task_bytes >= last and b.task_bytes + b.overhead_bytes == 1 << k
        last = b.task_bytes
    assert memory.workers(memory.resolve_budget("1 GiB"), 1 << 20, None, 4) == 4
    for bad in ("x", "-1 MB", 0):
        with pytest.raises(ValueError):
            memory.parse_bytes(bad)
    with pytest.raises(MemoryError):
        memory.workers(memory.resolve_budget(100), 1000, None, 4)


def test_persist_reopen_and_identity(movie, tmp_path):
    out = str(tmp_path / "out")
    made = (movie.max("time") - movie.min()).persist(out)
    np.testing.assert_array_equal(made.compute(), MOVIE.max(0) - MOVIE.min())
    again = open_array(out, spark=movie.spark)
    np.testing.assert_array_equal((again * 2).compute(), (MOVIE.max(0) - MOVIE.min()) * 2)
    assert again.metadata.source.checksum == made.metadata.source.checksum and open_result(out).status == "complete"
    scalar = movie.mean().persist(str(tmp_path / "scalar"))
    assert scalar.shape == () and scalar.compute() == MOVIE.mean()
    with pytest.raises(gl.ProvenanceMismatchError):
        (movie + 1).persist(out)
    with pytest.raises(gl.OutputConflictError):
        movie.persist(movie.metadata.source.uri + "/inside")
    np.testing.assert_array_equal((movie + 1).persist(ZarrOutput(out, "overwrite", "zlib")).compute(), MOVIE + 1)


def test_resume_repairs_only_what_is_broken(movie, tmp_path):
    out = str(tmp_path / "out")
    work = persist_workflow(movie * 2.0, out)
    assert work.status == "planned" and work.execute().status == "complete"
    times = {f: os.stat(f"{out}/arrays/result/{f}").st_mtime_ns for f in os.listdir(f"{out}/arrays/result")}
    with open(f"{out}/arrays/result/1.0.0", "wb") as f:
        f.write(b"broken")
    os.remove(f"{out}/manifests/tile-000003.json")
    report = work.verify()
    assert set(report["problems"]) == {"tile-000001", "tile-000003"} and work.status == "partial"
    with pytest.raises(gl.IncompletePartitionError):
        open_result(out).execute()
    assert persist_workflow(movie * 2.0, out).execute().verify()["valid"]
    changed = {f for f, t in times.items() if os.stat(f"{out}/arrays/result/{f}").st_mtime_ns != t}
    assert changed - {".zarray"} == {"1.0.0", "3.0.0"}
    bad = json.load(open(f"{out}/manifests/tile-000000.json"))
    bad["outputs"] = {"result:0": "../../secret"}
    json.dump(bad, open(f"{out}/manifests/tile-000000.json", "w"))
    assert "leaves the result" in work.verify()["problems"]["tile-000000"]


def test_functions_with_halo_tables_and_failures(movie, tmp_path, spark):
    smooth = kernels.FunctionAdapter(lambda b: (b + np.roll(b, 1, 0)) / 2, kernels.OutputSchema("array", "smooth", "f4"), name="smooth", requirements=kernels.Requirements(requires_overlap={"time": 1}))
    got = run(selection=movie.selection, adapter=smooth, partition=TimeWindowPlan(4, 1), output=ZarrOutput(str(tmp_path / "a")), spark=spark, execute=True).array().compute()
    np.testing.assert_array_equal(got[1:], ((MOVIE + np.roll(MOVIE, 1, 0)) / 2)[1:])
    with pytest.raises(gl.PartitionValidationError):
        run(selection=movie.selection, adapter=smooth, partition=TimeWindowPlan(4), output=ZarrOutput(str(tmp_path / "b")), spark=spark)
    table = kernels.FunctionAdapter(lambda b: pd.DataFrame({"kind": ["low" if b.mean() < 50 else "high"], "value": [float(b.mean())]}), kernels.OutputSchema("table", "means"), name="means")
    out = run(selection=movie.selection, adapter=table, partition=TimeWindowPlan(5), output=ParquetOutput(str(tmp_path / "t"), partition_on=("kind",)), spark=spark, execute=True)
    assert sorted(r.value for r in out.table().query("kind = 'high'").collect()) == [89.5] and out.verify()["valid"]
    with pytest.raises(gl.AdapterCompatibilityError):
        run(selection=movie.selection, adapter=table, partition=TimeWindowPlan(5), output=ZarrOutput(str(tmp_path / "x")), spark=spark)

    def fails(b):
        if b.max() > 100:
            raise ValueError("too bright")
        return b

    risky = kernels.FunctionAdapter(fails, kernels.OutputSchema("array", "r", "f4"), name="risky")
    work = run(selection=movie.selection, adapter=risky, partition=TimeWindowPlan(5), output=ZarrOutput(str(tmp_path / "f")), spark=spark)
    with pytest.raises(gl.IncompletePartitionError, match="too bright"):
        work.execute()
    assert work.status == "partial" and len(os.listdir(tmp_path / "f" / "failures")) == 1


def test_time_series_adapter(movie, tmp_path, spark):
    def summary(series):
        t, v = series
        return {"start": float(t[0]), "end": float(t[-1]), "samples": len(v)}

    adapter = kernels.TimeSeriesAdapter(summary, kernels.OutputSchema("table", "s"), requires_overlap=1)
    out = run(selection=movie.selection, adapter=adapter, partition=TimeWindowPlan(4, 1), output=ParquetOutput(str(tmp_path / "s")), spark=spark, execute=True)
    assert sorted(r.start for r in out.table().df.collect()) == [0.0, 1.5, 3.5]


def test_segmentation(movie, tmp_path, spark):
    def threshold(block, level=50):
        labels = (block > level).astype("u8")
        return labels, pd.concat([objects_of(labels), pd.DataFrame({"label_id": [99], "voxel_count": [0]})])

    work = movie.segment(SegmentationAdapter(threshold), tile={"time": 4}, halo={"time": 1}, output=SegmentationOutput(str(tmp_path / "seg")), execute=True)
    labels = work.array("labels").compute()
    tiles = np.repeat([0, 1, 2], [4, 4, 2])[:, None, None]
    np.testing.assert_array_equal(labels, np.where(MOVIE > 50, ((tiles + 1).astype("u8") << np.uint64(32)) + np.uint64(1), 0))
    objects = work.table("objects").df.toPandas()
    assert set(objects.local_label_id) == {1} and len(objects) == len(np.unique(labels)) - 1
    with pytest.raises(ValueError):
        movie.segment(SegmentationAdapter(threshold), tile={"y": 1}, output=SegmentationOutput(str(tmp_path / "s2")))
    with pytest.raises(TypeError):
        (movie + 1).segment(SegmentationAdapter(threshold), output=SegmentationOutput(str(tmp_path / "s3")))
    with pytest.raises(gl.UnsupportedBackendError):
        resolve_device("cuda")
    cells = from_cells(spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 1), (1, 1, 0, 0)], "y long, x long, tile long, value int"), ("y", "x"), (2, 2), "i4").selection._read(spark, None)
    r = label_objects(cells, ("y", "x")).first()
    assert (r.voxel_count, r.centroid_1, r.bbox_max_0, r.label_id) == (2, 0.5, 1, (1 << 32) + 1)


def test_traces(movie, tmp_path, spark):
    labels = np.array([[1, 1, 0, 0], [1, 1, 2, 2], [0, 0, 2, 2]], "u4")
    write_object(str(tmp_path / "l.zarr"), "processing/labels", labels, (3, 2), attributes={"axes": ["y", "x"]})
    lab = NamedArray(ZarrSource(str(tmp_path / "l.zarr")).select(name="labels"), spark=spark)
    want = np.stack([MOVIE[:, labels == i].astype("f8").mean(1) for i in (1, 2)], 1).astype("f4")
    np.testing.assert_allclose(movie.extract_traces(lab).matrix(), want, rtol=1e-6)
    plan = movie.plan_traces(lab)
    assert plan.cells == 2 and plan.active_chunks == 2 and plan.tasks == 1
    out = str(tmp_path / "traces")
    np.testing.assert_allclose(movie.extract_traces(lab, output=out).matrix(), want, rtol=1e-6)
    np.testing.assert_allclose(movie.extract_traces(lab, output=out).matrix(), want, rtol=1e-6)
    with pytest.raises(ValueError):
        movie.extract_traces(movie)
    with pytest.raises(gl.ProvenanceMismatchError):
        movie[:4].extract_traces(lab, output=out)


def frame(spark, a):
    a = np.array(a)
    return spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "y long, x long, value long")


def test_metrics(spark):
    ref, pred = frame(spark, [[1, 1, 0, 2], [1, 1, 0, 2]]), frame(spark, [[7, 7, 0, 8], [7, 7, 0, 0]])
    m = compare_segmentations(pred, ref, ("y", "x"))
    assert (m.mean_matched_iou, m.f1) == (0.75, 1.0) and abs(m.foreground_dice - 10 / 11) < 1e-12
    m = compare_segmentations(frame(spark, [[3, 3, 0], [4, 0, 0]]), frame(spark, [[1, 1, 0], [0, 0, 2]]), ("y", "x"))
    assert (m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5)
    m = compare_segmentations(frame(spark, [[0, 0]]), frame(spark, [[0, 0]]), ("y", "x"))
    assert m.precision == m.recall == m.foreground_dice == 1.0 and m.mean_matched_iou == 0.0
    good = frame(spark, [[1, 0]])
    for bad, error in ((frame(spark, [[1, 0, 0]]), ValueError), (frame(spark, [[-1, 0]]), ValueError), (good.withColumn("value", good.value.cast("double")), TypeError)):
        with pytest.raises(error):
            compare_segmentations(good, bad, ("y", "x"))
    for threshold in (0, 1.5):
        with pytest.raises(ValueError):
            compare_segmentations(good, good, ("y", "x"), threshold)


def test_metrics_of_random_volumes(spark):
    """Against a matching of all objects at once."""
    import itertools

    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(3):
        p, r = rng.integers(0, 5, (6, 7)), rng.integers(0, 5, (6, 7))
        p[:, 0], r[:, 0] = 9, 8
        m = compare_segmentations(frame(spark, p), frame(spark, r), ("y", "x"), 0.2)
        ps, rs = np.unique(p[p > 0]), np.unique(r[r > 0])
        iou = np.array([[((p == a) & (r == b)).sum() / ((p == a) | (r == b)).sum() for b in rs] for a in ps])
        iou = iou if len(ps) <= len(rs) else iou.T
        best = max(itertools.permutations(range(iou.shape[1]), len(iou)), key=lambda c: sum(iou[i, j] for i, j in enumerate(c)))
        kept = [iou[i, j] for i, j in enumerate(best) if iou[i, j] >= 0.2]
        assert m.matched == len(kept) and abs(m.mean_matched_iou - np.mean(kept)) < 1e-9 and abs(m.precision - len(kept) / len(ps)) < 1e-9


def test_conditions(spark):
    from gridloom.run import Table

    t = Table(spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5), (3, "c d", 2.5)], "n int, kind string, `a b` double"))
    ids = lambda c: sorted(r.n for r in t.query(c).collect())
    assert ids("n > 1 and kind == 'b'") == [2] and ids("1 < n <= 3") == [2, 3] and ids('kind in ["a", "c d"]') == [1, 3] and ids("kind not in ['a']") == [2, 3]
    assert ids("(`a b` * 2 > 2) & (n < 3)") == [2]
    assert ids("not n == 1 or -n == -1") == [1, 2, 3] and ids("kind = 'a'") == [1] and ids("kind LIKE '%d'") == [3] and ids("~(n == 2)") == [1, 3]
    for bad in ("m > 1", "n.real > 1", "print(n)"):
        with pytest.raises((KeyError, ValueError)):
            t.query(bad)


def test_plan_reports():
    assert TimeWindowPlan(4, 1).validate(meta()) == partitions.Report(True)
    late = TimeWindowPlan(50).validate(meta())
    assert late.valid and len(late.warnings) == 1
    for plan in (TimeWindowPlan(4, 4), TimeWindowPlan("2 h"), SpatialTilePlan({"q": 1}), SpatialTilePlan({"time": 0})):
        assert not plan.validate(meta()).valid
    at = SpatialTilePlan({"y": 2, "x": 3}).numbered(meta((5, 7), ("y", "x")))
    assert [at(i) for i in range(9)] == SpatialTilePlan({"y": 2, "x": 3}).build(meta((5, 7), ("y", "x")))
    rows = [Partition(str(i), ((i, i + 1), (0, 5)), ((i, i + 1), (0, 5)), ((0, 1), (0, 5))) for i in range(5)]
    partitions._check_sorted(rows, (5, 5), [0, 1])
    with pytest.raises(gl.PartitionValidationError):
        partitions._check_sorted(rows[:-1], (5, 5), [0, 1])
    with pytest.raises(gl.PartitionValidationError):
        partitions._check_sorted([*rows, rows[0]], (5, 5), [0, 1])


def test_a_persist_of_aligned_tiles_shuffles_nothing(movie, tmp_path):
    """Only the report of one job; the arrays agree, stages included."""
    made = ((movie - movie.mean()) * 2.0).persist(str(tmp_path / "b"), chunks=(4, 3, 4))
    np.testing.assert_allclose(made.compute(), (MOVIE - MOVIE.mean()) * 2.0)
    from gridloom.run import _block_axes

    assert _block_axes(movie * 2.0, [type("P", (), {"output": ((0, 2), (0, 3), (0, 4))})]) == {"time", "y", "x"}


def test_assignment_is_optimal():
    import itertools

    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        gain = rng.random((n, m)) * (rng.random((n, m)) < 0.7)
        a = gain if n <= m else gain.T
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
        pairs = assignment(gain)
        assert abs(sum(gain[i, j] for i, j in pairs) - best) < 1e-9 and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)


def test_spec_and_cli(movie, tmp_path, capsys):
    spec = WorkflowSpec.from_array((movie[2:8] / 2.0).max("time"), str(tmp_path / "o"))
    path = str(tmp_path / "w.json")
    spec.to_json(path)
    with pytest.raises(gl.WorkflowSpecError):
        spec.to_json(path)
    assert main(["reproduce", path]) == 0 and main(["verify", str(tmp_path / "o")]) == 0 and main(["status", str(tmp_path / "o")]) == 0
    np.testing.assert_array_equal(open_array(str(tmp_path / "o")).compute(), (MOVIE[2:8] / 2).max(0))
    assert main(["plan", path]) == 0 and main(["inspect", movie.metadata.source.uri]) == 0 and main(["version"]) == 0
    with open(f"{tmp_path}/o/arrays/result/0.0", "wb") as f:
        f.write(b"x")
    assert main(["verify", str(tmp_path / "o")]) == 1 and main(["reproduce", str(tmp_path / "none.json")]) == 2
    text = open(path).read()
    for broken in (text.replace('"kind": "numpy-expression"', '"kind": "x"'), text[:-2] + ', "kind": "numpy-expression"}', text.replace('"mode": "create"', '"mode": "overwrite"'), "{"):
        open(str(tmp_path / "b.json"), "w").write(broken)
        with pytest.raises(gl.WorkflowSpecError):
            WorkflowSpec.from_json(str(tmp_path / "b.json"))
    write_object(movie.metadata.source.uri, "acquisition/more", MOVIE, (5, 3, 4), rate=2.0)
    with pytest.raises(gl.WorkflowSpecError, match="changed"):
        spec.array(movie.spark)


def test_sources(tmp_path):
    with pytest.raises(gl.SourceResolutionError):
        gl.open_source(str(tmp_path / "nothing"))
    with pytest.raises(gl.UnsupportedBackendError):
        gl.open_source("x.nwb")
    with pytest.raises(ValueError):
        gl.open_source("DANDI:000123@0.1", version="0.2")
    with pytest.raises(ValueError):
        transport_options(cache="x")
    write_array(str(tmp_path / "z" / "a" / "data"), np.zeros((2, 2)), (1, 1))
    bad = json.load(open(tmp_path / "z" / "a" / "data" / ".zarray")) | {"compressor": {"id": "lzma"}}
    json.dump(bad, open(tmp_path / "z" / "a" / "data" / ".zarray", "w"))
    with pytest.raises(gl.UnsupportedBackendError):
        ZarrSource(str(tmp_path / "z"))
    assert redacted("https://user:pw@h.org/p?token=1#f") == "https://h.org/p" and not usable(object()) and usable(np.zeros((2, 2)))
    for path in ("/", os.path.expanduser("~")):
        with pytest.raises(gl.OutputConflictError):
            from gridloom.storage.outputs import guard_overwrite

            guard_overwrite(path)
    with pytest.raises(gl.OutputConflictError):
        separate(str(tmp_path), [str(tmp_path / "z")])


def blosc(data, width, codec, shuffle, block, whole):
    """A frame as the format describes it."""
    import struct
    import zlib

    import pyarrow as pa

    pack = (lambda b: zlib.compress(b)) if codec == 3 else lambda b: pa.Codec({1: "lz4_raw", 2: "snappy", 4: "zstd"}[codec]).compress(b).to_pybytes()
    starts, body = [], b""
    count = -(-len(data) // block)
    for k in range(count):
        part = data[k * block : (k + 1) * block]
        n = len(part) // width
        if shuffle == 1:
            part = np.frombuffer(part, np.uint8, n * width).reshape(n, width).T.tobytes() + part[n * width :]
        elif shuffle == 4:
            m = n - n % 8
            bits = np.unpackbits(np.frombuffer(part, np.uint8, m * width).reshape(m, width), axis=1, bitorder="little")
            part = np.packbits(bits.T, axis=1, bitorder="little").tobytes() + part[m * width :]
        split = not whole and len(part) == block and width <= 16 and block // width >= 128
        starts.append(16 + 4 * count + len(body))
        for i in range(width if split else 1):
            piece = part[i * (block // width) : (i + 1) * (block // width)] if split else part
            packed = pack(piece)
            packed = piece if len(packed) >= len(piece) else packed
            body += struct.pack("<i", len(packed)) + packed
    head = struct.pack(f"<{count}i", *starts) + body
    return struct.pack("<BBBBIII", 2, 1, shuffle | (16 if whole else 0) | codec << 5, width, len(data), block, 16 + len(head)) + head


def test_compressed_chunks(spark, tmp_path):
    import struct

    import pyarrow as pa
    import zstandard

    from gridloom.sources import codecs

    rng = np.random.Generator(np.random.PCG64(5))
    for width, kind in ((1, "u1"), (2, "i2"), (4, "f4"), (8, "f8")):
        data = np.concatenate([np.arange(700), rng.integers(0, 99, 531)]).astype(kind).tobytes()
        for codec in (1, 2, 3, 4):
            for shuffle in (0, 1, 4):
                for block, whole in ((1024, True), (1024, False), (1 << 20, False)):
                    assert codecs.decode(blosc(data, width, codec, shuffle, block, whole), "blosc") == data
    raw = MOVIE.tobytes()
    assert codecs.decode(zstandard.compress(raw), "zstd") == codecs.decode(struct.pack("<i", len(raw)) + pa.Codec("lz4_raw").compress(raw).to_pybytes(), "lz4") == raw
    copied = struct.pack("<BBBBIII", 2, 1, 2, 4, len(raw), len(raw), 16 + len(raw)) + raw
    assert codecs.decode(copied, "blosc") == raw
    for bad in (copied[:-1], struct.pack("<BBBBIII", 2, 1, 0, 4, 8, 8, 20) + b"0000"):
        with pytest.raises(ValueError):
            codecs.decode(bad, "blosc")
    root = str(tmp_path / "b.zarr")
    write_object(root, "acquisition/movie", MOVIE, (10, 3, 4), rate=2.0)
    folder = f"{root}/acquisition/movie/data"
    meta_ = json.load(open(f"{folder}/.zarray")) | {"compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1}}
    json.dump(meta_, open(f"{folder}/.zarray", "w"))
    with open(f"{folder}/0.0.0", "wb") as f:
        f.write(blosc(raw, 4, 1, 1, 256, False))
    source = ZarrSource(root)
    np.testing.assert_array_equal(NamedArray(source.select(name="movie"), spark=spark).compute(), MOVIE)
    counters = source.io_counters()
    assert counters["responses"] == 2 and counters["bytes"] == os.path.getsize(f"{folder}/.zarray") + os.path.getsize(f"{root}/acquisition/movie/.zattrs")


def test_archive_listing():
    base = "https://api.dandiarchive.org/api"
    pages = {"?page": {"results": [{"asset_id": "1", "path": "a.nwb", "size": 3, "metadata": {"digest": {"dandi:dandi-etag": "e", "dandi:sha2-256": "s"}}}], "next": f"{base}/p2"}, "p2": {"results": [{"asset_id": "2", "path": "b.nwb"}], "next": None}}
    source = ArchiveSource("42", fetch=lambda url: pages["p2" if url.endswith("p2") else "?page"])
    assert source.identity.uri == "DANDI:000042" and [a.checksum for a in source.assets()] == ["sha2-256:s", None] and source.resolve("b.nwb").asset_id == "2"
    with pytest.raises(gl.AmbiguousSelectionError):
        source.resolve(None)
    with pytest.raises(gl.ObjectNotFoundError):
        source.resolve("c")
    with pytest.raises(gl.SourceResolutionError):
        ArchiveSource("1", fetch=lambda url: {"results": [], "next": "http://evil.example/x"}).assets()
    with pytest.raises(gl.SourceResolutionError):
        ArchiveSource("1", fetch=lambda url: {"results": [], "next": url}).assets()


def test_benchmark_records():
    r = {"name": "m", "classification": "current", "config": {}, "wall_seconds": 1.5, "peak_rss_bytes": None, "bytes_read": 3, "valid": True, "environment": {}, "notes": None}
    assert "| m | 1.5 |" in tables([r], "current")[0]
    for bad in (r | {"wall_seconds": float("nan")}, r | {"x": 1}, r | {"classification": "no"}, r | {"bytes_read": True}):
        with pytest.raises(ValueError):
            validate(bad)


def test_pending_is_lazy(spark):
    def explode(*_):
        raise AssertionError("read")

    from gridloom.array import Selection

    a = NamedArray(Selection(meta(MOVIE.shape, ("time", "y", "x")), explode), spark=spark)
    (np.median(a[2:5] * 2, axis="time").astype("f4") + 1).expression
    assert expr.memory(a.expression) == 480 and a.selection.plan()["bytes"] == 480


def test_event_grid_keeps_events_of_all_days(spark, tmp_path):
    import datetime

    from gridloom.queries import event_grid

    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(i, at + datetime.timedelta(days=d), u, 1.25) for i, (d, u) in enumerate([(-2, 1), (3, 1), (3, 1), (31, 2)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.day, r.user_id): r.cents for r in event_grid(spark, str(tmp_path)).collect()}
    assert got.keys() == {(d, u) for d in range(-2, 32) for u in (1, 2)}
    assert {k: v for k, v in got.items() if v} == {(-2, 1): 125, (3, 1): 250, (31, 2): 125}


def test_division_by_zero_gives_the_rows_of_its_sql(spark, tmp_path):
    import duckdb

    from gridloom.queries import QUERIES, SQL

    vectors = [np.where(np.arange(64) % 3 == i, 1.0, -0.5).tolist() for i in range(3)]
    odd = [0.0, -0.0, np.inf, -np.inf, None, *vectors[0][5:]]
    rows = [(0, vectors[0]), (1, odd), (2, None), (5, vectors[1][:10]), (2000, vectors[1]), (3_000_000, vectors[2])]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    for name in ("ufunc_divide_by_zero", "ufunc_isinf"):
        got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select("y", "x", "value").collect())
        want = sorted(repr(r) for r in con.execute(SQL[name]).fetchall())
        assert len(want) == 64 * len(rows) and got == want


def test_quotients_of_null_are_null(spark):
    from gridloom.functions import elementwise
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(None, 0.0), (None, -0.0), (None, 2.0), (1.0, None), (1.0, -0.0)], "a double, b double")
    for f in (elementwise.divide, elementwise.floor_divide):
        got = pairs.select(f(F.col("a"), F.col("b")).alias("q")).collect()
        assert [r.q for r in got] == [None] * 4 + [-np.inf]
