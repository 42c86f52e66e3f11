"""Expressions, reductions, slices and safeguards, held against NumPy."""

import numpy as np
import pytest

import gridloom as gl
from gridloom import expr
from gridloom.array import NamedArray
from gridloom.sources.zarr import ZarrSource, write_object

MOVIE = np.arange(120, dtype="f4").reshape(10, 3, 4)


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "s.zarr")
    write_object(root, "acquisition/movie", MOVIE, (2, 3, 4), rate=2.0, attributes={"neurodata_type": "TwoPhotonSeries", "type_hierarchy": ["ImageSeries"]})
    write_object(root, "acquisition/irregular", MOVIE[:4], (2, 3, 4), timestamps=[0.0, 0.4, 1.1, 2.0], compressor="zlib")
    nan = np.arange(24, dtype="f4").reshape(4, 2, 3)
    nan[1, 0, 2] = nan[3, 1, 0] = np.nan
    write_object(root, "acquisition/holes", nan, (1, 2, 3), rate=1.0)
    write_object(root, "acquisition/small", np.arange(-6, 6, dtype="i1").reshape(2, 6), (1, 6), attributes={"axes": ["row", "column"]})
    edge = np.array([[-np.inf, -2.5, -1, -0.0, 0.0], [0.5, 1, 3, np.inf, np.nan]])
    write_object(root, "acquisition/edge", edge, (2, 5), attributes={"axes": ["row", "column"]})
    return root


@pytest.fixture(autouse=True, params=["cells", "auto"])
def engine(request, monkeypatch):
    monkeypatch.setattr("gridloom.array.ENGINE", request.param)


@pytest.fixture
def movie(spark, store):
    return NamedArray(ZarrSource(store).select(name="movie"), spark=spark)


def get(spark, store, name):
    return NamedArray(ZarrSource(store).select(name=name), spark=spark)


def same(got, want, rtol=1e-6):
    want = np.asarray(want)
    assert got.dtype == want.dtype, (got.dtype, want.dtype)
    np.testing.assert_allclose(got, want, rtol=rtol, atol=1e-7)


def test_read_and_metadata(movie):
    assert movie.axes == ("time", "y", "x") and movie.shape == (10, 3, 4) and len(movie) == 10 and np.ndim(movie) == 3 and np.size(movie, "y") == 3
    same(movie.compute(), MOVIE)


def test_slices(movie):
    same(movie[2:5, ..., 1:].compute(), MOVIE[2:5, :, 1:])
    part = movie.isel(time=slice(4, 8)).isel(time=slice(1, 3))
    assert part.metadata.bounds[0] == (5, 7) and part.metadata.starting_time == 2.5
    same(part.compute(), MOVIE[5:7])
    same((movie * 2)[1:3].compute(), MOVIE[1:3] * 2)
    for bad in (0, None, [1], np.array([True] * 10)):
        with pytest.raises(IndexError):
            movie[bad]
    for bad in (slice(0, 4, 2), slice(3, 3)):
        with pytest.raises(ValueError):
            movie[bad]


def test_two_branches_of_one_load(movie):
    cells = movie.cells()
    assert cells.where("time >= 4 and time < 6").count() == 24 and cells.count() == 120
    assert cells.where("time < 3").union(cells.where("time >= 9")).count() == 48


@pytest.mark.parametrize("name,args", [
    ("sum", {}), ("sum", {"axis": "time"}), ("mean", {"axis": ("y", -1)}), ("min", {"axis": 0}), ("max", {"axis": "x", "keepdims": True}),
    ("median", {"axis": "time"}), ("percentile", {"q": 90, "axis": "time"}), ("quantile", {"q": 0.25, "axis": "time"}), ("quantile", {"q": 0.3, "axis": "time", "method": "inverted_cdf"}),
])
def test_reductions(movie, name, args):
    numbers = dict(args)
    names = {"time": 0, "y": 1, "x": 2, -1: 2, 0: 0}
    if "axis" in numbers:
        a = numbers["axis"]
        numbers["axis"] = tuple(names[i] for i in a) if isinstance(a, tuple) else names[a]
    got = getattr(np, name)(movie, **args).compute()
    same(got, getattr(np, name)(MOVIE, **numbers))


def test_nan_propagates(spark, store):
    holes = get(spark, store, "holes")
    data = holes.compute()
    for name in ("sum", "mean", "min", "max", "median"):
        same(getattr(holes, name)("time").compute(), getattr(np, name)(data, axis=0))


def test_fused_and_staged(movie):
    same(((movie - movie.min()) / (movie.max() - movie.min())).compute(), (MOVIE - MOVIE.min()) / (MOVIE.max() - MOVIE.min()))
    same((movie.max("time") - movie.min("time")).astype("f8").compute(), (MOVIE.max(0) - MOVIE.min(0)).astype("f8"))
    same(np.median(abs(movie - movie.mean()), axis="time").compute(), np.median(abs(MOVIE - MOVIE.mean()), axis=0))
    assert len(expr.staged(((movie - movie.min()) / movie.min()).expression)) == 1
    plan = (movie.max("time") - movie.min("time")).cells()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("BatchScan") <= 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("function", ["absolute", "negative", "positive", "isnan", "isinf", "isfinite", "sqrt", "exp", "expm1", "log", "log1p", "sin", "cos", "tan"])
def test_unary(spark, store, function):
    a = get(spark, store, "edge")
    data = np.array([[-np.inf, -2.5, -1, -0.0, 0.0], [0.5, 1, 3, np.inf, np.nan]])
    with np.errstate(all="ignore"):
        same(getattr(np, function)(a).compute(), getattr(np, function)(data))


@pytest.mark.parametrize("function", ["add", "subtract", "multiply", "divide", "floor_divide", "remainder", "power", "maximum", "minimum", "equal", "not_equal", "greater", "greater_equal", "less", "less_equal"])
def test_binary(spark, store, function):
    a = get(spark, store, "edge")
    data = np.array([[-np.inf, -2.5, -1, -0.0, 0.0], [0.5, 1, 3, np.inf, np.nan]])
    for s in (-np.inf, -2.5, 0.0, 1.0, 3.0, np.nan):
        with np.errstate(all="ignore"):
            same(getattr(np, function)(a, s).compute(), getattr(np, function)(data, s))
            same(getattr(np, function)(s, a).compute(), getattr(np, function)(s, data))


@pytest.mark.parametrize("function", ["add", "subtract", "multiply", "divide", "floor_divide", "remainder", "maximum", "minimum", "greater"])
def test_small_integers_wrap(spark, store, function):
    a = get(spark, store, "small")
    data = np.arange(-6, 6, dtype="i1").reshape(2, 6)
    for s in (np.int8(100), np.int8(-128), np.int8(0), np.int8(3)):
        with np.errstate(all="ignore"):
            same(getattr(np, function)(a, s).compute(), getattr(np, function)(data, s))


def test_casts(spark, store):
    a = get(spark, store, "small")
    data = np.arange(-6, 6, dtype="i1").reshape(2, 6)
    for t in ("i2", "u1", "u2", "u4", "u8", "i8", "f4", "f8", "?"):
        same(a.astype(t).compute(), data.astype(t))
    same((a * np.int16(300)).astype("i1").compute(), (data * np.int16(300)).astype("i1"))
    with pytest.raises(TypeError):
        a.astype("u1", casting="safe")


def test_safeguards(movie, spark, store):
    for act in (lambda: np.asarray(movie), lambda: bool(movie), lambda: iter(movie), lambda: movie + MOVIE, lambda: np.concatenate([movie, movie])):
        with pytest.raises(TypeError):
            act()
    with pytest.raises(ValueError, match="same source selection"):
        movie[:4] + get(spark, store, "irregular")
    with pytest.raises(ValueError):
        movie + movie.mean("time")
    for bad in (lambda: movie.sum("z"), lambda: movie.sum((0, "time")), lambda: movie.sum(7), lambda: movie.quantile(2), lambda: movie.max("time", keepdims=True)[0:1]):
        with pytest.raises((ValueError, TypeError)):
            bad()
    with pytest.raises(TypeError):
        movie.sum(where=True)
    with pytest.raises(MemoryError):
        movie.compute(memory_limit=2)


def test_selection_errors(store):
    s = ZarrSource(store)
    with pytest.raises(gl.ObjectNotFoundError):
        s.select(name="nothing")
    with pytest.raises(gl.AmbiguousSelectionError):
        s.select()
    assert s.select(neurodata_type="ImageSeries").metadata.name == "movie"
    assert s.select(path="acquisition/movie/".replace("acq", "/acq")).metadata.name == "movie"


def test_irregular_times(spark, store):
    part = get(spark, store, "irregular")[1:3]
    assert [tuple(r) for r in part.selection.timestamps(spark).orderBy("time").collect()] == [(0, 0.4), (1, 1.1)]


def test_expression_round_trip(movie):
    e = ((movie - movie.mean()) / np.float32(2)).max("time").astype("f8").expression
    again = expr.from_dict(expr.to_dict(e))
    assert expr.identity(again) == expr.identity(e)
    broken = expr.to_dict(e)
    broken["shape"] = [9, 9]
    with pytest.raises(ValueError):
        expr.from_dict(broken)


def test_dtypes_follow_numpy(movie, spark, store):
    small = get(spark, store, "small")
    assert small.sum().dtype == np.int64 and small.mean().dtype == np.float64 and (small + 1).dtype == np.int8 and (small + 1.0).dtype == np.float64
    assert (movie + 1.0).dtype == np.float32 and (small / 2).dtype == np.float16 or (small / 2).dtype == np.float64


@pytest.mark.parametrize("method", ["lower", "higher", "nearest", "midpoint", "hazen", "weibull", "median_unbiased", "normal_unbiased", "inverted_cdf", "averaged_inverted_cdf", "interpolated_inverted_cdf"])
def test_quantile_methods(spark, method):
    from gridloom.sources.frames import from_cells

    data = np.random.Generator(np.random.PCG64(2)).integers(0, 50, (9, 3)).astype("f8")
    cells = spark.createDataFrame([(i, j, float(data[i, j])) for i in range(9) for j in range(3)], "y long, x long, value double")
    a = from_cells(cells, ("y", "x"), (9, 3), "f8")
    one = a.quantile(0.0, "y", method=method)
    for q in (0.2, 0.25, 0.5, 0.9):
        one = one + a.quantile(q, "y", method=method) * (1 + q)
    want = np.quantile(data, 0.0, axis=0, method=method) + sum(np.quantile(data, q, axis=0, method=method) * (1 + q) for q in (0.2, 0.25, 0.5, 0.9))
    np.testing.assert_allclose(one.compute(engine="cells"), want)
