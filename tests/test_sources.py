import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom import cli
from bitloom.errors import BitloomError, ImageError, InvalidMetadata, StorageError
from bitloom.operators import analysis, images
from bitloom.operators.normalize import Options
from bitloom.plans.compress import Plan, compress
from bitloom.sources import chunked, containers, store
from bitloom.sources import images as files


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")


def _same(a, b):
    return a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


@pytest.mark.parametrize("encoding, delta", list(itertools.product(("flat", "rle", "huffman"), (None, "unary", "fixed"))))
def test_container_round_trip(spark, events, tmp_path, encoding, delta):
    c = compress(events, "event_id", plan=Plan(options=Options(decimals=2), encoding=encoding, delta=delta, append_condensed=True))
    size = containers.save(c, f"file://{tmp_path}/t.tgd")
    assert size == (tmp_path / "t.tgd").stat().st_size
    d = containers.read_tgd((tmp_path / "t.tgd").read_bytes())
    assert (d.encoding, d.delta) == (encoding, delta) and d.columns == [("user_id", "int64"), ("value", "float64")]
    back = containers.load(spark, f"file://{tmp_path}/t.tgd")
    assert _same(back.decompress(), events.withColumnRenamed("event_id", "row_idx"))
    assert back.bases.agg({"cnt": "sum"}).first()[0] == back.info.n + len(back.info.weights)
    assert back.analytics().agg({"weight": "sum"}).first()[0] == back.info.n
    # what was read is written to the same bytes
    assert containers.tgd_bytes(d) == (tmp_path / "t.tgd").read_bytes()


@pytest.mark.parametrize("delta", [None, "fixed"])
def test_flat_container_in_chunks(spark, events, tmp_path, monkeypatch, delta):
    """Many small chunks give the bytes that one place writes, gaps in the row numbers or not."""
    c = compress(events, "event_id", plan=Plan(options=Options(decimals=2), delta=delta, append_condensed=True))
    whole = containers.tgd_bytes(containers.collect(c))
    monkeypatch.setattr(containers, "CHUNK_ROWS", 56)
    for k, rows in enumerate((c.rows, c.rows.withColumn("row_idx", F.col("row_idx") * 3 + 7))):
        size = containers.save(replace(c, rows=rows), f"file://{tmp_path}/{k}.tgd")
        assert (tmp_path / f"{k}.tgd").read_bytes() == whole and size == len(whole)


def test_egd_and_many_files(spark, events, tmp_path):
    c = compress(events, "event_id", plan=Plan(options=Options(decimals=2), m_max=None))
    containers.save(c, f"file://{tmp_path}/a.egd")
    back = containers.load(spark, f"file://{tmp_path}/a.egd").decompress().toDF("row_idx", "user_id", "value")
    assert _same(back, events.withColumnRenamed("event_id", "row_idx"))
    for n in ("a", "b"):
        containers.save(c, f"file://{tmp_path}/{n}.tgd")
    assert containers.read_tables(spark, f"file://{tmp_path}/*.tgd").count() == 2 * events.count()


def _streamed(monkeypatch):
    """Small chunks, pieces and stages; nothing may be read or collected whole."""

    def refuse(*args, **kwargs):
        raise AssertionError("the driver holds the whole container")

    for name in ("read_file", "to_compressed", "collect"):
        monkeypatch.setattr(containers, name, refuse)
    monkeypatch.setattr(containers, "CHUNK_ROWS", 56)
    monkeypatch.setattr(chunked, "PIECE_BYTES", 100)
    monkeypatch.setattr(chunked, "STAGE_BYTES", 1000)


@pytest.mark.parametrize("kind", ["egd", "tgd"])
def test_flat_container_is_streamed(spark, events, tmp_path, monkeypatch, kind):
    _streamed(monkeypatch)
    c = compress(events, "event_id", plan=Plan(options=Options(decimals=2), append_condensed=True))
    containers.save(c, f"file://{tmp_path}/a.{kind}")
    back = containers.load(spark, f"file://{tmp_path}/a.{kind}")
    assert _same(back.decompress().toDF("row_idx", "user_id", "value"), events.withColumnRenamed("event_id", "row_idx"))
    assert back.n_bases == c.n_bases and _same(back.bases.select("base_id", "cnt"), c.bases.select("base_id", "cnt"))
    assert back.analytics().agg({"weight": "sum"}).first()[0] == back.info.n


@pytest.mark.parametrize("encoding, delta", [("rle", None), ("rle", "fixed"), ("flat", "unary"), ("huffman", "unary")])
def test_coded_container_is_streamed(spark, events, tmp_path, monkeypatch, encoding, delta):
    """Many small chunks give the bytes that one place writes, and are read again."""
    runs = events.select("event_id", F.when(F.col("event_id") % 97 < 60, 7).otherwise(F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 97 < 60, 0.5).otherwise(F.col("value")).alias("value"))
    c = compress(runs, "event_id", plan=Plan(options=Options(decimals=2), encoding=encoding, delta=delta, append_condensed=True, block_rows=20))
    whole = containers.tgd_bytes(containers.collect(c))
    _streamed(monkeypatch)
    assert containers.save(c, f"file://{tmp_path}/a.tgd") == len(whole)
    assert (tmp_path / "a.tgd").read_bytes() == whole
    back = containers.load(spark, f"file://{tmp_path}/a.tgd")
    assert (back.plan.encoding, back.plan.delta, back.order) == (encoding, delta, c.order)
    assert _same(back.decompress(), runs.withColumnRenamed("event_id", "row_idx"))
    assert _same(back.bases.select("base_id", "cnt"), c.bases.select("base_id", "cnt"))


def test_broken_containers(tmp_path):
    with pytest.raises(InvalidMetadata):
        containers.read_egd(b"XXX\x01")
    with pytest.raises(StorageError):
        containers.read_egd(b"EGD\x01\x00")
    with pytest.raises(InvalidMetadata):
        containers.read_tgd(b"TGD\x07")
    with pytest.raises(InvalidMetadata):
        containers.kind_of("x.zip")


def test_store(spark, events, tmp_path):
    c = compress(events, "event_id", plan=Plan(options=Options(decimals=2)))
    store.save(c, f"file://{tmp_path}/s")
    back = store.load(spark, f"file://{tmp_path}/s")
    assert _same(back.decompress(), events.withColumnRenamed("event_id", "row_idx"))
    assert back.layout == c.layout and back.analytics().count() == c.analytics().count()
    plan = back.rows_between([(10, 12)])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(block_id" in plan  # the filter reaches the scan
    with pytest.raises(StorageError):
        store.load(spark, f"file://{tmp_path}/none")
    assert store.coerce_extension("a/b.csv", "tgd") == "a/b.tgd" and store.coerce_extension("a.x/b", "tgd") == "a.x/b.tgd"
    assert store.numbered("t.csv", {"t.csv", "t_1.csv"}.__contains__) == "t_2.csv"


def _picture(height, width, channels):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([(x * 3 + y) % 256, (x + y * 2) % 256, (x * y) % 256, (x + y) % 256][:channels], axis=2).astype(np.uint8)


def _pixels(spark, path):
    im = spark.read.format("image").load(path).select("image.*").head()
    cells = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])
    return cells[:, :, [2, 1, 0, 3][: im["nChannels"]]]


@pytest.mark.parametrize("channels, grouping, group", [(3, "for_first", (3, 3)), (4, "for_min", (2, 2)), (3, "raw", (1, 1)), (3, "for_min", (1, 1))])
def test_image_file_round_trip(spark, tmp_path, channels, grouping, group):
    picture = _picture(13, 17, channels)
    (tmp_path / "a.png").write_bytes(files.png_bytes(picture))
    c, info = files.compress_image(spark, f"file://{tmp_path}/a.png", group, grouping)
    containers.save(c, f"file://{tmp_path}/a.igd", info)
    d = containers.read_igd((tmp_path / "a.igd").read_bytes())
    assert d.image == info
    back = containers.to_compressed(spark, d)
    files.write_image(files.decompress_image(back, d.image), f"file://{tmp_path}/b.png", 17, 13, channels)
    assert np.array_equal(_pixels(spark, f"file://{tmp_path}/b.png"), picture)
    files.write_image(files.decompress_image(back, d.image, (2, 3, 9, 8)), f"file://{tmp_path}/c.png", 8, 6, channels)
    assert np.array_equal(_pixels(spark, f"file://{tmp_path}/c.png"), picture[3:9, 2:10])


def test_group_widths_and_refusals():
    assert sum(images.feature_bits("for_first", 4)) == 35 and sum(images.feature_bits("for_min", 4)) == 34 and sum(images.feature_bits("raw", 4)) == 32
    with pytest.raises(BitloomError):
        images.ImageInfo(3, 3, channels=1)
    with pytest.raises(BitloomError):
        images.feature_bits("raw", 0)
    with pytest.raises(BitloomError):
        images.crop_groups(images.ImageInfo(3, 3), 0, 0, 3, 1)


def test_colour_transform_is_reversible(spark):
    cells = spark.range(32768).selectExpr("'i' AS image", "cast(id AS int) AS x", "0 AS y", "cast(id % 32 * 8 + 3 AS int) AS r", "cast(id div 32 % 32 * 8 AS int) AS g", "cast(id div 1024 * 8 + 7 AS int) AS b")
    info = images.ImageInfo(32768, 1)
    assert images.from_channels(images.to_channels(cells, info), info).exceptAll(cells).count() == 0


def test_zero_padding(spark):
    cells = spark.createDataFrame([("i", x, 0, v, v, v) for x, v in enumerate((10, 40, 70))], "image string, x int, y int, r int, g int, b int")
    rows, _ = images.group_pixels(cells, images.ImageInfo(3, 1, color_model="rgb", grouping="raw", group_width=4, group_height=1))
    assert [rows.first()[f"c0_{i}"] for i in range(4)] == [10, 40, 70, 0]


def test_parsers():
    assert cli.parse_rows("0,5,10-12,5") == [0, 5, 10, 11, 12] and cli.parse_grouping("3x2") == (3, 2) and cli.parse_crop("1, 2,3,4") == (1, 2, 3, 4)
    for parse, text in ((cli.parse_rows, ""), (cli.parse_rows, "5-2"), (cli.parse_rows, "x"), (cli.parse_grouping, "3"), (cli.parse_grouping, "0x1"), (cli.parse_crop, "4,0,1,1"), (cli.one_of("on", "off"), "maybe")):
        with pytest.raises(ValueError):
            parse(text)
    assert cli.derive_output("/a/b.csv", "tgd") == "/a/b.tgd" and cli.format_size(2048) == "2.00 KB" and cli.format_duration(0.5) == "500.0 ms"
    assert cli.action_of(cli.arguments(["x.egd"])) == "decompress_tabular"
    with pytest.raises(ValueError):
        cli.action_of(cli.arguments(["x.csv", "--analytics"]))


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i % 7},{i / 4}\n" for i in range(200)))
    at = f"file://{tmp_path}"
    assert cli.main([f"{at}/t.csv", "--encoding", "huffman", "--base-compression", "on"], spark) == 0
    assert cli.main([f"{at}/t.tgd", "--rows", "3,5-6", "-o", f"{at}/some.csv"], spark) == 0
    assert cli.main([f"{at}/t.tgd", "--analytics", "-o", f"{at}/an.csv"], spark) == 0
    assert cli.main([f"{at}/t.csv", "--crop", "0,0,1,1"], spark) == 1
    some = spark.read.option("header", True).option("inferSchema", True).csv(f"{at}/some.csv")
    assert [tuple(r) for r in some.collect()] == [(3, 0.75), (5, 1.25), (6, 1.5)]
    assert spark.read.option("header", True).csv(f"{at}/an.csv").columns == ["weight", "a", "b"]


def test_streaming_appends_with_a_frozen_layout(spark, events, tmp_path):
    from bitloom.streaming.compress import start

    events.drop("event_id").repartition(3).write.parquet(f"{tmp_path}/in")
    first = compress(events, "event_id", plan=Plan(options=Options(decimals=2), m_max=None))
    stream = spark.readStream.schema(events.drop("event_id").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = start(stream, first, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", {"availableNow": True})
    q.awaitTermination(120)
    rows = spark.read.parquet(f"file://{tmp_path}/out/batch=*/rows")
    assert rows.count() == events.count()


def test_tier_plans():
    histogram = {1: 50, 3: 20, 9: 5, 20: 1}
    found = analysis.plans(histogram, 4, 2)
    # every way to cut the lengths into tiers
    lengths = sorted(histogram)
    for p in found:
        costs = []
        for cuts in itertools.combinations(range(1, 4), p["tiers"] - 1):
            edges = [0, *cuts, 4]
            costs.append(sum(histogram[b] * ((t + 1 if p["mode"] == "unary" else p["prefix_bits"]) + lengths[edges[t + 1] - 1]) for t in range(p["tiers"]) for b in lengths[edges[t] : edges[t + 1]]))
        assert p["total_bits"] == min(costs)
    unary = [p for p in found if p["mode"] == "unary"]
    assert analysis.knee(unary, 0.0001)["total_bits"] <= unary[0]["total_bits"]
    assert analysis.simplest_good(found, histogram, 1000)["tiers"] == 1


def test_precision_summary(spark, sf_dir):
    from bitloom import catalog

    found = analysis.precision_summary(catalog.hll_precision(spark, sf_dir)).first()
    assert found["steps"] > 10 and found["mape"] < 0.2


@pytest.mark.parametrize("suffix", ["png", "ppm", "bmp", "tiff", "gif", "jpg"])
def test_image_formats(spark, tmp_path, suffix):
    """Images are written as their extension says; Spark reads them back, exactly where the format loses nothing."""
    cells = np.random.default_rng(3).integers(0, 4, (5, 7, 3), dtype=np.uint8) * 80
    pixels = spark.createDataFrame([(x, y, *map(int, cells[y, x])) for y in range(5) for x in range(7)], "x int, y int, r int, g int, b int")
    files.write_image(pixels, f"file://{tmp_path}/a.{suffix}", 7, 5)
    data = (tmp_path / f"a.{suffix}").read_bytes()
    if suffix == "ppm":
        assert data == b"P6\n7 5\n255\n" + cells.tobytes()
    elif suffix == "tiff":
        assert data[:2] in (b"II", b"MM") and len(data) > 100
    else:
        found = files.to_pixels(files.open_images(spark, f"file://{tmp_path}/a.{suffix}")).select("x", "y", "r", "g", "b")
        assert found.count() == 35 and (suffix in ("gif", "jpg") or _same(found, pixels))


def test_images_that_cannot_be_written(spark, tmp_path):
    with pytest.raises(ImageError):
        files.format_of("a.xyz")
    for suffix in ("jpg", "ppm"):
        with pytest.raises(ImageError):
            files.image_bytes(spark, np.zeros((2, 2, 4), dtype=np.uint8), suffix)
