import numpy as np

from scanloom.operators import images as I


def _page(h=120, w=160):
    page = np.full((h, w), 230, np.uint8)
    page[20:100:16, 20:140] = 20
    page[21:100:16, 20:140] = 20
    return page


def test_codec_round_trip():
    rng = np.random.default_rng(1)
    for shape in ((3, 5), (3, 5, 3)):
        image = rng.integers(0, 256, shape, np.uint8)
        assert (I.decode(I.encode(image)) == image).all()


def test_skew_is_found_and_undone():
    for angle in (-3, 0, 4):
        assert I.skew(255 - I.rotate(255 - _page(), -angle)) == angle
    assert I.deskew(_page()) is not None and I.deskew(_page()).shape == (120, 160)


def test_thresholds_part_ink_from_paper():
    page = _page()
    assert 20 <= I.otsu(page) < 230
    for method in ("otsu", "adaptive"):
        out = I.binarize(page, method)
        assert (out[page == 20] == 0).all() and set(np.unique(out)) == {0, 255}


def test_denoise_equals_a_plain_version():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 13), np.uint8)
    h, w = image.shape
    src = np.pad(image.astype(float), 3, "reflect")
    want = np.empty((h, w))
    for y in range(h):
        for x in range(w):
            num = den = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    a, b = src[y + 2 : y + 5, x + 2 : x + 5], src[y + 2 + dy : y + 5 + dy, x + 2 + dx : x + 5 + dx]
                    k = np.exp(-((a - b) ** 2).mean() / 50.0**2)
                    num, den = num + k * src[y + 3 + dy, x + 3 + dx], den + k
            want[y, x] = num / den
    assert np.abs(I.denoise(image, 50.0, 3, 5).astype(float) - want).max() <= 0.5001


def test_point_maps():
    ramp = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert (I.adjust(ramp) == ramp).all() and I.adjust(ramp, 50).min() == 50 and I.adjust(ramp, -50).max() == 205
    assert int(np.ptp(I.adjust(ramp, 0, 40))) == 255 and int(np.ptp(I.adjust(ramp, 0, -60))) < 255
    flat = np.full((40, 40), 77, np.uint8)
    assert (I.sharpen(flat) == flat).all() and (I.median3(flat) == flat).all() and len(np.unique(I.equalize(flat))) == 1
    low = (100 + np.arange(1600).reshape(40, 40) % 20).astype(np.uint8)
    assert np.ptp(I.equalize(low)) > np.ptp(low)
    assert I.enlarge(flat).shape == (60, 60) and I.enlarge(flat, 40) is flat


def test_files_one_bad(spark):
    rgb = np.repeat(_page(40, 60)[..., None], 3, 2)
    df = spark.createDataFrame([("a", bytearray(I.encode(rgb))), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")
    rows = {r["path"]: r for r in I.apply(df).collect()}
    assert rows["a"]["ok"] and I.decode(bytes(rows["a"]["content"])).shape == (60, 90)
    assert not rows["b"]["ok"] and "ValueError" in rows["b"]["error"] and not rows["c"]["ok"] and I.apply(df.limit(0)).count() == 0


def test_crop_to_the_largest_outline():
    page = np.full((120, 160), 40, np.uint8)
    page[30:100, 50:140] = 220
    page[5:9, 5:9] = 220
    out = I.cropped(page)
    # the outline lies within a pixel or two of the bright area's border
    assert abs(out.shape[0] - 90) <= 4 and abs(out.shape[1] - 110) <= 4 and (out == 220).sum() >= 70 * 90
    assert I.cropped(page[:, :45]).shape == (120, 45) and I.cropped(np.zeros((20, 30), np.uint8)).shape == (20, 30)
    colour = np.repeat(page[:, :, None], 3, axis=2)
    assert I.cropped(colour).shape == (*out.shape, 3) and I.rgb(page).shape == (120, 160, 3)


def test_edges_are_thin_and_closed():
    page = np.zeros((60, 60), np.uint8)
    page[20:40, 20:40] = 200
    edges = I.canny(page)
    groups = I._groups(edges)
    assert len(groups) == 1 and edges.sum() <= 4 * 22 and I._enclosed(edges) >= 18 * 18


def test_steps_over_files(spark, sf):
    from scanloom.plans import files

    got = files.QUERIES["image_steps"](spark, sf).collect()
    keys = [r["s_suppkey"] for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()]
    assert len(got) == 10 * len(keys) and {r["path"] for r in got if not r["ok"]} == {f"s{k}.pgm" for k in keys if k % 11 == 0}
    by = {(r["path"], r["step"]): r for r in got}
    for k in keys:
        if k % 11:
            gray, out = by[f"s{k}.pgm", "gray"], by[f"s{k}.pgm", "cropped"]
            assert (gray["width"], gray["height"]) == (120, 90) and (out["width"], out["height"]) <= (120, 90) and out["mean"] >= gray["mean"] - 1e-6
            assert by[f"s{k}.pgm", "enhanced"]["width"] == int(out["width"] * 1.5)


def test_pictures_are_spread_and_read_once(spark, sf):
    from pyspark.sql import functions as F

    from scanloom.plans import files

    parts = files.QUERIES["image_steps"](spark, sf).select(F.spark_partition_id().alias("p"), "path")
    assert parts.select("p").distinct().count() > 1 and parts.groupBy("path").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0


def _plain_denoise(image, strength, patch, search):
    half, p = search // 2, patch // 2
    src = np.pad(image.astype(int), half + p, "reflect" if min(image.shape) > half + p else "symmetric")
    around = lambda y, x: src[y - p : y + p + 1, x - p : x + p + 1]
    out = np.empty(image.shape)
    for y, x in np.ndindex(*image.shape):
        a = around(y + half + p, x + half + p)
        near = [(np.exp(-((around(v, u) - a) ** 2).sum() / patch**2 / strength**2), src[v, u]) for v in range(y + p, y + p + search) for u in range(x + p, x + p + search)]
        out[y, x] = sum(k * v for k, v in near) / sum(k for k, _ in near)
    return out


def test_denoise_weighs_pairs_once(monkeypatch):
    rng = np.random.default_rng(5)
    looked, like = [], I._likeness

    class Table:
        def __init__(self, *a):
            self.table = like(*a)

        def take(self, at, mode):
            looked.append(len(at))
            return self.table.take(at, mode=mode)

    monkeypatch.setattr(I, "_likeness", Table)
    for shape, strength in (((17, 14), 40.0), ((6, 9), 5.0), ((1, 1), 7.0)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        looked.clear()
        assert np.abs(I.denoise(image, strength, 3, 9).astype(float) - _plain_denoise(image, strength, 3, 9)).max() <= 0.5 + 1e-9
        assert len(looked) == (9 * 9 - 1) // 2
    flat = np.full((20, 30), 255, np.uint8)
    flat[:, 15:] = 0
    assert (I.denoise(flat, 5.0) == flat).all()
