"""Image kernels and the scan of a directory, on PNGs made here."""

import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest

from twinsift import __main__ as cli
from twinsift import config
from twinsift.functions import images as I
from twinsift.plans import pipeline, views
from twinsift.sources import files


def png(path, a):
    """Writes an 8-bit RGB array."""
    h, w, _ = a.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def texture(seed, height, width):
    rng = np.random.default_rng(seed)
    small = rng.integers(0, 255, (12, 16, 3)).astype(float)
    return np.stack([I.resize(small[:, :, c], height, width) for c in range(3)], 2).clip(0, 255).astype(np.uint8)


def luma(a):
    return np.rint(a[:, :, ::-1].astype(np.float32) @ I.LUMA)


def distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_exports_of_one_picture_are_near_and_others_are_not():
    base = texture(1, 600, 800)
    small = np.stack([I.resize(base[:, :, c], 150, 200) for c in range(3)], 2).astype(np.uint8)
    a, b, c = (I.perceptual_hash(luma(x)) for x in (base, small, texture(2, 600, 800)))
    assert distance(a, b) <= 10 < distance(a, c)


def test_resize_by_area_is_the_block_mean():
    a = np.arange(64, dtype=float).reshape(8, 8)
    assert np.allclose(I.resize(a, 4, 2), a.reshape(4, 2, 2, 4).mean((1, 3)))
    assert np.allclose(I.resize(np.full((5, 7), 3.0), 11, 3), 3.0)


def test_dct_of_a_constant_is_its_first_term():
    out = I.DCT32 @ np.ones((32, 32)) @ I.DCT32.T
    assert out[0, 0] == pytest.approx(32) and np.abs(out).sum() == pytest.approx(32)


def test_tiny_and_flat_images():
    for shape in ((1, 1), (2, 9), (9, 2)):
        a = np.full(shape, 7.0)
        assert I.effective_resolution(a) == (0.0, 0.0) and I.noise(a) == 0.0 and I.blockiness(a) == 0.0
    assert I.sharpness(np.full((40, 40), 9.0)) == pytest.approx(0, abs=1e-12)
    assert I.gray(None, 3, 3, 3) is None and I.gray(b"x", -1, -1, 3) is None


def test_metrics_follow_what_they_measure():
    rng = np.random.default_rng(0)
    clean = luma(texture(3, 256, 256))
    noisy = clean + rng.normal(0, 10, clean.shape)
    assert I.noise(noisy) == pytest.approx(10, rel=0.15) and I.noise(clean) < 2
    steps = clean + 20 * ((np.arange(256) // 8) % 2)[None, :]
    assert I.blockiness(steps) > I.blockiness(clean) + 1
    sharp = rng.integers(0, 255, (512, 512)).astype(float)
    soft = I.resize(I.resize(sharp, 64, 64), 512, 512)
    assert I.sharpness(sharp) > I.sharpness(soft)
    assert I.effective_resolution(noisy)[1] <= 256


def test_resolution_scales_back_to_the_original_side():
    a = luma(texture(5, 1200, 3000))
    share, px = I.effective_resolution(a)
    assert px == pytest.approx(share * 1200)
    assert I.effective_resolution(a[:, :2048])[1] <= 1200


@pytest.fixture()
def album(tmp_path):
    base = texture(7, 300, 400)
    shrink = lambda h, w: np.stack([I.resize(base[:, :, c], h, w) for c in range(3)], 2).astype(np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "_old").mkdir()
    png(tmp_path / "big.png", base)
    png(tmp_path / "sub" / "small.PNG", shrink(75, 100))
    png(tmp_path / "other.png", texture(8, 200, 300))
    png(tmp_path / "copy.png", base)
    png(tmp_path / "_old" / "left.png", base)
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_scan_groups_scores_and_caches(spark, album, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store"))
    cfg = config.ScanConfig(str(album), recursive=True)
    assert {r["path"].rsplit("/", 1)[1] for r in files.scan(spark, cfg).collect()} == {"big.png", "small.PNG", "other.png", "copy.png", "broken.png"}
    for _ in range(2):
        groups, members = pipeline.scan_images(spark, cfg, store)
        got = sorted((r["member_idx"], r["path"].rsplit("/", 1)[1]) for r in members.collect())
        assert got == [(0, "big.png"), (1, "copy.png"), (2, "small.PNG")]
        g = groups.collect()
        assert len(g) == 1 and g[0]["suggested_idx"] == 0 and g[0]["is_close_call"] and g[0]["members"] == 3
    table = views.unpivoted(members, ["group_id", "member_idx"], views.image_cells())
    shown = {(r["member_idx"], r["label"]): r["value"] for r in table.collect()}
    assert shown[0, "Dimensions"] == "400x300" and shown[2, "Dimensions"] == "100x75" and shown[0, "NIQE (lower better)"] == "n/a"


def test_names_that_uris_encode_stay_in_their_group(spark, tmp_path, tmp_path_factory):
    base = texture(7, 120, 160)
    names = ["k[1].png", "p%20q.png", "a b.png", "c+d.png", "é#?.png", "x{y}*.png"]
    for n in names:
        png(tmp_path / n, base)
    png(tmp_path / "k1.png", texture(9, 120, 160))
    cfg = config.ScanConfig(str(tmp_path))
    for few in (files.FEW_PATHS, 1):
        found = files.scan(spark, cfg).select("path")
        assert {r["path"] for r in files.images(spark, cfg, found, few).select("path").collect()} == {f"{tmp_path}/{n}" for n in [*names, "k1.png"]}
    _, members = pipeline.scan_images(spark, cfg, str(tmp_path_factory.mktemp("store")))
    assert {r["path"].rsplit("/", 1)[1] for r in members.collect()} == set(names)


def test_a_cached_scan_decodes_what_is_new_alone(spark, album, tmp_path_factory, monkeypatch):
    store, cfg, asked = str(tmp_path_factory.mktemp("store")), config.ScanConfig(str(album), recursive=True), []
    load = files.images
    monkeypatch.setattr(files, "images", lambda s, c, wanted, *a: (asked.append({r["path"].rsplit("/", 1)[1] for r in wanted.collect()}), load(s, c, wanted, *a))[1])
    pipeline.scan_images(spark, cfg, store)
    assert asked == [{"big.png", "small.PNG", "other.png", "copy.png", "broken.png"}, {"big.png", "small.PNG", "copy.png"}]
    asked.clear()
    png(album / "new.png", texture(7, 300, 400))
    _, members = pipeline.scan_images(spark, cfg, store)
    assert asked == [{"new.png", "broken.png"}, {"new.png"}] and members.count() == 4


def test_half_spectrum_gives_the_rings_of_the_whole():
    rng = np.random.default_rng(1)
    for h, w in ((8, 8), (9, 12), (12, 9), (7, 7)):
        a = rng.normal(size=(h, w))
        power = np.abs(np.fft.fftshift(np.fft.fft2(a))) ** 2
        ring = np.hypot(np.arange(h)[:, None] - h // 2, np.arange(w)[None, :] - w // 2).astype(int)
        half = np.abs(np.fft.rfft2(a)) ** 2
        half[:, 1 : (w + 1) // 2] *= 2
        n = min(h, w) // 2
        assert np.bincount(I._ring(h, w), half.ravel())[:n] == pytest.approx(np.bincount(ring.ravel(), power.ravel())[:n])


def test_thumbnails_fit_and_fail_as_a_gray_square(spark, album):
    a = texture(3, 90, 300)[:, :, ::-1]
    w, h, data = I.thumbnail(a.tobytes(), 90, 300, 3, side=100)
    assert (w, h) == (100, 30) and len(data) == 100 * 30 * 3
    assert I.thumbnail(a.tobytes(), 90, 300, 3) == (300, 90, texture(3, 90, 300).tobytes())  # never enlarged, RGB
    assert I.thumbnail(None, -1, -1, -1, side=8) == (8, 8, bytes((60, 60, 60)) * 64)
    cfg = config.ScanConfig(str(album))
    got = {r["path"].rsplit("/", 1)[1]: r["t"] for r in files.images(spark, cfg, files.scan(spark, cfg).select("path")).select("path", I.image_thumbnail(side=50).alias("t")).collect()}
    assert (got["big.png"]["width"], got["big.png"]["height"]) == (50, 38) and (got["broken.png"]["width"], got["broken.png"]["height"]) == (50, 50)


def test_other_formats_go_through_an_optional_decoder(spark):
    def decode(content):
        return np.full((2, 3, 3), content[0], np.uint8)

    df = spark.createDataFrame([("a.heic", bytearray(b"\x07x")), ("b.heic", bytearray()), ("c.heic", None)], "path string, content binary")
    got = {r["path"]: r["i"] for r in df.select("path", I.other_formats("path", "content", decode).alias("i")).collect()}
    assert (got["a.heic"]["height"], got["a.heic"]["width"], bytes(got["a.heic"]["data"])) == (2, 3, b"\x07" * 18)
    assert got["b.heic"]["height"] == got["c.heic"]["height"] == -1
    assert [r["h"] for r in df.select(I.image_hash(I.other_formats("path", "content", decode)).alias("h")).collect()][1:] == [None, None]


def test_optional_scorers_are_asked_where_they_are_installed(monkeypatch):
    import types

    a = texture(2, 40, 50)
    assert I.analyse(a.tobytes(), 40, 50, 3)["brisque"] is None
    seen = []
    scorer = types.SimpleNamespace(BRISQUE=lambda url: types.SimpleNamespace(score=lambda img: seen.append(img) or 12))
    monkeypatch.setattr(I, "optional", lambda name: scorer if name == "brisque" else None)
    got = I.analyse(a.tobytes(), 40, 50, 3)
    assert got["brisque"] == 12.0 and got["niqe"] is None and (seen[0] == a[:, :, ::-1]).all()
    scorer.BRISQUE = lambda url: 1 / 0
    assert I.analyse(a.tobytes(), 40, 50, 3)["brisque"] is None


def test_an_older_file_in_the_way_stays(spark, album, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (album / "_duplicates").mkdir()
    (album / "_duplicates" / "copy.png").write_bytes(b"older")
    assert cli.main(["scan", str(album), "--auto"]) == 0
    assert (album / "_duplicates" / "copy.png").read_bytes() == b"older" and (album / "_duplicates" / "copy_dup1.png").exists()


def test_flat_scan_finds_direct_children_only(spark, album):
    got = files.scan(spark, config.ScanConfig(str(album))).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in got} == {"big.png", "other.png", "copy.png", "broken.png"}


def test_command_line(spark, album, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["scan", str(album / "missing")]) == 1
    assert cli.main(["scan", str(album), "-r", "--auto", "--dry-run"]) == 0
    assert "moved=2 bytes=0" in capsys.readouterr().out and (album / "copy.png").exists()
    assert cli.main(["scan", str(album), "-r", "--auto"]) == 0
    assert "confirmed=1 failed=0 moved=2" in capsys.readouterr().out
    assert (album / "big.png").exists() and (album / "_duplicates" / "sub" / "small.PNG").exists() and (album / "_duplicates" / "copy.png").exists()
    assert cli.main(["compare", str(album / "big.png"), str(album / "other.png")]) == 0
    assert "400x300" in capsys.readouterr().out
    for bad in ("missing.png", "broken.png"):
        assert cli.main(["compare", str(album / "big.png"), str(album / bad)]) == 1
        assert bad in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["scan", str(album), "--threshold", "65"])


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import pathlib
    import shutil

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "twinsift", tmp_path / "twinsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
