"""Unit fixtures, failure values, caps, files and command line."""

import json
import struct

import numpy as np
import pytest
from pixelloom import api, cli, schemas, sinks
from pixelloom.functions.classify import is_image_file, is_image_path
from pixelloom.operators import frames as V
from pixelloom.operators import images as I
from pixelloom.operators import records
from pixelloom.sources import image_files, video_tables
from pixelloom.functions import jpeg, kernels, webp
from pixelloom.streaming import stream_image_features
from pyspark.sql import functions as F


def image(h, w, c, data=None, fill=0):
    return ("x", h, w, c, 16 if c == 3 else 0, bytes(data if data is not None else [fill] * (h * w * c)))


def dot(base, value):
    px = [base] * 100
    px[55] = value
    return image(10, 10, 1, px)


def table(spark, **images):
    return spark.createDataFrame([(k, v) for k, v in images.items()], "name string, image " + schemas.IMAGE_DDL)


def test_image_fixtures(spark):
    df = table(
        spark, dims=image(100, 200, 3), gray=image(10, 10, 1, fill=128), bright=image(2, 2, 3, [100, 150, 200] * 4), edges=dot(0, 255), sharp=dot(128, 255),
        contrast=dot(100, 200), one=image(10, 10, 3, [255, 0, 0] * 100), bad=("x", -1, -1, -1, -1, None), black=image(4, 4, 3), tiny=image(1, 1, 1, [7]),
    )
    r = {x["name"]: x for x in I.image_metrics(df, k=1).collect()}
    assert (r["dims"]["width"], r["dims"]["height"], r["dims"]["aspect_ratio"], r["dims"]["channels"]) == (200, 100, 2.0, 3)
    assert r["gray"]["is_grayscale"] and r["gray"]["entropy"] == 0 and not r["one"]["is_grayscale"]
    assert r["bright"]["average_brightness"] == 150 and r["bright"]["saturation_level"] == 128
    assert r["edges"]["edge_count"] == 8 and round(r["sharp"]["blur_score"], 1) == 3225.8
    assert abs(r["contrast"]["contrast_ratio"] - 200 / (100 + 1e-6)) < 1e-9 and r["black"]["contrast_ratio"] == 0
    assert r["one"]["dominant_colors"] == [[255.0, 0.0, 0.0]] and r["tiny"]["dominant_colors"] == [[7.0, 7.0, 7.0]]
    assert [len(h) for h in r["bright"]["histogram"]] == [256] * 3 and r["bright"]["histogram"][0][100] == 4
    bad = r["bad"]
    assert (bad["width"], bad["aspect_ratio"], bad["channels"], bad["is_grayscale"], bad["edge_count"]) == (-1, 0.0, -1, False, -1)
    assert (bad["average_brightness"], bad["blur_score"], bad["contrast_ratio"], bad["saturation_level"], bad["entropy"]) == (-1,) * 5
    assert bad["histogram"] == [] and bad["dominant_colors"] == []
    assert I.image_metrics(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 50, 51, 101, 102, 1001, 1002])
def test_frame_caps(spark, n):
    level = lambda i: 10 if i <= 49 else 90 if i <= 100 else 255 * (i % 2)
    frames = spark.createDataFrame([(1, i, image(1, 1, 1, [level(i)])) for i in range(n)], schemas.FRAMES)
    videos = spark.createDataFrame([(1, "/v/a.mp4", n, 25.0, 1, 1)], schemas.VIDEOS)
    r = records.process_videos(videos, frames).first()
    seen = [level(i) for i in range(min(n, 101))]
    assert r["average_brightness"] == (sum(seen) / len(seen) if n else -1.0)
    assert r["motion_score"] == 0.0 and r["color_consistency"] == (0.0 if n else -1.0) and r["is_grayscale"]
    assert r["scene_changes"] == [i for i in range(1, min(n, 1001)) if abs(level(i) - level(i - 1)) > 30]
    assert r["duration_seconds"] == n / 25 and r["first_frame_extracted"] == (n > 0)


def test_threshold_is_strict(spark):
    frames = spark.createDataFrame([(1, i, image(1, 1, 1, [v])) for i, v in enumerate((0, 30, 61))], schemas.FRAMES)
    videos = spark.createDataFrame([(1, "a", 3, 0.0, 1, 1), (2, "b", -1, -1.0, -1, -1)], schemas.VIDEOS)
    assert V.video_scene_changes(videos, frames).filter("video_id = 1").first()["scene_changes"] == [2]
    r = {x["video_id"]: x for x in records.process_videos(videos, frames).collect()}
    assert r[1]["duration_seconds"] == -1 and r[1]["frame_rate_stability"] == -1 and r[2]["error"] and r[2]["fps"] is None


def test_extensions(spark):
    want = {"a.JPG": True, "..jpg": True, "a.tar.JPEG": True, ".jpg": False, "x/.png": False, "d.jpg/f": False, "a.jpg/": False, "a.jpg?x": False, "a.jpg\n": False}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", is_image_file(F.col("p")).alias("x")).collect()
    assert {r["p"]: r["x"] for r in got} == want == {p: is_image_path(p) for p in want}


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(path, frames, w, h, bits=24, kind=b"\0" * 4, palette=b"", upright=False):
    """An AVI file of the given frame chunks."""
    head = chunk(b"avih", struct.pack("<14I", 40000, 0, 0, 0, len(frames), 0, 1, 0, w, h, 0, 0, 0, 0))
    strh = chunk(b"strh", b"vids" + bytes(52))
    strf = chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, w, -h if upright else h, 1, bits, kind, 0, 0, 0, 0, 0) + palette)
    movi = b"".join(chunk(b"00dc" if kind.strip(b"\0") else b"00db", f) for f in frames)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + head + chunk(b"LIST", b"strl" + strh + strf)) + chunk(b"LIST", b"movi" + movi)
    path.write_bytes(chunk(b"RIFF", body))


def flat(w, h, v, c=3):
    return bytes([v]) * ((w * c + 3) // 4 * 4 * h)


def mov(path, frames, w, h, codec=b"jpeg"):
    """A QuickTime file: samples first, then the tables, two samples a chunk."""
    box = lambda n, b: struct.pack(">I4s", len(b) + 8, n) + b
    ftyp, mdat = box(b"ftyp", b"qt  " + bytes(4)), box(b"mdat", b"".join(frames))
    starts, at = [], len(ftyp) + 8
    for i, f in enumerate(frames):
        if i % 2 == 0:
            starts.append(at)
        at += len(f)
    stsd = bytes(4) + struct.pack(">I", 1) + box(codec, bytes(24) + struct.pack(">HH", w, h) + bytes(50))
    n = len(frames)
    runs = [(1, 2, 1)] if n % 2 == 0 else [(1, 2, 1), (n // 2 + 1, 1, 1)]
    stbl = box(b"stsd", stsd) + box(b"stts", struct.pack(">IIII", 0, 1, n, 20)) + box(b"stsz", struct.pack(">III", 0, 0, n) + b"".join(struct.pack(">I", len(f)) for f in frames))
    stbl += box(b"stsc", struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)) + box(b"stco", struct.pack(f">II{len(starts)}I", 0, len(starts), *starts))
    mdia = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 500, 20 * n) + bytes(4)) + box(b"hdlr", bytes(8) + b"vide" + bytes(12)) + box(b"minf", box(b"stbl", stbl))
    path.write_bytes(ftyp + mdat + box(b"moov", box(b"trak", box(b"mdia", mdia))))


def test_files_and_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.png").write_bytes(sinks.png(bytes([1, 2, 200] * 6), 3, 2, 3))
    (tmp_path / "gray.PNG").write_bytes(sinks.png(bytes([9] * 6), 3, 2, 1))
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "broken.webp").write_bytes(b"RIFFxxxx")
    (tmp_path / "none.webp").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"no image")
    (tmp_path / "odd").mkdir()
    for n in ("b[1] {x}*.png", "é ?.png"):
        (tmp_path / "odd" / n).write_bytes(sinks.png(bytes([1, 2, 200] * 6), 3, 2, 3))
    (tmp_path / "odd" / "e[2].jpg").write_bytes(b"")
    odd = api.process_images(spark, [str(p) for p in sorted((tmp_path / "odd").iterdir())])
    assert [("error" in r, r.get("width")) for r in odd] == [(False, 3), (True, None), (False, 3)]
    for p in (tmp_path / "odd").iterdir():
        p.unlink()
    wide = np.arange(40, dtype=np.uint8).reshape(4, 10) * 5
    (tmp_path / "w.webp").write_bytes(webp.encode_gray([wide])[0])
    avi(tmp_path / "v.avi", [flat(3, 2, v) for v in (10, 10, 200)], 3, 2)
    avi(tmp_path / "second.avi", [flat(3, 2, v) for v in (50, 60)], 3, 2)
    rows = {r["filename"].rsplit("/", 1)[1]: r for r in records.process_images(image_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.png", "gray.PNG", "empty.jpg", "broken.webp", "none.webp", "w.webp"}
    assert rows["a.png"]["dominant_colors"][0] == [1.0, 2.0, 200.0] and rows["gray.PNG"]["channels"] == 3
    assert all(rows[n]["error"] and rows[n]["width"] is None for n in ("empty.jpg", "broken.webp", "none.webp"))
    assert (rows["w.webp"]["width"], rows["w.webp"]["height"], rows["w.webp"]["average_brightness"]) == (10, 4, float(wide.mean()))
    v = api.process_video(spark, str(tmp_path / "v.avi"))
    assert (v["frame_count"], v["fps"], v["scene_changes"], v["width"], v["first_frame_saved"]) == (3, 25.0, [2], 3, False)
    assert api.extract_first_frame(spark, str(tmp_path / "v.avi"))["data"] == bytes([10] * 18) and api.extract_first_frame(spark, "gone.avi") is None
    out = tmp_path / "r.json"
    asked = ["a.png", "v.avi", "gone.png", "a.png", "second.avi", "notes.txt", "w.webp", str(tmp_path / "v.avi")]
    assert cli.main([*asked, "--output", str(out)]) == 0
    report = json.loads(out.read_text())
    assert [r["filename"] for r in report["images"]] == ["a.png", "a.png", "w.webp"]
    assert [(r["filename"], r["first_frame_saved"]) for r in report["videos"]] == [("v.avi", True), ("second.avi", True), (str(tmp_path / "v.avi"), True)]
    assert [r["first_frame_path"] for r in report["videos"]][1].endswith("second_first_frame.jpg")
    stills = {r["filename"].rsplit("/", 1)[1]: r for r in records.process_images(image_files(spark, [str(tmp_path / "v_first_frame.jpg"), str(tmp_path / "second_first_frame.jpg")])).collect()}
    assert stills["v_first_frame.jpg"]["width"] == 3 and abs(stills["second_first_frame.jpg"]["average_brightness"] - 50) <= 1
    assert cli.main([]) == 1 and cli.main([str(tmp_path / "none"), "--output", str(tmp_path / "no" / "dir.json")]) == 1
    stream_image_features(spark, str(tmp_path), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    streamed = {r["filename"].rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert set(rows) - {"empty.jpg", "none.webp"} <= set(streamed) and streamed["gray.PNG"]["channels"] == 3 and streamed["broken.webp"]["error"]
    videos, frames = video_tables(spark, str(tmp_path / "v.avi"))
    saved = sinks.save_first_frames(videos, frames, str(tmp_path), unique=True, kind="png").first()
    assert saved["saved"] and saved["path"].endswith("_v_first_frame.png")
    assert not sinks.save_first_frames(videos, frames, str(tmp_path / "no")).first()["saved"]
    sinks.write_report(str(out), records.process_images(image_files(spark, str(tmp_path))), None)
    assert json.loads(out.read_text())["videos"] == []


def test_video_containers(spark, tmp_path):
    """Palettes, row order, truncated and dropped frames, coded frames, and codecs without a decoder."""
    px = np.zeros((8, 16, 3), np.uint8)
    px[:, :, 1] = np.arange(16) * 10
    coded = [jpeg.encode(np.roll(px, i, axis=1), 1) for i in range(5)]
    palette = b"".join(bytes([i, 0, 255 - i, 0]) for i in range(256))
    avi(tmp_path / "p.avi", [bytes([5, 6, 7, 0, 8, 9, 10, 0])], 3, 2, 8, palette=palette)
    avi(tmp_path / "u.avi", [bytes([5, 6, 7, 0, 8, 9, 10, 0])], 3, 2, 8, palette=palette, upright=True)
    avi(tmp_path / "t.avi", [flat(3, 2, 9), b"", flat(3, 2, 9)[:10], flat(3, 2, 99)], 3, 2)
    avi(tmp_path / "m.avi", coded, 16, 8, kind=b"MJPG")
    avi(tmp_path / "x.avi", [b"abcd"], 16, 8, kind=b"XVID")
    mov(tmp_path / "q.mov", coded, 16, 8)
    mov(tmp_path / "h.mp4", [b"abc"] * 4, 16, 8, codec=b"avc1")
    (tmp_path / "z.mkv").write_bytes(b"\x1aE\xdf\xa3" + bytes(50))
    videos, frames = video_tables(spark, str(tmp_path))
    name = lambda r: r["filename"].rsplit("/", 1)[1]
    r = {name(x): x for x in records.process_videos(videos, frames).collect()}
    assert {n for n, x in r.items() if x["error"]} == {"x.avi", "h.mp4", "z.mkv"} and r["h.mp4"]["error"] == "No decoder for avc1"
    meta = {x["path"].rsplit("/", 1)[1]: x for x in videos.collect()}
    assert (meta["h.mp4"]["frame_count"], meta["h.mp4"]["fps"], meta["h.mp4"]["width"], meta["h.mp4"]["height"]) == (4, 25.0, 16, 8)
    ids = {x["video_id"]: n for n, x in r.items()}
    first = {ids[x["video_id"]]: bytes(x["image"]["data"]) for x in frames.filter("frame_index = 0").collect()}
    top, bottom = bytes([5, 0, 250, 6, 0, 249, 7, 0, 248]), bytes([8, 0, 247, 9, 0, 246, 10, 0, 245])
    assert first["p.avi"] == bottom + top and first["u.avi"] == top + bottom
    assert r["t.avi"]["average_brightness"] == 54 and r["t.avi"]["frame_count"] == 4 and r["t.avi"]["scene_changes"] == []
    for n in ("m.avi", "q.mov"):
        assert (r[n]["frame_count"], r[n]["fps"], r[n]["width"], r[n]["first_frame_info"]["channels"]) == (5, 25.0, 16, 3)
        assert abs(r[n]["average_brightness"] - 25) < 1.5 and 0 < r[n]["motion_score"] < 30 and len(r[n]["dominant_colors"]) == 3


def test_colours_of_a_video_are_those_of_its_pixels(spark):
    rnd = np.random.default_rng(3)
    for n in (1, 4, 12):
        data = [rnd.integers(0, 256, 7 * 5 * 3, dtype=np.uint8).tobytes() for _ in range(n)]
        frames = spark.createDataFrame([(1, i, image(5, 7, 3, d)) for i, d in enumerate(data)], schemas.FRAMES)
        videos = spark.createDataFrame([(1, "a", n, 1.0, 7, 5)], schemas.VIDEOS)
        want = kernels.dominant_colors(np.frombuffer(b"".join(data[:10]), np.uint8).reshape(-1, 3), 3)
        assert V.video_dominant_colors(videos, frames).first()["dominant_colors"] == [list(c[:3]) for c in want]


def test_jpeg_and_webp_files_are_read_back(spark, tmp_path):
    y, x = np.mgrid[:17, :30]
    px = np.stack([x * 8, y * 15, 255 - x * 4], axis=2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(px, 1))
    (tmp_path / "b.webp").write_bytes(webp.encode_gray([px[:, :, 0]])[0])
    got = {r["filename"].rsplit("/", 1)[1]: np.frombuffer(bytes(r["image"]["data"]), np.uint8).reshape(17, 30, 3).astype(int) for r in image_files(spark, str(tmp_path)).collect()}
    assert abs(got["a.jpg"] - px).max() <= 4 and (got["b.webp"] == px[:, :, :1]).all()
