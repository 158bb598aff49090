"""The batch command: every file on its own, results whole, exit codes."""

import json

import numpy as np

from rasterloom import batch
from rasterloom.sources import images as I


def test_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "deeper").mkdir()
    half = np.zeros((16, 16, 4), np.uint8)
    half[:, :8] = (200, 0, 0, 255)
    half[:, 8:] = (0, 0, 200, 255)
    wide = np.full((8, 32, 4), 255, np.uint8)
    empty = np.zeros((16, 16, 4), np.uint8)
    for name, img in (("half.png", half), ("wide.dat", wide), ("empty.png", empty), ("deeper/no.png", half)):
        (folder / name).write_bytes(I.png_bytes(img))
    (folder / "bad.png").write_bytes(b"not an image")
    photo = spark._jvm.java.awt.image.BufferedImage(16, 16, 1)
    spark._jvm.javax.imageio.ImageIO.write(photo, "jpg", spark._jvm.java.io.File(str(folder / "photo.jpg")))
    args = [str(folder), "--out", str(out), "--pixel-size", "8", "--scale", "2", "--files"]
    assert batch.main(args) == 1
    rows = {r.name: r for r in spark.read.parquet(f"{out}/converted").collect()}
    assert sorted(rows) == ["bad.png", "empty.png", "half.png", "photo.png", "wide.png"]
    assert rows["bad.png"].error and rows["bad.png"].png is None
    assert [(rows[n].width, rows[n].height, rows[n].colors_used) for n in ("half.png", "wide.png", "empty.png", "photo.png")] == [(4, 4, 2), (8, 2, 1), (4, 4, 0), (4, 4, 1)]
    img = I.png_pixels(bytes((out / "half.png").read_bytes()))
    assert (img[:, :2] == (200, 0, 0, 255)).all() and (img[:, 2:] == (0, 0, 200, 255)).all()
    (folder / "bad.png").unlink()
    (tmp_path / "s.json").write_text(json.dumps({"palette": [[255, 255, 255], [0, 0, 0]], "dither": "bayer2"}))
    assert batch.main([*args[:3], "--settings", str(tmp_path / "s.json")]) == 0
    (tmp_path / "s.json").write_text('{"unknown": 1}')
    assert batch.main([*args[:3], "--settings", str(tmp_path / "s.json")]) == 2
    assert batch.main(["--scale", "3"]) == 2


def test_a_stopped_batch_keeps_what_is_done(spark, tmp_path, capsys):
    folder, out, calls = tmp_path / "in", str(tmp_path / "out"), []
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.png").write_bytes(I.png_bytes(np.full((8 + 8 * (k // 2), 8, 4), 255, np.uint8)))
    (folder / "bad.png").write_bytes(b"")

    def proceed(done, total):
        calls.append((done, total))
        return done < 3

    rows = batch.convert_folder(spark, str(folder), out, batch.settings_from(None), 8.0, 1, proceed)
    assert calls == [(1, 5), (3, 5)] and sorted(r["name"] for r in rows.collect()) == ["0.png", "1.png", "bad.png"]
    assert batch.main([str(folder), "--out", out, "--progress"]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines == [{"done": 1, "total": 5}, {"done": 3, "total": 5}, {"succeeded": 4, "failed": 1}]
