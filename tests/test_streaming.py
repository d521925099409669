import json
import os

from relief.operators import tiles
from relief.schema import Grid
from relief.streaming.requests import start_point_value_stream

G = Grid(0.0, 8.0, 1.0, 1.0, 4, 4)


def test_point_value_stream_available_now(spark, raster, tmp_path):
    cells = raster([[float(x + 10 * y) for x in range(8)] for y in range(8)])
    t = tiles.pack(cells, G)
    req = tmp_path / "req"
    req.mkdir()
    with open(req / "a.json", "w") as f:
        for r in [{"id": 1, "x": 2.5, "y": 7.5}, {"id": 2, "x": 5.5, "y": 1.5}, {"id": 3, "lat": 1.0}]:
            f.write(json.dumps(r) + "\n")
    q = start_point_value_stream(spark, str(req), t, G, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = {r.id: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 2.0, 2: 65.0}
    assert [(r.id, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(3, "bad_request")]
    assert os.path.isdir(tmp_path / "ckpt")
