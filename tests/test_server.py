"""The HTTP service, end to end on a folder of images."""

import base64
import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import numpy as np
import pytest

from quarrylens.operators.images import header
from quarrylens.server import png, serve


def test_service(spark, tmp_path):
    for k in range(3):
        (tmp_path / "set" / "ab"[k % 2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "set" / "ab"[k % 2] / f"{k}.png").write_bytes(png(np.random.default_rng(k).integers(0, 255, (300, 200, 3)).astype(np.uint8)))
    (tmp_path / "secret.png").write_bytes(png(np.zeros((4, 4, 3), np.uint8)))
    server = serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path: urllib.request.urlopen(base + path, timeout=300).read().decode("utf-8", "replace")

    def post(body):
        return json.loads(urllib.request.urlopen(urllib.request.Request(base + "/api/analyze", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=60).read())

    def status(call, *args):
        with pytest.raises(urllib.error.HTTPError) as e:
            call(*args)
        return e.value.code

    assert json.loads(get("/health")) == {"status": "ok"}
    assert status(get, "/api/report") == 404 and status(post, {"path": "/none"}) == 404 and status(post, {}) == 400 and status(get, "/api/analyze/result/x") == 404
    job = post({"path": str(tmp_path / "set"), "mode": "full"})["job_id"]
    events = [json.loads(line[6:]) for line in get(f"/api/analyze/progress/{job}").splitlines() if line.startswith("data: ")]
    assert events[-1]["status"] == "complete" and [e["progress"] for e in events] == sorted(e["progress"] for e in events)
    report = json.loads(get(f"/api/analyze/result/{job}"))
    assert report["dataset"]["num_samples"] == 3 and json.loads(get("/api/report")) == report
    assert get("/api/report/export?format=markdown").startswith("# ") and status(get, "/api/report/export?format=x") == 400
    images = json.loads(get("/api/examples?limit=2"))
    assert len(images) == 2
    path = urllib.parse.quote(images[0]["path"])
    small = base64.b64decode(json.loads(get(f"/api/image/thumbnail?path={path}&size=64"))["thumbnail"].split(",")[1])
    assert header(small)[1:3] == (43, 64) and get(f"/api/image?path={path}")
    assert status(get, f"/api/image?path={urllib.parse.quote(str(tmp_path / 'secret.png'))}") == 403
    server.shutdown()
