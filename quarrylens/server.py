"""A small local HTTP service over the same analysis, with the standard library alone.

    POST /api/analyze {"path", "mode": "full"|"sample", "sample_size", "force_type"}  -> {"job_id"}
    GET  /api/analyze/progress/{job}    server-sent events, the last one complete or error
    GET  /api/analyze/result/{job}      the report, or 202 while it runs
    GET  /api/report                    the last finished report
    GET  /api/report/export?format=     json, markdown or html
    GET  /api/examples?limit=           1 to 100 of the report's examples
    GET  /api/image?path=               an image below the reported path
    GET  /api/image/thumbnail?path=&size=   the same as a base64 PNG, 32 to 1024 pixels
    GET  /health
"""

from __future__ import annotations

import base64
import json
import mimetypes
import os
import struct
import threading
import uuid
import zlib
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
from pyspark.sql import SparkSession

from quarrylens import reports
from quarrylens.engine import analyze
from quarrylens.model import DatasetReport, ProgressUpdate, plain
from quarrylens.operators.images import averaged
from quarrylens.sources.scan import IMAGE_EXTENSIONS, extension_of


@dataclass
class Job:
    """Updates of one analysis; readers wait for news on the condition."""

    updates: list[ProgressUpdate] = field(default_factory=list)
    report: DatasetReport | None = None
    error: str | None = None
    news: threading.Condition = field(default_factory=threading.Condition)

    @property
    def over(self) -> bool:
        return self.report is not None or self.error is not None

    def tell(self, update: ProgressUpdate) -> None:
        with self.news:
            self.updates.append(update)
            self.news.notify_all()

    def run(self, spark: SparkSession, path: str, sample_size: int | None, force_type: str | None) -> None:
        try:
            report, error = analyze(spark, path, sample_size, force_type, self.tell), None
        except Exception as failure:  # handed to the client
            report, error = None, f"{type(failure).__name__}: {failure}"[:2000]
        with self.news:
            self.report, self.error = report, error
            if error:
                self.updates.append(ProgressUpdate("error", "error", 1.0, message=error))
            self.news.notify_all()


def png(pixels: np.ndarray) -> bytes:
    """RGB bytes [h, w, 3] as a PNG."""
    h, w = pixels.shape[:2]
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def thumbnail(spark: SparkSession, path: str, size: int) -> bytes | None:
    row = spark.read.format("image").option("dropInvalid", True).load([path]).select("image.*").first()
    if row is None:
        return None
    bgr = np.frombuffer(bytes(row["data"]), np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    rgb = bgr[:, :, [2, 1, 0]] if bgr.shape[2] >= 3 else np.repeat(bgr[:, :, :1], 3, axis=2)
    ratio = min(1.0, size / max(rgb.shape[:2]))
    return png(averaged(rgb.astype(np.float64), max(1, round(rgb.shape[0] * ratio)), max(1, round(rgb.shape[1] * ratio))).round().astype(np.uint8))


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jobs: dict[str, Job] = {}
        self.last: str | None = None

    def start(self, request: dict) -> str:
        name, job = uuid.uuid4().hex, Job()
        size = None if request.get("mode", "sample") == "full" else request.get("sample_size")
        self.jobs[name] = job
        self.last = name
        threading.Thread(target=job.run, args=(self.spark, request["path"], size, request.get("force_type")), daemon=True).start()
        return name

    def report(self) -> DatasetReport | None:
        return self.jobs[self.last].report if self.last else None

    def image_path(self, path: str) -> str | None:
        """The real path of an image below the reported folder, never outside it."""
        report = self.report()
        if report is None or extension_of(path) not in IMAGE_EXTENSIONS:
            return None
        real, root = os.path.realpath(path), os.path.realpath(report.scan.root)
        return real if os.path.commonpath([real, root]) == root and os.path.isfile(real) else None


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_) -> None:
            pass

        def send(self, body: bytes | str | dict | list, status: int = 200, kind: str = "application/json") -> None:
            if not isinstance(body, (bytes, str)):
                body = json.dumps(body, ensure_ascii=False, default=str)
            data = body.encode() if isinstance(body, str) else body
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def fail(self, status: int, why: str) -> None:
            self.send({"error": why}, status)

        def do_POST(self) -> None:
            if urlparse(self.path).path != "/api/analyze":
                return self.fail(404, "no such address")
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                path = request["path"]
            except (ValueError, KeyError, TypeError):
                return self.fail(400, "a JSON object with a path is needed")
            if not os.path.exists(path):
                return self.fail(404, "no such path")
            self.send({"job_id": service.start(request)})

        def do_GET(self) -> None:
            url = urlparse(self.path)
            query = {k: v[-1] for k, v in parse_qs(url.query).items()}
            parts = url.path.strip("/").split("/")
            if url.path == "/health":
                return self.send({"status": "ok"})
            if parts[:2] == ["api", "analyze"] and len(parts) == 4 and parts[2] in ("progress", "result"):
                job = service.jobs.get(parts[3])
                if job is None:
                    return self.fail(404, "no such job")
                return self.stream(job) if parts[2] == "progress" else self.result(job)
            report = service.report()
            if report is None:
                return self.fail(404, "no report yet" if parts[0] == "api" else "no such address")
            if url.path == "/api/report":
                return self.send(reports.as_json(report))
            if url.path == "/api/report/export":
                form = query.get("format", "json")
                if form not in reports.WRITERS:
                    return self.fail(400, "unknown format")
                return self.send(reports.WRITERS[form](report), kind={"json": "application/json", "markdown": "text/markdown", "html": "text/html"}[form] + "; charset=utf-8")
            if url.path == "/api/examples":
                return self.send(plain(report.examples[: min(max(self.number(query, "limit", 20), 1), 100)]))
            if url.path in ("/api/image", "/api/image/thumbnail"):
                return self.image(service.image_path(query.get("path", "")), url.path.endswith("thumbnail"), min(max(self.number(query, "size", 256), 32), 1024))
            self.fail(404, "no such address")

        @staticmethod
        def number(query: dict, name: str, default: int) -> int:
            try:
                return int(query.get(name, default))
            except ValueError:
                return default

        def result(self, job: Job) -> None:
            if not job.over:
                return self.send({"status": "running"}, 202)
            if job.error:
                return self.fail(500, job.error)
            self.send(reports.as_json(job.report))

        def stream(self, job: Job) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            sent = 0
            while True:
                with job.news:
                    job.news.wait_for(lambda: len(job.updates) > sent or job.over, timeout=15)
                    new, over = job.updates[sent:], job.over
                sent += len(new)
                for update in new:
                    self.wfile.write(f"data: {json.dumps(plain(update))}\n\n".encode())
                self.wfile.flush()
                if over and sent == len(job.updates):
                    return

        def image(self, path: str | None, small: bool, size: int) -> None:
            if path is None:
                return self.fail(403, "not an image of the report")
            if not small:
                with open(path, "rb") as source:
                    return self.send(source.read(), kind=mimetypes.guess_type(path)[0] or "application/octet-stream")
            data = thumbnail(service.spark, path, size)
            if data is None:
                return self.fail(422, "the image cannot be decoded")
            self.send({"thumbnail": "data:image/png;base64," + base64.b64encode(data).decode()})

    return Handler


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready; call serve_forever() on it."""
    return ThreadingHTTPServer((host, port), handler(Service(spark)))
