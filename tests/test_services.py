"""Services read as Spark sources, over HTTP."""

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from larder.sources import services

SCHEMA = "c_custkey long, c_name string, c_acctbal double, missing string"
FILE = bytes(range(256)) * 40


@pytest.fixture(scope="module")
def server(spark, sf_dir):
    """Pages of `customer`; files whose connection breaks half way the first time."""
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").collect()]
    seen = {"rows": rows, "shown": len(rows), "ranges": [], "pages": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/page":
                offset, size = int(q["offset"]), int(q["size"])
                seen["pages"].append(offset)
                body = json.dumps({"items": rows[: seen["shown"]][offset : offset + size], "has_more": offset + size < seen["shown"]}).encode()
            elif url.path == "/total":
                body = json.dumps({"total": seen["shown"]}).encode()
            elif url.path == "/size":
                body = json.dumps({"size": len(FILE)}).encode()
            elif url.path == "/search":
                if q["channel"] == "9":
                    return self.send_error(500)
                start = datetime.fromtimestamp(float(q["at"]), timezone.utc).isoformat()
                body = b"no xml" if q["channel"] == "8" else f"<r><searchMatchItem><startTime>{start}</startTime><endTime>{start}</endTime><playbackURI>file{q['channel']}</playbackURI></searchMatchItem></r>".encode()
            else:
                if q["of"] == "gone":
                    return self.send_error(404)
                offset = int(self.headers["Range"].removeprefix("bytes=").removesuffix("-"))
                seen["ranges"].append((q["of"], offset))
                self.send_response(206)
                self.end_headers()
                self.wfile.write(FILE[offset : None if offset else 4000])  # the first connection breaks
                return None
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            return None

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    seen["url"] = f"http://127.0.0.1:{http.server_port}"
    spark.dataSource.register(services.Pages)
    spark.dataSource.register(services.Recordings)
    yield seen
    http.shutdown()


def pages(spark, server, **options):
    return spark.read.format("pages").schema(SCHEMA).options(service="tests.fake_service:Client", url=server["url"], **options)


@pytest.mark.parametrize("counts, tasks", [("yes", 4), ("no", 1)])
def test_all_pages_are_read(spark, server, counts, tasks):
    n = len(server["rows"])
    df = pages(spark, server, page_size="7", task_items=str(-(-n // 4)), counts=counts).load()
    assert df.rdd.getNumPartitions() == tasks
    want = [(r["c_custkey"], r["c_name"], r["c_acctbal"], None) for r in server["rows"]]
    assert sorted(map(tuple, df.collect())) == want


def test_pages_that_end_too_soon_are_an_error(spark, server):
    class Short:
        def page(self, offset, size):
            return {"items": [], "has_more": True}

    with pytest.raises(RuntimeError):
        list(services._pages(Short(), services.Range(0, 5), 2))
    with pytest.raises(ValueError):
        services.connected({"service": "nowhere"})


def test_pages_as_a_stream(spark, server, tmp_path):
    """Each run takes what is new since the last one, whole and once."""
    source = spark.readStream.format("pages").schema(SCHEMA).options(service="tests.fake_service:Client", url=server["url"], page_size="10")
    for shown in (30, 30, 71, len(server["rows"])):
        server["shown"], before = shown, len(server["pages"])
        query = source.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        found = sorted(r["c_custkey"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert found == [r["c_custkey"] for r in server["rows"][:shown]]
        assert all(at >= 30 for at in server["pages"][before:]) or shown == 30
    server["shown"] = len(server["rows"])


def test_recordings_are_searched_by_channel_and_window(spark, server):
    source = lambda channels: spark.read.format("recordings").options(channels=channels, service="tests.fake_service:Client", url=server["url"], start="2024-01-05T00:00:00+00:00", end="2024-01-06T12:00:00+00:00")
    df = source("3, 8,9").schema("channel_id string, filename string, start_time string, download_url string, size long, error string").load()
    assert df.rdd.getNumPartitions() == 6
    found = sorted((r["channel_id"], r["filename"], r["start_time"]) for r in df.where("error is null").collect())
    assert found == [("3", "cam3_1704412800.mp4", "2024-01-05T00:00:00+00:00"), ("3", "cam3_1704499200.mp4", "2024-01-06T00:00:00+00:00")]
    assert sorted(r["channel_id"] for r in df.where("error is not null").collect()) == ["8", "8", "9", "9"]
    assert source("3,8,9").load().count() == 2 and source(" ").load().count() == 0


def test_interrupted_downloads_are_resumed(spark, server, tmp_path):
    rows = [("a.mp4", "one", 0), ("b.mp4", "two", 0), ("c.mp4", "gone", 0), ("a.mp4", "one", 0)]
    df = spark.createDataFrame([(n, "s", "e", u, z) for n, u, z in rows], "filename string, start_time string, end_time string, download_url string, size long")
    (tmp_path / "b.mp4.part").write_bytes(FILE[:100])  # left by a task that was lost
    get = lambda: {r["filename"]: r for r in services.downloaded(df, f"file://{tmp_path}", service="tests.fake_service:Client", url=server["url"]).collect()}
    server["ranges"].clear()
    found = get()
    assert (tmp_path / "a.mp4").read_bytes() == (tmp_path / "b.mp4").read_bytes() == FILE
    assert sorted(server["ranges"]) == [("one", 0), ("one", 4000), ("two", 100)]
    assert found["c.mp4"]["error"].startswith("HTTPError") and found["a.mp4"]["bytes"] == len(FILE)
    server["ranges"].clear()
    assert get()["a.mp4"]["bytes"] == len(FILE) and server["ranges"] == []
