import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from partloom.plans import intake
from partloom.sources import pdf, urls


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            if self.path == "/slow":
                time.sleep(3)
            code = 404 if self.path == "/gone" else 500 if self.path == "/flaky" and seen.count("/flaky") == 1 else 200
            body = {"/text": b"R1 10k\nC1 100n\nnothing here\n", "/latin": "R2 4k7 µ".encode("latin-1"), "/flaky": b"Q1 2N3904", "/sheet": b"%PDF-1.4 two pages", "/x.PDF": b"broken"}.get(self.path, b"")
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; charset=latin-1" if self.path == "/latin" else "text/plain")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def reader(content):
    """Two pages, of which the second can be damaged."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    yield "", [[["Location", "Value"], ["R1", "1k"], ["R2", "2k2"]]], [{"text": "Box", "size": 20.0, "top": 1.0, "x0": 1.0}]
    yield "VOLUME A1M\nR7 5k", [], []
    raise ValueError("page 3 is damaged")


def test_slots_by_address_end_to_end(spark, server):
    base, seen = server
    rows = [(1, "A", "From URL", f" {base}/text ", None), (2, "B", "From URL", f"{base}/sheet", None), (3, "C", "From URL", f"{base}/gone", None), (4, "D", "From URL", f"{base}/slow", None), (5, "E", "From URL", f"{base}/x.PDF", None), (6, "F", "From URL", f"{base}/flaky", None), (7, "G", "Paste Text", "R9 1M", None), (8, "H", "From URL", "nonsense", None), (9, "I", "From URL", "", None), (10, "J", "From URL", f"{base}/latin", None), (11, "K", "From URL", "R8 1k", "http://read.before")]
    slots = spark.createDataFrame(rows, "slot long, source string, method string, payload string, path string")
    got = intake.take_in(slots, fetch=True, reader=reader, timeout=1.0)
    stats = {r.slot: (r.lines_read, r.parts_found) for r in got["stats"].collect()}
    errors = {(r.slot, r.error) for r in got["errors"].collect()}
    assert stats == {1: (3, 2), 2: (2, 3), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (1, 1), 7: (1, 1), 8: (0, 0), 9: (0, 0), 10: (1, 1), 11: (1, 1)}
    assert {s for s, _ in errors} == {2, 3, 4, 5, 8}
    said = dict(errors)
    assert "404" in said[3] and "timed out" in said[4] and said[5] == "File Error: not a PDF" and said[2] == "Parse Error: page 3 is damaged"
    assert {(r.slot, r.ref) for r in got["events"].where("slot IN (2, 10)").collect()} == {(2, "R1"), (2, "R2"), (2, "VOLUME"), (10, "R2")}
    assert seen.count("/text") == 1 and seen.count("/flaky") == 2 and seen.count("/gone") == 1


def test_pages_of_a_reader(spark):
    files = spark.createDataFrame([(1, "x", bytearray(b"%PDF")), (2, "y", bytearray(b"no"))], "slot long, source string, content binary")
    pages = pdf.extract(files, reader)
    assert sorted((r.slot, r.page, r.error) for r in pages.collect()) == [(1, 0, None), (1, 1, None), (1, 2, "Parse Error: page 3 is damaged"), (2, 0, "File Error: not a PDF")]
    assert {(r.slot, r.title) for r in pdf.titles(pages.where("error IS NULL")).collect()} == {(1, "Box")}


def test_text_with_the_mark_of_matches(spark):
    """A text may hold any character, those that the scan cuts at too."""
    pages = spark.createDataFrame([(1, "s", 0, "R1 10\u0001k R2 4k7\u0001\u0003 R3 1k\u0001\u0002\u0003 VOLUME \u0001A1M x\u0001y", [], [])], pdf.SCHEMA)
    got = [(r.ref_raw, r.val_raw) for r in pdf.text_matches(pages, strict=False).orderBy("ordinal").collect()]
    assert got == [("R1", "10\u0001k"), ("R2", "4k7\u0001\u0003"), ("R3", "1k\u0001\u0002\u0003"), ("VOLUME", "\u0001A1M x\u0001y")]


def test_errors_of_get(server):
    base, _ = server
    with pytest.raises(Exception, match="404"):
        urls.get(f"{base}/gone", 1.0, 3)
    assert urls.get(f"{base}/sheet") == (None, b"%PDF-1.4 two pages")
