"""Crawls of preset folders: texts and PDFs, first and later runs."""

import json
import os

from partloom.plans import library
from partloom.sources import presets
from partloom.streaming import crawl


def paper(content):
    """Stands in for a PDF reader: pages written as JSON; a null page fails."""
    for page in json.loads(content):
        if page is None:
            raise ValueError("bad page")
        yield page["text"], page.get("tables", []), page.get("words", [])


def put(root, files):
    for path, content in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


TABLE = {"text": "", "tables": [[["Location", "Value"], ["R2", "10k"], ["R1", "10k"], ["IC1", "TL072"], ["C1", "100n"]]]}
TITLE = [{"text": "Drive", "size": 20.0, "top": 1.0, "x0": 9.0}, {"text": "Big", "size": 20.0, "top": 1.0, "x0": 1.0}]


def test_compiled(spark, tmp_path):
    put(
        tmp_path,
        {
            "pedalpcb/fuzz/plain_box.pdf": json.dumps([{**TABLE, "words": TITLE}]),
            "tayda/some-box.PDF": json.dumps([TABLE, None]),
            "tayda/nothing.pdf": json.dumps([{"text": "no parts at all"}]),
            "tayda/broken.pdf": "x",
            "tayda/list.txt": "﻿ R1 1k\r\nR2 2k\n\n",
            "tayda/blank.txt": " \n",
            "tayda/odd.txt": b"R1 \xff",
            "tayda/x.md": "R1 1k",
        },
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    rows = {os.path.relpath(r.source_path, tmp_path): r for r in library.compiled(files, str(tmp_path), paper).collect()}
    assert set(rows) == {"pedalpcb/fuzz/plain_box.pdf", "tayda/some-box.PDF", "tayda/nothing.pdf", "tayda/broken.pdf", "tayda/list.txt", "tayda/blank.txt", "tayda/odd.txt"}
    full = rows["pedalpcb/fuzz/plain_box.pdf"]
    assert (full.full_key, full.is_pdf, full.error) == ("[PedalPCB] [Fuzz] Big Drive", True, None)
    assert full.bom_text == "PCB Big Drive PCB\nIC1 TL072\nC1 100n\nR2 10k\nR1 10k\nIC1 (Inj) DIP SOCKET (Check Size)"
    part = rows["tayda/some-box.PDF"]
    assert (part.full_key, part.error) == ("[Tayda] Some Box", "Parse Error: bad page")
    assert part.bom_text == full.bom_text.split("\n", 1)[1]
    assert rows["tayda/nothing.pdf"].full_key is None and rows["tayda/nothing.pdf"].error == "No parts found."
    assert rows["tayda/broken.pdf"].full_key is None and rows["tayda/broken.pdf"].error.startswith("File Error: ")
    assert (rows["tayda/list.txt"].full_key, rows["tayda/list.txt"].bom_text) == ("[Tayda] List", "﻿ R1 1k\nR2 2k")
    assert (rows["tayda/blank.txt"].full_key, rows["tayda/blank.txt"].bom_text) == ("[Tayda] Blank", "")
    assert rows["tayda/odd.txt"].full_key is None and "UTF-8" in rows["tayda/odd.txt"].error


def test_compiled_nothing(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert library.compiled(none, "/x", paper).collect() == []
    nulls = spark.createDataFrame([("/x/a.txt", None), ("/x/b.pdf", None), (None, None)], "path string, content binary")
    got = {r.source_path: r for r in library.compiled(nulls, "/x", paper).collect()}
    assert set(got) == {"/x/a.txt", "/x/b.pdf"} and all(r.full_key is None and r.error for r in got.values())


def test_listed_without_references(spark):
    rows = [(1, 0, 0, "Hardware/Misc", "Box", "", 2, "part"), (1, 1, 0, "Resistors", "10k", "HW", 1, "part"), (1, 2, 0, "Resistors", "1k", "R1", 1, "part")]
    events = spark.createDataFrame(rows, "slot bigint, ordinal int, pos int, category string, value string, ref string, qty bigint, kind string")
    assert [r.bom_text for r in library.listed(events).collect()] == ["R1 1k\nBox (Qty: 2)"]


def test_crawled_twice(spark, tmp_path):
    folder, log, state = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")

    def run(**more):
        q = crawl.crawl(spark, str(folder), log, state, paper, **more)
        q.awaitTermination()
        return {r.full_key: r for r in crawl.read(spark, log).collect()}

    put(folder, {"pedalpcb/fuzz/a.pdf": json.dumps([{**TABLE, "words": TITLE}]), "tayda/b.txt": "R1 1k", "c.txt": "C1 1n"})
    first = run(files_a_batch=2)
    assert set(first) == {"[PedalPCB] [Fuzz] Big Drive", "[Tayda] B", "[Misc] C"}
    n = crawl.log_rows(spark, log).count()
    assert n == 3 and crawl.log_rows(spark, log).select("batch").distinct().count() == 2
    assert run() == first and crawl.log_rows(spark, log).count() == n  # nothing new: nothing read

    put(folder, {"tayda/boost/d.txt": "D1 1N4148", "tayda/B.TXT": "R1 1k\nR2 2k"})
    second = run()
    assert set(second) == {*first, "[Tayda] [Boost] D"} and second["[Tayda] B"].bom_text == "R1 1k\nR2 2k"
    assert crawl.log_rows(spark, log).count() == n + 2

    lib = crawl.read(spark, log)
    slots = spark.createDataFrame([(1, "[Tayda] B"), (2, "[None] such")], "slot bigint, key string")
    assert {r.slot: r.payload for r in presets.lookup(slots, lib).collect()} == {1: "R1 1k\nR2 2k", 2: ""}
    assert {r.label for r in presets.labels(presets.metadata(lib), source="Tayda").collect()} == {"B", "D  (Boost)"}


def test_one_key_of_two_files(spark):
    rows = [("/a", "[X] K", "one", False, None, "0"), ("/b", "[X] K", "two", False, None, "0"), ("/c", "[X] G", "old", False, None, "0"), ("/c", None, None, False, "Empty file.", "1")]
    got = library.newest(spark.createDataFrame(rows, f"{library.SCHEMA}, batch string"))
    assert [(r.full_key, r.bom_text, r.source_path) for r in got.collect()] == [("[X] K", "two", "/b")]
    later = spark.createDataFrame([*rows, ("/0", "[X] K", "three", False, None, "1")], f"{library.SCHEMA}, batch string")
    assert [r.bom_text for r in library.newest(later).collect()] == ["three"]
