"""Queries that pass texts on have rows of all projects."""

from partloom.plans.queries import QUERIES


def test_pdf_text_of_all_projects(spark, sf):
    slots = {r.slot for r in QUERIES["pdf_regex_scan"](spark, sf).select("slot").collect()}
    assert {s % 7 for s in slots} == set(range(7))
    assert {r.slot for r in QUERIES["pdf_tables"](spark, sf).select("slot").collect()} <= slots
