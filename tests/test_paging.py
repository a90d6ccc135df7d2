"""Walks over pages against a plain walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from tidemark.operators import paging

START = datetime(2024, 1, 1)


def at(n):
    return None if n is None else START + timedelta(minutes=n)


def plain(request, pages, limit):
    rid, start, end = request
    by = {}
    for p in sorted(p for p in pages if p[0] == rid):
        by.setdefault(p[2], []).append(p)
    cursor, met, repeats = end, [], 0
    while True:
        if cursor not in by:
            return met, repeats, "broken"
        first = by[cursor][0]
        met.append(first[1])
        repeats += len(by[cursor]) - 1
        oldest = first[3]
        if oldest is not None and oldest >= cursor:
            return met, repeats, "no_progress"
        if oldest is None:
            return met, repeats, "complete"
        if len(met) == limit or oldest not in by:
            return met, repeats, "complete" if oldest <= start else "page_limit" if len(met) == limit else "broken"
        cursor = oldest


def test_walks_are_those_of_a_loop(spark):
    rng = random.Random(1)
    requests, pages = [], []
    for k in range(60):
        end, n = 200, rng.choice([0, 1, 2, 5, 8, 13])
        cuts = [end, *sorted(rng.sample(range(200), n), reverse=True)]
        requests.append((k, rng.choice([0, cuts[-1], 50]), end))
        for i in range(n):
            if rng.random() > 0.07:
                oldest = rng.choice([cuts[i + 1]] * 15 + [cuts[i], None])
                pages += [(k, f"{k:02}-{i:02}", cuts[i], oldest)] + [(k, f"{k:02}-{i:02}x", cuts[i], oldest)] * (rng.random() < 0.2)
        pages.append((k, f"{k:02}-other", 1000, 900))
    asked = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in requests], "request_id long, start_at timestamp_ntz, end_at timestamp_ntz")
    given = spark.createDataFrame([(k, p, at(c), at(o)) for k, p, c, o in pages], "request_id long, page_id string, cursor timestamp_ntz, oldest timestamp_ntz")
    met, walks = paging.chains(asked, given, 6)
    want = {r[0]: plain(r, pages, 6) for r in requests}
    places = {}
    for r in met.collect():
        places.setdefault(r["request_id"], {})[r["place"]] = r["page_id"]
    assert {k: [v[i] for i in sorted(v)] for k, v in places.items()} == {k: w[0] for k, w in want.items() if w[0]}
    assert {r["request_id"]: (r["pages"], r["repeats"], r["status"]) for r in walks.collect()} == {k: (len(w[0]), w[1], w[2]) for k, w in want.items()}
    assert {w[2] for w in want.values()} == {"broken", "no_progress", "complete", "page_limit"}


def test_rows_that_disagree_make_a_request_conflicting(spark):
    asked = spark.createDataFrame([(1, at(0), at(30)), (2, at(0), at(30))], "request_id long, start_at timestamp_ntz, end_at timestamp_ntz")
    given = spark.createDataFrame([(r, f"{r}-{i}", at(c), at(o)) for r in (1, 2) for i, (c, o) in enumerate([(30, 10), (10, 0)])], "request_id long, page_id string, cursor timestamp_ntz, oldest timestamp_ntz")
    rows = [(f"{r}-{i}", at(m), at(m + 1), float(m + (r == 2 and i == 1 and m == 10))) for r in (1, 2) for i, ms in enumerate([range(10, 30), range(0, 11)]) for m in ms] + [("1-0", at(40), at(41), 9.0)]
    found, walks = paging.collected(asked, given, spark.createDataFrame(rows, "page_id string, start_at timestamp_ntz, end_at timestamp_ntz, close double"), ["close"])
    assert {r["request_id"]: (r["rows"], r["status"]) for r in walks.collect()} == {1: (30, "complete"), 2: (30, "conflicting")}
    assert [(r["request_id"], r["at"]) for r in found.where("conflict").collect()] == [(2, at(10))]
