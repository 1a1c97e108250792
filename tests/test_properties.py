"""Property tests: WordCount tokenisation against Python's own splitting."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import montecarlo, text

# delimiters, plus whitespace that is NOT a delimiter (vertical tab, no-break space)
ALPHABET = st.sampled_from(list("ab,.Aé") + [" ", "\t", "\n", "\r", "\f", "\v", " "])
LINES = st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=0, max_size=20)


@settings(max_examples=15, deadline=None)
@given(LINES)
def test_word_count_matches_python_split(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["word"]: r["n"] for r in text.word_count(df).collect()}
    want = Counter(t for x in lines for t in re.split(r"[ \t\n\r\f]+", x) if t)
    assert got == dict(want)


def test_pi_on_no_points_is_null(spark):
    r = montecarlo.pi_from_ids(spark.range(0)).first()
    assert (r["n"], r["inside"], r["pi"]) == (0, None, None)


# --- range-split window operators against a pure-Python brute force ------------------
# Rows: (id, key, t, v) with few keys (null included), many tied and null times and
# null values; a tiny row target forces many ranges and stitching across them.

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators import windows  # noqa: E402

ROWS = st.lists(st.tuples(st.sampled_from([1, 2, None]),
                          st.one_of(st.none(), st.integers(0, 40)),
                          st.one_of(st.none(), st.integers(-5, 9))),
                min_size=1, max_size=60)
# the same with times from a handful of instants: every instant repeats, so the
# heavy-instant split (ranges of the tie-breaker inside one instant) is exercised
DENSE = st.lists(st.tuples(st.sampled_from([1, 2, None]),
                           st.one_of(st.none(), st.integers(0, 4)),
                           st.one_of(st.none(), st.integers(-5, 9))),
                 min_size=1, max_size=60)


def _frame(spark, rows):
    data = [(i, k, t, v) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, t long, v long")
    return data, df.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def _asc(x):
    """Spark's ascending order: nulls first."""
    return (x is not None, x if x is not None else 0)


def _groups(data):
    g = {}
    for row in data:
        g.setdefault(row[1], []).append(row)
    return g


@settings(max_examples=8, deadline=None)
@given(st.one_of(ROWS, DENSE))
def test_split_lag_lead_and_running_total(spark, rows):
    data, df = _frame(spark, rows)
    want_prev, want_next, want_run = {}, {}, {}
    for grp in _groups(data).values():
        grp.sort(key=lambda r: (_asc(r[2]), r[0]))
        acc = None
        for j, r in enumerate(grp):
            want_prev[r[0]] = grp[j - 1][0] if j else None
            want_next[r[0]] = grp[j + 1][0] if j + 1 < len(grp) else None
            if r[3] is not None:
                acc = (acc or 0) + r[3]
            want_run[r[0]] = acc
    ll = windows.lag_lead(df, "k", "ts", "id", ["id"], target_rows=3)
    assert {r["id"]: (r["prev_id"], r["next_id"]) for r in ll.collect()} == \
        {i: (want_prev[i], want_next[i]) for i in want_prev}
    rt = windows.running_total(df, "k", "ts", "id", "v", target_rows=3)
    assert {r["id"]: r["running"] for r in rt.collect()} == want_run


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_split_trailing_range(spark, rows):
    data, df = _frame(spark, rows)
    want = {}
    for grp in _groups(data).values():
        for r in grp:
            if r[2] is None:
                frame = [x for x in grp if x[2] is None]
            else:
                frame = [x for x in grp if x[2] is not None and r[2] - 5 <= x[2] <= r[2]]
            vals = [x[3] for x in frame if x[3] is not None]
            want[r[0]] = (len(frame), float(sum(vals)) if vals else None)
    out = windows.trailing_range(df, "k", "ts", "v", 5, target_rows=3)
    assert {r["id"]: (r["n_trailing"], r["sum_trailing"]) for r in out.collect()} == want


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_split_ranks(spark, rows):
    data, df = _frame(spark, rows)
    want = {}
    for grp in _groups(data).values():
        # value descending, nulls last; ties of rn / ntile by id ascending
        grp.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        n, q, rem = len(grp), len(grp) // 3, len(grp) % 3
        rank = dense = 0
        for j, r in enumerate(grp):
            if j == 0 or r[3] != grp[j - 1][3]:
                rank, dense = j + 1, dense + 1
            rn = j + 1
            tile = (j // (q + 1) + 1) if rn <= rem * (q + 1) else rem + (rn - rem * (q + 1) - 1) // q + 1
            want[r[0]] = (rn, rank, dense, tile)
    out = windows.rank_spread(df, "k", "v", "id", tiles=3, target_rows=3)
    assert {r["id"]: (r["rn"], r["rnk"], r["drnk"], r["tile"]) for r in out.collect()} == want


@settings(max_examples=8, deadline=None)
@given(ROWS, ROWS, st.booleans())
def test_split_asof(spark, left_rows, right_rows, strict):
    """SQL semantics: a null key or time never matches; the match's time is compared
    (which of several right rows sharing that time is taken is not specified)."""
    from quarry.operators import joins
    ldata, left = _frame(spark, left_rows)
    rdata, right = _frame(spark, right_rows)
    want = {}
    for i, k, t, _ in ldata:
        cands = [rt for _, rk, rt, _ in rdata if k is not None and rk == k and t is not None
                 and rt is not None and (rt < t if strict else rt <= t)]
        want[i] = max(cands) if cands else None
    out = joins.asof_join(left.select("id", "k", "ts"), right.select("k", "ts"), "k", "ts", ["ts"],
                          strict=strict, target_rows=3)
    got = {r["id"]: (None if r["r_ts"] is None else int(r["r_ts"].timestamp())) for r in
           out.select("id", F.col("r_ts").cast("timestamp").alias("r_ts")).collect()}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_interval_join(spark, rows):
    from quarry.operators import joins
    data, df = _frame(spark, rows)
    want = sorted((a[0], b[0]) for a in data for b in data
                  if a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None
                  and a[2] < b[2] <= a[2] + 4)
    out = joins.interval_join(df.select("id", "k", "ts"), df.select("id", "k", "ts"), "k", "ts", 4)
    assert sorted((r["l_id"], r["r_id"]) for r in out.collect()) == want


@settings(max_examples=8, deadline=None)
@given(ROWS)
def test_first_last(spark, rows):
    data, df = _frame(spark, rows)
    want = {}
    for grp in _groups(data).values():
        grp.sort(key=lambda r: (_asc(r[2]), r[0]))
        first, last = grp[0][3], grp[-1][3]
        nth = grp[1][3] if len(grp) > 1 else None
        for r in grp:
            want[r[0]] = (first, last, nth)
    out = windows.first_last(df, ["k"], [F.col("ts"), F.col("id")], "v")
    assert {r["id"]: (r["first_v"], r["last_v"], r["nth2_v"]) for r in out.collect()} == want


# --- graph jobs against brute force on random small graphs ---------------------------

from itertools import combinations  # noqa: E402

from quarry.operators import graph  # noqa: E402

GRAPHS = st.tuples(st.integers(2, 14),
                   st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13)), max_size=40))


def _graph_frames(spark, spec):
    n, pairs = spec
    edges = sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b and a < n and b < n})
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    nb = {i: set() for i in range(n)}
    for a, b in edges:
        nb[a].add(b)
        nb[b].add(a)
    return v, e, nb


@settings(max_examples=5, deadline=None)
@given(GRAPHS)
def test_triangles_and_wedges(spark, spec):
    v, e, nb = _graph_frames(spark, spec)
    tri = {i: sum(1 for a, c in combinations(sorted(nb[i]), 2) if c in nb[a]) for i in nb}
    wedges = {i: sum(1 for a, c in combinations(sorted(nb[i]), 2) if c not in nb[a]) for i in nb}
    assert {r["id"]: r["triangles"] for r in graph.triangle_counts(v, e).collect()} == tri
    assert {r["id"]: r["open_wedges"] for r in graph.open_two_hop(v, e).collect()} == wedges


@settings(max_examples=5, deadline=None)
@given(GRAPHS)
def test_bfs_and_pagerank(spark, spec):
    v, e, nb = _graph_frames(spark, spec)
    n = len(nb)
    want_hops = {}
    for lm in (0, n - 1):
        seen, frontier, h = {lm: 0}, [lm], 0
        while frontier:
            h += 1
            frontier = [y for x in frontier for y in sorted(nb[x]) if y not in seen]
            for y in frontier:
                seen.setdefault(y, h)
            frontier = sorted(set(frontier))
        want_hops.update({(lm, i): d for i, d in seen.items()})
    got = {(r["landmark"], r["id"]): r["hops"] for r in graph.bfs_hops(v, e, [0, n - 1]).collect()}
    assert got == want_hops
    pr, d = [1.0 / n] * n, 0.85
    for _ in range(10):
        dm = sum(pr[i] for i in range(n) if not nb[i])
        pr = [(1 - d) / n + d * (sum(pr[u] / len(nb[u]) for u in nb[i]) + dm / n) for i in range(n)]
    got_pr = {r["id"]: r["pr"] for r in graph.pagerank(v, e).collect()}
    assert all(abs(got_pr[i] - pr[i]) < 1e-12 for i in range(n))


import datetime  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.datetimes(min_value=datetime.datetime(1900, 1, 1),
                             max_value=datetime.datetime(2100, 1, 1)),
                min_size=1, max_size=20),
       st.sampled_from(["UTC", "America/New_York", "Asia/Kolkata"]))
def test_naive_time_round_trip(spark, times, zone):
    """Naive times -> epoch micros -> instant -> naive again, unchanged in any session
    zone, including times a daylight-saving zone skips."""
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, zone)
    try:
        out = (df.select("ts", windows.micros(df, "ts").alias("m"),
                         windows.naive_instant(df, "ts").alias("i"))
                 .select("ts", "m", windows.naive_of_instant("i").alias("back")).collect())
    finally:
        spark.conf.set(key, old)
    epoch = datetime.datetime(1970, 1, 1)
    for r in out:
        assert r["back"] == r["ts"]
        assert r["m"] == (r["ts"] - epoch) // datetime.timedelta(microseconds=1)
