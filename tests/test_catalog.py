"""Every query against its SQL twin in DuckDB, over the smallest tables."""

import duckdb
import pytest

from hushgrad.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and (abs(a - b) <= 2e-6 or (a != a and b != b)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    rel = duck.execute(catalog.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(map(same, g, w)), (cols, g, w)


def test_sgd_epoch_goes_through_the_whole_table(spark, monkeypatch):
    seen, plain = [], catalog.stages.gradient_sum

    def spy(rows, *a):
        seen.append([r.row_id for r in rows.select("row_id").collect()])
        return plain(rows, *a)

    monkeypatch.setattr(catalog.training.stages, "gradient_sum", spy)
    assert catalog.QUERIES["sgd_epoch"](spark, SF).collect()
    n = catalog.click_rows(spark, SF).count()
    first = [i for b in seen[: n // len(seen[0])] for i in b]
    assert len(first) == len(set(first)) > n - len(seen[0])
    assert sum(map(len, seen)) > n


@pytest.mark.parametrize("name", ["ranked_walk", "pr_curve"])
def test_scores_that_only_rounding_tells_apart_are_ranked_as_in_sql(spark, tmp_path, name):
    # Nine hours more and fifty more in k leave the score as it is, but for its last bits.
    pairs = [(7.31 * i, h, k) for i in range(1, 21) for h in (0, 5, 14) for k in (3, 28)]
    rows = [(v, h + 9 * j, k + 50 * j) for a in range(4) for v, h, k in pairs for j in ((0, 1) if a % 2 else (1, 0))]
    duck = duckdb.connect()
    duck.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    duck.executemany("insert into events values (?, ?, 1, ?, ?, ?)", [(i, f"2024-01-01 {h:02}:00:00", "click" if i % 3 else "view", v, f'{{"k": {k}}}') for i, (v, h, k) in enumerate(rows)])
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"select {', '.join(df.columns)} from ({catalog.SQL[name]}) order by k").fetchall()
    got = df.orderBy("k").collect()
    assert len(got) == len(want) and all(same(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_scores_for_rankings_are_those_of_clicks(spark, tmp_path):
    odd = [(0, None, "{}"), (1, -1.0, '{"k": 3}'), (2, -5.0, '{"k": 3}'), (3, float("nan"), '{"k": 3}'), (4, 1e300, '{"k": 3}'), (5, 0.0, '{"k": -900000}'), (6, 0.0, '{"k": 900000}'), (7, 2.0, None)]
    rows = spark.createDataFrame(odd, "event_id long, value double, props string").selectExpr("*", "timestamp'2024-01-01 10:00:00' ts", "1L user_id", "'click' event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.row_id: r.p for r in catalog.tables.ranked_clicks(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({r.row_id: r.p for r in catalog.tables.scored_clicks(spark, str(tmp_path)).collect()}, nan_ok=True)
    assert got[1] is got[2] is None and got[5] == 0 and got[6] == 1
