"""Files, paged REST extraction, streams."""

from __future__ import annotations

import json
import sys
from datetime import date

import pytest
from pyspark import cloudpickle

from tidewatch.errors import GateError
from tidewatch.functions.text import district_of_code, is_official, parse_district, strip
from tidewatch.operators.contracts import valid
from tidewatch.operators.detectors import ALERT_COLUMNS
from tidewatch.schemas import BOROUGH_CODES, DISTRICTS, REQUEST
from tidewatch.sources import files, parts, rest
from tidewatch.sources.service import TableService
from tidewatch.streaming import ingest


def record(k, **more):
    return {"unique_key": f"K{k:03d}", "created_date": f"2026-07-{k % 28 + 1:02d}T10:00:00", "agency": "DOT", "complaint_type": "Noise", "status": "Open", "borough": "BRONX", "community_board": "03 BRONX", "open_data_channel_type": "PHONE", "address": "secret"} | more


ROWS = [record(k) for k in range(25)]


def fetch(params):
    if "count" in params["$select"]:
        return [{"count": str(len(ROWS))}]
    at = int(params["$offset"])
    return ROWS[at : at + int(params["$limit"])]


def by_value():
    # Spark makes data sources in another process, which can't import this file.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_rest_batch(spark):
    by_value()
    spark.dataSource.register(rest.source(fetch, "requests_test"))
    rows = spark.read.format("requests_test").option("start", "2026-07-01").option("end", "2026-07-31").option("page_size", "10").load()
    assert rows.rdd.getNumPartitions() == 3
    assert "address" not in rows.columns
    assert sorted(r["unique_key"] for r in valid(rows).collect()) == [r["unique_key"] for r in ROWS]


def test_rest_stream_resumes(spark, tmp_path):
    by_value()
    spark.dataSource.register(rest.source(fetch, "requests_stream"))

    def run():
        stream = spark.readStream.format("requests_stream").option("start", "2026-07-01").option("end", "2026-07-31").option("page_size", "10").load()
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.json(str(tmp_path / "out")).count()

    assert run() == 25
    assert run() == 25


def test_retries():
    calls, pauses = [], []

    def flaky(params):
        calls.append(params)
        if len(calls) < 3:
            raise OSError("no")
        return [] if len(calls) > 3 else {"error": 1}

    assert rest.query(flaky, {}, sleep=pauses.append) == []
    assert pauses == [1, 2, 4]
    with pytest.raises(OSError):
        rest.query(lambda p: (_ for _ in ()).throw(OSError()), {}, attempts=2, sleep=pauses.append)


def test_query_all():
    rows, pages = rest.query_all(lambda p: [{"k": str(k)} for k in range(3)][int(p["$offset"]) :][: int(p["$limit"])], {"$order": "k"}, 2)
    assert (len(rows), pages) == (3, 2)
    with pytest.raises(GateError, match="duplicate"):
        rest.query_all(lambda p: [{"k": "1"}] * max(0, min(2, 3 - int(p["$offset"]))), {"$order": "k"}, 2)
    with pytest.raises(ValueError, match="order"):
        rest.query_all(fetch, {})


def test_districts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("05 BROOKLYN",), (" 3 staten island ",), ("0 Unspecified",), ("O'HARE",), ("19 BROOKLYN",)], "b string").withColumn("x", parse_district("b"))
    got = [(r["x"]["district"], r["x"]["borough"], r["ok"]) for r in rows.withColumn("ok", is_official(F.col("x.district"))).collect()]
    assert got == [("Brooklyn 05", "Brooklyn", True), ("Staten Island 03", "Staten Island", True), ("Unspecified", "Unspecified", False), ("O'Hare", "Unspecified", False), ("Brooklyn 19", "Brooklyn", False)]
    assert spark.range(1).select(district_of_code(F.lit(305)), strip(F.lit("\t a \n"))).first()[:] == ("Brooklyn 05", "a")


def collection(path, skip=0):
    codes = [100 * b + n for b, name in BOROUGH_CODES.items() for n in range(1, DISTRICTS[name] + 1)][skip:] + [164, 595]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"boro_cd": str(c), "shape_area": "1.5"}, "geometry": {"type": "Point", "coordinates": [c, 1]}} for c in codes]}, indent=1))
    return str(path)


def test_boundaries(spark, tmp_path):
    rows = files.read_boundaries(spark, collection(tmp_path / "b.json"))
    assert rows.count() == 59 and rows.columns == ["code", "district", "geometry"]
    counts = spark.createDataFrame([("Bronx 03", "Bronx", 7, "high")], "district string, borough string, requests long, severity string")
    joined = {r["district"]: (r["requests"], r["severity"]) for r in files.join_boundaries(rows, counts).collect()}
    assert joined["Bronx 03"] == (7, "high") and joined["Queens 01"] == (0, "normal")
    with pytest.raises(GateError, match="59"):
        files.read_boundaries(spark, collection(tmp_path / "c.json", 1))


def test_labels(spark, tmp_path):
    rows = [{"case_id": "a", "label": "uncertain", "external_evidence": ["x"]}, {"case_id": "b", "label": "unsupported"}]
    for name, payload in (("l", rows), ("d", {"cases": rows})):
        (tmp_path / name).write_text(json.dumps(payload))
        got = files.read_labels(spark, str(tmp_path / name)).orderBy("case_id").collect()
        assert [(r["case_id"], r["label"]) for r in got] == [("a", "uncertain"), ("b", "unsupported")]


def test_csv(spark, tmp_path):
    files.export_csv(spark.createDataFrame([('say "hi"', None, 1)], "a string, b string, n int"), str(tmp_path / "c"))
    lines = [x for f in (tmp_path / "c").glob("*.csv") for x in f.read_text().splitlines()]
    assert [x for x in lines if x != '"a","b","n"'] == ['"say ""hi""","","1"']


def test_csv_in_order(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "cast(20 - id AS string) AS place").repartition(5)
    files.export_csv(rows, str(tmp_path / "one"), ["place", "id"], order=["id"])
    (file,) = (tmp_path / "one").glob("*.csv")
    assert file.read_text().splitlines() == ['"place","id"', *[f'"{20 - k}","{k}"' for k in range(20)]]
    files.export_csv(rows.limit(0), str(tmp_path / "none"))
    assert not [x for f in (tmp_path / "none").glob("*.csv") for x in f.read_text().splitlines()[1:]]


def test_window_holds_the_last_second():
    where = rest._where({"start": "2026-02-01", "end": "2026-02-28"})
    assert where == "created_date >= '2026-02-01T00:00:00' and created_date < '2026-03-01T00:00:00'"


def test_cached_query(spark, tmp_path):
    calls = []

    def answer(params):
        calls.append(params)
        return [{"day": "2026-01-01", "requests": "3"}, {"day": "2026-01-02"}]

    for _ in range(2):
        rows = rest.cached_query(spark, answer, {"$select": "day", "$order": "day"}, str(tmp_path / "cache"), "day string, requests string")
        assert [tuple(r) for r in rows.orderBy("day").collect()] == [("2026-01-01", "3"), ("2026-01-02", None)]
    rest.cached_query(spark, answer, {"$order": "day"}, str(tmp_path / "cache"), "day string, requests string")
    assert len(calls) == 2


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(r) + "\n" for r in [*ROWS, record(99, borough=" ")]))
    for _ in range(2):
        ingest.ingest(files.stream_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out/valid")).count() == 25
    assert spark.read.json(str(tmp_path / "out/quarantine")).count() == 1


def test_stream_sessions_and_counts(spark, tmp_path):
    days = [date(2026, 7, 1), date(2026, 7, 8), date(2026, 7, 16), date(2026, 9, 1)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("".join(json.dumps({"date": str(d), "district": "A", "problem": "P"}) + "\n" for d in days))
    kinds = {"date": "date", "affected_count": "long"} | dict.fromkeys(("id", "type", "district", "problem", "detector"), "string")
    stream = spark.readStream.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in ALERT_COLUMNS)).json(str(tmp_path / "a"))
    q = ingest.episode_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["episode_start"], r["episode_end"], r["persistence"]) for r in spark.table("sessions").collect()}
    assert got == {(days[0], days[1], 2), (days[2], days[2], 1)}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text("".join(json.dumps(r) + "\n" for r in [*ROWS, ROWS[0], record(200, created_date="2026-12-01T00:00:00")]))
    rows = ingest.deduplicated(files.stream_requests(spark, str(tmp_path / "r")), "60 days")
    q = rows.writeStream.format("memory").queryName("unique_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_rows").count() == 26
    counts = ingest.daily_counts(files.stream_requests(spark, str(tmp_path / "r")))
    q = counts.writeStream.format("memory").queryName("day_counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["requests"] for r in spark.table("day_counts").collect()) == 26


def service_table(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 400
    times = pa.array([1_000_000 * (880_000_000 + 7200 * k) for k in range(n)], pa.timestamp("us"))
    table = pa.table({"o_orderkey": list(range(n)), "o_orderdate": times, "o_custkey": [k * 7 % 50 for k in range(n)], "o_orderpriority": [["1-URGENT", "it's", "5-LOW", "Ä"][k % 4] for k in range(n)], "o_orderstatus": ["OFP"[k % 3] for k in range(n)]})
    pq.write_table(table, tmp_path / "orders.parquet")
    return str(tmp_path / "orders.parquet")


class Recorded:
    """A service that notes what it was asked in a file, as its calls come from other processes."""

    def __init__(self, path, log):
        self.service, self.log = TableService(path), str(log)

    def __call__(self, params):
        with open(self.log, "a") as out:
            out.write(json.dumps(params) + "\n")
        return self.service(params)


def test_filters_and_columns_reach_the_service(spark, tmp_path):
    from pyspark.sql import functions as F

    by_value()
    path, log = service_table(tmp_path), tmp_path / "asked"
    rows = rest.read_api(spark, Recorded(path, log), ["unique_key", "created_date", "complaint_type", "descriptor"], "api_pushed", page_size=50)
    when = F.col("created_date") >= F.lit("1997-11-25 00:00:00").cast("timestamp_ntz")
    wanted = rows.where(when & F.col("complaint_type").isin("it's", "Ä") & F.col("descriptor").isNotNull() & (F.col("descriptor") != "d'1") & (F.length("complaint_type") > 1))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("Filter") : plan.index("Filter") + 200].split("\n")[0]
    assert "length" in above and " >= " not in above and " IN " not in above and "descriptor" not in above
    whole = spark.read.parquet(path).where("o_orderdate >= '1997-11-25' AND o_orderpriority = \"it's\" AND o_orderkey % 5 > 0 AND o_orderkey % 3 <> 1")
    assert sorted(r[0] for r in wanted.select("unique_key").collect()) == sorted(f"{r[0]:012d}" for r in whole.select("o_orderkey").collect())
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    pages = [a for a in asked if "$offset" in a]
    assert {a["$select"] for a in pages} == {"unique_key,created_date,complaint_type,descriptor"}
    for part in ("created_date >= '1997-11-25T00:00:00.000'", "complaint_type in('it''s','Ä')", "descriptor is not null", "not (descriptor = 'd''1')"):
        assert all(part in a["$where"] for a in asked)
    assert len({a["$offset"] for a in pages}) < 4  # pages of what is left, not of the table


def test_filters_that_stay_in_spark(spark, tmp_path):
    """Whatever is asked, the rows are those of the same filter on the whole table."""
    from pyspark.sql import functions as F

    by_value()
    path = service_table(tmp_path)
    rows = rest.read_api(spark, TableService(path), name="api_left", page_size=150)
    every = rows.collect()
    assert len(every) == 400 and "address" not in rows.columns
    key, kind, text, made = (F.col(c) for c in ("unique_key", "complaint_type", "descriptor", "created_date"))
    local = spark.createDataFrame(every, rows.schema)
    odd_time = F.lit("1997-11-25 00:00:00.000123").cast("timestamp_ntz")
    for found in (key > "000000000100", kind == "it's", ~kind.isin("5-LOW", "Ä"), text.isNull(), text.eqNullSafe("d'0"), ~text.isNull(), kind.startswith("1"), made.isNull(), made > odd_time, made == made, (kind == "Ä") | text.isNull(), ~(text == "d'0"), kind.isin("Ä", None), F.lower(kind) == "ä", ~(made < F.lit("1997-12-01").cast("timestamp_ntz"))):
        assert sorted(map(repr, rows.where(found).collect())) == sorted(map(repr, local.where(found).collect()))


def test_broken_cache_is_asked_again(spark, tmp_path):
    calls = []

    def answer(params):
        calls.append(params)
        return [{"n": "3"}]

    def rows(**more):
        return [tuple(r) for r in rest.cached_query(spark, answer, {"$select": "n"}, str(tmp_path / "cache"), **({"schema": "n string"} | more)).collect()]

    assert rows() == [("3",)]
    (entry,) = (tmp_path / "cache").iterdir()
    for f in [f for f in entry.rglob("*") if f.is_file() and (f.parent.name == "done" or f.name != "_SUCCESS")]:
        f.unlink()
    for name in ("rows", "done"):
        (entry / name / "_temporary").mkdir()
    assert rows() == rows() == [("3",)] and len(calls) == 2
    assert rows(schema="n string, m string") == [("3", None)] and rows(endpoint="other") == [("3",)] and len(calls) == 4


def test_errors_of_a_transport_that_are_not_retried():
    def broken(params):
        raise KeyError("own bug")

    with pytest.raises(KeyError):
        rest.query(broken, {}, sleep=lambda s: pytest.fail("no pause"))


def test_parts_are_committed_once(spark, tmp_path):
    by_value()
    path, out, check = service_table(tmp_path), str(tmp_path / "out"), tmp_path / "check"
    spark.dataSource.register(rest.source(TableService(path), "api_parts"))

    def run():
        stream = spark.readStream.format("api_parts").option("page_size", "90").load()
        q = parts.stream_parts(stream, out, str(check)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        rows = parts.read_parts(spark, out, REQUEST)
        return sorted(r["unique_key"] for r in rows.select("unique_key").collect())

    want = [f"{k:012d}" for k in range(400)]
    assert run() == want
    assert json.loads((tmp_path / "out/checkpoint.json").read_text()) == {"offset": 400}
    commits, manifests = sorted((check / "commits").glob("[0-9]*")), sorted((tmp_path / "out/_commits").iterdir())
    assert len(manifests) >= 5
    # Ended after the manifest, before Spark's own commit: the batch comes again and is not doubled.
    for f in (commits[-1], check / "commits" / f".{commits[-1].name}.crc"):
        f.unlink(missing_ok=True)
    assert run() == want
    # Ended between the parts and their manifest: parts of no manifest don't count and are replaced.
    for f in [*sorted((check / "commits").glob("[0-9]*"))[-1:], manifests[-1]]:
        f.unlink()
    for f in (check / "commits").glob(".*.crc"):
        f.unlink()
    assert len(parts.read_parts(spark, out, REQUEST).collect()) < 400
    assert run() == want


def test_batches_of_parts(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(10).selectExpr("cast(id as string) AS unique_key")
    assert parts.read_parts(spark, out, rows.schema).count() == 0
    parts.write_parts(rows, out, key="a")
    parts.write_parts(rows, out, key="a")
    assert parts.read_parts(spark, out, rows.schema).count() == 10
    parts.write_parts(rows.limit(0), out)
    parts.write_parts(rows.limit(3), out)
    assert parts.read_parts(spark, out, rows.schema).count() == 13
    parts.write_parts(rows.limit(4), out, replace=True)
    assert parts.read_parts(spark, out, rows.schema).count() == 4
    failing = rows.selectExpr("raise_error('no') AS unique_key")
    with pytest.raises(Exception, match="no"):
        parts.write_parts(failing, out)
    assert parts.read_parts(spark, out, rows.schema).count() == 4 and parts.committed(spark, out).count() == 1


def asked_pages(log):
    return [a for a in map(json.loads, log.read_text().splitlines()) if "$offset" in a]


def test_many_rows_are_asked_for_between_keys(spark, tmp_path):
    """No page has the service order much more than itself, in batches and streams, and tasks fetch a stream's pages."""
    by_value()
    path, want = service_table(tmp_path), [f"{k:012d}" for k in range(400)]
    rows = rest.read_api(spark, Recorded(path, tmp_path / "batch"), ["unique_key", "descriptor"], "api_deep", page_size=50, deepest=100)
    assert sorted(r[0] for r in rows.select("unique_key").collect()) == want
    assert rows.where("descriptor = 'd''1'").count() == sum(k % 5 > 0 and k % 3 == 1 for k in range(400))
    spark.dataSource.register(rest.source(Recorded(path, tmp_path / "stream"), "api_deep_pages"))
    stream = spark.readStream.format("api_deep_pages").options(page_size="30", deepest="100", batch_pages="5").load()
    q = parts.stream_parts(stream, str(tmp_path / "out"), str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r[0] for r in parts.read_parts(spark, str(tmp_path / "out"), REQUEST).select("unique_key").collect()) == want
    assert [r["last"] for r in parts.committed(spark, str(tmp_path / "out")).orderBy("batch").collect()] == [150, 300, 400]
    for log, n in (("batch", 50), ("stream", 30)):
        pages = asked_pages(tmp_path / log)
        assert pages and all("unique_key" in a["$where"] and int(a["$offset"]) < n for a in pages)
    assert len(asked_pages(tmp_path / "stream")) == 14  # each page once


KEYS = [None, "", "'", "''", "it's", "a", "a", "aa", "ab", "ab", "abc", "Z", "Ä", "é", "0", "00", "000", "0001", "0002", "0010", "1", "10", "2", None, "日本", "日", "~"]


@pytest.mark.parametrize("nulls", ["FIRST", "LAST"])
@pytest.mark.parametrize("keys", [KEYS, [k for k in KEYS if k is not None], [None] * 9, ["same"] * 9])
def test_pages_between_keys_are_whole(keys, nulls):
    from pyspark.sql import types as T

    values = ",".join("(" + ("NULL" if k is None else "'" + k.replace("'", "''") + "'") + ")" for k in keys)
    service = TableService("", f"SELECT k::VARCHAR AS unique_key FROM (VALUES {values}) v(k)")

    def ordered(params):
        return service(params | ({"$order": f"{params['$order']} NULLS {nulls}"} if "$order" in params else {}))

    whole = sorted(keys, key=lambda k: ((k is None) == (nulls == "LAST"), k or ""))
    for size in (1, 2, 3, 5, 40):
        paged = rest._Paged(ordered, {"page_size": size, "deepest": 4}, T.StructType([REQUEST["unique_key"]]))
        for start in (0, 1, 4):
            found = [[r[0] for r in paged.page(p)] for p in paged.pages(start, len(keys), len(keys))]
            assert [k for page in found for k in page] == whole[start:]
            assert all(len(page) == size for page in found[:-1])


def test_pages_of_a_service_that_has_changed():
    from pyspark.sql import types as T

    paged = rest._Paged(lambda params: [{"prefix": "a", "count": "9"}] if "$group" in params else [{"unique_key": "a"}], {"page_size": 9, "deepest": 4}, T.StructType([REQUEST["unique_key"]]))
    with pytest.raises(GateError):
        paged.pages(0, 8, 8)
    (page,) = paged.pages(0, 9, 9)
    with pytest.raises(GateError):
        paged.page(page)


def test_filtered_pages_are_asked_for_between_keys(spark, tmp_path):
    """Filters and keys bound a page together; pages count what the filters leave."""
    from pyspark.sql import functions as F

    by_value()
    path, log = service_table(tmp_path), tmp_path / "asked"
    rows = rest.read_api(spark, Recorded(path, log), ["unique_key", "complaint_type"], "api_filtered", page_size=40, deepest=90).where(F.col("complaint_type").isin("it's", "Ä"))
    assert sorted(r[0] for r in rows.collect()) == [f"{k:012d}" for k in range(400) if k % 2]
    pages = asked_pages(log)
    assert len(pages) == 5 and all("complaint_type in(" in a["$where"] and "unique_key" in a["$where"] and int(a["$offset"]) < 40 for a in pages)


MOST_MB = """
import resource, sys
from tidewatch.sources.service import TableService

params = {"$select": "unique_key,created_date,complaint_type,descriptor", "$where": "unique_key < '000000000100'", "$order": "unique_key", "$limit": "100"}
assert len(TableService(sys.argv[1])(params)) == 100
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""


def test_a_service_in_a_task_takes_no_more_memory_for_more_row_groups(tmp_path):
    """It answers inside the asking process: one thread and nothing read ahead, however many cores and row groups there are."""
    import os
    import subprocess
    from pathlib import Path

    import duckdb

    assert TableService("", "SELECT current_setting('threads') AS threads, current_setting('async_threads') AS ahead")({}) == [{"threads": "1", "ahead": "0"}]
    most = []
    for groups in (1, 8):
        rows = f"SELECT range AS o_orderkey, hash(range) % 100000 AS o_custkey, TIMESTAMP '1997-01-01' + to_seconds((hash(range) % 100000000)::BIGINT) AS o_orderdate, 'F' AS o_orderstatus, hash(range)::VARCHAR AS o_orderpriority FROM range({groups * 491_520})"
        path = str(tmp_path / f"{groups}.parquet")
        with duckdb.connect() as con:
            con.execute(f"COPY ({rows}) TO '{path}' (FORMAT parquet, ROW_GROUP_SIZE 491520)")
        root = str(Path(rest.__file__).parents[2])
        most.append(float(subprocess.run([sys.executable, "-c", MOST_MB, path], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout))
    assert most[1] < most[0] + 40, most
