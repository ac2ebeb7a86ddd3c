import calendar
import hashlib
import random
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from panelforge.config import ExperimentConfig, parse_experiment_config
from panelforge.operators import panel
from panelforge.sources import download, klines, sinks, validate
from panelforge.sources.panels import Panel, carried_forward

MONTH = "2024-02"
CONFIG = ExperimentConfig(("AAA", "BBB"), "1m", (MONTH,), 30)


def lines(month=MONTH):
    year, number = map(int, month.split("-"))
    start = int(datetime(year, number, 1, tzinfo=timezone.utc).timestamp() * 1000)
    n = calendar.monthrange(year, number)[1] * 1440
    return [[str(start + i * 60_000), "1.5", "2.5", "0.5", f"{1 + (i % 97) / 100}", "1", "0", "0", "0", "0", "0", "0"] for i in range(n)]


def write(folder, symbol, rows, month=MONTH, extra=False, sidecar=None):
    stem = f"{symbol}-1m-{month}"
    path = folder / f"{stem}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{stem}.csv", "\n".join(",".join(r) for r in rows))
        if extra:
            archive.writestr("more.txt", "x")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    (folder / f"{stem}.zip.CHECKSUM").write_text(sidecar or f"{digest}  {stem}.zip\n")


def problems(spark, folder, config=CONFIG):
    return {(r["symbol"], r["problem"]) for r in validate.archive_report(spark, str(folder), config).collect()}


def test_good_archives(spark, tmp_path):
    for symbol in CONFIG.symbols:
        write(tmp_path, symbol, lines())
    report = validate.archive_report(spark, str(tmp_path), CONFIG)
    assert report.count() == 0
    validate.require_valid(report)
    bound = klines.load_closing_prices(spark, str(tmp_path), CONFIG)
    row = panel.audit(bound, 30).first()
    assert row["n_prices"] == 29 * 1440 and row["n_matrices"] == (29 * 1440 - 1) // 30 and row["n_incomplete"] == 0
    assert bound.rows.agg({"ts": "min"}).first()[0] == datetime(2024, 2, 1)


def _drop(rows):
    del rows[100]


def _double(rows):
    rows[101] = list(rows[100])


def _late(rows):
    for r in rows:
        r[0] = str(int(r[0]) + 60_000)


def _price(value):
    def change(rows):
        rows[5][2] = value

    return change


@pytest.mark.parametrize(
    ("change", "found"),
    [
        (_drop, {"rows", "continuity"}), (_double, {"continuity"}), (_late, {"first_timestamp", "last_timestamp"}),
        (_price("0"), {"prices"}), (_price("-1"), {"prices"}), (_price("inf"), {"prices"}), (_price(""), {"prices"}), (_price("x"), {"prices"}),
        (lambda rows: [r.pop() for r in rows], {"columns"}), (lambda rows: rows[70].append("x"), {"columns"}), (lambda rows: rows[70].pop(), {"columns"}),
    ],
)
def test_broken_rows(spark, tmp_path, change, found):
    rows = lines()
    change(rows)
    write(tmp_path, "AAA", rows)
    write(tmp_path, "BBB", lines())
    assert problems(spark, tmp_path) == {("AAA", f) for f in found}


def test_broken_files(spark, tmp_path):
    write(tmp_path, "AAA", lines(), extra=True)
    write(tmp_path, "BBB", lines(), sidecar="0" * 64 + "  BBB-1m-2024-02.zip")
    assert problems(spark, tmp_path) == {("AAA", "members"), ("BBB", "checksum")}
    with pytest.raises(ValueError, match="checksum"):
        validate.require_valid(validate.archive_report(spark, str(tmp_path), CONFIG))
    wanted = ExperimentConfig(("AAA", "CCC"), "1m", (MONTH,), 30)
    assert ("CCC", "missing") in problems(spark, tmp_path, wanted)


def test_sidecar_name(spark, tmp_path):
    write(tmp_path, "AAA", lines()[:10])
    digest = hashlib.sha256((tmp_path / "AAA-1m-2024-02.zip").read_bytes()).hexdigest()
    sidecar = tmp_path / "AAA-1m-2024-02.zip.CHECKSUM"
    for text, ok in ((f"{digest} *AAA-1m-2024-02.zip", True), (f"{digest} other.zip", False), (digest, False), (f"{digest} AAA-1m-2024-02.zip more", False)):
        sidecar.write_text(text)
        assert validate.checksums(spark, str(tmp_path)).first()["ok"] is ok


GOOD = {"data": {"symbols": ["A"], "interval": "1m", "months": ["2024-01"]}, "covariance": {"block_size": 30}}


def test_config():
    assert parse_experiment_config(GOOD) == ExperimentConfig(("A",), "1m", ("2024-01",), 30)


@pytest.mark.parametrize(
    "bad",
    [
        [], {}, {"data": 1, "covariance": {}}, GOOD | {"covariance": 3}, GOOD | {"data": GOOD["data"] | {"symbols": []}},
        GOOD | {"data": GOOD["data"] | {"months": ["2024-13"]}}, GOOD | {"data": GOOD["data"] | {"interval": 1}},
        GOOD | {"covariance": {"block_size": 1}}, GOOD | {"covariance": {"block_size": True}},
    ],
)
def test_config_refuses(bad):
    with pytest.raises(ValueError):
        parse_experiment_config(bad)


def test_addresses():
    found = download.archive_addresses("https://host.invalid/data/", CONFIG)
    assert found[0] == "https://host.invalid/data/AAA/1m/AAA-1m-2024-02.zip" and found[1] == found[0] + ".CHECKSUM" and len(found) == 4


def test_carry_forward_and_sinks(spark, tmp_path):
    t = [datetime(2024, 1, 1, h) for h in range(3)]
    rows = spark.createDataFrame([(t[0], "a", 1.0), (t[1], "b", 2.0), (t[2], "a", 3.0)], "ts timestamp, asset string, price double")
    filled = Panel(carried_forward(rows), ("a", "b"))
    assert [(r["ts"], list(r["price"])) for r in filled.wide.orderBy("ts").collect()] == [(t[1], [1.0, 2.0]), (t[2], [3.0, 2.0])]
    paths = sinks.save_tables({"one": rows}, str(tmp_path))
    assert spark.read.option("header", True).csv(paths[0]).count() == 3
    assert "asset" in sinks.report({"one": rows}) and "more rows" not in sinks.report({"one": rows}, 3) and "more rows" in sinks.report({"one": rows}, 2)


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_carry_forward_over_units(spark, unit):
    """The last price is carried over any number of empty units, and null prices are none."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), a, rng.choice([None, float(h + 1)])) for h in range(0, 24 * 9) for a in "abc" if rng.random() < (0.02 if a == "a" else 0.3)]
    rows = [r for r in rows if not (r[1] == "b" and 30 < (r[0] - start).total_seconds() / 3600 < 150)]
    frame = spark.createDataFrame(rows, "ts timestamp, asset string, price double")
    known = {(t, a): p for t, a, p in rows if p is not None}
    want = {}
    for a in "abc":
        last = None
        for t in sorted({t for t, *_ in rows}):
            last = known.get((t, a), last)
            if last is not None:
                want[t, a] = last
    assert {(r["ts"], r["asset"]): r["price"] for r in carried_forward(frame, unit).collect()} == want


def test_contiguity_over_chunks(spark):
    times = [0, 60, 120, 120, 240, 300, 360, 600, 540]
    frame = spark.createDataFrame([("a", i, t, t != 300) for i, t in enumerate(times)] + [("b", 0, 5, True)], "g string, line long, t long, good boolean")
    for size in (1, 2, 4, 100):
        rows = validate.contiguity(frame, ["g"], "line", "t", 60, F.floor(F.col("line") / size), F.col("good")).collect()
        assert sorted(tuple(r) for r in rows) == [("a", 9, 0, 540, 4, False), ("b", 1, 5, 5, 0, True)]
