import datetime as dt

from marketclime.plans import reports
from tests.test_climate import DDL, make_days
from tests.test_water import BASE, CAP, CROP_DDL, CROPS


def test_price_report_is_written(spark, tmp_path, rows):
    data = [
        (i, str(dt.date(2020, 1, 1) + dt.timedelta(days=i // 2)), "ab"[i % 2], 1, 2.0 + i % 7, 30, 1) for i in range(200)
    ]
    mapping = spark.createDataFrame([("a", "crop"), ("b", "ignore")], "item string, crop_id string")
    df = rows(*data)
    report = reports.price_report(df, mapping, min_days=10)
    reports.write_price_report(report, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 200
    index = {r.name: r for r in spark.read.json(str(tmp_path / "prices_index")).collect()}
    assert index["a"].crop == "crop" and not index["b"].mapped
    one = spark.read.json(str(tmp_path / "prices" / f"series_id={index['a'].id}")).first()
    assert one.days == 100 and len(one.weekly) == 15
    assert spark.read.json(str(tmp_path / "latest")).count() == 2
    audit = reports.audit_report(df)
    assert audit["duplicates"].first().duplicate_keys == 0 and audit["name_pairs"].count() == 1
    local = reports.price_report(df, mapping, min_days=10, outlier_rule="local")
    assert local.clean.count() == 200


def test_climate_and_planting_reports(spark, tmp_path):
    weather = spark.createDataFrame(make_days(5), DDL)
    reports.write_climate_report(reports.climate_report(weather), str(tmp_path))
    document = spark.read.json(str(tmp_path / "climate")).first()
    assert len(document.monthly) == 12 and len(document.frost) == 3
    assert len(document.monthly[0].heat_days_per_year) == 3
    variants = spark.createDataFrame(CROPS, CROP_DDL)
    seasons, sweep = reports.planting_report(weather, variants, 0.4, 0.9, BASE, CAP, dates=[(4, 1), (9, 1)])
    assert seasons.count() > 0 and {(r.month, r.day) for r in sweep.collect()} <= {(4, 1), (9, 1)}
