"""The command line, job after job, on the same folders."""

import json

import run_job
from emberline.operators import spatial
from emberline.plans import fixtures as fx
from emberline.sources.weather import DAILY_COLUMNS


def test_jobs_from_the_command_line(spark, sf, tmp_path, capfd):
    path = {n: str(tmp_path / n) for n in ("fires", "payloads", "mapping", "grid", "history", "out")}
    fx.fires(spark, sf).selectExpr(
        "latitude", "longitude", "cast(rep_date AS timestamp) AS rep_date", "size_ha"
    ).write.parquet(path["fires"])
    (tmp_path / "payloads").mkdir()
    names = [s["name"] for s in spatial.stations(spark).collect()]
    lines = [
        json.dumps({"station": n, "fetched_at": "2024-07-01T05:00:00Z", "payload": {"main": {"temp": 20.0}}})
        for n in names
    ]
    (tmp_path / "payloads" / "run.json").write_text("\n".join(lines))

    run_job.main(["grid", "--fires", path["fires"], "--out", path["grid"]])
    run_job.main(["stations", "--out", path["mapping"]])
    ts = ["--run-ts", "2024-07-01 06:00:00"]
    places = [x for n in ("payloads", "mapping", "grid", "history", "out") for x in (f"--{n}", path[n])]
    run_job.main(["refresh", *places, *ts])
    run_job.main(["score", *places, *ts])
    capfd.readouterr()
    run_job.main(["stats", *places])
    assert "14952" in capfd.readouterr().out
    run_job.main(["health", *places, *ts])
    assert "Weather Data" in capfd.readouterr().out
    run_job.main(["classes"])
    assert "30+ FWI" in capfd.readouterr().out
    weather = spark.read.parquet(path["history"])
    assert weather.count() == 14952 and weather.first()["date"] == "2024-07-01 00:00:00"
    scored = spark.read.parquet(path["out"] + "/predictions/parquet")
    assert scored.count() == 14952
    assert scored.filter("danger_class IS NULL OR daily_fire_risk IS NULL").isEmpty()
    streamed = str(tmp_path / "streamed")
    run_job.main(["ingest", "--payloads", path["payloads"], "--mapping", path["mapping"], "--history", streamed, "--checkpoint", str(tmp_path / "cp")])
    assert spark.read.parquet(streamed).count() == 14952
    run_job.main(["score", "--history", streamed, "--out", str(tmp_path / "out2"), "--as-of", "2024-07-01", *ts])
    assert spark.read.parquet(str(tmp_path / "out2/scored")).count() == 14952
    capfd.readouterr()
    run_job.main(["prune", "--history", streamed, "--keep", "1"])
    assert capfd.readouterr().out.strip() == ""


def test_import_of_daily_files(spark, tmp_path):
    header = ",".join(DAILY_COLUMNS)
    for day in (1, 2):
        values = {c: "" for c in DAILY_COLUMNS} | {"lat": "50.0", "lon": "-110.0", "temperature": str(10 + day)}
        (tmp_path / f"2024-06-0{day}.csv").write_text(f"{header}\n{','.join(values.values())}\n")
    run_job.main(["import", "--daily-files", str(tmp_path), "--history", str(tmp_path / "history")])
    stored = spark.read.parquet(str(tmp_path / "history"))
    assert sorted((str(r["file_date"]), r["temperature"]) for r in stored.collect()) == [
        ("2024-06-01", 11.0), ("2024-06-02", 12.0)
    ]
    out = ["--out", str(tmp_path / "out"), "--run-ts", "2024-06-02 12:00:00"]
    run_job.main(["score", "--history", str(tmp_path / "history"), *out])
    assert spark.read.parquet(str(tmp_path / "out/predictions/parquet")).count() == 1
