"""Raw manifests, checks inside processing, and sets of tables that are published together."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.jobs import predict, process, train
from exposure_jobs.sources import lineage, publication
from exposure_jobs.sources.alerts import RAW_COLUMNS, read_raw_alerts
from exposure_jobs.sources.regions import registry


def write_feed(path, names, n, seed=1, parts=1):
    rng, start, lines = random.Random(seed), datetime(2024, 1, 1), []
    for name in names:
        for _ in range(n):
            a = start + timedelta(minutes=rng.randrange(120 * 1440))
            lines.append(f"{name},,,oblast,{a:%Y-%m-%d %H:%M:%S}+00:00,{a + timedelta(minutes=rng.randrange(600)):%Y-%m-%d %H:%M:%S}+00:00,official")
    path.mkdir(exist_ok=True)
    for part in range(parts):
        (path / f"{part}.csv").write_text("\n".join([",".join(RAW_COLUMNS), *lines[part::parts]]) + "\n")
    return lines


def test_digest_knows_rows_not_their_order(spark, tmp_path):
    lines = write_feed(tmp_path / "a", ["Kyiv City"], 40)
    write_feed(tmp_path / "b", ["Kyiv City"], 40, parts=3)
    of = lambda p: tuple(lineage.row_digest(read_raw_alerts(spark, str(tmp_path / p))).first())
    assert of("a") == of("b") and of("a")[0] == len(lines)
    rows = [("x", None, "", "l", "s", "f", "o"), ("x", "", None, "l", "s", "f", "o"), ("x", "", "", "l", "s", "f", "o")]
    digests = {lineage.row_digest(spark.createDataFrame([r] * n, ", ".join(f"{c} string" for c in RAW_COLUMNS))).first()["row_digest"] for r in rows for n in (1, 2)}
    assert len(digests) == 6
    assert tuple(lineage.row_digest(read_raw_alerts(spark, str(tmp_path / "a")).limit(0)).first()) == (0, "0")


def test_a_changed_byte_a_lost_file_and_a_new_one_are_found(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "manifest")
    write_feed(feed, ["Kyiv City", "Lvivska oblast"], 200, parts=3)
    raw = read_raw_alerts(spark, str(feed))
    lineage.write_raw_manifest(spark, raw, str(feed), out)
    found = lambda: sorted((r.check, r.detail.split(" ")[0]) for r in lineage.raw_differences(spark, read_raw_alerts(spark, str(feed)), str(feed), out).collect())
    assert found() == []
    text = (feed / "1.csv").read_text()
    (feed / "1.csv").write_text(text.replace("official", "officiaL", 1))
    assert found() == [("file", "changed"), ("rows", "digest")]
    (feed / "1.csv").write_text(text.replace("\n", "\r\n"))  # other bytes, the same rows
    assert found() == [("file", "changed")]
    (feed / "1.csv").unlink()
    write_feed(feed.parent / "more", ["Kyiv City"], 1)
    (feed / "9.csv").write_text((tmp_path / "more" / "0.csv").read_text())
    assert found() == [("file", "came"), ("file", "went"), ("row_count", "expected"), ("rows", "digest")]
    with pytest.raises(ValueError, match="file: came"):
        lineage.checked_raw(spark, read_raw_alerts(spark, str(feed)), str(feed), out)


def test_processing_checks_feed_and_tables_and_states_its_lineage(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "tables")
    lines = write_feed(feed, ["Kyiv City", "Lvivska oblast", "Nowhere"], 100)
    process.main([str(feed), out, "--data-cutoff", "2024-05-01 00:00:00", "--check-labels"])
    facts = spark.read.json(f"{out}/manifest").collect()
    digest = lineage.row_digest(read_raw_alerts(spark, str(feed))).first()["row_digest"]
    assert {(r.raw_rows, r.raw_digest, r.validation_weeks, r.test_weeks) for r in facts} == {(len(lines), digest, 8, 4)}
    assert all(r.labels.split(",") == [f"y_{k}" for k in range(1, 25)] and len(r.features.split(",")) == 12 for r in facts)
    assert [(r.oblast, r.n_events) for r in spark.read.json(f"{out}/unmapped").collect()] == [("Nowhere", 100)]
    process.main([str(feed), out, "--raw-manifest", f"{out}/raw_manifest"])
    (feed / "0.csv").write_text((feed / "0.csv").read_text() + lines[0] + "\n")
    with pytest.raises(ValueError, match="rows: digest"):
        process.main([str(feed), out, "--raw-manifest", f"{out}/raw_manifest"])


def test_quality_errors_name_what_is_wrong(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = spark.createDataFrame([("kyiv_city", at(h), at(h + 2)) for h in range(0, 24 * 120, 40)], "region_id string, started_at timestamp, finished_at timestamp")
    good = process.build_tables(events, registry(spark), Settings(horizons=(1, 6)))
    assert process.quality_errors(good, labels=True).count() == 0
    wrong = process.replace(
        good,
        events=events.union(events.limit(1).select("region_id", "finished_at", "started_at")),
        merged=good.merged.union(good.merged.limit(1)),
        matrix=good.matrix.union(good.matrix.limit(3)),
        origins=good.origins.withColumn("y_6", F.when(F.col("origin_hour") == F.lit(at(3)), 1 - F.col("y_6")).otherwise(F.col("y_6"))),
    )
    assert {(r.check, r.n) for r in process.quality_errors(wrong, labels=True).collect()} == {("negative duration", 1), ("overlapping intervals", 1), ("repeated origin", 3), ("wrong label", 1)}


def test_a_crash_between_the_writes_leaves_the_last_version_in_force(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(FileNotFoundError, match="nothing is published"):
        publication.current(spark, root)
    of = lambda v: spark.createDataFrame([("r1", v), ("r2", v)], "region_id string, v int")
    first = publication.publish(root, {"parameters": of(1), "calibrators": of(1)}, {"method": "isotonic"})
    broken = of(2).withColumn("v", F.raise_error("lost").cast("int"))
    with pytest.raises(Exception, match="lost"):
        publication.publish(root, {"parameters": of(2), "calibrators": broken}, {"method": "isotonic"})
    assert publication.current(spark, root)["version"] == first
    assert {r.v for name in ("parameters", "calibrators") for r in publication.read_published(spark, root, name).collect()} == {1}
    second = publication.publish(root, {"parameters": of(3), "calibrators": of(3)}, {"method": "sigmoid"})
    assert second > first and {r.v for r in publication.read_published(spark, root, "parameters", ["r2"], method="sigmoid").collect()} == {3}
    with pytest.raises(ValueError, match="does not fit"):
        publication.read_published(spark, root, "parameters", method="isotonic")
    with pytest.raises(FileNotFoundError, match="r9"):
        publication.read_published(spark, root, "parameters", ["r9"])
    with pytest.raises(FileNotFoundError, match="no report"):
        publication.read_published(spark, root, "report")


def test_models_of_another_matrix_are_refused(spark, tmp_path):
    feed, out, models = tmp_path / "feed", str(tmp_path / "tables"), str(tmp_path / "models")
    write_feed(feed, ["Kyiv City", "Lvivska oblast"], 150)
    process.main([str(feed), out, "--data-cutoff", "2024-05-01 00:00:00", "--publish"])
    train.main([f"{out}/published", models, "--constant-single-class", "--publish"])
    predict.main([f"{out}/published", models, str(tmp_path / "forecast"), "--published"])
    assert spark.read.json(str(tmp_path / "forecast")).count() == 48
    assert publication.read_published(spark, models, "scores").count() == 2 * 24 * 4
    process.main([str(feed), out, "--data-cutoff", "2024-05-02 00:00:00", "--publish"])
    with pytest.raises(ValueError, match="matrix_version"):
        predict.main([f"{out}/published", models, str(tmp_path / "forecast"), "--published"])
