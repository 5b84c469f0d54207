"""End to end: files -> detect -> read -> clean -> align -> write, batch and incremental."""

import glob
import os

from glucoflow.plans import workflow
from glucoflow.sinks import export

HEADER = ("Device,Serial Number,Device Timestamp,Historic Glucose mmol/L,Scan Glucose mmol/L,Strip Glucose mmol/L,"
          "Rapid-Acting Insulin (units),Long-Acting Insulin Value (units),Carbohydrates (grams),Notes")


def write_export(path, start_hour=8):
    rows = ["Glucose Data,Generated on,02-01-2024", HEADER]
    for i in range(12):
        m = i * 5
        rows.append(f"L,1,01-01-2024 {start_hour:02d}:{m:02d},{5.0 + i * 0.1:.1f},,,,,,")
    rows.append(f"L,1,01-01-2024 {start_hour:02d}:07,,,6.5,4,,20,lunch")
    rows.append(f"L,1,01-01-2024 {start_hour:02d}:31,,,,,10,0.5,")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(rows) + "\n")


def test_run_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_export(src / "alice.csv", 8)
    write_export(src / "bob.csv", 9)
    run, aligned, written = workflow.run(spark, [str(src / "alice.csv"), str(src / "bob.csv")], str(tmp_path / "out"))
    assert set(run.processed) == {"CGM", "BGM", "INSULIN", "CARBS", "NOTES"}
    al = aligned.frame
    assert al.select("series_id").distinct().count() == 2
    alice = al.where("series_id = 'alice'").orderBy("ts").collect()
    assert len(alice) == 12
    assert alice[1]["bgm_primary"] == 6.5 * 18.0182  # 08:07 rounds to 08:05
    assert alice[1]["bolus_dose"] == 4.0
    assert alice[1]["carbs_primary"] == 20.0
    assert alice[1]["notes_primary"] == "lunch"
    assert alice[6]["basal_dose"] == 10.0  # long-acting column at 08:31 -> 08:30
    assert sum(r["carbs_primary"] for r in alice) == 20.0  # 0.5 g dropped
    base = written["base"]
    assert os.path.basename(base).startswith("2024-01-01_to_2024-01-01_complete_")
    assert glob.glob(f"{base}/aligned/part-*.csv")
    assert glob.glob(f"{base}/monthly/cgm/month=2024-01/*.csv")
    assert export.read_table(spark, base, "monthly/cgm", ["bob"]).where("month = '2024-01'").count() == 12
    missing = spark.read.json(written["missing_required_data"]).collect()  # the exports have no scan values
    assert sorted((r["_file"].rsplit("/", 1)[1], r["missing_required_data"]) for r in missing) == [("alice.csv", ["Scan Glucose mmol/L"]), ("bob.csv", ["Scan Glucose mmol/L"])]
    notes = spark.read.schema(export.NOTES_SCHEMA).json(written["processing_notes"])
    assert notes.where("data_type = 'aligned' AND scope = 'person'").count() == 2
    cgm_notes = notes.where("data_type = 'cgm' AND series_id = 'alice' AND scope = 'person'").first()["notes"]
    assert "Processed 12 total CGM readings" in cgm_notes


def test_stream_processes_new_files(spark, tmp_path):
    from glucoflow.streaming import watch_exports

    src = tmp_path / "in"
    src.mkdir()
    write_export(src / "carol.csv", 10)
    q = watch_exports(spark, str(src), str(tmp_path / "out"), glob="*.csv", checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    base = glob.glob(str(tmp_path / "out" / "batch=0" / "*_complete_*"))[0]
    assert export.read_table(spark, base, "cgm", ["carol"]).count() == 12
