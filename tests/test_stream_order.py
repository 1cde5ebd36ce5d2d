"""An older file that is taken in late never replaces what a newer one brought."""

import os
from datetime import datetime

from wardgate.operators import tables as tb
from wardgate.streaming.incremental import LANDED, intake_stream
from wardgate.workspace import new_folder

AS_OF = datetime(2026, 7, 1, 12)


def test_late_files(spark, tmp_path):
    root = new_folder(spark, "late")
    patients = tb.KeyedTable(spark, f"{root}/patients", tb.PATIENTS, "notice_id", versions=LANDED)
    for name, value, when in (("b", "new", 1_700_000_000), ("a", "old", 1_690_000_000), ("c", "newest", 1_710_000_000)):
        path = tmp_path / "in" / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(f'{{"notice_id": "N1", "patient_name": "{value}"}}\n{{"notice_id": "{name}", "patient_name": "x"}}\n')
        os.utime(path, (when, when))
        intake_stream(spark, str(tmp_path / "in"), patients, f"{root}/audit", f"{root}/checkpoint", AS_OF).awaitTermination()
        held = {r["notice_id"]: r["patient_name"] for r in patients.current().collect()}
        assert held["N1"] == {"b": "new", "a": "new", "c": "newest"}[name]
    assert set(held) == {"N1", "a", "b", "c"} and patients.current().columns == tb.PATIENTS.names
