"""Readers of subject files: files do not grow with the subjects, one file per subject still works."""

from wavemill.plans import catalog
from wavemill.sources import tables as tb

SF = "/root/testdata/sf0.01"


def test_files_do_not_grow_with_the_subjects(spark):
    for name in ("subject_id_map", "src_subject_csv"):
        df = catalog.QUERIES[name](spark, SF)
        assert len(df.inputFiles()) <= 40
        assert df.count() >= 150


def test_files_of_their_own(spark, tmp_path):
    for k, text in enumerate(("Time,ECG,PPG\n1,2,3\n", "Time,ECG,PPG\n4,NaN,6\n")):
        (tmp_path / f"s{k}.csv").write_text(text)
    got = {tuple(r) for r in tb.read_subject_csv(spark, {0: str(tmp_path)}).collect()}
    assert got == {("s0", 0, 1.0, 2.0, 3.0), ("s1", 0, 4.0, None, 6.0)}
