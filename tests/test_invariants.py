"""Rules the code base keeps: no driver-wide collects, no machine-local checkpoints."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = [*(p for p in ROOT.glob("attestra/**/*.py") if p.parent.name != "llm"), *ROOT.glob("checks/**/*.py"), ROOT / "__spark_entry__.py", ROOT / "bench.py"]


def test_no_forbidden_calls():
    for path in CODE:
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".toPandas(", "dropDuplicates(", ".rdd.map"):
            # store.py drops copies that are equal in every column
            assert word not in text or (word, path.name) == ("dropDuplicates(", "store.py"), f"{word} in {path.name}"


def test_collects_are_bounded():
    allowed = {"analysis.py": 2, "sinks.py": 2}
    for path in CODE:
        n = len(re.findall(r"\.collect\(\)", path.read_text()))
        assert n <= allowed.get(path.name, 0), f"{n} collects in {path.name}"


def test_checkpoint_folder_comes_from_the_session(spark, tmp_path):
    from attestra.session import checkpoint_dir, cut_lineage

    folder = checkpoint_dir(spark)
    cut = cut_lineage(spark.range(5))
    assert cut.count() == 5 and all(f.startswith(folder) or folder in f for f in cut.inputFiles())
