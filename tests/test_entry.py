"""The entry registers what can be imported, and nothing fails for the rest."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def registered(lead: str) -> set[str]:
    code = f"{lead}\nimport __spark_entry__ as e\nprint('|'.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.strip().split("|"))


def test_missing_parts_leave_the_others():
    catalog = registered("import sys; sys.modules['merrow.llm'] = None")
    assert {"content_recommend", "tfidf_weights", "retention_purge"} <= catalog and "pipeline" not in catalog
    assert not [q for q in catalog if q.startswith("op") and q[2].isdigit()]
    assert catalog <= registered("import sys; sys.modules['ahocorasick'] = None")
    assert "pipeline" not in registered("import sys; sys.modules['ahocorasick'] = None")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from merrow.scratch import shared_folder

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
