"""The driver's contract, with and without the text operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_without_text_operators(tmp_path):
    code = "import sys\nsys.modules['barline.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and len(e.queries()) > 80\nassert not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_a_broken_dependency_is_no_absence():
    code = "import sys\nsys.modules['numpy'] = None\ntry:\n    import __spark_entry__\nexcept ImportError as e:\n    assert 'barline' not in str(e.name), e\nelse:\n    raise SystemExit('imported')"
    subprocess.run([sys.executable, "-c", code], check=True)
