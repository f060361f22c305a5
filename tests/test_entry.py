import subprocess
import sys

CHECK = """
import sys
for name in BLOCKED:
    sys.modules[name] = None
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
assert "evaluate_rules" in names and set(sql) <= set(names)
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""


def blocked(*names):
    done = subprocess.run([sys.executable, "-c", CHECK.replace("BLOCKED", repr(names))], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_works_without_the_language_model_part():
    blocked("ledgerlark.llm", "corpus_pipeline")


def test_works_without_its_libraries():
    blocked("public_tokenizers", "zstandard")
