import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ModuleNotFoundError("hidden " + name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), sum(n.startswith("op") for n in entry.queries()))
"""


def loaded(*hidden):
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden=set(hidden))], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()))


def test_entry_without_training_queries():
    from registered import ORACLES, QUERIES

    core = (len(QUERIES), len(ORACLES), 0)
    assert loaded("panelwright.llm") == core
    assert loaded("ahocorasick", "tokenizers") == core
