"""The driver's entry with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDING = """
import sys, warnings
warnings.simplefilter("ignore")
hidden = sys.argv[1]

class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == hidden or name.startswith(hidden + "."):
            raise ImportError(name + " is hidden")

sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
names = e.queries()
assert "redact_text_documents" in names and set(e.oracle_sql()) <= set(names)
print(sum(n.startswith("op") or n == "pipeline" for n in names))
"""


def _with_hidden(name):
    out = subprocess.run([sys.executable, "-c", HIDING, name], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return int(out.stdout.split()[-1])


def test_what_cannot_be_imported_is_left_out():
    assert _with_hidden("umbra.llm") == 0
    assert _with_hidden("xxhash") == 0  # a dependency of the subpackage alone
    assert _with_hidden("umbra.llm") == 0
    assert _with_hidden("xxhash") == 0  # a dependency of the subpackage alone
    assert _with_hidden("corpus_pipeline") == 0


def test_other_queries_need_no_llm():
    import umbra.plans  # noqa: F401

    out = subprocess.run([sys.executable, "-c", "import sys, umbra.plans, umbra.streaming.jobs; print(any(m.startswith('umbra.llm') for m in sys.modules))"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert out.stdout.split()[-1:] == ["False"], out.stderr[-2000:]
