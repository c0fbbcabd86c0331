"""The entry module without the part that may be lacking."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), any(k.startswith("op") and "_" in k and k[2].isdigit() for k in entry.queries()))
"""


def queries_without(*blocked):
    code = CODE.format(blocked=blocked, root=str(Path(__file__).parents[1]))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    n, corpus = out.split()
    return int(n), corpus == "True"


def test_a_missing_library_leaves_the_other_queries():
    n, corpus = queries_without("ahocorasick")
    assert n >= 81 and not corpus
