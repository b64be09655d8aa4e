import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
blocked = {blocked!r}
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in blocked:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = set(e.queries())
print(len(names), len([n for n in names if n.startswith("op")]), "pipeline" in names, set(e.oracle_sql()) <= names)
"""


def offered(*blocked):
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(blocked=set(blocked))], cwd=REPO, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_queries_where_the_training_data_operators_cannot_be_imported():
    own = offered("obslytics.llm")
    assert int(own[0]) >= 106 and own[1:] == ["0", "False", "True"]
    for library in ("xxhash", "zstandard", "tokenizers", "public_tokenizers"):
        assert offered(library, "obslytics.llm") == own
        assert int(offered(library)[0]) >= int(own[0])
