"""The entry points with and without what the corpus part needs."""

import subprocess
import sys
from pathlib import Path

import pytest

from weftline.llm import pieces, queries
from weftline.plans.queries import QUERIES as GRAPH_QUERIES

ROOT = Path(__file__).resolve().parents[2]
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in {names!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith(('op1_', 'pipeline'))))
"""


GRAPH, OPERATORS, SQL = len(GRAPH_QUERIES), len(queries.QUERIES), len(queries.ORACLE_SQL)


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (("public_tokenizers",), f"{GRAPH} {GRAPH} []"),
        (("corpus_pipeline",), f"{GRAPH + OPERATORS} {GRAPH + SQL} ['op1_hilbert_shards']"),
        ((), f"{GRAPH + OPERATORS + 1} {GRAPH + SQL} ['op1_hilbert_shards', 'pipeline']"),
    ],
)
def test_entry_without_libraries(names, want):
    said = subprocess.run([sys.executable, "-c", BLOCK.format(names=list(names))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == want, said.stderr


def test_large_piece_ids_are_refused():
    with pytest.raises(ValueError, match="16 bits"):
        pieces.Merger([(1 << 16, "x", 0.0, None)])
