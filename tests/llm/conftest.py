import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every awkward case: nulls, empty and blank texts, a long text, repeated rows, clashing columns."""
    words = [f"w{i * 7919 % 4001}" for i in range(60_000)]
    shared = " ".join(f"shared{i}" for i in range(80))
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "The cat sat on the mat and looked at the dog."),
        (5, "The cat sat on the mat and looked at the dog."), (6, " ".join(words)), (7, "début " + shared + " fin"),
        (8, "x " + shared), (None, "no id here " + shared), (9, "aaaa " * 500), (4, "The cat sat on the mat and looked at the dog."),
        (10, "UPPER case Text with 123 numbers, marks! and <|endoftext|> in it"), (11, "日本語 の テキスト"),
    ]
    return spark.createDataFrame([(i, t, "c", 1.0, "s") for i, t in rows], "doc_id long, text string, did string, h double, spans string")


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"
