import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASHES = ("size", "key", "target", "epochs", "cut", "shard", "slot", "digest", "print", "score",
           "anchor", "path", "at", "n", "seed", "item_id", "stream", "place", "quality", "toxic",
           "_source", "_n", "Score", "root", "u", "v", "bucket", "component_id", "_copy", "_id",
           "_digest", "_doc", "_at", "_s", "_rank", "_key", "_place", "_bucket")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, copies, repeated rows."""
    shared = prose(1, 60)
    return [
        (1, prose(2, 80), "en", "a", 1), (2, prose(2, 80), "en", "b", 1),  # exact copies
        (3, prose(3, 40) + " " + shared + " " + prose(4, 30), "en", "a", 1),
        (4, prose(5, 20) + "\n" + shared.replace(" ", " \t"), None, "c", None),
        (5, None, "en", "a", None), (6, "", "en", None, 0), (7, " \n\t ", "de", "b", 3),
        (8, "one", "en", "a", 3), (8, "one", "en", "a", 3),  # a repeated row
        (None, prose(6, 90), "en", None, 1), (None, prose(7, 5), "en", "b", 1),
        (9, prose(8, 30_000, 5_000), "en", "a", 1),  # long
        (10, "na " * 3_000, "en", "d", 1),  # one word again and again
        (11, "Ärger über alles und £€ 漢字 " * 9, "de", "d", 1),
        (12, (prose(9, 7) + " ") * 30, "en", "d", 1),  # periodic
        (13, "x" * 5_000 + " " + prose(10, 34), "en", "c", 1),
        (14, prose(11, 35), "en", "c", 1), (15, prose(11, 35), "en", "c", 1),
        (16, prose(12, 36), "en", "c", 1), (17, "q " + prose(12, 36), "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge):
    return edge.withColumns({c: F.lit("own") for c in CLASHES if c != "Score"})
