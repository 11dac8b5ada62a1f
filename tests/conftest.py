import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
KNOWN = dict(zip(("river", "stone", "maple", "cloud", "north", "south", "##s", "gentle"), range(10, 18), strict=True))


@pytest.fixture(scope="session")
def spark():
    from impactspark.session import get_spark

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    s = get_spark("tests", "local[4]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def small_vocab() -> list[str]:
    tokens = [f"spare-{n}" for n in range(200)]
    for t, i in KNOWN.items():
        tokens[i] = t
    return tokens


def fake_encode(text: str) -> dict[int, float]:
    """2.0 for each word that is in the vocabulary."""
    return {KNOWN[w]: 2.0 for w in text.split() if w in KNOWN}


@pytest.fixture
def fake_model():
    from impactspark.functions.encoders import FunctionEncoder
    from impactspark.functions.models import register_model, unregister_model

    register_model("fake", FunctionEncoder("fake", small_vocab(), dict.fromkeys(KNOWN.values(), 1.5), fake_encode))
    yield "fake"
    unregister_model("fake")


@pytest.fixture
def index(spark, tmp_path, fake_model):
    from impactspark.operators.index import SparseIndex

    return SparseIndex(spark, str(tmp_path / "ix"), model=fake_model)


def put(spark, ix, texts, **kw):
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return ix.insert_text(spark.createDataFrame(rows, "id long, text string"), **kw)


def hits(df):
    return [(r["rowid"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]
