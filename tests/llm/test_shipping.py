"""Operators called first of all on DataFrames of one's own, by a driver whose path the workers don't share."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, f"some words of text number {{i}} licensed under the MIT License.", "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
from marlstone.llm import ann, catalogue, fingerprints, licenses, neardup, packing, quality, toxicity
print("rows", {call}.count())
"""
CALLS = (
    "neardup.near_duplicate_classes(docs)", "packing.pack_sequences(docs, catalogue.tokenizer_path())", "fingerprints.fingerprint_digest(docs)", "licenses.license_scan(docs)",
    "ann.nearest_neighbours(vectors, F.col('vec_id') == 0)", "quality.quality_scores(docs, labels)", "toxicity.toxicity_scores(docs, labels)",
)


def test_first_calls(tmp_path):
    repo = str(Path(__file__).parents[2])
    for call in (CALLS[0], CALLS[2]):
        got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, call=call)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
        assert "rows 6" in got.stdout, got.stderr[-3000:]


def test_every_operator_ships_before_it_makes_a_function(spark, monkeypatch):
    """ship() comes before the first mapInArrow of each operator."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from marlstone.llm import ann, catalogue, common, fingerprints, learning, licenses, neardup, packing, quality, toxicity

    calls: list[str] = []
    for module in (ann, common, fingerprints, learning, licenses, neardup, packing):
        monkeypatch.setattr(module, "ship", lambda _: calls.append("ship"))
    whole = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *a, **b: (calls.append("map"), whole(*a, **b))[1])
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.5, 1.0])], "vec_id long, embedding array<double>")
    known = {"neardup": neardup, "packing": packing, "fingerprints": fingerprints, "licenses": licenses, "ann": ann, "quality": quality, "toxicity": toxicity, "catalogue": catalogue, "F": F, "docs": docs, "labels": labels, "vectors": vectors}
    for call in CALLS:
        calls.clear()
        eval(call, known)  # noqa: S307  the list above
        assert calls[0] == "ship", call
