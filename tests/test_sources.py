"""CSV round trips, strict reading, and dictionaries of any size."""
import os

import pytest
from pyspark.sql import functions as F

from ragscope.operators import features as FE
from ragscope.operators import neighbors as NB
from ragscope.sources.tables import read_csv_table, save_table

ROWS = [(1, 'quoted "words", and commas', 1.5), (2, "two\nlines\n", None), (3, "", 2.0), (4, None, 3.0), (5, " spaces around ", 0.1), (6, '"', 1e-9), (7, "\\N!", 7.0)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, text string, x double")
    back = read_csv_table(spark, save_table(df, f"{tmp_path}/t", "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == ROWS


@pytest.mark.parametrize("content", ["id,other,x\n1,a,2.0\n", "id,text,x\n1,a,not a number\n"])
def test_wrong_header_and_malformed_rows_are_errors(spark, tmp_path, content):
    with open(os.path.join(tmp_path, "bad.csv"), "w") as f:
        f.write(content)
    with pytest.raises(Exception):
        read_csv_table(spark, f"{tmp_path}/bad.csv", "id int, text string, x double").collect()


def test_encoding_of_12000_values(spark):
    """More values than become literals, in two columns: codes, slots, the way back, and class weights."""
    n = 12_000
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id") * 7919 % n).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 50)).alias("b"))
    code = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(n)))}
    small = {v: i for i, v in enumerate(sorted({f"w{i % 50}" for i in range(n) if i % 3}))}
    enc = FE.label_encode(df, ["a", "b"])
    rows = FE.one_hot_slots(enc, ["a", "b"]).collect()
    assert len(rows) == n
    with_nan = {v: i for i, v in enumerate(sorted([*small, "nan"]))}
    for r in rows:
        assert r["a_enc"] == code[r["a"]] and r["b_enc"] == with_nan[r["b"] or "nan"]
        assert r["slots"] == [code[r["a"]]] + ([n + small[r["b"]]] if r["b"] else [])
    back = FE.decode(enc, "a", FE.dictionary(df, ["a"]), "a_enc", "again")
    assert back.where("a = again").count() == n
    weights = NB.balanced_weights(df.union(df.where("id = 0")), "a").select("a", "weight").distinct().collect()
    assert len(weights) == n and {round(r["weight"] * n * (2 if r["a"] == "v0" else 1), 6) for r in weights} == {n + 1}
