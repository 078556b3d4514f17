"""Places of lines under any split size, ordered files, exact decimals, lemmas, records."""

import json
import os
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tagsift import sinks
from tagsift.functions.decimals import decimal_text, metric_percent
from tagsift.operators import textstats as ts
from tagsift.sources import lines, tsv


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in keep.items():
        spark.conf.set(k, v)


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, rows in files.items():
        with open(f"{folder}/{name}", "w", newline="") as f:
            f.write("".join(r + "\n" for r in rows))
    return str(folder)


@pytest.mark.parametrize("size", [17, 64, 1000, 10 ** 6])
def test_places_do_not_depend_on_splits(spark, small_splits, tmp_path, size):
    draw = random.Random(size)
    files = {f"f{k}.txt": ["x" * draw.randint(0, 60) + f"é{k}.{n}" for n in range(draw.choice([0, 1, 40]))] for k in range(6)}
    files["f2.txt"] = ["", "", "a\r", ""]
    path = write(tmp_path / "t", files)
    small_splits(size)
    for down in (False, True):
        got = lines.numbered_lines(spark, path, down).orderBy("place").collect()
        want = [(name, n, r.removesuffix("\r")) for name in sorted(files, reverse=down) for n, r in enumerate(files[name], 1)]
        assert [(os.path.basename(r.file), r.line_no, r.line) for r in got] == want
        assert [r.place for r in got] == list(range(1, len(want) + 1))
    # A filter on the file doesn't change the numbers.
    one = lines.numbered_lines(spark, path).where(F.col("file").endswith("f1.txt") & (F.col("line_no") > 1)).collect()
    assert sorted(r.line_no for r in one) == list(range(2, len(files["f1.txt"]) + 1))


@pytest.mark.parametrize("size", [30, 10 ** 6])
def test_errors_name_file_and_line(spark, small_splits, tmp_path, size):
    rows = [f"{n}\tx{n}" for n in range(50)]
    path = write(tmp_path / "t", {"a.tsv": rows, "b.tsv": rows[:20] + ["7\ty\tz"] + rows})
    small_splits(size)
    fields = [("n", "int"), ("x", "string")]
    with pytest.raises(Exception, match=r"line 21 of [^ ]*b.tsv: 3 fields, not 2: 7\ty\tz"):
        lines.scan_numbered(spark, path, fields).collect()
    path = write(tmp_path / "u", {"a.tsv": rows + ["q\tx"]})
    with pytest.raises(Exception, match="line 51 of [^ ]*a.tsv: n is not a int"):
        lines.scan_numbered(spark, path, fields).collect()
    path = write(tmp_path / "v", {"a.tsv": rows})
    assert sorted((r.line_no, r.n) for r in lines.scan_numbered(spark, path, fields).collect()) == [(n + 1, n) for n in range(50)]


def test_readers(spark, tmp_path):
    m = write(tmp_path / "m", {"a": ["5\tp\ts\t1\t4\tx\t0\t77", "6\tp\ts\t2\t3\tx\t0\t78"]})
    got = sorted(tuple(r) for r in tsv.scan_raw_matches(spark, m).collect())
    assert got == [(1, 5, 1, 4, 0, 77), (2, 6, 2, 3, 0, 78)]
    with pytest.raises(Exception, match="line 1 of .*not 8 fields"):
        tsv.scan_raw_matches(spark, write(tmp_path / "n", {"a": ["5\tp"]})).collect()
    e = write(tmp_path / "e", {"a": ["77\t-2\told"], "b": ["77\t-2\tnew"]})
    assert tsv.scan_entities(spark, e).orderBy(F.col("line_no").desc()).first().identifier == "new"
    p = write(tmp_path / "p", {"a": ["a ||| b ||| c", " x ", "", "a|||b", "||| q"]})
    assert [tuple(r) for r in tsv.scan_pairs(spark, p).orderBy("unique_id").collect()] == [
        (0, "a ||| b", "c"), (1, "x", None), (2, "", None), (3, "a|||b", None), (4, "||| q", None)]
    x = write(tmp_path / "x", {"a": ["12\r", "13"]})
    assert {r.doc_id for r in tsv.scan_exclusions(spark, x).collect()} == {"12", "13"}


def test_ordered_files(spark, tmp_path):
    draw = random.Random(2)
    rows = [(draw.choice([float("inf"), float("-inf"), 1e300, 1e-300, 0.1, -0.5, 3.0]), f"n{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "value double, name string").repartition(5)
    path = str(tmp_path / "o")
    lines.write_ordered(df, path, [F.col("value").desc(), F.col("name")], ["value", "name"], 6)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 1
    text = "".join(open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.startswith("part-")).splitlines()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(float(a), b) for a, b in (t.split("\t") for t in text)] == want and text[0].startswith("inf\t")
    got = lines.read_ordered(spark, path, [("value", "double"), ("name", "string")]).orderBy("place").collect()
    assert [(r.value, r.name) for r in got] == want
    lines.write_ordered(df.limit(0), str(tmp_path / "none"), [F.col("value")], ["value"])
    assert lines.read_ordered(spark, str(tmp_path / "none"), [("value", "double")]).collect() == []


def test_decimal_text_is_exact(spark):
    draw = random.Random(8)
    xs = [0.125, 2.675, 0.5, 1.5, 2.5, -0.125, -0.0, 0.0, -1e-9, 1e-320, 0.999995, 0.9999949999, 1e15 + 0.5, 2.0 ** 53, 2.0 ** 62, 2.0 ** 63,
          2.0 ** 80 + 2.0 ** 40, -9.99e36, 123456789.987654321, float("inf"), float("-inf"), 1.005, 0.045, 1e22, 9007199254740993.0]
    xs += [draw.uniform(-1, 1) * 10 ** draw.randint(-8, 12) for _ in range(1500)]
    xs += [draw.randint(-10 ** 6, 10 ** 6) / 2 ** draw.randint(0, 8) for _ in range(1500)]
    xs += [round(draw.uniform(0, 100), 3) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (1, 2, 4, 5, 6):
        got = {r.i: r.t for r in df.select("i", decimal_text("x", digits).alias("t")).collect()}
        for i, x in enumerate(xs):
            assert got[i] == f"{x:.{digits}f}", (x, digits)
    assert f"{Decimal(2.675).quantize(Decimal('0.01'), ROUND_HALF_EVEN)}" == "2.67"
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(decimal_text("x", 3).alias("t")).collect()
    assert [r.t for r in odd] == ["nan", None]
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(1e38,)], "x double").select(decimal_text("x", 2)).collect()


def test_metric_percent(spark):
    cases = {"INFO:tensorflow:  eval_accuracy = 0.87659999": "87.65", "x accuracy = 1.000000": "00.00", "x accuracy = 0.8765": "x accuracy = 0.8765",
             "loss = 0.123456": "loss = 0.123456", "accuracy = 0.98765": "98.76"}
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    assert {r.line: r.p for r in df.select("line", metric_percent("line", "accuracy").alias("p")).collect()} == cases


def test_lemmas(spark):
    parts = spark.createDataFrame([("dogs", "n"), ("running", "v"), ("making", "v"), ("better", "a"), ("xing", "v"), ("running", "v")], "word string, part string")
    lemmas = spark.createDataFrame([("better", "a", "good"), ("dog", "n", "dog"), ("run", "v", "run"), ("make", "v", "make"), ("runn", "v", "runn")],
                                   "word string, part string, lemma string")
    ends = spark.createDataFrame([("s", "n", ""), ("ing", "v", ""), ("ing", "v", "e"), ("ning", "v", "")], "ending string, part string, base string")
    p = spark.createDataFrame([("better dogs running", ), ("making xing dog",), ("",), ("better dogs running",), (None,)], "phrase string")
    got = {r.phrase: r.lemma_phrase for r in ts.lemmatize(p, parts, lemmas, ends).collect()}
    assert got == {"better dogs running": "good dog run", "making xing dog": "make xing dog", "": ""}


def test_layers(spark, tmp_path):
    f = spark.createDataFrame([(0, ["a", "b"]), (1, [])], "unique_id long, tokens array<string>")
    ls = spark.createDataFrame([(0, 1, -2, [[0.1234565, 2.0], [1e-7, 3.0], [9.0, 9.0]]), (0, 0, -1, [[1.0, 1.0]] * 3), (1, 0, -1, [[0.5]])],
                               "unique_id long, place int, index int, vectors array<array<double>>")
    sinks.write_layers(f, ls, str(tmp_path / "j"))
    got = sorted((json.loads(line) for name in os.listdir(tmp_path / "j") if name.startswith("part-") for line in open(tmp_path / "j" / name)),
                 key=lambda r: r["linex_index"])
    assert got[0] == {"linex_index": 0, "features": [
        {"token": "a", "layers": [{"index": -1, "values": [1.0, 1.0]}, {"index": -2, "values": [round(0.1234565, 6), 2.0]}]},
        {"token": "b", "layers": [{"index": -1, "values": [1.0, 1.0]}, {"index": -2, "values": [0.0, 3.0]}]}]}
    assert got[1] == {"linex_index": 1, "features": []}
    with pytest.raises(Exception, match="no results for 1"):
        sinks.write_layers(f, ls.where("unique_id = 0"), str(tmp_path / "k"))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_padded_records(spark, tmp_path, n):
    df = spark.createDataFrame([(k, [k] * 3, f"t{k}") for k in range(n)], "doc_id long, ids array<int>, t string")
    rows = sinks.padded_rows(df, ["doc_id"], 4)
    sinks.write_records(rows, str(tmp_path / "r"), 3)
    got = sorted(tuple(r) for r in spark.read.schema("row_no long, doc_id long, ids array<int>, t string, is_real_example boolean, file int")
                 .parquet(str(tmp_path / "r")).select("row_no", "doc_id", "ids", "t", "is_real_example", "file").collect())
    want = [(k, k, [k] * 3, f"t{k}", True, k % 3) for k in range(n)] + [(k, 0, [0] * 3, "", False, k % 3) for k in range(n, -(-n // 4) * 4)]
    assert got == want
