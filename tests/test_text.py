import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import checks, text
from lexigrove.functions.stemming import english_stem
from lexigrove.sources import documents as source


@pytest.mark.parametrize(
    ("term", "stem"),
    [
        ("running", "run"), ("quickly", "quick"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"),
        ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("generously", "generous"), ("happy", "happi"), ("relational", "relat"),
        ("adjustment", "adjust"), ("skies", "sky"), ("news", "news"), ("is", "is"), ("by", "by"), ("boys", "boy"), ("nationalization", "nation"),
    ],
)
def test_stems(term, stem):
    assert english_stem(term) == stem


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_words(spark):
    assert one(spark, text.words(F.lower("t")), "Hello world! It's 3.14, e-mail") == ["hello", "world", "it's", "3.14", "e", "mail"]
    assert one(spark, text.words(F.col("t"))) == []
    assert one(spark, text.words(F.col("t")), "漢字かな カタカナ x漢y a.b 1,5") == ["漢", "字", "か", "な", "カタカナ", "x", "漢", "y", "a.b", "1,5"]
    assert one(spark, text.words(text.normal(F.col("t"), nfc=True)), "Café") == ["café"]


def test_stop_words_and_positions(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "doc_id long, body string")
    rows = text.tokens(docs, ["body"], stop_words=["the"]).orderBy("pos").collect()
    assert [(r["term"], r["pos"]) for r in rows] == [("quick", 1), ("brown", 2), ("fox", 3)]


def test_array_text(spark):
    df = spark.createDataFrame([(["a", None, "b"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(text.array_text(F.col("x"))).collect()] == ["a  b", ""]


def test_clean_up(spark):
    assert one(spark, text.without_controls(F.col("t")), "a\x01b   c\n") == "ab c\n"
    assert one(spark, text.trimmed(F.col("t")), " \x02a b\t") == "a b"


def test_highlight_keeps_the_text(spark):
    mark = text.highlighted(F.col("t"), ["quick", "c++"])
    assert one(spark, mark, "The Quick, quicker (c++) fox") == "The <em>Quick</em>, quicker (<em>c++</em>) fox"
    assert one(spark, text.highlighted(F.col("t"), []), "x") == "x"
    assert one(spark, text.cropped(F.col("t"), 5), "abcdefghij") == "abcde…"


def test_readable_bytes(spark):
    df = spark.createDataFrame([(5,), (2048,), (3 * 1024**3,)], "n long")
    assert [r[0] for r in df.select(text.readable_bytes(F.col("n"))).collect()] == ["5 B", "2.00 KB", "3.00 GB"]


def test_csv_and_json(spark):
    df = spark.createDataFrame([(1, 'a "b", c', [1, 2]), (2, None, None)], "i int, s string, a array<int>")
    assert [r[0] for r in source.as_csv(df).collect()] == ['1,"a ""b"", c","[1,2]"', "2,,"]
    assert [r[0] for r in source.as_json(df.select("i", "s")).collect()][1] == '{"i":2,"s":null}'


def test_json_lines_without_objects_are_left_out(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n[1]\n5\n{"a": 2}\n')
    assert sorted(r["a"] for r in source.read_json(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_text_of_nested_values(spark):
    schema = "x struct<b: string, a: array<array<int>>, c: map<string, boolean>>, y array<string>"
    df = spark.createDataFrame([((("q"), [[1, 2], None, [3]], {"z": True, "k": None}), ["a", None, "b"]), (None, None)], schema)
    of = lambda c, sep: [r[0] for r in df.select(text.as_text(F.col(c), sep, df.schema[c].dataType)).collect()]
    assert of("x", "-") == ["1-2--3-q--true", ""] and of("y", " ") == ["a  b", ""]


def test_original_forms_and_places(spark):
    value = "  The QUICK, brown\nfoxes! é "
    docs = spark.createDataFrame([(1, value), (1, value), (2, None), (3, "")], "doc_id long, body string")
    rows = text.analysed(docs, ["body"], stop_words=["the"], stem=True).where("doc_id = 1").orderBy("pos").collect()
    assert [(r["pos"], r["term"], r["original"]) for r in rows[::2]] == [(1, "quick", "QUICK"), (2, "brown", "brown"), (3, "fox", "foxes"), (4, "é", "é")]
    assert all(value[r["start"] : r["end"]] == r["original"] for r in rows) and len(rows) == 8


def test_durations(spark):
    texts = ["250ms", "1.5h", "2", " 3d ", "5us", "7µs", "x", "", "4 s", "-1s", ".5m", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(text.duration_seconds(F.col("t"))).collect()]
    assert got == [0.25, 5400.0, 2.0, 259200.0, pytest.approx(5e-6), pytest.approx(7e-6), None, None, None, None, 30.0, None]


def test_checks(spark):
    names = ["a-b_1", "stats", "a b", "", None, "x" * 513, "f.g"]
    df = spark.createDataFrame([(t,) for t in names], "t string").coalesce(1)
    of = lambda f: [r[0] for r in df.select(f(F.col("t"))).collect()]
    assert of(checks.collection_name) == [True, False, False, False, False, False, False]
    assert of(checks.field_name) == [False, True, False, False, False, False, True]
    assert of(checks.key_text) == [True, True, True, False, False, False, True]
    assert of(checks.query_text) == [True, True, True, True, False, True, True]
    with pytest.raises(TypeError):
        checks.as_key("t", T.BooleanType())


def test_page_as_json(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert source.page_as_json(df, "i").first()[0] == '[{"i":1,"s":"x"},{"i":2,"s":null}]'


def test_only_texts_with_marks_reach_python(spark):
    texts = [("caf\u00e9",), ("cafe\u0301",), ("plain",), (None,), ("",), ("n\u0303o \u00e5",)]
    rows = spark.createDataFrame(texts, "text string")
    found = rows.select(text.composed(F.col("text")).alias("t"))
    assert [r["t"] for r in found.collect()] == ["caf\u00e9", "caf\u00e9", "plain", None, "", "\u00f1o \u00e5"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    given = next(line for line in plan.splitlines() if "_composed(" in line)
    assert "_composed(CASE WHEN RLIKE(" in given or "_composed(text" not in given
