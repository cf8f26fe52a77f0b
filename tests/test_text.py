import pytest
from pyspark.sql import functions as F

from prsignal.functions import text as X
from prsignal.functions.messages import GREETINGS, PHRASES, suggestion_message
from prsignal.operators.issues import issue_facts, overlong_frames


def values(spark, items, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_quotes(spark):
    texts = ['"a"', '""a""', 'a"b', '"', None, '"a']
    assert values(spark, texts, X.strip_quotes) == ["a", '"a"', 'a"b', "", None, "a"]
    assert values(spark, texts, X.strip_quote_runs) == ["a", "a", 'a"b', "", None, "a"]
    assert values(spark, texts, X.drop_quotes) == ["a", "a", "ab", "", None, "a"]


def test_decode_json_text(spark):
    texts = [r'"@@ -1,2 +1,2 @@\n+a \"b\" \\ \u00e9"', '""', "not json", None]
    assert values(spark, texts, X.decode_json_text) == ['@@ -1,2 +1,2 @@\n+a "b" \\ é', "", None, None]
    others = ['"a","b"', "5", "null", '["a"]', '"a"],["b"', '{"a":"b"}', '"a', 'a"', '"a"b"', '"\\x"', "", " "]
    assert values(spark, others, X.decode_json_text) == [None] * len(others)
    long = "x\\n" * 200_000
    assert values(spark, [f' "{long}" '], X.decode_json_text) == ["x\n" * 200_000]


def test_parse_int(spark):
    texts = ["5", "-5", "+5", " 5 ", "5.0", "", "x", None, "2147483647", "2147483648", "٣"]
    assert values(spark, texts, X.parse_int) == [
        5, -5, 5, None, None, None, None, None, 2147483647, None, None,
    ]


@pytest.mark.parametrize(
    "path, extension",
    [
        ("ab.py", "py"),
        ("x/a.py", "py"),
        ("a.py", None),  # the part before the dot needs two characters, folders included
        ("__init__.py", None),
        ("x/__init__.py", None),
        ("ab.PY", "py"),
        ("ab.php5", None),
        ("ab.ipynb", None),
        ("ab.java", None),
        ("ab.go", "go"),
        ("Makefile", None),
        ("ab.py\n", None),
        (None, None),
    ],
)
def test_extension(spark, path, extension):
    assert values(spark, [path], X.extension) == [extension]


def test_basename(spark):
    assert values(spark, ["a/b/c.py", "c.py", "a/", None], X.basename) == ["c.py", "c.py", "", None]


def test_only_spaces(spark):
    texts = ["   ", "\t ", "sss", "", "a b", " x"]
    assert values(spark, texts, X.only_spaces) == [True, True, False, False, False, False]
    compat = values(spark, texts, lambda c: X.only_spaces(c, compat=True))
    assert compat == [False, False, True, False, False, False]


def test_diff_url_and_project(spark):
    assert values(spark, ["https://h/o/r/pull/7.patch"], X.diff_url) == ["https://h/o/r/pull/7.diff"]
    urls = ["https://api.h/repos/o/r/pulls/7", "https://h/o/r/pull/7"]
    assert values(spark, urls, X.project_of) == ["o/r", None]


def facts(spark, body, **options):
    df = spark.createDataFrame([("o/r", body)], "name string, body string")
    return [(r.filename, r.line) for r in issue_facts(df, **options).collect()]


def test_go_stack(spark):
    body = "goroutine 7 [running]:\nmain.Load(0x1)\n   /srv/app/\n   src/load.go:41 +0x1f\nmain.run()\n   /srv/app/\n   src/run.go:18 +0x2a\n"
    assert sorted(facts(spark, body)) == [("load.go", 41), ("run.go", 18)]


def test_java_stack(spark):
    body = "Exception in thread\n  at org.a.Shelf.put(Shelf.java:61)\n  at org.a.Store.save(Store.java:207)\n  at org.a.Run.main(Run.java:33)"
    assert sorted(facts(spark, body)) == [("Run.java", 33), ("Shelf.java", 61), ("Store.java", 207)]


def test_stack_quirks(spark):
    # The blank after a frame belongs to it, so the next frame has none in front.
    assert facts(spark, " a.go:1 b.go:2") == [("a.go", 1)]
    assert facts(spark, "\n a\nb.py:3") == [("a\nb.py", 3)]
    assert facts(spark, r" C:\x\y.pyc:7") == [(r"C:\x\y.pyc", 7)]
    assert facts(spark, " a.rb:1") == []


def test_repeats_and_overlong_frames(spark):
    body = " a.py:1\n at f(a.py:1)\n in\n b.py:99999999999"
    assert facts(spark, body) == [("a.py", 1)]
    assert facts(spark, body, dedupe=False) == [("a.py", 1)] * 2
    df = spark.createDataFrame([("o/r", body)], "name string, body string")
    assert [r.filename for r in overlong_frames(df).collect()] == ["b.py"]


def test_messages(spark):
    keys = [f"c{i}" for i in range(200)]
    got = values(spark, keys, lambda c: suggestion_message(c, "Robin"))
    assert got == values(spark, keys, lambda c: suggestion_message(c, "Robin"))
    allowed = {f"{g} {p.format(name='Robin')}" for g in GREETINGS for p in PHRASES}
    assert set(got) <= allowed and len(set(got)) > 30


def test_bucket_is_the_first_bits_of_md5(spark):
    import hashlib

    keys = ["a", "b", "é"]
    want = [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % 1000 for k in keys]
    assert values(spark, keys, lambda c: X.bucket_of(c, 1000)) == want
