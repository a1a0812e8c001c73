import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import hooks, text, vectors, vocabulary
from quire.operators.search import Terms


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


BLANKS = "  \x1c\u0085　\t\n \x0b"


def test_white_space_is_unicode(spark):
    texts = [f"{BLANKS}a{BLANKS}b{BLANKS}", "", "  ", "a​b", None]
    assert column(spark, texts, text.collapse) == ["a b", "", "", "a​b", None]
    assert column(spark, [f"{BLANKS}a b{BLANKS}"], text.strip) == ["a b"]


def test_plain_and_word_count(spark):
    pages = ["<p>one <i>two</i></p><br/>three", None, "", "<p></p>"]
    assert column(spark, pages, text.plain) == ["one two three", "", "", ""]
    assert column(spark, pages, text.word_count) == [3, 0, 0, 0]


def test_names(spark):
    names = ["Dumas, Alexandre, 1802-1870", "Homer, 751? BCE-651? BCE", "X, Y [translator]", "1802-1870", "", "Voltaire", "[x]", "A, B, C"]
    assert column(spark, names, text.flipped_name) == ["Alexandre Dumas", "Homer", "Y X", None, None, "Voltaire", None, "B A"]


def test_dates_subjects_positions(spark):
    assert column(spark, ["2008-06-07", "", None, " 1999-12-31 "], text.display_date) == ["June 7, 2008", None, None, "December 31, 1999"]
    with pytest.raises(Exception):
        column(spark, ["7 June"], text.display_date)
    assert column(spark, ["b; a;; b ", "", None], text.subjects) == [["a", "b"], [], []]
    assert column(spark, ["84-12", "84", "a-b", "1-2-3", None], text.position) == [12, None, None, 3, None]


def test_summary_agrees_with_its_sql_on_letters_of_several_capitals(spark, tmp_path):
    import duckdb

    from quire.plans import queries

    firsts = [*queries.CAPITALS, "a", "\u00e9", "\u01c6", "\u03c2", "1", "\U00010428", "i", "\u0131", "\u00ff", "\u00b5"]
    texts = [*(f"\u00a0\u2003{c}x\u0085\u3000y .. " for c in firsts), "\u2028", " . ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.sql(queries.ORACLE_SQL["summary_normalise"]).fetchall()
    found = queries.summary_normalise(spark, str(tmp_path)).collect()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found) and len(found) == len(texts)
    assert docs.where("text like '%\u00dfx%'").select(text.summary(F.col("text"))).first()[0] == "SSx y."


def test_summary_and_descriptors(spark):
    texts = ["aBC  dEF", " x. . ", "", "  ", "Done.", ".", None]
    assert column(spark, texts, text.summary) == ["ABC dEF.", "X.", None, None, "Done.", ".", None]
    assert column(spark, [[" Sad ", "", "EERIE"], None], text.descriptors, "array<string>") == [["sad", "eerie"], None]


def test_uuid5(spark):
    space = uuid.uuid5(uuid.NAMESPACE_DNS, "quire.scenes")
    names = [f"{i}-{i * 7}" for i in range(100)] + ["", "é"]
    assert column(spark, names, lambda c: text.uuid5(c, space)) == [str(uuid.uuid5(space, n)) for n in names]


def test_vectors(spark):
    kind = "array<float>"
    assert column(spark, [[3.0, 4.0], [0.0, 0.0], None], lambda c: vectors.cosine(c, [1, 0]), kind) == [pytest.approx(0.6), None, None]
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.unit, kind) == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert vectors.mixture([[2, 0], [0, 5]], [0.5, 0.5]) == [pytest.approx(0.5**0.5)] * 2


@pytest.mark.parametrize(
    "terms, weights", [([], []), ([[1]], [0.5, 0.5]), ([[1], [1]], [1.5, -0.5]), ([[1], [1]], [0.5, 0.499998])]
)
def test_weights_that_are_refused(terms, weights):
    with pytest.raises(ValueError):
        vectors.shares(len(terms), weights)


def test_directions(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert vectors.mixture([a, b]) == [pytest.approx(0.5**0.5)] * 2
    assert vectors.apart(a, b, 1.0) == [pytest.approx(0.5**0.5), pytest.approx(-(0.5**0.5))]
    with pytest.raises(ValueError):
        vectors.apart(a, a, 1.0)
    assert vectors.shares(2, [0.5, 0.5 + 5e-7]) and vectors.shares(4) == [0.25] * 4
    table = spark.createDataFrame([([2.0, 0.0], [0.0, 5.0])], "a array<float>, b array<float>")
    assert table.select(vectors.mixed([(F.col("a"), 0.5), (F.col("b"), -0.5)]).alias("v")).first().v == [pytest.approx(0.5**0.5), pytest.approx(-(0.5**0.5))]
    embed = lambda texts: [[float(t.count(c)) for c in "ab"] for t in texts]
    for wrong in (Terms(["a"], shunned=["b"]), Terms(["a"], shunned_weights=[1.0]), Terms(["a"], shunned=["a"], shunned_weights=[1.0]), Terms([])):
        with pytest.raises(ValueError):
            wrong.direction(embed)
    assert Terms(["a"], shunned=["b"], shunned_weights=[1.0]).direction(embed) == [pytest.approx(0.5**0.5), pytest.approx(-(0.5**0.5))]


def test_vocabulary():
    assert len(vocabulary.TONES) == len(set(vocabulary.TONES)) == 44


def test_retries():
    assert [round(hooks.temperature(a), 4) for a in (0, 1, 2, 5, 10)] == [0, 0.15, 0.2886, 0.4719, 0.6105]
    assert [hooks.backoff(n) for n in (1, 2, 5, 9)] == [2, 4, 30, 30]
    calls, naps = [], []

    def model(payload, notes, warmth):
        calls.append((len(notes), warmth))
        if len(calls) == 1:
            raise ConnectionError
        return len(calls)

    assert hooks.call(model, "x", lambda p, a: None if a == 4 else "not 4", sleep=naps.append) == 4
    assert [n for n, _ in calls] == [0, 0, 1, 2] and naps == [2]
    with pytest.raises(ValueError):
        hooks.call(lambda *a: 1, "x", lambda p, a: "never", attempts=3)

    def broken(*a):
        raise KeyError("own fault")

    with pytest.raises(KeyError):
        hooks.call(broken, "x")

    class Status(Exception):
        def __init__(self, code):
            self.status_code = code

    assert [hooks.is_transient(Status(c)) for c in (400, 404, 429, 500, 503)] == [False, False, True, True, True]
    assert hooks.is_transient(TimeoutError()) and not hooks.is_transient(ValueError())
