import math
import re
from html import unescape

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlore.functions import text as tx
from runlore.functions import vector as vc
from runlore.functions.html import page_text


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_clean_text_collapses_then_drops_nuls(spark):
    got = values(spark, ["  a\n\n b\t c ", "a \0 b", "a  b\x1cc"], tx.clean_text(F.col("t")))
    assert got == [("a b c",), ("a  b",), ("a b c",)]


def test_clean_text_keep_lines(spark):
    got = values(spark, ["\n# A \t x\r\n\r\nb\0 ", ""], tx.clean_text_keep_lines(F.col("t")))
    assert got == [("# A x\n\nb",), ("",)]


def test_redaction_order_labels_and_idempotence(spark):
    rows = [
        "from 10.0.0.1 to 1.2.3.4.5",
        "api_key = abc123 Token:xyz PASSWORD=p",
        "mail a.b+c@ex-ample.org now",
        "token = me@example.com",
        "nothing here",
    ]
    once = tx.redact(F.col("t"))
    got = values(spark, rows, once, tx.redact(once))
    assert [g[0] for g in got] == [
        "from [REDACTED_IP_ADDRESS] to [REDACTED_IP_ADDRESS].5",
        "[REDACTED_API_KEY] [REDACTED_API_KEY] [REDACTED_API_KEY]",
        "mail [REDACTED_EMAIL] now",
        "[REDACTED_API_KEY]",
        "nothing here",
    ]
    assert all(a == b for a, b in got)


def test_titles_and_headings_need_lines(spark):
    doc = "intro\n# Main title \ntext\n## Two\n#### no\n### Three\n#no"
    lines, flat = tx.clean_text_keep_lines(F.col("t")), tx.clean_text(F.col("t"))
    got = values(spark, [doc, "# all one"], tx.first_heading(lines), tx.headings(lines), tx.first_heading(flat))
    assert got[0] == ("Main title", ["Main title ", "Two", "Three"], None)
    assert got[1][2] == "all one"
    many = "\n".join(f"## h{i}" for i in range(15))
    assert len(values(spark, [many], tx.headings(F.col("t")))[0][0]) == 15


def test_title_from_stem(spark):
    rows = ["db-connection-pool", "k8s_oom", "incident_ticket"]
    assert values(spark, rows, tx.title_from_stem(F.col("t"))) == [(r.replace("-", " ").title(),) for r in rows]


@pytest.mark.parametrize(
    "path, text, kind",
    [
        ("/kb/Post-Mortems/a.md", "x", "post_mortem"),
        ("/kb/runbooks/a.md", "A Retrospective of it", "post_mortem"),
        ("/kb/runbooks/a.md", "x" * 600 + " retrospective", "post_mortem"),
        ("/kb/PlayBook.txt", "x", "runbook"),
        ("/kb/a.md", "x", "documentation"),
    ],
)
def test_classify(spark, path, text, kind):
    assert values(spark, [text], tx.classify(F.lit(path), F.col("t"))) == [(kind,)]


def test_times_fall_back_to_now(spark):
    now = F.timestamp_seconds(F.lit(0))
    rows = ["2024-01-15T10:30:00Z", "2024-01-15T11:30:00+01:00", "soon", None]
    assert [r[0] for r in values(spark, rows, F.unix_seconds(tx.parse_iso(F.col("t"), now)))] == [1705314600, 1705314600, 0, 0]
    rows = ["2024-01-15 10:30:00", "2024-01-15", ""]
    assert [r[0] for r in values(spark, rows, F.unix_seconds(tx.parse_utc(F.col("t"), now)))] == [1705314600, 0, 0]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　ab.é"), max_size=30), min_size=1, max_size=8))
def test_whitespace_is_that_of_unicode(spark, rows):
    got = values(spark, rows, tx.clean_text(F.col("t")), tx.word_count(F.col("t")), tx.words(F.col("t")))
    assert got == [(" ".join(r.split()), len(r.split()), r.split()) for r in rows]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(vc.normalise(F.col("v"))).collect()]
    assert got == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    x = [0.3, -2.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(vc.sigmoid(F.col("x"))).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-v)) for v in x])


def test_page_text():
    html = "<!doctype html><title>T &amp; U</title><style>p{}</style><script>var a='</p>'</script><!-- c --><p> one<b>two</b> three</p><template>x</template>"
    assert page_text(html) == "T & U\none\ntwo\nthree"
    assert page_text("a &lt;b&gt; &#233;") == unescape("a &lt;b&gt; &#233;")
    assert page_text("") == "" and page_text(None) is None
    assert re.search("script", page_text("<p>no script</p>"))
