import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import terms, text


def test_collapse_and_strip_know_unicode_space(values):
    given = ["a  b\x1cc ", "　x\x85", "  ", "a\n\tb", None]
    assert values(given, "string", text.collapse_ws) == ["a b c", "x", "", "a b", None]
    assert values(["　x y\x85"], "string", text.strip) == ["x y"]


def test_match_key(values):
    got = values(["Node.js", "nodejs", "CI-CD", "ci/cd", "C++", "C#", "c", " T-SQL "], "string", text.match_key)
    assert got == ["nodejs", "nodejs", "cicd", "cicd", "c++", "c#", "c", "tsql"]


def test_content_hash(spark):
    rows = [
        ("Engineer", "Acme", "Toronto, ON", "Build   things"),
        ("engineer", "ACME", "toronto,  on", "build things"),
        ("engineer", "ACME", "toronto,  on", "build other things"),
        ("engineer", "ACME", None, "x"),
    ]
    df = spark.createDataFrame(rows, "t string, c string, l string, d string")
    got = [r[0] for r in df.select(text.content_hash(*[F.col(x) for x in "tcld"])).collect()]
    assert got[0] == got[1] != got[2]
    assert got[0] == hashlib.sha256("engineer\x1facme\x1ftoronto, on\x1fbuild things".encode()).hexdigest()
    assert got[3] == hashlib.sha256("engineer\x1facme\x1f\x1fx".encode()).hexdigest()


def test_parse_ts(values):
    given = [
        "2026-08-15T00:00:00.0000000", "2025-12-09T10:15:25-05:00", "2026-08-15T01:02:03Z",
        "2026-08-15", "junk", "", None, "12:30", "2026",
    ]
    got = values(given, "string", lambda c: F.date_format(text.parse_ts(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == [
        "2026-08-15 00:00:00", "2025-12-09 15:15:25", "2026-08-15 01:02:03", "2026-08-15 00:00:00",
        None, None, None, None, None,
    ]


def test_epoch_ms(values):
    got = values(["1786394912472", "x", None], "string", lambda c: text.epoch_ms_ts(c).cast("string"))
    assert got == ["2026-08-10 20:48:32.472", None, None]


def test_html_to_text(values):
    given = [
        "<p>Hello <b>world</b></p><ul><li>a</li></ul>",
        "a &amp; b<!-- x -->c&nbsp;d &eacute;&#233;&#xE9; &amp;lt; &#60;b&#62; &AMP; &nosuch; &copyx",
        "<div title=\"a>b\">t</div><script>var t=\"</p>\";</script><style>p{}</style>q<template>z</template>",
        "<a title='x&eacute;&#39;y'>q</a> 1 < 2 &",
        "<!-- never closed <p>x</p>",
        "",
        None,
    ]
    assert values(given, "string", text.html_to_text) == [
        "Hello\nworld\na", "a & b\nc d ééé &lt; <b> & &nosuch; ©x", "t\nq", "q\n1 < 2 &", "", "", "",
    ]
    inline = values(["Senior <strong>Engineer</strong>\n&nbsp;II"], "string", lambda c: text.html_to_text(c, True))
    assert inline == ["Senior Engineer II"]


def test_twice_escaped_markup(values):
    given = [
        "&lt;p&gt;R&amp;amp;D &amp;eacute;&lt;/p&gt;\n&lt;b&gt;x&lt;/b&gt;", "&lt;p&gt;R&amp;D &amp;nbsp; y&lt;/p&gt;",
        "&#60;i&#62;a&#38;lt;b", None,
    ]
    one = values(given, "string", lambda c: text.html_to_text(c, escaped=True))
    assert one == ["R&D é\nx", "R&D   y", "a<b", ""]
    assert one[:3] == values(given[:3], "string", lambda c: text.html_to_text(text.unescape(c)))


def test_main_content_follows_nesting(values):
    nested = (
        '<html><head><title>t</title></head><body><div class="x">no</div>'
        '<div class="a description b"><div>in<div>ner</div></div>' + " long text" * 6 + "</div>after</body></html>"
    )
    short = '<body><div class="description">tiny</div>' + "body words " * 6 + "</body>"
    got = values([nested, short, "<p>short</p>", None], "string", text.main_content)
    assert got[0] == "in\nner\n" + " ".join(["long text"] * 6)
    assert got[1].startswith("tiny\nbody words")
    assert got[2:] == ["", ""]


def test_urls(values):
    urls = ["https://a/b-1234567?x=1", "https://a/b/12345678", "https://a/b-123", "https://a/1234567/x"]
    assert values(urls, "string", text.long_id) == ["1234567", "12345678", None, None]
    assert values(urls[:1], "string", text.strip_query) == ["https://a/b-1234567"]


@pytest.mark.parametrize(
    "name, slugs",
    [
        ("Maple Analytics Inc.", ["mapleanalytics", "maple-analytics"]),
        ("Shopify", ["shopify"]),
        ("Super.com", ["supercom"]),
        ("Acme Ltd..", ["acme"]),
        ("...", []),
        ("", []),
    ],
)
def test_slug_guesses(values, name, slugs):
    assert values([name], "string", text.slug_guesses) == [slugs]


def test_terms(values):
    given = [
        "Python and React Native, CI / CD, c++, C# node.js. Machine\nlearning, scikit-learn go x.java",
        "We use MACHINE LEARNING", "", None, "event-driven, High Availability!", "gopher rusty",
    ]
    assert values(given, "string", terms.extract_terms) == [
        ["c#", "c++", "ci/cd", "go", "machine learning", "node.js", "python", "react", "react native", "scikit-learn"],
        ["machine learning"], [], [], ["event-driven", "high availability"], [],
    ]


def test_terms_read_the_whole_text(values):
    assert values(["filler " * 20000 + "python"], "string", terms.extract_terms) == [["python"]]
    cut = values(["x" * 10 + " python"], "string", lambda c: terms.extract_terms(text.cut(c, 10)))
    assert cut == [[]]


def test_the_python_step_travels_without_this_package(tmp_path):
    """Executors load the function although the package is not installed there."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    for udf in (text._respelled, text._unescaped_respelled):
        (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(udf.func))
        code = "import pickle, pandas as pd; f = pickle.load(open('f.pkl', 'rb')); print(f(pd.Series(['&eacute;'])).iloc[0])"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONIOENCODING": "utf8"})
        assert done.stdout.strip() == "é", done.stderr
