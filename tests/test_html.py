from __future__ import annotations

import pytest

from weftline.sources.html import extract, extract_html, html_files

CASES = [
    ("<html><body><article>a</article><main>m</main></body></html>", "m"),
    ('<body><main>m</main><div class="x item-page">d</div></body>', "d"),
    ('<body><div class="NavBox">a</div><p>b</p></body>', "b"),
    ('<body class="has-sidebar"><p>x</p></body>', ""),
    ("<body><p>a <b>b</b> c</p></body>", "a\nb\nc"),
    ("<p>one<p>two<br>three", "one\ntwo\nthree"),
    ("<body><script>var a='</p>'</script><style>p{}</style>x &amp; y &lt;z&gt;</body>", "x & y <z>"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<body><!-- c -->t<header>h</header></body>", "t"),
    ("<body><div>a<div class='subheader'>b</div>c</div></body>", "a\nc"),
    ("", ""), (None, ""), ("plain", "plain"),
    ("<body><p>a\n\n\n\nb</p></body>", "a\n\nb"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_extract(html, text):
    assert extract(html) == text


def test_bytes_and_column(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<body><main>嵐湖</main></body>".encode())
    df = html_files(spark, str(tmp_path))
    assert [r[0] for r in df.select(extract_html(df.html)).collect()] == ["嵐湖"]
    assert extract("<meta charset=big5><p>中文</p>".encode("big5")) == "中文"
