"""What pages with rare tags and cut-off tags keep."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.html_text import blocks, extract


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>E = <math>mc<sup>2</sup></math> two</p>", ["E = mc2 two"]),
        ("<p>one</p><noscript><p>three</p></noscript><p>four</p>", ["one", "three", "four"]),
        ("<p>a <object data='x'>five</object> b</p>", ["a five b"]),
        ("<div><p>one <svg><text>six</p><p>seven</p></div><p>eight</p>", ["one", "six", "seven", "eight"]),
        ("<p>one</p><iframe><p>in</p></iframe><xmp>raw</xmp><canvas>drawn</canvas>", ["one", "in", "raw", "drawn"]),
        ("<template><p>t</p></template><noframes>n</noframes>", ["t", "n"]),
        ("<p>one</p><textarea><p>typed</p></textarea><p>two</p>", ["one", "two"]),
        ("<p>one</p><textarea>typed<p>two</p>", ["one", "typed", "two"]),
        ("<p>one</p><script>if (a < b) c()</script><style>p{}</style><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>never ended <p>two</p>", ["one"]),
        ("<p>one</p><script/><p>two</p>", ["one", "two"]),
        ("<p>a<object>b<p>c</p>d", ["ab", "c", "d"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_article_with_a_formula(spark):
    sentence = "The measured value agrees with what was expected, and no other cause was found in the samples."
    article = f"<article><h1>A long report of values</h1><p>{sentence} Here <math>x<sub>1</sub></math> holds.</p><noscript><p>{sentence}</p></noscript><p>{sentence} <object>plain</object></p></article>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Other</a></li></ul></nav>{article}<footer>&copy; 2024 Someone</footer></body></html>"
    frame = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page)], "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit("x").alias("n_chars"))
    got = extract(frame).collect()
    want = f"A long report of values {sentence} Here x1 holds. {sentence} {sentence} plain"
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)])
