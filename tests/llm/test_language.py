"""The training sample and the evidence of web pages."""

from tidelens.llm import language, registry


def taken(rows, **kwargs):
    seen = {}
    for r in language.sampled(rows, "text", "lang", **kwargs).collect():
        seen.setdefault(r.l, []).append(r.t)
    return seen


def test_the_sample_is_of_distinct_texts(spark):
    rows = [("copy of one text", "en")] * 500 + [(f"other text {i}", "en") for i in range(300)]
    seen = taken(spark.createDataFrame(rows, "text string, lang string"), sample=200)
    assert len(seen["en"]) == 200 == len(set(seen["en"]))


def test_every_label_is_learnt(spark):
    rows = spark.createDataFrame([(f"text of language {i}", f"l{i:02}") for i in range(60)], "text string, lang string")
    assert len(taken(rows)) == 60 and len(language.fit(rows, "text", "lang").languages) == 61


def test_a_late_declaration_is_found(spark):
    page = "<!-- " + "x" * 5000 + " -->" + '<html class="a" lang="de-AT"><body>text</body></html>'
    rows = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
    assert [r[0] for r in rows.select(language.declared_in(rows.html)).collect()] == ["de", None]


def test_op4_is_the_whole_method_over_pages(spark, sf):
    out = registry.op4_language_id(spark, sf)
    assert "page_id" in out.columns and out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
