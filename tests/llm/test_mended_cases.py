"""Cases that earlier forms of the training-data operators got wrong: extreme vectors, class names that only hold a word, clashing columns."""

import time

import pytest

import corpus_pipeline
from ledgermill.llm import html_templates, secret_scan, vector_search


def test_cosines_at_any_magnitude(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [0.0, 5e-324]), (4, [-1.7e308, 0.0]), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]),
            (7, [float("nan"), 1.0]), (8, None), (9, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.rank, r.score) for r in vector_search.search(table, table.where("vec_id = 0")).collect()}
    half = 0.7071067811865475
    assert {found[1][0], found[2][0]} == {1, 2} and (found[3][0], found[4][0]) == (3, 4) and len(found) == 4
    assert [found[i][1] for i in (1, 2, 3, 4)] == [pytest.approx(half), pytest.approx(half), 0.0, -1.0]


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><p>Main text</p></div>", "<div class='page no-comments'>Main text</div>", "<section class='login-tutorial'>Main text</section>",
    "<div class='content widget-content'>Main text</div>", "<p class='notice-text'>Main text</p>",
    "<div class='sidebar'>x</div><div class='site-footer'>x</div><div class='cookie-notice'>x</div><div id='comments-area'>x</div><div class='main-menu wide'>x</div><p>Main text</p>",
    "<article><p>Main <select><option>x</option></select>text</p></article>", "<p>Main <button>x</button> text"])
def test_class_words_inside_names(page):
    assert [b[0] for b in html_templates.parse(page)[0]] == ["Main text"]


def test_parsing_is_linear_in_nesting():
    started = time.time()
    for opened in ("<div>", "<font>", "<div><p><b>"):
        assert html_templates.parse(opened * 20_000 + "deep")[0][0][0] == "deep"
    assert time.time() - started < 10


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    extra = ["_size", "_spans", "_base", "_lang_pred", "_lang_score", "_copies", "_host", "_target", "_source_size", "_counted", "row", "_packed", "a.b"]
    folder = str(tmp_path)
    words = [" ".join(f"word{i}x{j}" for j in range(12)) for i in range(40)]
    rows = [(i, words[i] + (" key q8Zk2vX9pLw3RtY7uBn5JmD4sHf6" if i == 3 else ""), "en", "web", 5 if i else None, *[f"{c}{i}" for c in extra]) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([*rows, (90, "  12 ", "en", "web", 3, *extra), (91, words[1], "en", "web", 3, *extra)], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, words[2])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == docs.columns
    found = {r.doc_id: r for r in out.collect()}
    assert set(found) == set(range(40)) - {2} and found[3].text.endswith("[SECRET]")
    assert all(tuple(r)[2:] == rows[i][2:] for i, r in found.items())
    clean = secret_scan.redact(corpus_pipeline._packed(docs, "text"))
    assert clean.columns == ["text", "row"] and clean.count() == 42
