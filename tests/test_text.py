import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import chapters as C
from lectern.functions import text as T
from lectern.operators import paged
from lectern.operators.chunking import estimate


def test_tokens(one):
    texts = ["", "a b c d e f", "一二三四五六七八", "一" * 999, "hello 世界", None, "a\u00a0b", "  "]
    assert one(T.estimate_tokens, texts) == [0, 8, 5, 666, 2, None, 2, 0]
    assert [estimate(t) for t in texts if t is not None] == [0, 8, 5, 666, 2, 2, 0]


def test_sanitize(one):
    texts = ["a\u200bb", "x\u202ey", "t\U000e0041g", "plain", "שלום", None, ""]
    assert one(T.sanitize, texts) == ["ab", "xy", "tg", "plain", "שלום", None, ""]
    assert one(T.invisible_count, texts) == [1, 1, 1, 0, 0, None, 0]
    assert one(lambda c: T.sanitize(T.sanitize(c)), texts) == one(T.sanitize, texts)


def test_page_number(one):
    assert one(T.is_page_number, ["12", " iv ", "xcix", "mix", "civil", "12345", "", "IIII", "\u00a07"]) == [True, True, True, False, False, False, False, False, True]


def test_dehyphenate(one):
    assert one(T.dehyphenate, ["wri-\ntten", "é-\nà", "a - \nb", "x-\n\ny"]) == ["written", "éà", "a - \nb", "x-\n\ny"]


def test_fingerprint(one):
    assert one(lambda c: T.fingerprint(c), ["", "a", "b", None]) == ["cbf29ce484222325", "af63dc4c8601ec8c", "af63df4c8601f1a5", None]


def test_slug_and_lines(one):
    assert one(T.slug, ["Hello, World!", "--a--", "é", "x" * 70, "a" * 63 + " b"]) == ["hello-world", "a", "", "x" * 64, "a" * 63 + "-"]
    assert one(T.one_line, ["a\n  b", "w " * 100])[0] == "a b"
    assert len(one(T.one_line, ["w " * 100])[0]) == 160
    assert one(T.lines, ["a\r\nb\n", "", "\n", "a\n\n"]) == [["a", "b"], [], [""], ["a", ""]]


def test_small_functions(one):
    assert one(T.unquote, ['"a"', "'b'", '"', "c", '"d\'']) == ["a", "b", '"', "c", '"d\'']
    assert [tuple(x) for x in one(lambda c: T.read_slice(c, 1, 2), ["abcd", "ab"])] == [("bc", 4, 3), ("b", 2, None)]
    assert one(lambda c: T.lossy(c), [b"\xef\xbb\xbfa\xff", None], "binary") == ["a\ufffd", None]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_kernel_is_stable(t):
    assert T.fnv1a(t.encode("utf-8", "surrogatepass")) == T.fnv1a(t.encode("utf-8", "surrogatepass")) < 1 << 64


def test_paged(spark):
    head = "Some Title"
    pages = [f"{head}\nbody {i} wri-\ntten\n{i}" for i in range(1, 5)]
    rows = [(1, "\f".join(pages)), (2, "one\ftwo"), (3, None), (4, ""), (5, "a\npq\fa\nqr\fa\nrs\fb")]
    out = dict(paged.clean_paged_text(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert out[1] == "\n".join(f"body {i} written" for i in range(1, 5))
    assert out[2] == "one\ntwo" and out[3] is None and out[4] == ""
    assert out[5] == "pq\nqr\nrs\nb"
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert paged.clean_paged_text(empty).count() == 0


def test_append_layout(spark):
    rows = spark.createDataFrame([("m", 3, "a  b"), ("m", 3, None), ("m", 3, " \n"), (None, 1, "x")], "m string, n int, l string")
    got = [r[0] for r in rows.select(paged.append_layout(F.col("m"), F.col("n"), F.col("l"))).collect()]
    assert got == ["m\n\n[page 3, as laid out]\n\na  b", "m", "m", "\n\n[page 1, as laid out]\n\nx"]


@pytest.mark.parametrize(
    ("tables", "columns", "pages", "want"),
    [([3], [1, 2], 8, [1, 2, 3]), ([], [1, 2, 3], 4, []), ([2], [1, 2], 4, [1, 2]), (None, None, None, []), ([5], [1], 0, [1, 5])],
)
def test_pages_to_supplement(spark, tables, columns, pages, want):
    row = spark.createDataFrame([(tables, columns, pages)], "t array<int>, c array<int>, n int")
    assert row.select(paged.pages_to_supplement(F.col("t"), F.col("c"), F.col("n"))).first()[0] == want


def test_chapters(one):
    lines = [
        "Chapter 5", "CAPÍTULO 7: Los ríos", "Kapitel 3 Überblick", "Chapter 6 explores this", "Chapter 2025.", "IV: The Sea", "vi: the editor", "## vi: the editor",
        "第三章 河", "第十二节", "## 一 · 缘起", "第１２回", "บทที่ ๑๒", "제4장 근로", "제5장에서 보듯", "## Chapter 9", "== Chapter 10", "Chapter " + "x" * 90, "", "XLII. Sea", "IIII: No", "第百二十章",
    ]
    assert one(C.chapter_number, lines) == [5, 7, 3, None, None, 4, None, 6, 3, 12, 1, 12, 12, 4, None, 9, 10, None, None, 42, None, 120]


def test_structure(one):
    text = "# Book\n\n## One\n\n```\n# not\n```\n## Two\n## two\n\nThree\n-----\n"
    assert C.count_titles(C.structural_titles(text)) == 3
    got = one(C.structure, [text, "Chapter 1\nx\nChapter 1\nChapter 2\nContents", "", "plain"])
    assert [g["chapters"] for g in got] == [3, 2, 0, 0]
    assert got[1]["sample"] == ["Chapter 1", "Chapter 1", "Chapter 2"] and got[1]["has_toc"] and not got[0]["has_toc"]
    assert one(C.has_toc, ["目 录", "the contents of this", " Inhaltsverzeichnis \nx"]) == [True, False, True]
