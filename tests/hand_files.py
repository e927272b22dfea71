"""Cases by hand: names, answers, posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hand_pages import query
from lectern.functions import text as tx
from lectern.functions import urls
from lectern.operators import chunking
from lectern.plans import rows

# names, answers, posts --------------------------------------------------------------------------------------------------

_BODY = "제목\n작성자\n홍\n조회\n5\n작성일\n2025.01.05\n본문 내용이 여기에 있습니다\n\n[표 데이터 시작]칸[표 데이터 끝]\n이전글 무엇\n뒤"
_SHORT = "목록 " + "x" * 60


@query(rows("id int, clean string", [(1, "2025.01.05\n본문 내용이 여기에 있습니다\n칸"), (2, _SHORT), (3, "a\nb"), (4, ""), (5, "작성자\nx")]))
def cleaned_posts(spark, d) -> DataFrame:
    """Posts without head and tail; a short rest of a long text gives the text back."""
    df = spark.createDataFrame([(1, _BODY), (2, _SHORT), (3, "a\r\n\r\nb \n목록으로"), (4, None), (5, "작성자\nx\n다음글")], "id int, t string")
    return df.select("id", tx.clean_post("t").alias("clean"))


@query(rows("id int, base string, same boolean, header string, title string, redacted string, html string", [(1, "Guide", True, "title: Guide.pdf_chunk12\n\nbody", "x", "mail [이메일 확인: 원문 참조]!", "a b"), (2, "plain name", False, "title: plain name\n\nbody", None, "none", "t"), (3, None, False, "\nbody", None, None, None)]))
def document_names(spark, d) -> DataFrame:
    """Names of documents, headers of chunks, fenced answers, redacted and plain texts."""
    df = spark.createDataFrame([(1, "Guide.pdf_chunk12", "Guide.pdf_chunk1", '```json\n{"title": "x"}\n```', "mail a.b@c.org!", "<p>a<script>no</script></p>\n<b>b</b>"), (2, "plain name", "other", "no json", "none", "t"), (3, None, None, None, None, None)], "id int, a string, b string, j string, m string, h string")
    return df.select("id", tx.base_document_name("a").alias("base"), F.coalesce(tx.same_document("a", "b"), F.lit(False)).alias("same"), chunking.with_header(F.lit("body"), {"title": F.col("a")}).alias("header"), tx.parse_fenced_json("j", "title string")["title"].alias("title"), tx.redact_emails("m").alias("redacted"), tx.html_to_text("h").alias("html"))


@query(rows("url string, uuid string", [("http://h/", "d17977ad-b400-53b5-b614-e2e1279af39a"), ("https://www.site.ac.kr/b?x=1", "0024e480-b24d-5ad2-8b27-4dd50dd67b71")]))
def url_ids(spark, d) -> DataFrame:
    """Version 5 UUIDs of addresses."""
    return spark.createDataFrame([("http://h/",), ("https://www.site.ac.kr/b?x=1",)], "url string").select("url", urls.uuid5("url").alias("uuid"))
