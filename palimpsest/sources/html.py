"""Raw web pages to titles, plain text and table rows, with expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->"
TAG = r"<[^>]*>"
SPACES = r"[\x20\x09-\x0D]+"


def plain(html):
    """Visible text of an html column: no scripts, styles, comments or tags, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, SPACES, " "))


def title_text(pages: DataFrame) -> DataFrame:
    """page_id, title and text of every page; a null page has neither."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", TITLE, 1), SPACES, " "))
    return pages.select("page_id", title.alias("title"), plain(F.col("html")).alias("text"))


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_no (from 0) and cells (array) of every table row."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return rows.select("page_id", "row_no", F.transform(cells, plain).alias("cells"))
