"""Web page sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.sources.literature import page_sections as split_pages
from checks.base import Tables, check


@check(r"""
    WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
    m AS (SELECT page_id, regexp_replace(h, '(?i)<h1([\s>])', chr(1) || '<h1\1', 'g') AS h FROM b),
    s AS (SELECT page_id, string_split(h, chr(1)) AS parts FROM m),
    p AS (SELECT page_id, i - 2 AS pos, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM s)),
    c AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_extract(part, '(?is)^<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
          trim(regexp_replace(regexp_replace(regexp_replace(part, '(?is)^<h1[^>]*>.*?</h1>', ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS passage FROM p)
    SELECT page_id, pos, title, md5(passage) AS passage_md5 FROM c WHERE passage <> ''
""")
def page_sections(t: Tables) -> DataFrame:
    return split_pages(t.text("pages"), level=1).select("page_id", "pos", "title", F.md5("passage").alias("passage_md5"))
