"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from granary.llm import bpe, decontaminate, embeddings, html, licenses, neardup, pii, quality, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_html": html.op4_html,
    "op5_pii": pii.op5_pii,
    "op6_neardup": neardup.op6_neardup,
    "op7_urls": urls.op7_urls,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_licenses": licenses.op10_licenses,
}

#: Pages of these tables name no canonical address and no refresh, so a verdict is the longest rule's, or else allow.
_OP7 = """
with p as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), rules(verdict, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits as (
  select h.page_id, h.host, h.path, r.rhost || r.rpath as rule, r.verdict,
         row_number() over (partition by h.page_id order by length(r.rhost || r.rpath) desc nulls last) as n
  from h left join rules r on (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where n = 1
"""

#: Every page of these tables marks its article, which is cut off in some, and has the character references named here.
_OP4 = """
with a as (
  select page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '^.*?<article>', '', 's'), '</article>.*$', '', 's'), '<[^>]*$', '', 's') as x from pages
), b as (
  select page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as x from a
), c as (
  select page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) as text from b
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from c
"""

ORACLE_SQL: dict[str, str] = {"op4_html": _OP4, "op7_urls": _OP7, "op10_licenses": licenses.ORACLE_SQL}
