"""The operators over their whole tables, and their reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import (
    byte_bpe, collocations, conversations, decontaminate, exact_dedup, layout, licences, lm, planes, simhash, toxicity, url_reputation, warc,
)
from larder.llm.common import table
from larder.llm.licences import _apart, covering_rules, known_sentences, path_of
from larder.llm.url_reputation import DEVIATIONS, FLOOR, LEAST_RHO, MOST_RHO, RULES, SUFFIXES


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select(
        "record_id", "url", "warc_type", "outcome", "refers_to", headers.alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.stored(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repairs(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_warc_revisits, op3_byte_bpe, op4_url_reputation, op5_layout, op6_simhash, op7_toxicity,
        op8_token_planes, op9_licences, op10_decontaminate, op11_conversations, op12_collocations,
        op13_log_bilinear,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

_OP1 = r"""
with rows as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
), classes as (
    select body, min(doc_id) as keep_id, count(*) as group_size from rows group by body
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
from rows join classes using (body)
"""

_LONG = ", ".join(f"'{s}'" for s in SUFFIXES)
_FITS = {
    (what, host, path): f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
    for what, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
}
_RHO = (
    "least(greatest(coalesce(sum(pow(k - n * prior, 2) - n * prior * (1 - prior))"
    " / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0),"
    f" {MOST_RHO}), {LEAST_RHO}), {MOST_RHO})"
)
_OP4 = rf"""
with parsed as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from (
        select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
        from pages
    )
), outcomes as (
    select doc_id, min(case when coalesce(quality, 1) > 0 and coalesce(toxic, 0) <= 0 then 1 else 0 end) as good
    from labels where quality is not null or toxic is not null group by doc_id
), counts as (
    select host, count(good) as n, coalesce(sum(good), 0) as k
    from parsed left join outcomes on page_id = doc_id group by host
), cut as (
    select host, n, k, string_split(host, '.') as parts,
        case when regexp_extract(host, '[^.]*\.[^.]*$') in ({_LONG}) then 2 else 1 end as labels
    from counts
), hosts as (
    select host, n, k, array_to_string(parts[-(labels + 1):], '.') as domain, array_to_string(parts[-labels:], '.') as suffix
    from cut
), domains as (
    select domain, suffix, sum(n) as n, sum(k) as k from hosts group by domain, suffix
), tops as (
    select suffix, sum(n) as n, sum(k) as k, (select (sum(k) + 1) / (sum(n) + 2) from hosts) as prior
    from hosts group by suffix
), tops2 as (
    select suffix, (s * prior + k) / (s + n) as mean from tops, (select 1 / {_RHO} - 1 as s from tops)
), domains1 as (
    select domain, n, k, mean as prior from domains join tops2 using (suffix)
), domains2 as (
    select domain, (s * prior + k) / (s + n) as mean from domains1, (select 1 / {_RHO} - 1 as s from domains1)
), hosts1 as (
    select host, n, k, mean as prior from hosts join domains2 using (domain)
), hosts2 as (
    select host, (s * prior + k) / (s + n) as mean, s + n as size from hosts1, (select 1 / {_RHO} - 1 as s from hosts1)
), found as (
    select host, n, k, mean, mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (size + 1)) as bound from hosts2 join hosts using (host)
)
select page_id, host, path, n as n_labelled, k::bigint as n_good, round(mean, 9) as mean, round(bound, 9) as bound,
    case {" ".join(f"when {fit} then '{r[1] + r[2]}'" for r, fit in _FITS.items())} end as rule,
    case {" ".join(f"when {fit} then '{r[0]}'" for r, fit in _FITS.items())}
        when bound < {FLOOR} * (select (sum(k) + 1) / (sum(n) + 2) from hosts) then 'block' else 'allow' end as verdict
from parsed join found using (host)
"""


def _licence_sql() -> str:
    """Known sentences end to end in runs of whole lines, from each line on the longest, and rules in their order.

    Unlike the operator, which scans once by one pattern, this looks up the lines and joins what may follow them.
    """
    rows = ", ".join(f"('{sentence}', '{name}')" for sentence, name in known_sentences().items())
    most = max(len(sentence.split()) for sentence in known_sentences())
    longer, hits = covering_rules(licences.RULES), []
    for licence, rule, names in licences.RULES:
        own, left = path_of(names), "replace(path, '>', '>>')"
        for other in sorted(longer[own], key=len, reverse=True):
            left = f"replace({left}, '{_apart(other)}', '|')"
        hits.append(f"select doc_id, '{licence}' as licence, '{licence}/{rule}' as rule from paths "
                    f"where contains({left}, '{_apart(own)}')")
    return rf"""
with known(sentence, name) as (values {rows}
), bodies as (
    select doc_id, regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\r', chr(10), 'g'),
        '\n[ \t]*(#+|//+|\*+)', chr(10), 'g'), '\n[ \t]*\n[ \t\n]*|[.!?][ \t\n]+|\n[ \t]*(?:[0-9]+[.)]|-)[ \t]') as paragraphs
    from documents
), paragraphs as (
    select doc_id, p, list_filter(list_transform(string_split(paragraphs[p], chr(10)),
        lambda x: trim(regexp_replace(x, '[^a-z0-9.-]+', ' ', 'g'), ' ')), lambda x: x <> '') as l
    from bodies, unnest(range(1, len(paragraphs) + 1)) as u(p)
), starts as (
    select doc_id, p, l, i, ltrim(l[i], ' .-') as line from paragraphs, unnest(range(1, len(l) + 1)) as a(i)
), runs as (
    select doc_id, p, i, j, name from starts join known on left(line, 3) = left(sentence, 3)
        and (starts_with(sentence, line) or rtrim(line, ' .-') = sentence), unnest(range(i, least(len(l), i + {most}) + 1)) as b(j)
    where rtrim(ltrim(array_to_string(l[i:j], ' '), ' .-'), ' .-') = sentence
), longest as (
    select doc_id, p, i, max(j) as j, arg_max(name, j) as name from runs group by doc_id, p, i
), free as (
    select * from longest a where not exists (
        select 1 from longest b where b.doc_id = a.doc_id and b.p = a.p and b.i < a.i and b.j >= a.i)
), joined as (
    select doc_id, count(*) as n_known, string_agg(name || '>', '' order by p, i) as tail from free group by doc_id
), paths as (
    select doc_id, coalesce(n_known, 0) as n_known, '>' || coalesce(tail, '') as path
    from documents left join joined using (doc_id)
), hits as ({" union all ".join(hits)}
), named as (
    select doc_id, string_agg(distinct rule, ',' order by rule) as rules,
        string_agg(distinct licence, ',' order by licence) as licences
    from hits group by doc_id
)
select doc_id, n_known, path, coalesce(rules, '') as rules, coalesce(licences, '') as licences
from paths left join named using (doc_id)
"""


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\??([\s\S]*)$"
_OP2 = rf"""
with cut as (
    select page_id, html, coalesce(html, '') as body, regexp_replace(url, '#[\s\S]*$', '') as whole from pages
), parts as (
    select *, lower(regexp_extract(whole, '{_URL}', 1)) as scheme, lower(regexp_extract(whole, '{_URL}', 2)) as host,
        regexp_extract(whole, '{_URL}', 3) as path,
        list_sort(list_filter(string_split(regexp_extract(whole, '{_URL}', 4), '&'), lambda p: p <> '' and not starts_with(p, 'utm_'))) as args
    from cut
), named as (
    select page_id, html, case when scheme <> '' and host <> '' then scheme || '://' || regexp_replace(host,
            case scheme when 'http' then ':80$' when 'https' then ':443$' else '^$' end, '')
            || case when path = '' then '/' else path end || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end end as url,
        1704067200 + page_id * 3600 as at, 1704067200 + page_id * 3600 + case when page_id % 7 = 0 then -3600 else 180000 end as again,
        '"' || md5(body) || '"' as etag, strftime(make_timestamp((1704067200 + page_id * 3600) * 1000000), '%Y-%m-%d') || 'T00:00:00' as modified,
        strlen(body) as size
    from parts
), latest as (
    select v.page_id, arg_max(r.page_id, (r.at, 'response-' || r.page_id)) as source
    from named v join named r on r.url = v.url and r.at < v.again group by 1
), asked as (
    select v.*, r.page_id as source, r.html as payload, r.etag as stored_tag, r.size as stored_size,
        case when r.page_id is null then 'no_response'
            when case when v.page_id % 3 <> 0 then v.etag = r.etag else v.modified = r.modified end then 'resolved' else 'mismatch' end as outcome
    from named v left join latest l on l.page_id = v.page_id left join named r on r.page_id = l.source
)
select 'response-' || page_id as record_id, url, 'response' as warc_type, 'response' as outcome, null as refers_to,
    array_to_string(['Cache-Control: max-age=60', 'Content-Length: ' || size, 'Content-Type: text/html', 'ETag: ' || etag, 'Last-Modified: ' || modified],
        chr(10)) as headers, sha256(html) as payload_sha256 from named
union all
select 'revisit-' || page_id, url, 'revisit', outcome, 'response-' || source,
    array_to_string(list_filter(case when outcome = 'resolved' then
        ['Age: ' || page_id % 60, 'Content-Length: ' || stored_size, 'Content-Type: text/html',
         'ETag: ' || case when page_id % 3 <> 0 then 'W/' || etag else stored_tag end, 'Last-Modified: ' || modified, 'cache-control: max-age=600']
        else ['Age: ' || page_id % 60, 'Content-Length: 0', case when page_id % 3 <> 0 then 'ETag: W/' || etag end, 'Last-Modified: ' || modified,
         'cache-control: max-age=600'] end, lambda h: h is not null), chr(10)),
    case when outcome = 'resolved' then sha256(payload) end
from asked
"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_OP10 = f"""
with docs as (
    select doc_id, {_WORDS} as w from documents
), items as (
    select coalesce(item_id::varchar, 'null') as name, {_WORDS} as w from benchmark
), windows as (
    select distinct name, s, array_to_string(w[i:i + s - 1], ' ') as gram
    from (select name, w, least(13, len(w)) as s, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)
), grams as (
    select doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') as gram
    from (select doc_id, w, s, unnest(range(1, len(w) - s + 2)) as i from docs, (select distinct s from windows) where len(w) >= s)
), found as (
    select doc_id, i, s, name from grams join windows using (gram, s)
), hits as (
    select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + s)) as p from found) group by 1
), named as (
    select doc_id, count(distinct name) as n_items, string_agg(distinct name, ',' order by name) as names from found group by 1
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from docs left join hits using (doc_id) left join named using (doc_id)
"""



def _crc32(key: str) -> str:
    """The CRC-32 of a string of ASCII characters."""
    octets = f"[4294967295::bigint] || list_transform(string_split({key}, ''), lambda x: ascii(x)::bigint)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: {bits}))"


def _then(state: str, cost: str, edit: str) -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} end"


def _turned(initial: str, state: str) -> str:
    return f"case when initial = '{initial}' then {_then(state, 'x', 'K')} else {_then(state, '1 + x', 'R')} end"


_OP11 = rf"""
with recursive fated as (
    select *, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations
), damaged as (
    select conv_id, turn, case when fate = 4 then 'user' else coalesce(role, ' ') end as role,
        case fate when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
        unnest(case when fate = 3 then [1, 2] else [1] end) as copy
    from fated where fate <> 0
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as initial from damaged
), judged as (
    select *, body = '' as blank, body <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
        lag(initial) over (partition by conv_id order by i) || initial as pair from numbered
), rows as (
    select *, not blank and not duplicate and right(body, 1) not in ('.', '!', '?') as truncated from judged
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
        count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
        count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
    from rows group by conv_id
), best as (
    select conv_id, 0::bigint as j, {{'c': 0::bigint, 'a': ''}} as s0, null::struct(c bigint, a varchar) as s1,
        {{'c': 5::bigint, 'a': 'I'}} as s2, {{'c': 10::bigint, 'a': 'II'}} as s3 from counts
    union all
    select conv_id, j, n0, n1, list_min([m2, {_then("m3", "5", "I")}]), m3 from (
        select *, list_min([n3, {_then("m2", "5", "I")}]) as m3 from (
            select *, list_min([n2, {_then("n0", "5", "I")}, {_then("n1", "5", "I")}, {_then("n3", "5", "I")}]) as m2 from (
                select conv_id, j, {_then("s0", "2", "D")} as n0,
                    case when gone then {_then("s1", "2", "D")}
                        else list_min([{_then("s1", "2", "D")}, case when initial = 's' then {_then("s0", "x", "K")} end]) end as n1,
                    case when gone then {_then("s2", "2", "D")}
                        else list_min([{_then("s2", "2", "D")}, {_turned("u", "s0")}, {_turned("u", "s1")}, {_turned("u", "s3")}]) end as n2,
                    case when gone then {_then("s3", "2", "D")} else list_min([{_then("s3", "2", "D")}, {_turned("a", "s2")}]) end as n3
                from (
                    select b.* exclude (j), b.j + 1 as j, r.initial, r.blank or r.duplicate as gone, case when r.truncated then 5 else 0 end as x
                    from best b join rows r on r.conv_id is not distinct from b.conv_id and r.i = b.j + 1
                )
            )
        )
    )
), chosen as (
    select c.*, list_min([s0, s3]) as won from counts c join best b on b.conv_id is not distinct from c.conv_id and b.j = c.n
), letters as (
    select conv_id, k, won.a[k] as edit, count(*) filter (won.a[k] <> 'I') over w as i, count(*) filter (won.a[k] <> 'D') over w as place,
        len(won.a) - len(replace(won.a, 'D', '')) as gone, len(won.a) as n
    from chosen, unnest(range(1, len(won.a) + 1)) as u(k)
    window w as (partition by conv_id order by k)
), lines as (
    select l.conv_id, place, case when edit = 'K' then role when (n - gone - place) % 2 = 0 then 'assistant' else 'user' end
        || ':' || case when edit = 'I' then '' else text end as line
    from letters l left join rows r on r.conv_id is not distinct from l.conv_id and r.i = l.i where edit <> 'D'
), texts as (
    select conv_id, string_agg(line, chr(10) order by place) as body from lines group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(won.c, 0) as cost, coalesce(won.a, '') as audit,
    sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join chosen c on c.conv_id is not distinct from o.conv_id left join texts t on t.conv_id is not distinct from o.conv_id
"""

_OP12 = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
    from documents
), counts as materialized (
    select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, count(*) as f
    from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from pieces, unnest(range(1, {collocations.LONGEST} + 1)) as s(size) where len(w) >= size)
    group by 1, 2, 3 having size = 1 or count(*) >= {collocations.LEAST}
), totals as (
    select lang, sum(f)::hugeint as n from counts where size = 1 group by lang
), often as materialized (
    select lang, size, string_split(phrase, ' ') as w, phrase, f::hugeint as f from counts where f >= {collocations.LEAST}
), parts as (
    select lang, f, w, size, part, unnest(range(1, size - part + 2)) as i
    from (select lang, f, w, size, unnest(range(2, size)) as part from often where size > 2)
), inner_ as materialized (
    select lang, array_to_string(w[i:i + part - 1], ' ') as phrase, max(f) as most from parts group by 1, 2
), candidates as (
    select o.* from often o left join inner_ i on i.lang = o.lang and i.phrase = o.phrase where size > 1 and (most is null or 100 * most < 100 * f)
), cuts as materialized (
    select lang, phrase, f, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
    from (select *, unnest(range(1, size)) as k from candidates)
), heads as materialized (
    select c.*, o.f as l from cuts c join often o on o.lang = c.lang and o.phrase = c.head
), tails as materialized (
    select c.*, o.f as r from heads c join often o on o.lang = c.lang and o.phrase = c.tail
), lowest as (
    select t.*, n, 1000 * f * n // (l * r) as score from tails t join totals using (lang)
    qualify row_number() over (partition by lang, phrase order by 1000 * f * n // (l * r), k) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from lowest
)
select lang, rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= {collocations.BEST}
"""

ORACLES: dict[str, str] = {"op10_decontaminate": _OP10, "op11_conversations": _OP11, "op12_collocations": _OP12, "op1_exact_dedup": _OP1, "op2_warc_revisits": _OP2, "op4_url_reputation": _OP4, "op9_licences": _licence_sql()}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
