"""Registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, base, chat, exact, jaccard, leaks, lines, lm, packing, pii, quality, resample, substrings, tokens

Query = Callable[[SparkSession, str], DataFrame]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_whole(base.table(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(base.table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(base.table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(base.table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(base.table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(base.table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(base.table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(base.table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(base.table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_rotation": op1_chat_rotation,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_personal_data": op4_personal_data,
        "op5_token_counts": op5_token_counts,
        "op6_quality": op6_quality,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_packing": op8_packing,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_token_alignment": op11_token_alignment,
        "op12_line_dedup": op12_line_dedup,
        "op13_importance_resampling": op13_importance_resampling,
    }


SQL = {
    "op1_chat_rotation": """
        with t as (select distinct conv_id, cast(floor(coalesce(turn, 0) / 256) as bigint) as block, turn,
                          coalesce(replace(role, '<|', '< |'), 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text
                   from conversations),
        s as (select distinct conv_id, block, role as speaker from t where role not in ('system', 'unknown')),
        x as (select t.*, speaker, case when role = speaker then '<|assistant|>' || chr(10) when role = 'system' then '<|system|>' || chr(10)
                     else '<|user name=' || role || '|>' || chr(10) end as head from t join s using (conv_id, block)),
        y as (select *, length(head) as h, length(text) + 8 as b,
                     coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, block, speaker order by turn nulls first, role, text
                              rows between unbounded preceding and 1 preceding), 0) as pos from x)
        select conv_id, block, speaker, count(*) as n_turns, count(*) filter (role = speaker) as n_spoken,
               string_agg(head || text || '<|end|>' || chr(10), '' order by turn nulls first, role, text) as text,
               string_agg(case when role = speaker then concat_ws(':', cast(pos + h as bigint), cast(pos + h + b as bigint)) end, ',' order by turn nulls first, role, text) as mask
        from y group by conv_id, block, speaker""",
    "op2_substring_dedup": """
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
        g as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
        m as (select g, min(doc_id) as lo from g group by g),
        h as (select distinct doc_id, p from (select g.doc_id, unnest(range(i, i + 50)) as p from g join m using (g) where lo < g.doc_id)),
        x as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
        k as (select x.doc_id, count(h.p) as n_removed, string_agg(case when h.p is null then word end, ' ' order by x.p) as kept
              from x left join h using (doc_id, p) group by x.doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join k using (doc_id)""",
    "op3_jaccard_join": f"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w
                             from documents),
        s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
        e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
        r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
        select r.a as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id
        from r left join n on n.doc_id = r.a group by r.a""",
    "op9_exact_dedup": f"""
        with t as (select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op10_decontamination": f"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                          '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                          '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
        bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
               from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
        ks as (select distinct k from bw),
        dw as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as gram
               from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks)),
        m as (select doc_id, i, dw.k, item_id from dw join bw on dw.gram = bw.gram and dw.k = bw.k),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by doc_id),
        s as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
              from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               coalesce(items_sha256, '{_EMPTY_SHA}') as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (doc_id) left join s using (doc_id)""",
    "op12_line_dedup": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents),
        l as (select doc_id, w[i] as line, i, translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key
              from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
        g as (select key, min(doc_id) as lo from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
        k as (select l.doc_id, line, i, g.key is null or lo = l.doc_id as stays from l left join g using (key))
        select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (stays), '')) as kept_sha256
        from k group by doc_id""",
}
