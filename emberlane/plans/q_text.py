"""Queries of the text detection and stance functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stance
from . import views as v
from .views import entry, table, with_views

def _dictionary(spark, d):
    """Frequent upper-case tokens of the documents as symbols, with their lower-case doubles as names."""
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z$])([A-Z]{3,5})(?![A-Za-z])"), F.lit(1)))).alias("w"))
    often = t.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 3")
    return often.select(F.col("w").alias("symbol"), F.concat(F.lower("w"), F.lit(" "), F.lower("w")).alias("name"))


def _named(spark, d):
    """Parts as companies: names with legal forms and places, symbols of two to six letters from their first letters."""
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") % 4).alias("k"))
    form = F.element_at(F.array(F.lit(" Inc."), F.lit(" Corp of America"), F.lit(" Bank & Trust"), F.lit("")), F.col("k").cast("int") + 1)
    named = p.select(F.concat(F.when(F.col("k") == 2, F.element_at(F.split("name", " "), 1)).otherwise(F.col("name")), form).alias("name"), "k").distinct()
    letters = F.regexp_replace("name", "[^A-Za-z]", "")
    return named.select(F.substring(F.upper(letters), F.lit(1), (F.col("k") + 2 + F.length("name") % 3).cast("int")).alias("symbol"), "name")


_STOP = "[" + ", ".join(f"'{w}'" for w in stance.STOP_WORDS) + "]"
_DICTIONARY = f"""with p as (select p_name as name, p_partkey % 4 as k from part),
    n as (select distinct (case when k = 2 then string_split(name, ' ')[1] else name end) || [' Inc.', ' Corp of America', ' Bank & Trust', ''][k + 1] as name, k from p),
    s as (select substring(upper(regexp_replace(name, '[^A-Za-z]', '', 'g')), 1, k + 2 + length(name) % 3) as symbol, name,
          list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z ]', ' ', 'g'), ' +'), lambda x: length(x) >= 3 and not list_contains({_STOP}, x)) as w from n)
    select symbol, 'cashtag' as route, symbol as key from s union select symbol, 'token', symbol from s where regexp_full_match(symbol, '[A-Z]{{3,5}}') and symbol <> 'RING'
    union select symbol, 'word', w[1] from s where len(w) = 1 and length(w[1]) >= 5 and w[1] <> 'widget' union select symbol, 'phrase', w[1] || ' ' || w[2] from s where len(w) >= 2"""


def _compiled(spark, d):
    return stance.compile_dictionary(_dictionary(spark, d), ["THE"], [])


def _routes(spark, d):
    return stance.mention_routes(table(spark, d, "documents"), "doc_id", "text", _compiled(spark, d))


_GUARDED = ["AND", "DER"]
# whole words: letters and digits of any script bound them, where \b knows only ASCII
_words_sql = lambda words: r"regexp_matches(coalesce(text, ''), '(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])')"
_FINANCE, _STRICT = _words_sql(stance.FINANCE_WORDS), _words_sql(stance.STRICT_FINANCE)
# words between marks, so that a pattern takes whole ones only, whatever script stands beside them
_MARKED = r"regexp_replace(lower(text), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g')"
_SIGNALS = "|".join(w.replace("'", "''").replace(" ", r"\x02 \x01") for w in stance.BULL + stance.BEAR)
_SHOUTS = r"(len(regexp_extract_all(coalesce(text, ''), '\p{Lu}')) > 0.7 * len(regexp_extract_all(coalesce(text, ''), '\p{L}')))"


# runs of letters with a dollar sign before them stand in for looking behind
_MENTIONS = r"""with runs as (select doc_id, unnest(regexp_extract_all(text, '\$?[A-Za-z]+')) as w from documents), often as (select w as symbol from (select distinct doc_id, w from runs where regexp_full_match(w, '[A-Z]{3,5}')) group by 1 having count(*) >= 3),
    low as (select doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') as l from documents), r as (
    select distinct doc_id, symbol, 'cashtag' as route from (select doc_id, upper(unnest(regexp_extract_all(text, '\$([A-Za-z]{1,5})\b', 1))) as w from documents) join often on w = symbol
    union all select distinct doc_id, symbol, 'token' from runs join often on w = symbol where symbol <> 'THE'
    union all select doc_id, symbol, 'phrase' from low join often on list_contains(l, lower(symbol)) and contains(array_to_string(l, ' '), lower(symbol) || ' ' || lower(symbol)) where not list_contains(""" + _STOP + """, lower(symbol)))"""


#: Cells of a sample for annotation: name, condition, quota.
_CELLS = [("short", "n_chars < 400", 40), ("long", "n_chars > 6000", 30), ("numbers", "text rlike '[0-9]'", 30), ("german", "lang = 'de'", 20), ("one source", "source = 'src1'", 10)]


QUERIES = {
    "g1_dictionary": entry(lambda s, d: stance.compile_dictionary(_named(s, d), ["RING"], ["widget"]), _DICTIONARY),
    "g2_mentions": entry(lambda s, d: stance.detect_mentions(table(s, d, "documents"), "doc_id", "text", stance.compile_dictionary(_dictionary(s, d), ["THE"], [])), _MENTIONS + " select distinct doc_id, symbol from r"),
    "g3_symbols_light": entry(lambda s, d: stance.detect_light(table(s, d, "documents"), "doc_id", "text", ["THE", "AND", "OF", "DER", "DE"]), """select distinct doc_id, w as symbol from (select doc_id, unnest(regexp_extract_all(text, '\\$?[A-Za-z]+')) as w from documents) where w in ('THE', 'AND', 'OF', 'DER', 'DE')"""),
    "g4_occurrences": entry(lambda s, d: stance.count_occurrences(table(s, d, "part"), "p_partkey", "p_name", s.createDataFrame([("W", "widget"), ("R", "ring"), ("RW", "red widget")], "symbol string, name string")), """select p_partkey, case when p_name like '%red widget%' then 'RW' when p_name like '%widget%' then 'W' else 'R' end as symbol, 1::bigint as n from part where regexp_matches(p_name, '(^| )(widget|ring)( |$)')"""),
    "g5_routes": entry(lambda s, d: _routes(s, d).groupBy("doc_id", "symbol").agg(F.array_join(F.array_sort(F.collect_set("route")), "|").alias("routes")), _MENTIONS + " select doc_id, symbol, string_agg(distinct route, '|' order by route) as routes from r group by 1, 2"),
    "g6_context": entry(lambda s, d: table(s, d, "documents").select("doc_id", *stance.context_gate(F.col("text"))), f"select doc_id, {_FINANCE} as finance, {_SHOUTS} as shouts from documents"),
    "g6_gated_routes": entry(lambda s, d: stance.gated_routes(table(s, d, "documents"), "doc_id", "text", _compiled(s, d), _GUARDED), _MENTIONS + f""", f as (select doc_id, {_FINANCE} as ok from documents), g as (select r.doc_id, symbol, route, ok,
        route = 'token' and symbol in ('AND', 'DER') as guarded from r join f on f.doc_id = r.doc_id) select doc_id, symbol, arg_min(case when guarded then 'token_ctx' when route = 'phrase' then 'name' else route end, case route when 'cashtag' then 0 when 'token' then 1 else 2 end) as route
        from g where not guarded or ok group by 1, 2"""),
    "g6_strict_routes": entry(lambda s, d: stance.strict_routes(table(s, d, "documents"), "doc_id", "text", _compiled(s, d), ["AND"]), _MENTIONS + f""", f as (select doc_id, {_STRICT} and not {_SHOUTS} as ok from documents)
        select r.doc_id, symbol, arg_min(case when route = 'phrase' then 'name' else route end, case route when 'cashtag' then 0 when 'token' then 1 else 2 end) as route from r join f on f.doc_id = r.doc_id where route <> 'token' or ok and symbol <> 'AND' group by 1, 2"""),
    "g7_audit_routes": entry(lambda s, d: _routes(s, d).groupBy("symbol", "route").agg(F.count("*").alias("n")), _MENTIONS + " select symbol, route, count(*) as n from r group by 1, 2"),
    "g8_kwic": entry(lambda s, d: table(s, d, "documents").select("doc_id", stance.kwic(F.col("text"), "token", 40).alias("quote")).filter("quote is not null"), "select doc_id, substring(text, greatest(p - 40, 1), least(p, 41) - 1 + 45) as quote from (select doc_id, text, strpos(lower(text), 'token') as p from documents) where p > 0"),
    "g8_signals": entry(lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(stance.direction_signals(F.col("text")), "|").alias("signals")), f"""select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_MARKED}, '\\x01({_SIGNALS})\\x02', 1), lambda x: replace(replace(x, chr(1), ''), chr(2), '')))), '|'), '') as signals from documents"""),
    "g9_stance": entry(lambda s, d: stance.score_messages(table(s, d, "conversations").select("conv_id", "turn", "text"), "text").groupBy("label").agg(F.count("*").alias("n"))),
    "g10_score_messages": entry(lambda s, d: stance.score_messages(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "label", "p_bull", "p_bear", "p_neutral")),
    "g11_score_long_text": entry(lambda s, d: stance.score_long_text(table(s, d, "documents"), "doc_id", "text")),
    "g12_jaccard": entry(lambda s, d: table(s, d, "conversations").alias("a").join(table(s, d, "conversations").alias("b"), F.expr("a.conv_id = b.conv_id and b.turn = a.turn + 1")).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), stance.jaccard(F.col("a.text"), F.col("b.text")).alias("similarity")),
        """with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) as w from conversations) select a.conv_id, a.turn, case when len(list_distinct(list_concat(a.w, b.w))) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end as similarity from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1""", "similarity"),
    "g13_stratified_sample": entry(lambda s, d: stance.stratified_sample(table(s, d, "documents"), ["lang", "source"], "doc_id", 3).groupBy("lang", "source").agg(F.count("*").alias("n")), "select lang, source, least(count(*), 3) as n from documents group by 1, 2"),
    "g13_capped_capture": entry(lambda s, d: stance.capped_capture(table(s, d, "documents"), ["lang"], "doc_id", 0.5, 100).select("doc_id", "lang")),
    "g13_pick_without_reuse": entry(lambda s, d: stance.pick_without_reuse(table(s, d, "documents"), "doc_id", _CELLS, 150)),
    "g14_manifest": entry(lambda s, d: stance.sample_manifest(table(s, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.25).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("chosen").alias("chosen")), "select lang, count(*) as n, cast(ceil(count(*) * 0.25) as bigint) as chosen from documents group by 1"),
    "g15_split": entry(lambda s, d: stance.sample_manifest(table(s, d, "labels"), ["quality"], "doc_id", 0.9).groupBy("quality").agg(F.count_if("chosen").alias("train"), F.count_if(~F.col("chosen")).alias("valid")), "select quality, cast(ceil(count(*) * 0.9) as bigint) as train, count(*) - cast(ceil(count(*) * 0.9) as bigint) as valid from labels group by 1"),
    "g16_dual_series": entry(lambda s, d: stance.dual_series(v.messages(s, d).withColumn("other", F.when(F.col("p_bull") > F.col("p_bear"), "bull").otherwise("bear")), ["symbol"], "label", "other"), with_views("m", "select symbol, count(*) filter (label = 'bull') as native_bull, count(*) filter (label = 'bear') as native_bear, count(*) filter (p_bull > p_bear) as scored_bull, count(*) filter (p_bull <= p_bear) as scored_bear from m group by 1")),
}
