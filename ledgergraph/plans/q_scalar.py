"""Scalar functions applied to the driver tables (SC3-SC19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialog as DL
from ..operators import evaluate as EV
from ..sources import ontology as O
from ..sources import reference_values as RV
from ..sources.fixtures import sql_with
from .registry import query


@query("date_to_quarter", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, "
       "CAST(quarter(o_orderdate) AS INTEGER) AS qtr FROM orders")
def date_to_quarter(t):
    """SC8/Q12: calendar quarter of a date (built-in, no fixed-range table)."""
    o = t.orders
    return o.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("order_date"),
                    F.quarter("o_orderdate").cast("int").alias("qtr"))


def phrase_rows() -> list[tuple[int, str]]:
    """Time phrases exercised by the resolver: every lexicon word with its unit, plus edge cases."""
    out = [f"{w} year" for w, _ in RV.LEXICON_YEAR] + [f"{w} quarter" for w, _ in RV.LEXICON_QUARTER]
    out += ["this year", "this quarter", "the 4th quarter", "sometime soon"]
    return list(enumerate(out))


def _phrase_sql() -> str:
    return O.values_sql(phrase_rows(), ["idx", "phrase"], ["INTEGER", "VARCHAR"])


def _unit_words(kind: str) -> list[tuple[str, str]]:
    words = RV.LEXICON_YEAR if kind == "year" else RV.LEXICON_QUARTER
    return list(words) + list(RV.EXTRA_TIME_WORDS)


def _lexicon_unit_sql(kind: str) -> str:
    return O.values_sql(_unit_words(kind), ["word", "word_desc"], ["VARCHAR", "VARCHAR"])


def time_phrase_table(spark):
    """(idx, phrase, year_desc, quarter_desc): phrases with their first word looked up per unit."""
    p = spark.createDataFrame(phrase_rows(), "idx int, phrase string")
    yl = spark.createDataFrame(_unit_words("year"), "word string, year_desc string")
    ql = spark.createDataFrame(_unit_words("quarter"), "word string, quarter_desc string")
    p = p.withColumn("word", F.split("phrase", " ").getItem(0))
    return p.join(F.broadcast(yl), "word", "left").join(F.broadcast(ql), "word", "left").drop("word")


def _ordinal_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{w}' THEN {q}" for q, w in RV.QUARTER_ORDINALS) + " ELSE 4 END"


_UNSPEC = ", ".join(f"'{w}'" for w in RV.UNSPECIFIC_QUARTER_WORDS)


def time_resolve_sql(src: str, phrase: str, as_of: str, ydesc: str, qdesc: str, availability: str = "reference") -> str:
    """SQL twin of :func:`ledgergraph.operators.dialog.resolve_time` (oracle only)."""
    return f"""
SELECT *, CASE WHEN error IS NULL THEN CASE WHEN dropy THEN ref_year - 1 ELSE ref_year END END AS year,
       CASE WHEN error IS NULL THEN ref_q END AS quarter,
       CASE WHEN error IS NULL AND dropy THEN printf('{DL.NOT_YET}', ref_year - 1, ref_year, y) END AS warning
FROM (
  SELECT *, {f"(chk AND month({as_of}) <> 3)" if availability == "reference" else "FALSE"} AS dropy FROM (
    SELECT *,
      CASE WHEN {phrase} IS NULL THEN y
           WHEN has_year THEN CASE WHEN {ydesc} = 'PAST' THEN y - 1 WHEN {ydesc} = 'FUTURE' THEN y + 1 ELSE y END
           WHEN has_quarter AND NOT unspec THEN CASE WHEN {qdesc} = 'PAST' THEN CASE WHEN q = 1 THEN y - 1 ELSE y END
                                                     WHEN {qdesc} = 'FUTURE' THEN CASE WHEN q = 4 THEN y + 1 ELSE y END
                                                     ELSE y END END AS ref_year,
      CASE WHEN {phrase} IS NULL THEN NULL WHEN has_year THEN 4
           WHEN has_quarter AND NOT unspec THEN CASE WHEN {qdesc} = 'PAST' THEN CASE WHEN q = 1 THEN 4 ELSE q - 1 END
                                                     WHEN {qdesc} = 'FUTURE' THEN CASE WHEN q = 4 THEN 1 ELSE q + 1 END
                                                     ELSE {_ordinal_sql('k')} END END AS ref_q,
      ({phrase} IS NOT NULL AND ((has_year AND COALESCE({ydesc}, '') <> 'FUTURE')
        OR (NOT has_year AND has_quarter AND NOT unspec AND {qdesc} = 'PAST' AND q = 1))) AS chk,
      CASE WHEN {phrase} IS NULL THEN NULL WHEN has_year THEN NULL
           WHEN has_quarter AND unspec THEN '{DL.NEEDS_ORDINAL}'
           WHEN has_quarter THEN NULL ELSE '{DL.NO_TIME}' END AS error
    FROM (
      SELECT *, CAST(year({as_of}) AS INTEGER) AS y, CAST(quarter({as_of}) AS INTEGER) AS q,
             split_part({phrase}, ' ', 1) AS k, strpos({phrase}, 'year') > 0 AS has_year,
             strpos({phrase}, 'quarter') > 0 AS has_quarter,
             split_part({phrase}, ' ', 1) IN ({_UNSPEC}) AS unspec
      FROM {src}) a) b) c"""


_NPH = len(phrase_rows())


def _resolve_sql(availability):
    return f"""
WITH ph AS ({_phrase_sql()}), yl AS ({_lexicon_unit_sql('year')}), ql AS ({_lexicon_unit_sql('quarter')}),
src AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS as_of, ph.phrase, yl.word_desc AS year_desc, ql.word_desc AS quarter_desc
  FROM orders o JOIN ph ON ph.idx = o.o_orderkey % {_NPH}
  LEFT JOIN yl ON yl.word = split_part(ph.phrase, ' ', 1)
  LEFT JOIN ql ON ql.word = split_part(ph.phrase, ' ', 1))
SELECT o_orderkey, CAST(as_of AS VARCHAR) AS as_of, phrase, year, quarter, error, warning FROM ({time_resolve_sql('src', 'phrase', 'as_of', 'year_desc', 'quarter_desc', availability)}) r"""


def _resolve(t, availability):
    ph = time_phrase_table(t.spark)
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("as_of"),
                        (F.col("o_orderkey") % _NPH).cast("int").alias("idx"))
    j = DL.resolve_time(o.join(F.broadcast(ph), "idx"), "phrase", "as_of", "year_desc", "quarter_desc", availability)
    return j.select("o_orderkey", F.col("as_of").cast("string").alias("as_of"), "phrase", F.col("t_year").alias("year"),
                    F.col("t_quarter").alias("quarter"), F.col("t_error").alias("error"), F.col("t_warning").alias("warning"))


@query("time_phrase_resolve", _resolve_sql("reference"))
def time_phrase_resolve(t):
    """SC9-SC11/SC17, JN7: relative time phrase -> (year, quarter, error, warning) with each order date as 'today'."""
    return _resolve(t, "reference")


@query("time_phrase_resolve_intended", _resolve_sql("intended"))
def time_phrase_resolve_intended(t):
    """SC11/Q9: the same where a year once asked for is never taken back for want of a report (availability='intended')."""
    return _resolve(t, "intended")


@query("report_availability", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) BETWEEN make_date(CAST(year(o_orderdate) AS INTEGER), 3, 1)
       AND make_date(CAST(year(o_orderdate) AS INTEGER), 3, 31) AS annual_report_out FROM orders""")
def report_availability(t):
    """SC11: is the annual report out on this date (1–31 March window)."""
    d = F.to_date("o_orderdate")
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", d.between(F.make_date(y, F.lit(3), F.lit(1)),
                                                   F.make_date(y, F.lit(3), F.lit(31))).alias("annual_report_out"))


_WORDS_SQL = O.values_sql([(i, w, d) for i, (w, d) in enumerate(RV.LEXICON_WORDS)], ["idx", "word", "word_desc"],
                          ["INTEGER", "VARCHAR", "VARCHAR"])
_NW = len(RV.LEXICON_WORDS)


@query("percent_to_factor", f"""
WITH w AS ({_WORDS_SQL})
SELECT l.l_orderkey, l.l_linenumber, w.word AS apply_word,
       CAST(CAST(ROUND(l.l_discount * 100) AS BIGINT) AS VARCHAR) || ' percent' AS percent,
       ROUND(1.0 + CASE w.word_desc WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 END
             * CAST(ROUND(l.l_discount * 100) AS BIGINT) / 100.0, 6) AS factor
FROM lineitem l JOIN w ON w.idx = (l.l_orderkey + l.l_linenumber) % {_NW}""")
def percent_to_factor(t):
    """SC12: UP/DOWN word + 'n percent' -> factor 1 ± n/100."""
    words = t.spark.createDataFrame([(i, w, d) for i, (w, d) in enumerate(RV.LEXICON_WORDS)],
                                    "idx int, word string, word_desc string")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount",
                           ((F.col("l_orderkey") + F.col("l_linenumber")) % _NW).cast("int").alias("idx"))
    j = li.join(F.broadcast(words), "idx")
    pct = F.concat(F.round(F.col("l_discount") * 100).cast("bigint").cast("string"), F.lit(" percent"))
    j = j.withColumn("percent", pct)
    return j.select("l_orderkey", "l_linenumber", F.col("word").alias("apply_word"), "percent",
                    F.round(DL.percent_to_factor(F.col("word_desc"), F.col("percent")), 6).alias("factor"))


@query("scale_roundtrip", sql_with(["fin_nation_fact"], """
SELECT code, bsns_year, quarter, account, value / 1e13 AS scaled, CAST(trunc(value / 1e13 * 1e13) AS BIGINT) AS restored
FROM fin_nation_fact"""))
def scale_roundtrip(t):
    """SC13/UD1: scale by 1e13 and back, truncating to int64 (scalers are Column -> Column functions)."""
    from ..operators.series import scale, inv_scale
    f = t.fin_nation_fact
    return f.select("code", "bsns_year", "quarter", "account", scale(F.col("value")).alias("scaled"),
                    inv_scale(scale(F.col("value"))).alias("restored"))


@query("udf_scaler", sql_with(["fin_nation_fact"], """
SELECT code, bsns_year, quarter, account, CAST(trunc((value / 1e13) * 2.0 * 1e13) AS BIGINT) AS doubled
FROM fin_nation_fact"""))
def udf_scaler(t):
    """UD1: user-supplied scaler/inverse pair around a model, given as native Column functions (no Python UDF)."""
    from ..operators.series import apply_scaled
    f = t.fin_nation_fact
    return f.select("code", "bsns_year", "quarter", "account",
                    apply_scaled(F.col("value"), lambda x: x * F.lit(2.0)).alias("doubled"))


@query("format_thousands", sql_with(["fin_fact"],
       "SELECT code, bsns_year, quarter, account, format('{:,}', value) AS value_text FROM fin_fact"))
def format_thousands(t):
    """SC14: thousands separators."""
    f = t.fin_fact
    return f.select("code", "bsns_year", "quarter", "account", F.format_number("value", 0).alias("value_text"))


@query("property_to_sign", sql_with(["fin_fact", "onto_nodes"], """
SELECT f.code, f.bsns_year, f.quarter, f.account, f.value * CASE WHEN n.sign > 0 THEN 1 ELSE -1 END AS signed_value
FROM fin_fact f JOIN onto_nodes n ON n.acc = f.account"""))
def property_to_sign(t):
    """SC15: Positive -> +1 else -1, applied to the facts."""
    n = O.nodes(t.spark).select(F.col("acc").alias("account"),
                                F.when(F.col("sign") > 0, "Positive").otherwise("Negative").alias("prop"))
    j = t.fin_fact.join(F.broadcast(n), "account")
    return j.select("code", "bsns_year", "quarter", "account", (F.col("value") * EV.sign_col(F.col("prop"))).alias("signed_value"))


@query("qualified_name", sql_with(["fin_fact"], """
SELECT DISTINCT statement || '.' || account AS qualified, split_part(statement || '.' || account, '.', 1) AS part_statement,
       split_part(statement || '.' || account, '.', 2) AS part_account FROM fin_fact"""))
def qualified_name(t):
    """SC16: build 'STATEMENT.Account' and split it back."""
    q = F.concat_ws(".", "statement", "account")
    parts = F.split("qualified", "\\.")
    return t.fin_fact.select(q.alias("qualified")).distinct().select(
        "qualified", parts.getItem(0).alias("part_statement"), parts.getItem(1).alias("part_account"))


@query("json_props_extract", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props_extract(t):
    """SC19: JSON parse of a string column (scalar path extraction)."""
    return t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("wordpiece_strip", "SELECT page_id, ltrim(regexp_extract(url, '#.*$'), '#') AS fragment FROM pages")
def wordpiece_strip(t):
    """SC7: strip every leading '#' (as for word pieces), here from URL fragments."""
    return t.pages.select("page_id", F.expr("trim(LEADING '#' FROM regexp_extract(url, '#.*$', 0))").alias("fragment"))
