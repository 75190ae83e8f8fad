"""Quality rules with adaptive thresholds (DataFrame operations only).

Each (language, source) group's metrics are summarised by a mergeable quantile sketch: a
log-linear histogram of integers whose bins keep the six leading binary digits of a value, so that
a bin is at most 1/32 wide and merging sketches is adding counts. Its quantiles give Tukey fences,
which take the place of fixed cutoffs; groups with too few documents take the merged sketch of
their language, or of everything. The documents are then joined with the fences and filtered.

Cases: a null text counts as empty (no words, base_failed). Null language or source form groups of
their own. Ties and repeated rows count as often as they come. An empty table gives an empty result.
Extra columns of the input are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Metric:
    """A ratio of integers; fences reach ``reach`` interquartile ranges, taken as ``spread`` at least."""

    name: str
    value: str
    spread: int
    low: bool = False


METRICS = (
    Metric("symbols", "n_symbols * 1000 div n_words", 15),
    Metric("dup_lines", "n_dup_lines * 1000 div n_lines", 60),
    Metric("repeats", "n_repeat_words * 1000 div n_words", 60),
    Metric("word_len", "word_chars * 100 div n_words", 40, low=True),
)
REACH = 3
MIN_DOCS = 100


def text_stats(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    null = F.lit(None).cast("int")
    df = documents.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t"))
    df = df.select(
        "doc_id", "lang", "source",
        F.filter(F.split("t", SPACES), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
    )
    df = df.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    ordered = F.when(repeated, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("s", ordered).drop("h")
    found = F.filter(
        F.transform("s", lambda x, j: F.when((F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]), x["i"]).otherwise(null)),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("p", F.array_sort(found)).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch_bin(value: Column) -> Column:
    """The lower end of a value's bin: its six leading binary digits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(stats: DataFrame) -> DataFrame:
    """The sketch of each lang, source and metric as rows (bin, n); add counts to merge sketches."""
    rows = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.expr(m.value).alias("v")) for m in METRICS)))
    return (
        stats.where("n_words > 0").select("lang", "source", rows.alias("r"))
        .select("lang", "source", "r.metric", sketch_bin(F.col("r.v")).alias("bin"))
        .groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """lang, source and for each metric the fences, from the group's own or a merged sketch."""
    from pyspark.sql import Window

    levels = (
        sketch.groupingSets([["lang", "source", "metric", "bin"], ["lang", "metric", "bin"], ["metric", "bin"]], "lang", "source", "metric", "bin")
        .agg(F.sum("n").alias("n"), F.grouping("source").alias("no_source"), F.grouping("lang").alias("no_lang"))
    )
    group = ["no_lang", "no_source", "lang", "source", "metric"]
    total, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("bin")
    ranked = levels.withColumns({"total": F.sum("n").over(total), "upto": F.sum("n").over(upto)})
    edges = ranked.groupBy(*group).agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
    )
    spread = F.create_map(*(F.lit(x) for m in METRICS for x in (m.name, m.spread)))
    edges = edges.withColumn("reach", reach * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("metric")].cast("long")))
    edges = edges.withColumns({"hi": F.col("q3") + F.col("reach"), "lo": F.col("q1") - F.col("reach")})
    own = edges.where("no_source = 0 and no_lang = 0").select("lang", "source", "metric", "total", "hi", "lo")
    lang = edges.where("no_source = 1 and no_lang = 0").select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("total").alias("l_total"), F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"))
    every = edges.where("no_source = 1 and no_lang = 1").select(F.col("metric").alias("a_metric"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    joined = own.join(lang, own.lang.eqNullSafe(lang.l_lang) & (own.metric == lang.l_metric)).join(every, own.metric == every.a_metric)
    pick = lambda x: F.when(F.col("total") >= min_docs, F.col(x)).when(F.col("l_total") >= min_docs, F.col(f"l_{x}")).otherwise(F.col(f"a_{x}"))
    joined = joined.select("lang", "source", "metric", pick("hi").alias("hi"), pick("lo").alias("lo"))
    return joined.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("metric") == m.name, F.col(x))).alias(f"{m.name}_{x}") for m in METRICS for x in ("hi", "lo"))
    )


def verdicts(documents: DataFrame, min_docs: int = MIN_DOCS, reach: int = REACH) -> DataFrame:
    """Every document's counts, base verdict and verdict against its group's fences.

    The counts are written once (eleven short columns, no text), since both the sketches and the
    filter read them; the fences have a row for each language and source and are joined by an
    ordinary equi-join, which Spark broadcasts only where their measured size allows it and whose hot
    groups it can split.
    """
    stats = materialize(text_stats(documents), "quality")
    f = fences(sketches(stats), min_docs, reach).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = stats.join(f, stats.lang.eqNullSafe(f.f_lang) & stats.source.eqNullSafe(f.f_source), "left")
    bad = F.lit(False)
    for m in METRICS:
        v = F.expr(f"case when n_words > 0 then {m.value} end")
        bad = bad | (v > F.col(f"{m.name}_hi"))
        if m.low:
            bad = bad | (v < F.col(f"{m.name}_lo"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(base_failed(), F.lit(False)).otherwise(~F.coalesce(bad, F.lit(False))).alias("kept"),
    )


def filter_documents(documents: DataFrame, **parameters) -> DataFrame:
    """The documents whose id is kept, all columns as they were. Needs ids that are unique and not null to tell rows apart."""
    kept = verdicts(documents, **parameters).where("kept").select("doc_id")
    return documents.join(kept, "doc_id", "left_semi")


_BIN = "((({v}) >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"


def oracle(min_docs: int = MIN_DOCS, reach: int = REACH) -> str:
    metric_rows = " union all ".join(f"select lang, source, '{m.name}' metric, {m.value.replace(' div ', ' // ')} v from st where n_words > 0" for m in METRICS)
    spread = " ".join(f"when '{m.name}' then {m.spread}" for m in METRICS)
    wide = ", ".join(f"max({x}) filter (metric = '{m.name}') {m.name}_{x}" for m in METRICS for x in ("hi", "lo"))
    value = lambda m: m.value.replace(" div ", " // ")
    bad = " or ".join([f"{value(m)} > {m.name}_hi" for m in METRICS] + [f"{value(m)} < {m.name}_lo" for m in METRICS if m.low])
    return f"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
tri as (select rid, i, [w[i], w[i + 1], w[i + 2]] g from (select rid, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from tri) where c >= 2),
cov as (select rid, sum(least(3, coalesce(nxt - i, 3))) n from (select rid, i, lead(i) over (partition by rid order by i) nxt from hit) group by rid),
st as (select w.rid, doc_id, lang, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, len(lines)::bigint n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words
       from w left join cov using (rid)),
m as ({metric_rows}),
sk as (select lang, source, metric, {_BIN.format(v='v')} bin, count(*) n from m group by all),
lv as (select grouping(lang) no_lang, grouping(source) no_source, lang, source, metric, bin, sum(n) n from sk
       group by grouping sets ((lang, source, metric, bin), (lang, metric, bin), (metric, bin))),
rk as (select *, sum(n) over (partition by no_lang, no_source, lang, source, metric) total,
        sum(n) over (partition by no_lang, no_source, lang, source, metric order by bin) upto from lv),
eg as (select no_lang, no_source, lang, source, metric, max(total) total, min(bin) filter (4 * upto >= total) q1,
        min(bin) filter (4 * upto >= 3 * total) q3 from rk group by all),
fe as (select *, q3 + {reach} * greatest(q3 - q1, case metric {spread} end) hi, q1 - {reach} * greatest(q3 - q1, case metric {spread} end) lo from eg),
pk as (select o.lang, o.source, o.metric, case when o.total >= {min_docs} then o.hi when l.total >= {min_docs} then l.hi else a.hi end hi,
        case when o.total >= {min_docs} then o.lo when l.total >= {min_docs} then l.lo else a.lo end lo
       from fe o join fe l on o.lang is not distinct from l.lang and o.metric = l.metric and l.no_source = 1 and l.no_lang = 0
       join fe a on a.metric = o.metric and a.no_lang = 1 where o.no_source = 0 and o.no_lang = 0),
wd as (select lang, source, {wide} from pk group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
  case when n_words < 50 or 100 * n_repeat_words > 50 * n_words then false else not coalesce({bad}, false) end kept
from st left join wd on st.lang is not distinct from wd.lang and st.source is not distinct from wd.source
"""
