"""Secret scans with corpus-wide ownership frequency (DataFrame operations only).

Base rules find assignments, access keys and hex strings. Their values, and mixed tokens of 24
characters or more, are candidates. For each candidate's hash the corpus is asked in how many
repositories (source and language) and by how many owners (source) it is used: a value that many
owners have is a copied example; one that a single owner has looks like a live credential. Live
candidates add spans of kind ``live``; base spans always stay.

Spans are in code points, end exclusive. Positions come from ``split`` and ``regexp_extract_all`` of
one pattern: a match starts after all earlier matches and the pieces between them.

Cases: a null text counts as empty (no spans). Null sources count as one owner, null languages as one
language. Equal texts have equal spans; ties and repeated rows don't add owners. An empty table gives
an empty result. Extra columns aren't carried by ``scan``; ``redact`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, materialize, quoted, text_key, with_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIXED = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS = 1
MAX_REPOSITORIES = 2

_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Matches whose places are added up together, so that the work grows with the matches of a text, not their square.
_BLOCK = 128


def _matches(kind: int, pattern: str, value_group: int, keep: str) -> Column:
    """The matches of a pattern in ``t`` that ``keep`` accepts (of ``x.v``), or null where there is none."""
    quoted_ = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"""arrays_zip(slice(split(t, '{quoted_}', -1), 1, size(regexp_extract_all(t, '{quoted_}', 0))), regexp_extract_all(t, '{quoted_}', 0), regexp_extract_all(t, '{quoted_}', {value_group}))"""
    block = f"""aggregate(slice(z, {_BLOCK} * b + 1, {_BLOCK}), named_struct('at', element_at(done, -1).at, 'out', cast(array() as {_FOUND})),
        (a, x) -> named_struct('at', a.at + length(x.p) + length(x.m), 'out', if({keep},
            array_append(a.out, named_struct('start', a.at + length(x.p), 'kind', {kind}, 'end', a.at + length(x.p) + length(x.m), 'value', x.v)), a.out)))"""
    for name, place in (("x.p", "x['0']"), ("x.m", "x['1']"), ("x.v", "x['2']")):
        block = block.replace(name, place)
    start = f"array(named_struct('at', 0, 'out', cast(array() as {_FOUND})))"
    walk = f"aggregate(sequence(0, (size(z) - 1) div {_BLOCK}), {start}, (done, b) -> array_append(done, {block}), done -> flatten(transform(done, x -> x.out)))"
    return F.when(F.expr(f"rlike(t, '{quoted_}')"), F.expr(f"element_at(transform(array({found}), z -> {walk}), 1)"))


def candidates(documents: DataFrame) -> DataFrame:
    """Each document's key, owner and base spans, and its candidates; without the text."""
    owner = [F.coalesce("source", F.lit("\0")).alias("owner"), F.coalesce("lang", F.lit("\0")).alias("lang")]
    df = documents.select("doc_id", *owner, *text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("t"))
    none = F.array().cast(_FOUND)
    found = {
        "assign": _matches(0, ASSIGN, 2, "length(x.v) >= 8"),
        "access": _matches(1, ACCESS, 0, "true"),
        "hex": _matches(2, HEX, 0, "true"),
        "mixed": _matches(3, MIXED, 0, "x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'"),
    }
    df = df.select("doc_id", "owner", "lang", "k1", "k2", *(F.coalesce(c, none).alias(k) for k, c in found.items()))
    # the value of an assignment ends where its match ends
    values = F.transform(F.concat(*found), lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("v1"), F.xxhash64(F.lit(7), x["value"]).alias("v2")))
    spans = F.transform(F.array_sort(F.concat("assign", "access", "hex")), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return df.select(
        "doc_id", "owner", "lang", "k1", "k2",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        spans.alias("spans"), F.array_distinct(values).alias("values"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate's hash the number of distinct repositories and owners; counted in two steps, so that a hot value is combined before the shuffle."""
    used = found.select("owner", "lang", F.explode("values").alias("v")).groupBy("v.v1", "v.v2", "owner", "lang").agg(F.lit(1).alias("one"))
    owned = used.groupBy("v1", "v2", "owner").agg(F.count("*").alias("r"))
    return owned.groupBy("v1", "v2").agg(F.sum("r").alias("repositories"), F.count("*").alias("owners"))


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def located(documents: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Each document's key, counts, base spans and all spans, as arrays of (start, kind, end)."""
    found = materialize(candidates(documents), "secrets")
    live = materialize(ownership(found).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("v1", "v2"), "live")
    uses = found.where(F.size("values") > 0).select("k1", "k2", F.explode("values").alias("v")).select("k1", "k2", "v.v1", "v.v2", "v.start", "v.end")
    uses = uses.groupBy("k1", "k2", "v1", "v2", "start", "end").agg(F.lit(1).alias("one")).drop("one")
    added = uses.join(live, ["v1", "v2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))
    return found.join(added, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", "n_assign", "n_access", "n_hex", "spans",
        F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("all_spans"),
    )


def scan(documents: DataFrame, **parameters) -> DataFrame:
    df = located(documents, **parameters)
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(rendered(F.col("spans")), 256).alias("base_sha256"), rendered(F.col("all_spans")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]", **parameters) -> DataFrame:
    """The documents with every span, base or live, put out of their texts; overlapping spans give one mark. n_chars, if there, is counted again."""
    found = located(documents, **parameters).where(F.size("all_spans") > 0)
    k1, k2, s1, s2, name = fresh(documents, "k1", "k2", "s1", "s2", "spans")
    spans = found.groupBy(F.col("k1").alias(s1), F.col("k2").alias(s2)).agg(F.first("all_spans").alias(name))
    keyed = documents.select("*", *(k.alias(n) for k, n in zip(text_key(F.col("text")), (k1, k2), strict=True)))
    joined = keyed.join(materialize(spans, "redacted"), (F.col(k1) == F.col(s1)) & (F.col(k2) == F.col(s2)), "left")
    walk = f"""aggregate({quoted(name)}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct(
        'at', greatest(a.at, x.end),
        'out', if(x.start < a.at, a.out, concat(a.out, substring(text, a.at + 1, x.start - a.at), '{mark}'))),
        a -> concat(a.out, substring(text, a.at + 1)))"""
    text = F.when(F.col(name).isNotNull(), F.expr(walk)).otherwise(F.col("text"))
    return with_text(joined, text, documents.columns)


def _sql_matches(kind: int, pattern: str, group: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
select rid, t_start start, {kind} kind, t_start + length(m) as "end", v from (
  select rid, m, v, i, sum(length(p) + length(m)) over (partition by rid order by i) - length(m) t_start from (
    select rid, unnest(range(len(mm))) i, unnest(mm) m, unnest(vv) v, unnest(pp[1:len(mm)]) p from (
      select rid, regexp_extract_all(t, '{quoted}', 0) mm, regexp_extract_all(t, '{quoted}', {group}) vv, regexp_split_to_array(t, '{quoted}') pp
      from d where regexp_matches(t, '{quoted}'))))
where {keep}"""


def oracle(max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> str:
    join = lambda rel: f"(select rid, string_agg(name || ':' || start || ':' || \"end\", ',' order by start, kind, \"end\") s from (select distinct rid, start, kind, \"end\", ['assign', 'access', 'hex', 'live'][kind + 1] as name from {rel}) group by rid)"
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(1)) owner, coalesce(lang, chr(1)) lang, coalesce(text, '') t from documents),
assign as ({_sql_matches(0, ASSIGN, 2, "length(v) >= 8")}), access as ({_sql_matches(1, ACCESS, 0, "true")}),
hex as ({_sql_matches(2, HEX, 0, "true")}),
mixed as ({_sql_matches(3, MIXED, 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')")}),
base as (select * from assign union all select * from access union all select * from hex),
vals as (select distinct rid, "end" - length(v) as start, "end", v from (select * from base union all select * from mixed)),
own as (select v from (select v, owner, count(distinct lang) r from vals join d using (rid) group by v, owner) group by v having count(*) <= {max_owners} and sum(r) <= {max_repositories}),
live as (select rid, start, 3 as kind, "end" from vals semi join own using (v)),
every as (select rid, start, kind, "end" from base union all select * from live),
n as (select rid, count(*) filter (kind = 0) a, count(*) filter (kind = 1) b, count(*) filter (kind = 2) c from base group by rid)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(b, 0)::bigint n_access, coalesce(c, 0)::bigint n_hex,
  sha256(coalesce(x.s, '')) base_sha256, coalesce(y.s, '') spans
from d left join n using (rid) left join {join('base')} x using (rid) left join {join('every')} y using (rid)
"""
