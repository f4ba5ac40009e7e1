"""The engine's queries by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.functions.markdown import with_structure
from proselens.operators import alignment, edits, gate, incremental, model_rows, ranges, rules, structure
from proselens.plans import oracles as O
from proselens.plans.analysis import analyse
from proselens.plans.policy import Policy
from proselens.sources.documents import as_json, rejects, spread, status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def col_text() -> Column:
    return F.col("text")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str, expression: str = "text") -> DataFrame:
    found = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.expr(expression).alias("text"))


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _rule(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.scan(docs(spark, sf_dir, O.VIEWS.get(name, "text")), name)
        return found.select("doc_id", *long("start", "end"), "original", "replacement")

    query(f"q_rule_{name}", O.rule_query(name))(run)


for _name in rules.BY_NAME:
    _rule(_name)

_LOCAL = O.local_rows(O.docs_view())


@query("q_local_all", f'select doc_id, ord::bigint as ord, rule::bigint as rule, "start"::bigint as "start", "end"::bigint as "end", original, replacement, title, category, severity from ({_LOCAL})')
def q_local_all(spark, sf_dir):
    return rules.scan(docs(spark, sf_dir)).select("doc_id", *long("ord", "rule", "start", "end"), "original", "replacement", "title", "category", "severity")


@query("q_local_by_category", f"select category, count(*) as n from ({_LOCAL}) group by category")
def q_local_by_category(spark, sf_dir):
    return rules.scan(docs(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query("q_local_by_severity", f"select severity, count(*) as n from ({_LOCAL}) group by severity")
def q_local_by_severity(spark, sf_dir):
    return rules.scan(docs(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("n"))


@query("q_checksum", f"select doc_id, ord::bigint as ord, case when original <> '' then sha256(original) end as checksum, sha256(concat_ws('|', doc_id, \"start\", \"end\", title, replacement)) as suggestion_id from ({_LOCAL})")
def q_checksum(spark, sf_dir):
    return rules.scan(docs(spark, sf_dir)).select("doc_id", *long("ord"), "checksum", "suggestion_id")


_LINKED = "replace(replace(text, ' and ', ' [and](https://ex.org/a_b) '), ' with ', ' http://ex.org/w?x=1 ')"
_URLS = O.spans(O.docs_view(expression=_LINKED), f"https?://[^{O.SPACE}]+")
_LINKS = O.spans(O.docs_view(expression=_LINKED), rf"\[[^\]]+\]\([^){O.SPACE}]+\)")


def _ranged(df: DataFrame, array: Column) -> DataFrame:
    return df.select("doc_id", F.inline(array)).select("doc_id", *long("start", "end"))


@query("q_url_spans", f'select doc_id, s as "start", e as "end" from ({_URLS})')
def q_url_spans(spark, sf_dir):
    return _ranged(docs(spark, sf_dir, _LINKED), structure.addresses(col_text()))


_TARGETS = f"select doc_id, s + position('(' in t[s + 1:]) - 1 as s, e from ({_LINKS})"


@query("q_link_targets", f'select doc_id, s::bigint as "start", e::bigint as "end" from ({_TARGETS})')
def q_link_targets(spark, sf_dir):
    return _ranged(docs(spark, sf_dir, _LINKED), structure.link_targets(col_text()))


_MERGED = f"""select doc_id, min(s) as s, max(e) as e from (select *, sum(new) over (partition by doc_id order by s, e rows unbounded preceding) as island from (
    select *, case when s > max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as new
    from (select doc_id, s, e from ({_URLS}) union all select doc_id, s, e from ({_TARGETS})))) group by doc_id, island"""


@query("q_ranges_merged", f'select doc_id, s::bigint as "start", e::bigint as "end" from ({_MERGED})')
def q_ranges_merged(spark, sf_dir):
    return _ranged(docs(spark, sf_dir, _LINKED), structure.plain_forbidden(col_text()))


@query("q_ranges_merged_table", f'select doc_id, s::bigint as "start", e::bigint as "end" from ({_MERGED})')
def q_ranges_merged_table(spark, sf_dir):
    d = docs(spark, sf_dir, _LINKED)
    return ranges.merge_table(_ranged(d, structure.addresses(col_text())).unionByName(_ranged(d, structure.link_targets(col_text()))))


_LINKED_LOCAL = O.local_rows(O.docs_view(expression=_LINKED))


@query("q_outside_forbidden", f"""select l.doc_id, l.rule::bigint as rule, l."start"::bigint as "start", l."end"::bigint as "end" from ({_LINKED_LOCAL}) l
    where not exists (select 1 from ({_MERGED}) f where f.doc_id = l.doc_id and l."start" < f.e and l."end" > f.s)""")
def q_outside_forbidden(spark, sf_dir):
    forbidden = structure.plain_forbidden(col_text())
    kept = T.let(forbidden, lambda f: F.filter(rules.local_rows(col_text()), lambda r: ~ranges.intersects(r["start"], r["end"], f)))
    return docs(spark, sf_dir, _LINKED).select("doc_id", F.inline(kept)).select("doc_id", *long("rule", "start", "end"))


@query("q_outside_forbidden_join", ORACLES["q_outside_forbidden"])
def q_outside_forbidden_join(spark, sf_dir):
    """The same with the ranges as a table of their own."""
    d = docs(spark, sf_dir, _LINKED)
    kept = ranges.outside_join(rules.scan(d), _ranged(d, structure.plain_forbidden(col_text())))
    return kept.select("doc_id", *long("rule", "start", "end"))


_BROKEN = "replace(text, chr(10), chr(10) || chr(10))"
_BLOCKS = f"""select doc_id, s + (length(m) - length(ltrim(m, ' '))) as s, s + length(rtrim(m, ' ')) as e from ({O.spans(O.docs_view(expression=_BROKEN), "[^" + chr(92) + "n]+")})
    where trim(m, ' ') <> ''"""


@query("q_within_prose", f"""select l.doc_id, l.rule::bigint as rule, l."start"::bigint as "start", l."end"::bigint as "end" from ({O.local_rows(O.docs_view(expression=_BROKEN))}) l
    where exists (select 1 from ({_BLOCKS}) p where p.doc_id = l.doc_id and l."start" >= p.s and l."end" <= p.e)""")
def q_within_prose(spark, sf_dir):
    d = docs(spark, sf_dir, _BROKEN)
    kept = ranges.within_join(rules.scan(d), _ranged(d, structure.blocks(col_text())))
    return kept.select("doc_id", *long("rule", "start", "end"))


@query("q_paragraphs_intended", f"""select doc_id, s::bigint as "start", e::bigint as "end" from ({O.spans(O.docs_view(expression=_BROKEN), "[^" + chr(92) + "n]+")})""")
def q_paragraphs_intended(spark, sf_dir):
    return _ranged(docs(spark, sf_dir, _BROKEN), structure.paragraphs(col_text(), "intended"))


@query("q_paragraphs", """select doc_id, s::bigint as "start", e::bigint as "end" from (
    select doc_id, case when i = 1 then 0 else pos[i - 1] + 4 end as s, case when i > len(pos) then n else pos[i] + 2 end as e
    from (select doc_id, n, pos, unnest(range(1, len(pos) + 2)) as i from (
        select doc_id, length(t) as n, list_filter(range(0, length(t)), lambda p: t[p + 1] = chr(10) and t[p + 2] = chr(10)) as pos
        from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as t from documents)))) where e > s""")
def q_paragraphs(spark, sf_dir):
    return _ranged(docs(spark, sf_dir, _BROKEN), structure.paragraphs(col_text()))


@query("q_token_count", f"select doc_id, {O.TOKENS}::bigint as tokens, {O.LETTERS}::bigint as letters from (select doc_id, text as t from documents)")
def q_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count(col_text()).cast("long").alias("tokens"), T.letter_count(col_text()).cast("long").alias("letters"))


@query("q_style_budget", """select doc_id, n_chars as length, c as correctness, ((case when least(3, floor(0.15 * c)) > 0 then least(3, floor(0.15 * c)) else 3 end) * ceil(n_chars / 1000.0))::bigint as budget
    from (select doc_id, n_chars, unnest([0, 6, 7, 14, 20, 100]::bigint[]) as c from documents)""")
def q_style_budget(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("length"), F.explode(F.array(*(F.lit(c).cast("long") for c in (0, 6, 7, 14, 20, 100)))).alias("correctness"))
    return d.withColumn("budget", gate.style_budget(F.col("length"), F.col("correctness")).cast("long"))


@query("q_token_distance", f"""select doc_id, ord::bigint as ord, (case when rule in (4, 7) then {O.TOKENS.replace("(t,", "(original,")} - {O.TOKENS.replace("(t,", "(replacement,")} when rule in (3, 6) then 1 else 0 end)::bigint as changed from ({_LOCAL}) where rule in (3, 4, 5, 6, 7)""")
def q_token_distance(spark, sf_dir):
    """Rows that insert, remove, substitute or space tokens: all that the texts give."""
    found = rules.scan(docs(spark, sf_dir))
    return found.select("doc_id", *long("ord"), T.token_distance(F.col("original"), F.col("replacement")).cast("long").alias("changed"))


@query("q_selected_local", f'select l.doc_id, l.rule::bigint as rule, l."start"::bigint as "start", l."end"::bigint as "end" from ({_LOCAL}) l join ({O.selected(O.docs_view())}) k using (doc_id, ord)')
def q_selected_local(spark, sf_dir):
    kept = gate.select(gate.full_rows(rules.local_rows(col_text())), col_text())
    return gate.as_rows(docs(spark, sf_dir), kept).select("doc_id", *long("rule", "start", "end"))


@query("q_final_local", f'select doc_id, rule::bigint as rule, "start"::bigint as "start", "end"::bigint as "end", original, replacement, category, severity from ({O.final(O.docs_view())})')
def q_final_local(spark, sf_dir):
    found = gate.as_rows(docs(spark, sf_dir), gate.final_local(col_text()))
    return found.select("doc_id", *long("rule", "start", "end"), "original", "replacement", "category", "severity")


@query("q_final_by_category", f"select category, count(*) as n from ({O.final(O.docs_view())}) group by category")
def q_final_by_category(spark, sf_dir):
    return gate.as_rows(docs(spark, sf_dir), gate.final_local(col_text())).groupBy("category").agg(F.count("*").alias("n"))


@query("q_analysis", f"""select doc_id, (row_number() over (partition by doc_id order by "start", category = 'style', ord) - 1)::bigint as ord, rule::bigint as rule, "start"::bigint as "start", "end"::bigint as "end",
    original, replacement, category, severity, case when original <> '' then sha256(original) end as checksum from ({O.final(O.docs_view())})""")
def q_analysis(spark, sf_dir):
    return analyse(docs(spark, sf_dir)).select("doc_id", *long("ord", "rule", "start", "end"), "original", "replacement", "category", "severity", "checksum")


@query("q_request_validation", "select doc_id, case when coalesce(length(t), 0) = 0 then 400 when length(t) > 100000 then 413 else 200 end::bigint as status from (select doc_id, case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then repeat(text, 60) else text end as t from documents)")
def q_request_validation(spark, sf_dir):
    d = docs(spark, sf_dir, "case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then repeat(text, 60) else text end")
    return d.select("doc_id", status().cast("long").alias("status"))


_KEPT_LOCAL = f"select * from (select *, max(\"end\") over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as reach from ({_LOCAL}) where category <> 'style') where \"start\" >= coalesce(reach, 0)"


@query("q_apply_all_intended", f"""select d.doc_id, sha256(coalesce(p.head || substring(d.text, p.last + 1), d.text)) as edited_sha256 from documents d left join (
    select doc_id, string_agg(substring(text, prev + 1, "start" - prev) || replacement, '' order by ord) as head, max("end") as last from (
        select k.*, d.text, coalesce(lag("end") over (partition by k.doc_id order by ord), 0) as prev from ({_KEPT_LOCAL}) k join documents d on d.doc_id = k.doc_id) group by doc_id) p on p.doc_id = d.doc_id""")
def q_apply_all_intended(spark, sf_dir):
    rows = gate.full_rows(rules.local_rows(col_text()))
    return docs(spark, sf_dir).select("doc_id", F.sha2(edits.applied_all(col_text(), rows), 256).alias("edited_sha256"))


@query("q_apply_all_observed")
def q_apply_all_observed(spark, sf_dir):
    """All suggestions of every document; see the brute force in ``tests/test_whole.py``."""
    found = docs(spark, sf_dir).select("doc_id", "text", gate.final_local(col_text()).alias("rows"))
    return edits.applied_in_order(found).select("doc_id", F.sha2("text", 256).alias("edited_sha256"))


_RANK = "case severity when 'error' then 3 when 'warn' then 2 when 'info' then 1 else 0 end"


@query("q_client_merge", f"""select doc_id, rule::bigint as rule, "start"::bigint as "start", row_number() over (partition by doc_id order by {_RANK} desc, "start", src, ord)::bigint as rank from (
    select *, row_number() over (partition by doc_id, case when {O.norm('original')} <> '' then concat_ws('|', {O.norm('original')}, {O.norm('replacement')}, title) else concat_ws('-', "start", "end", title, replacement) end order by src, ord) as nth
    from (select *, 0 as src from ({_LOCAL}) where rule <> 7 union all select *, 1 as src from ({_LOCAL}))) where nth = 1""")
def q_client_merge(spark, sf_dir):
    every = rules.scan(docs(spark, sf_dir)).withColumn("confidence", F.lit(None).cast("double"))
    tagged = every.withColumn("_src", F.explode(F.when(F.col("rule") == 7, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return edits.merged_tagged(tagged).select("doc_id", *long("rule", "start", "rank"))


@query("q_severity_sort", f'select doc_id, ord::bigint as ord, row_number() over (partition by doc_id order by {_RANK} desc, "start", ord)::bigint as rank from ({_LOCAL})')
def q_severity_sort(spark, sf_dir):
    from pyspark.sql import Window as W

    every = rules.scan(docs(spark, sf_dir)).withColumn("confidence", F.lit(None).cast("double"))
    return every.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*edits.importance(), "ord"))).select("doc_id", *long("ord", "rank"))


@query("q_quota_other", """select doc_id, ord::bigint as ord from (select doc_id, unnest(range(0, doc_id % 5)) as ord from documents) where ord < 2""")
def q_quota_other(spark, sf_dir):
    def row(i: Column) -> Column:
        given = {"source": F.lit("ai"), "start": i * 20, "end": i * 20 + 1, "ord": i, "category": F.lit("other"), "severity": F.lit("info"), "title": F.lit("Suggestion"), "original": F.lit("a"), "replacement": F.lit("b")}
        return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in gate.FIELDS))

    n = (F.col("doc_id") % 5).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(F.array().cast(gate.ROWS))
    kept = gate.select(made, F.lit("x" * 200))
    return docs(spark, sf_dir).select("doc_id", F.explode(kept).alias("r")).select("doc_id", F.col("r.ord").cast("long").alias("ord"))


# What a made answer says of each document: range, place of its original in the text (none: -1), and how it is taken.
_ITEMS = [
    ("p", "p + 4", 0, "spelling", "error", 0.9),
    ("p + 10", "p + 18", 14, "nonsense", "loud", 1.5),
    ("null", "null", 2, "style", "info", 0.8),
    ("p + 9", "p + 3", -1, "style", "warn", 0.76),
    ("p", "1000000", -1, "punctuation", "info", 0.0),
    ("0", "3", -1, "spacing", "info", 0.56),
]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made answer for each document, about a chunk that begins at c and has a prefix of p: good, misplaced, without range,
    reversed, out of bounds, and inside the prefix; a last item has a range of strings."""
    d = docs(spark, sf_dir).withColumns({"p": (F.col("doc_id") % 3 * 5).cast("int"), "c": (F.col("doc_id") % 4 * 7).cast("int")})
    items = []
    for start, end, at, category, severity, confidence in _ITEMS:
        original = F.substring("text", F.col("c") + at + 1, F.lit(8)) if at >= 0 else F.lit(None).cast("string")
        place = F.struct(F.expr(start).cast("int").alias("start"), F.expr(end).cast("int").alias("end"))
        items.append(F.to_json(F.struct(place.alias("range"), original.alias("original"), F.lit("x").alias("replacement"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))))
    items.append(F.lit('{"range": {"start": "1", "end": "2"}}'))
    body = F.concat(F.lit('{"suggestions": ['), F.concat_ws(", ", *items), F.lit("]}"))
    return d.select("doc_id", F.lit(0).alias("chunk_id"), F.col("c").alias("chunk_start"), F.col("p").alias("prefix_len"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw"))


_AI_ROWS = " union all ".join(
    f"""select doc_id, {i}::bigint as item, text, p, greatest(0, least({start} - p + c, length(text))) as s, greatest(0, least({end} - p + c, length(text))) as e,
    {f"text[c + {at + 1}:c + {at + 8}]" if at >= 0 else "null::varchar"} as given, '{category if category in ("spelling", "style", "punctuation", "spacing") else "other"}' as category,
    '{severity if severity in ("info", "warn", "error") else "info"}' as severity, {confidence if confidence <= 1 else "null"}::double as confidence from ai"""
    for i, (start, end, at, category, severity, confidence) in enumerate(_ITEMS)
    if start != "null"
)
_AI = f"with ai as (select doc_id, text, (doc_id % 3 * 5)::int as p, (doc_id % 4 * 7)::int as c from documents), rows as ({_AI_ROWS})"


@query("q_ai_validate", f"""{_AI} select doc_id, item, s::bigint as "start", e::bigint as "end", category, severity, confidence,
    case when coalesce(nullif(given, ''), text[s + 1:e]) <> '' then sha256(coalesce(nullif(given, ''), text[s + 1:e])) end as checksum from rows""")
def q_ai_validate(spark, sf_dir):
    found = model_rows.validated(_answers(spark, sf_dir), docs(spark, sf_dir))
    return found.select("doc_id", *long("item", "start", "end"), "category", "severity", "confidence", "checksum")


_SANE = "e >= s and not (category = 'spacing' and regexp_matches('x', '\\pL'))"
_AI_PLACED = f"""{_AI}, near as (select doc_id, item, case when coalesce(given, '') = '' or text[s + 1:e] = given then s else
    (select min_by(q, abs(q - s) * 1000000 + q) from (select unnest(list_filter(range(0, length(text) - length(given) + 1), lambda q: text[q + 1:q + length(given)] = given)) as q)) end as at from rows),
    placed as (select r.* exclude (s, e), n.at as s, case when coalesce(given, '') = '' then e else n.at + length(given) end as e, r.s as first from rows r join near n using (doc_id, item))"""


@query("q_ai_accepted", f"""{_AI_PLACED} select doc_id, item, s::bigint as "start", e::bigint as "end", category from placed where first >= p and s is not null and {_SANE}""")
def q_ai_accepted(spark, sf_dir):
    found = model_rows.accepted(_answers(spark, sf_dir), docs(spark, sf_dir))
    return found.select("doc_id", *long("item", "start", "end"), "category")


@query("q_ai_stages", f"""{_AI_PLACED} select 'parsed' as stage, 7 * count(*) as n from documents union all select 'with_range', count(*) from rows union all select 'after_prefix', count(*) from rows where s >= p
    union all select 'in_place', count(*) from rows where s >= p and not (s < 12 and e > 6) union all select 'found', count(*) from placed where first >= p and not (first < 12 and greatest(0, case when item = 0 then least(first + 4, length(text)) when item = 1 then least(first + 8, length(text)) else e end) > 6) and s is not null
    union all select 'kept', count(*) from placed where first >= p and not (first < 12 and greatest(0, case when item = 0 then least(first + 4, length(text)) when item = 1 then least(first + 8, length(text)) else e end) > 6) and s is not null and {_SANE}""")
def q_ai_stages(spark, sf_dir):
    """With one forbidden range, from 6 to 12."""
    forbidden = F.array(F.struct(F.lit(6).alias("start"), F.lit(12).alias("end")))
    return model_rows.stages(_answers(spark, sf_dir), docs(spark, sf_dir), forbidden=forbidden)


@query("q_ai_align", """with o as (select doc_id, text, text[14:21] as w from documents where n_chars > 13),
    c as (select doc_id, unnest(list_filter(range(0, length(text) - length(w) + 1), lambda p: text[p + 1:p + length(w)] = w)) as p, w, text from o)
    select doc_id, p::bigint as "start", (p + n)::bigint as "end" from (select doc_id, any_value(length(w)) as n, case when any_value(text[11:18]) = any_value(w) then 10 else arg_min(p, abs(p - 10) * 1000000 + p) end as p from c group by doc_id)""")
def q_ai_align(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.length("text") > 13)  # there is something to find
    w = F.substring("text", 14, 8)
    at = alignment.align(col_text(), F.lit(10), F.lit(18), w, F.lit("moved"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return d.select("doc_id", at.alias("r")).select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


_OLD_NEW = "select doc_id, text as a, text[:length(text) // 2] || 'XY' || text[length(text) // 2 + 4:] as b from documents"


@query("q_change_span", f"""select doc_id, i::bigint as "start", (len(a) - j)::bigint as end_a, (len(b) - j)::bigint as end_b from (
    select *, coalesce(list_min(list_filter(range(0, least(len(a), len(b)) - i), lambda k: a[len(a) - k] <> b[len(b) - k])), least(len(a), len(b)) - i) as j from (
    select *, coalesce(list_min(list_filter(range(0, least(len(a), len(b))), lambda k: a[k + 1] <> b[k + 1])), least(len(a), len(b))) as i from (
    select doc_id, string_split(a, '') as a, string_split(b, '') as b from ({_OLD_NEW}) where a <> b)))""")
def q_change_span(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substring("text", F.lit(1), half), F.lit("XY"), F.substring("text", half + 4, F.length("text")))
    pairs = docs(spark, sf_dir).select("doc_id", col_text().alias("a"), new.alias("b")).where("a <> b")
    return pairs.select("doc_id", ranges.change_span(F.col("a"), F.col("b")).alias("s")).select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("start", "end_a", "end_b")))


@query("q_edit_shift", f"""select doc_id, rule::bigint as rule, s::bigint as "start", e::bigint as "end" from (select doc_id, rule, case when "start" >= 100 then "start" + 7 else "start" end as s, case when "start" >= 100 then "end" + 7 else "end" end as e from ({_LOCAL}))
    where not (s < 117 and e > 100)""")
def q_edit_shift(spark, sf_dir):
    every = rules.scan(docs(spark, sf_dir)).withColumn("applied", F.lit(False))
    return ranges.shift_after_edit(every, F.lit(100), F.lit(110), F.lit(117)).select("doc_id", *long("rule", "start", "end"))


@query("q_routes", "select doc_id, case when length(t) - length(replace(t, 'X', '')) > 0 and doc_id % 3 = 0 then 'scoped' else 'full' end as route from (select doc_id, 'aXb' || text as t from documents)")
def q_routes(spark, sf_dir):
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ab"), col_text()))
    pairs = docs(spark, sf_dir).select("doc_id", old.alias("old"), F.concat(F.lit("aXb"), col_text()).alias("new"))
    return incremental.routed(pairs).select("doc_id", "route")


@query("q_dedupe_by_content", "select sha256(text) as text_hash, min(doc_id) as doc_id from documents group by text")
def q_dedupe_by_content(spark, sf_dir):
    return incremental.distinct_texts(docs(spark, sf_dir)).select("text_hash", "doc_id")


@query("q_latest_text", "select event_type as doc_id, arg_max(props, event_id) as text, max(event_id) as version from events group by event_type")
def q_latest_text(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("doc_id"), F.col("props").alias("text"), F.col("event_id").alias("version"))
    return incremental.latest(events)


@query("q_debounce_sessions", """select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as n from (
    select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from (
    select user_id, ts, event_id, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 10 minutes then 1 else 0 end as new from events)) group by user_id, burst""")
def q_debounce_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = incremental.sessions(events, "10 minutes")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


_MARKED = "concat('# ', text, chr(10), chr(10), '[ref]: http://ex.org/a', chr(10), chr(10), '```', chr(10), text, chr(10), '```')"


@query("q_markdown_ranges", """with d as (select doc_id, length(text) as n, case when contains(text, chr(10)) then position(chr(10) in text) - 1 else length(text) end as l from documents)
    select doc_id, 'prose' as kind, 0::bigint as "start", (l + 2)::bigint as "end" from d union all select doc_id, 'prose', l + 3, n + 2 from d where l < n
    union all select doc_id, 'forbidden', n + 11, n + 26 from d union all select doc_id, 'forbidden', n + 28, 2 * n + 36 from d""")
def q_markdown_ranges(spark, sf_dir):
    """Each text as a heading with a paragraph, a definition, and the text again as code."""
    d = with_structure(docs(spark, sf_dir, _MARKED))
    both = [d.select("doc_id", F.lit(kind).alias("kind"), F.inline(kind)) for kind in ("prose", "forbidden")]
    return both[0].unionByName(both[1]).select("doc_id", "kind", *long("start", "end"))


@query("q_chunks")
def q_chunks(spark, sf_dir):
    found = structure.chunk_rows(docs(spark, sf_dir), structure.blocks(col_text()), mode="intended")
    return found.select("doc_id", *long("chunk_id", "start", "end", "prefix_len"), F.length("content").cast("long").alias("n"))


_ACCENT = chr(769)
_ACCENTED = f"replace(text, 'e', 'e{_ACCENT}')"


@query("q_grapheme_snap", f"""select doc_id, p::bigint as place, case when t = '' then 0 when p = length(t) or t[p + 1] = '{_ACCENT}' then case when t[length(t)] = '{_ACCENT}' and p = length(t) then p - 2 else p - 1 end else p end::bigint as "start",
    least(case when t[p + 3] = '{_ACCENT}' then p + 3 else p + 2 end, length(t))::bigint as "end" from (select doc_id, t, unnest(list_distinct(list_append(range(0, length(t) + 1, 32), length(t)))) as p from {O.docs_view(expression=_ACCENTED)})""")
def q_grapheme_snap(spark, sf_dir):
    """Ranges of two code points through the whole text of every document, one in 32 and one at the end, with accents of their own."""
    places = F.explode(F.array_distinct(F.array_append(F.sequence(F.lit(0), F.length("text"), F.lit(32)), F.length("text"))))
    d = docs(spark, sf_dir, _ACCENTED).select("doc_id", "text", places.alias("place"))
    found = d.select("doc_id", "place", T.snapped(col_text(), F.col("place"), F.col("place") + 2).alias("r"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), *(F.col(f"r.{c}").cast("long").alias(c) for c in ("start", "end")))


@query("q_relocate", f"""with o as (select doc_id, text, regexp_replace(text[31:42], ' ', '  ', 'g') as w from documents where length(text) > 30),
    a as (select doc_id, w, text, list_filter(range(0, length(text) - length(w) + 1), lambda p: text[p + 1:p + length(w)] = w) as exact,
          list_filter(range(0, least(320, length(text))), lambda p: starts_with(trim(regexp_replace(text[p + 1:least(least(320, length(text)), p + length(w) + 40)], '[{O.SPACE}]+', ' ', 'g'), ' '), trim(regexp_replace(w, '[{O.SPACE}]+', ' ', 'g'), ' '))) as near from o),
    b as (select doc_id, w, case when text[21:30] = w then null when len(exact) > 0 then list_min(list_transform(exact, lambda p: abs(p - 20) * 1000000 + p)) % 1000000 else near[1] end as p from a)
    select doc_id, p::bigint as "start", (p + length(w))::bigint as "end" from b""")
def q_relocate(spark, sf_dir):
    d = docs(spark, sf_dir).where(F.length("text") > 30)  # there is something to find
    none = F.lit(None).cast("string")
    at = alignment.relocate(col_text(), F.lit(20), F.lit(30), F.regexp_replace(F.substring("text", 31, 12), " ", "  "), F.lit("x"), none, none)
    return d.select("doc_id", at.alias("r")).select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"))


_PLACES = "select doc_id, text, unnest(range(0, length(text) + 1, 37)) as p from documents"


@query("q_sentence_start", f"""select doc_id, p::bigint as place, (b = '' or regexp_matches(b, '[.!?{chr(92)}n]$')) as opens from (select doc_id, p, regexp_replace(text[1:p], '[{O.SPACE}"''“”‘’({chr(92)}[{{]+$', '') as b from ({_PLACES}))""")
def q_sentence_start(spark, sf_dir):
    places = docs(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(37))).alias("p"))
    return places.select("doc_id", F.col("p").cast("long").alias("place"), structure.is_sentence_start(col_text(), F.col("p")).alias("opens"))


@query("q_chunks_observed", f"""select doc_id, (row_number() over (partition by doc_id order by s) - 1)::bigint as chunk_id, s::bigint as "start", e::bigint as "end", 0::bigint as prefix_len, sha256(t[s + 1:e]) as content_sha256 from (
    select doc_id, t, 0 as s, length(t) as e from {O.docs_view(expression=_BROKEN)} where length(t) <= 4500 union all
    select b.doc_id, d.t, b.s, b.e from ({_BLOCKS}) b join {O.docs_view(expression=_BROKEN)} d on d.doc_id = b.doc_id where length(d.t) > 4500)""")
def q_chunks_observed(spark, sf_dir):
    found = structure.chunk_rows(docs(spark, sf_dir, _BROKEN), structure.blocks(col_text()))
    return found.select("doc_id", *long("chunk_id", "start", "end", "prefix_len"), F.sha2("content", 256).alias("content_sha256"))


@query("q_prompt", """select doc_id, sha256('List at most 30 corrections of spelling, spacing, punctuation and style in the text, as JSON with the key suggestions; ranges count characters from 0.' ||
    case when doc_id % 3 > 0 then ' The first ' || (doc_id % 3 * 10)::varchar || ' characters are context only: suggest nothing there.' else '' end || chr(10) || chr(10) || text) as prompt_sha256 from documents""")
def q_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(structure.prompt(col_text(), (F.col("doc_id") % 3 * 10).cast("int")), 256).alias("prompt_sha256"))


@query("q_sentence_span", """select doc_id, p::bigint as place, 0::bigint as "start", length(text)::bigint as "end" from (select doc_id, text, unnest(range(0, length(text), 500)) as p from documents)""")
def q_sentence_span(spark, sf_dir):
    places = docs(spark, sf_dir).where("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500))).alias("p"))
    found = places.select("doc_id", "p", structure.sentence_span(col_text(), F.col("p"), F.col("p") + 3).alias("s"))
    return found.select("doc_id", F.col("p").cast("long").alias("place"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("q_json_round_trip", f'select doc_id, ord::bigint as ord, rule::bigint as rule, "start"::bigint as "start", "end"::bigint as "end", original, replacement, title from ({_LOCAL})')
def q_json_round_trip(spark, sf_dir):
    """Rows written as one JSON answer a document and read again."""
    rows = rules.scan(docs(spark, sf_dir)).select("doc_id", "ord", "rule", "start", "end", "original", "replacement", "title")
    kind = "struct<suggestions:array<struct<ord:bigint,rule:bigint,start:bigint,end:bigint,original:string,replacement:string,title:string>>>"
    return as_json(rows).select("doc_id", F.inline(F.from_json("body", kind)["suggestions"]))


@query("q_revert", f"""select doc_id, sha256(text) as text_sha256 from documents where doc_id in (select doc_id from ({_LOCAL}) where rule = 7)""")
def q_revert(spark, sf_dir):
    """The first run of marks of each document reduced, and put back."""
    rows = gate.full_rows(rules.rule_rows(col_text(), rules.BY_NAME["repeated_punct"]))
    found = docs(spark, sf_dir).select("doc_id", "text", F.get(rows, F.lit(0)).alias("r")).where("r is not null")
    changed = found.withColumn("edited", edits.applied(col_text(), F.col("r")))
    return changed.select("doc_id", F.sha2(edits.reverted(F.col("edited"), F.col("r")), 256).alias("text_sha256"))


_FIRST = f"select doc_id, min(ord) as one from ({_LOCAL}) where category <> 'style' group by doc_id"


@query("q_apply_one", f"""select l.doc_id, l.ord::bigint as ord, (l."start" + m)::bigint as "start", (l."end" + m)::bigint as "end", applied from (select l.*, coalesce(l.ord = f.one, false) as applied,
    case when f.one is not null and l.ord <> f.one and l."start" >= o."end" then length(o.replacement) - (o."end" - o."start") else 0 end as m from ({_LOCAL}) l left join ({_FIRST}) f on f.doc_id = l.doc_id left join ({_LOCAL}) o on o.doc_id = f.doc_id and o.ord = f.one) l""")
def q_apply_one(spark, sf_dir):
    """The first correction of each document is applied; the rest moves."""
    every, one = _with_first(spark, sf_dir)
    return edits.apply_one(every, one).select("doc_id", *long("ord", "start", "end"), "applied")


@query("q_undo_one", f'select doc_id, ord::bigint as ord, "start"::bigint as "start", "end"::bigint as "end", false as applied from ({_LOCAL})')
def q_undo_one(spark, sf_dir):
    """The same and then undone: all rows are where they were, but for those that the applied one reached over."""
    every, one = _with_first(spark, sf_dir)
    return edits.apply_one(edits.apply_one(every, one), one, undo=True).select("doc_id", *long("ord", "start", "end"), "applied")


def _with_first(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = rules.scan(docs(spark, sf_dir)).withColumn("applied", F.lit(False)).select("doc_id", "ord", "start", "end", "original", "replacement", "applied", "category")
    return every, every.where("category <> 'style'").groupBy("doc_id").agg(F.min("ord").alias("ord"))


@query("q_split", f"""select doc_id, count(*) filter (category <> 'style') as corrections, count(*) filter (category = 'style') as style, bool_and(category = 'style' or "start" < 2000) as all_applied from ({_LOCAL}) group by doc_id""")
def q_split(spark, sf_dir):
    return edits.split(rules.scan(docs(spark, sf_dir)).withColumn("applied", F.col("start") < 2000))


@query("q_without_style", f'select l.doc_id, l.rule::bigint as rule, l."start"::bigint as "start", l."end"::bigint as "end" from ({_LOCAL}) l join ({O.selected(O.docs_view(), "category <> " + repr("style"))}) k using (doc_id, ord)')
def q_without_style(spark, sf_dir):
    kept = gate.select(gate.full_rows(rules.local_rows(col_text())), col_text(), Policy().with_settings({"proselens.enable_style": "false"}))
    return gate.as_rows(docs(spark, sf_dir), kept).select("doc_id", *long("rule", "start", "end"))


_DASHED = "replace(replace(text, ', ', ' - '), '. ', '... ')"


@query("q_style_verdict", f"""select doc_id, rule::bigint as rule, s::bigint as "start", case when regexp_matches(replacement, '[.,!?:;]') and regexp_matches(t[s], '\\pL') and regexp_matches(t[e + 1], '\\pL') then 'boundary'
    when len(regexp_extract_all(replacement, '\\pL')) > len(regexp_extract_all(original, '\\pL')) then 'adds_letters' when changed / greatest(tokens, 1) > 0.06 then 'too_much' end as reason from (
    select l.doc_id, l.rule, l."start" as s, l."end" as e, l.original, l.replacement, t.t, {O.TOKENS.replace("(t,", "(t.t,")} as tokens,
    case l.rule when 4 then {O.TOKENS.replace("(t,", "(l.original,")} - {O.TOKENS.replace("(t,", "(l.replacement,")} when 6 then 1 when 10 then 3 else 99 end as changed
    from ({O.local_rows(O.docs_view(expression=_DASHED))}) l join {O.docs_view(expression=_DASHED)} t on t.doc_id = l.doc_id where l.category = 'style')""")
def q_style_verdict(spark, sf_dir):
    d = docs(spark, sf_dir, _DASHED).select("doc_id", "text", T.token_count(col_text()).alias("n"), F.explode(F.filter(gate.full_rows(rules.local_rows(col_text())), lambda r: r["category"] == "style")).alias("r"))
    return d.select("doc_id", F.col("r.rule").cast("long").alias("rule"), F.col("r.start").cast("long").alias("start"), gate.style_verdict(F.col("r"), col_text(), F.col("n"))["reason"].alias("reason"))


_PARAGRAPHS = """select doc_id, case when i = 1 then 0 else pos[i - 1] + 4 end as s, case when i > len(pos) then n else pos[i] + 2 end as e, i from (select doc_id, n, pos, unnest(range(1, len(pos) + 2)) as i from (
    select doc_id, length(t) as n, list_filter(range(0, length(t)), lambda p: t[p + 1] = chr(10) and t[p + 2] = chr(10)) as pos from (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as t from documents)))"""


@query("q_paragraph_of", f"""select l.doc_id, l.ord::bigint as ord, coalesce(min(p.nth), 0)::bigint as paragraph from ({O.local_rows(O.docs_view(expression=_BROKEN))}) l left join (
    select doc_id, s, e, row_number() over (partition by doc_id order by i) - 1 as nth from ({_PARAGRAPHS}) where e > s) p on p.doc_id = l.doc_id and l."start" >= p.s and l."end" <= p.e group by l.doc_id, l.ord""")
def q_paragraph_of(spark, sf_dir):
    d = docs(spark, sf_dir, _BROKEN).select("doc_id", structure.paragraphs(col_text()).alias("p"), F.posexplode(rules.local_rows(col_text())).alias("ord", "r"))
    return d.select("doc_id", *long("ord"), structure.paragraph_of(F.col("r.start"), F.col("r.end"), F.col("p")).cast("long").alias("paragraph"))


@query("q_case_only", f"""select doc_id, ord::bigint as ord, (length(original) = length(replacement) and lower(original) = lower(replacement) and original <> replacement) as case_only from ({_LOCAL})""")
def q_case_only(spark, sf_dir):
    return rules.scan(docs(spark, sf_dir)).select("doc_id", *long("ord"), alignment.case_only(F.col("original"), F.col("replacement")).alias("case_only"))


@query("q_shift", f'select doc_id, ord::bigint as ord, ("start" + 100 * (doc_id % 3))::bigint as "start", ("end" + 100 * (doc_id % 3))::bigint as "end" from ({_LOCAL})')
def q_shift(spark, sf_dir):
    """Rows of a part of a text in the coordinates of the whole."""
    by = (F.col("doc_id") % 3 * 100).cast("int")
    return ranges.shift(rules.scan(docs(spark, sf_dir)), by).select("doc_id", *long("ord", "start", "end"))


@query("q_scoped", """select doc_id, case when real then low else 0 end::bigint as base, sha256(case when real then text[low + 1:high] else text end) as part_sha256 from (
    select *, high > low and high - low < length(text) as real from (select doc_id, text, greatest(0, least(doc_id % 700, length(text))) as low, greatest(0, least(doc_id % 1100, length(text))) as high from documents))""")
def q_scoped(spark, sf_dir):
    part = incremental.scoped(col_text(), (F.col("doc_id") % 700).cast("int"), (F.col("doc_id") % 1100).cast("int"))
    return docs(spark, sf_dir).select("doc_id", part.alias("s")).select("doc_id", F.col("s.base").cast("long").alias("base"), F.sha2("s.part", 256).alias("part_sha256"))


@query("q_for_all_copies", f'select doc_id, rule::bigint as rule, "start"::bigint as "start" from ({_LOCAL})')
def q_for_all_copies(spark, sf_dir):
    """Each text is scanned once, and its rows are those of all its copies."""
    once = incremental.distinct_texts(docs(spark, sf_dir))
    found = once.select("text_hash", "doc_id", F.explode(rules.local_rows(col_text())).alias("r")).select("text_hash", "doc_id", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("rule", "start")))
    return incremental.for_all_copies(docs(spark, sf_dir), found).select("doc_id", "rule", "start")


@query("q_current", "select user_id, event_id as version, event_type from events e where event_id = (select max(event_id) from events x where x.user_id = e.user_id)")
def q_current(spark, sf_dir):
    """Results that came too late are left out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("version"), "event_type")
    return incremental.current(events, events, "user_id").select("user_id", "version", "event_type")


@query("q_rejects", "select doc_id, case when length(t) = 0 then 400 else 413 end::bigint as status from (select doc_id, case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then repeat(text, 60) else text end as t from documents) where length(t) = 0 or length(t) > 100000")
def q_rejects(spark, sf_dir):
    d = docs(spark, sf_dir, "case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then repeat(text, 60) else text end")
    return rejects(d).select("doc_id", F.col("status").cast("long").alias("status"))


@query("q_cache_hits")
def q_cache_hits(spark, sf_dir):
    """Events as requests to one cache a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = events.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("text_key"))
    return incremental.cached(asked.withColumn("at", F.col("at") / 1e6), cap=3, seconds=36_000).select("node", "seq", "hit")


@query("q_conversation_rules", f"""select conv_id, turn, rule::bigint as rule, count(*) as n from (select conv_id, turn, r.rule from ({O.local_rows("(select conv_id * 1000000 + turn as doc_id, text as t from conversations)")}) r join conversations c on c.conv_id * 1000000 + c.turn = r.doc_id) group by conv_id, turn, rule""")
def q_conversation_rules(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text", "conv_id", "turn")
    found = turns.select("conv_id", "turn", F.explode(rules.local_rows(F.coalesce("text", F.lit("")))).alias("r"))
    return found.groupBy("conv_id", "turn", F.col("r.rule").cast("long").alias("rule")).agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysis reports on each document, by category and severity."""
    return analyse(docs(spark, sf_dir)).groupBy("category", "severity").agg(F.count("*").alias("n"))
