"""DuckDB SQL for the queries of the engine, written independently of the Spark expressions.

RE2 has no look-around and no back-references, so conditions on neighbours are tested after the match, and repeated
words are found over pairs of neighbouring words.
"""

from __future__ import annotations

SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
INLINE = SPACE.replace(r"\n", "")
WORDS = "recieve|accomodate|seperate|definately|occured|occurance"
SPELLED = "map {'recieve': 'receive', 'accomodate': 'accommodate', 'seperate': 'separate', 'definately': 'definitely', 'occured': 'occurred', 'occurance': 'occurrence'}"

#: How the texts of a rule's query are made from ``documents``, so that the rule has something to find.
VIEWS = {
    "multi_space": "replace(text, ', ', ',  ')",
    "space_before_punct": "replace(text, ',', ' ,')",
    "misspelling": "replace(text, ' the ', ' recieve ')",
    "em_dash": "replace(text, ', ', ' - ')",
    "ellipsis": "replace(text, '. ', '... ')",
    "colon_space": "replace(text, ', ', ':  ')",
    "space_after_punct": "replace(text, ', ', ',')",
}

# name: rule number, pattern, first of the span in the match, code points cut at its end, replacement of match m, condition
_PATTERNS = {
    "multi_space": (1, f"[{INLINE}]{{2,}}", 0, 0, "' '", "true"),
    "space_before_punct": (2, f"[{SPACE}]+[,.!?;:]", 0, 1, "''", "not regexp_matches(t[e + 1], '[A-Za-z0-9_]')"),
    "space_after_punct": (5, r"[,.!?;:]\pL", 0, 0, "m[1] || ' ' || m[2]", "true"),
    "capitalize": (6, rf"(?:^|[\n\r\x{{2028}}\x{{2029}}]|[.!?][{SPACE}]+)[a-z]", -1, 0, "upper(m[-1])", "true"),
    "repeated_punct": (7, r"\.{2,}|!{2,}|\?{2,}", 0, 0, "m[1]", "true"),
    "colon_space": (8, f":[{SPACE}]{{2,}}", 1, 0, "' '", "true"),
    "em_dash": (9, f"[^{SPACE}][{SPACE}]-[{SPACE}][^{SPACE}]", 1, 0, "m[1] || '—' || m[-1]", "true"),
    "ellipsis": (10, r"\.\.\.", 0, 0, "'…'", "true"),
    "misspelling": (11, rf"(?i)\b(?:{WORDS})\b", 0, 0, f"{SPELLED}[lower(m)]", "true"),
}
_TITLES = {1: ("Change the spacing", "spacing", "info"), 2: ("Use correct spacing", "spacing", "info"), 3: ("Punctuation mistake", "punctuation", "warn"), 4: ("Repeated word", "style", "info"), 5: ("Add space after punctuation", "spacing", "info"), 6: ("Capitalize sentence", "style", "info"), 7: ("Reduce punctuation", "punctuation", "info"), 8: ("Normalize colon spacing", "spacing", "info"), 9: ("Use an em dash", "style", "info"), 10: ("Use ellipsis character", "style", "info"), 11: ("Spelling", "spelling", "warn")}


def spans(docs: str, pattern: str) -> str:
    """(doc_id, t, m, s, e): all matches of a pattern in the texts t of a table."""
    return f"""select doc_id, t, m[k] as m, s, s + length(m[k]) as e from (
        select doc_id, t, m, k, (list_sum(list_transform(g[1:k], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda v: length(v))), 0))::bigint as s
        from (select doc_id, t, m, g, unnest(range(1, len(m) + 1)) as k from (
            select doc_id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from {docs})))"""


def rule(name: str, docs: str) -> str:
    """(doc_id, rule, start, end, original, replacement) of one rule over (doc_id, t)."""
    if name == "missing_period":
        return f"""select doc_id, 3 as rule, n as "start", length(t) as "end", t[n + 1:] as original, '.' || repeat(' ', length(t) - n) as replacement
            from (select doc_id, t, length(regexp_replace(t, '[{SPACE}]+$', '')) as n from {docs}) where n > 0 and t[n] not in ('.', '!', '?')"""
    if name == "repeated_word":
        word = "[A-Za-z0-9_]+"
        return f"""select doc_id, 4 as rule, s as "start", s + length(w) + length(gap) + length(nw) as "end", w || gap || nw as original, w as replacement from (
            select *, row_number() over (partition by doc_id, island order by k) as nth from (
                select *, k - row_number() over (partition by doc_id order by k) as island from (
                    select doc_id, k, w[k] as w, w[k + 1] as nw, g[k + 1] as gap,
                           (list_sum(list_transform(g[1:k], lambda v: length(v))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda v: length(v))), 0))::bigint as s
                    from (select doc_id, w, g, unnest(range(1, len(w))) as k from (select doc_id, regexp_extract_all(t, '{word}') as w, string_split_regex(t, '{word}') as g from {docs}))
                    where lower(w[k]) = lower(w[k + 1]) and regexp_full_match(g[k + 1], '[{SPACE}]+')))) where nth % 2 = 1"""
    number, pattern, first, cut, put, where = _PATTERNS[name]
    start = "e - 1" if first < 0 else f"s + {first}"
    return f"""select doc_id, {number} as rule, {start} as "start", e - {cut} as "end", t[{start} + 1:e - {cut}] as original, {put} as replacement from ({spans(docs, pattern)}) where {where}"""


def docs_view(name: str | None = None, expression: str | None = None) -> str:
    return f"(select doc_id, {expression or VIEWS.get(name, 'text')} as t from documents)"


def rule_query(name: str) -> str:
    return f"""select doc_id, "start"::bigint as "start", "end"::bigint as "end", original, replacement from ({rule(name, docs_view(name))})"""


def local_rows(docs: str) -> str:
    """All rules over (doc_id, t), with title, category and severity, numbered by start and rule."""
    every = " union all ".join(f"({rule(n, docs)})" for n in [*_PATTERNS, "missing_period", "repeated_word"])
    facts = ", ".join(f"({n}, '{t}', '{c}', '{s}')" for n, (t, c, s) in _TITLES.items())
    return f"""select r.*, f.title, f.category, f.severity, row_number() over (partition by doc_id order by "start", r.rule) - 1 as ord
        from ({every}) r join (values {facts}) as f(rule, title, category, severity) on r.rule = f.rule"""


#: Paragraph, token and other facts in DuckDB expressions over a text t.
TOKENS = rf"len(regexp_extract_all(t, '\pL+|[0-9]+|[^{SPACE}]'))"
LETTERS = r"len(regexp_extract_all(t, '\pL'))"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g')))"


def selected(docs: str, where: str = "true") -> str:
    """Rows kept by the ordered selection of local rows over (doc_id, t), as a fold over each document's list."""
    keyed = f"""select doc_id, list({{'s': "start", 'e': "end", 'o': ord, 'k': {norm("original")} || '|' || {norm("replacement")} || '|' || title}} order by ord) as l
        from ({local_rows(docs)}) where not (category = 'spacing' and regexp_matches(replacement, '\\pL')) and {where} group by doc_id"""
    fold = """list_reduce(list_prepend({'kept': [], 'x': null}, list_transform(l, lambda i: {'kept': [], 'x': i})),
        lambda a, b: {'kept': case when len(list_filter(a.kept, lambda o: (b.x.s < o.e and b.x.e > o.s) or (o.k = b.x.k and abs(o.s - b.x.s) <= 8))) > 0
                      then a.kept else list_append(a.kept, b.x) end, 'x': b.x}).kept"""
    return f"select doc_id, unnest({fold}).o as ord from ({keyed})"


def final(docs: str) -> str:
    """Local rows after selection and style gate, for texts without paragraph breaks of their own (or any, observed)."""
    return f"""with loc as materialized ({local_rows(docs)}),
    sel as materialized (select loc.* from loc join ({selected(docs)}) k using (doc_id, ord)),
    txt as (select doc_id, t, {TOKENS} as tokens, length(t) as n from {docs}),
    cnt as (select doc_id, count(*) filter (category in ('spacing', 'punctuation', 'spelling')) as correct, count(*) filter (category <> 'style') as others from sel group by doc_id),
    sty as (select s.*, x.tokens, x.n, x.t, c.correct, c.others,
            case s.rule when 4 then {TOKENS.replace("(t,", "(s.original,")} - {TOKENS.replace("(t,", "(s.replacement,")} when 6 then 1 when 10 then 3 else 99 end as changed
            from sel s join txt x using (doc_id) join cnt c using (doc_id) where category = 'style'),
    fit as (select *, row_number() over (partition by doc_id order by ord) as nth from sty
            where changed / greatest(tokens, 1) <= 0.06 and not (regexp_matches(replacement, '[.,!?:;]') and regexp_matches(coalesce(t["start"], ''), '\\pL') and regexp_matches(coalesce(t["end" + 1], ''), '\\pL')) and rule <> 9),
    cap as (select * from fit where nth <= case when others > 0 then 1 else (case when least(3, floor(0.15 * correct)) > 0 then least(3, floor(0.15 * correct)) else 3 end) * ceil(n / 1000.0) end)
    select doc_id, rule, "start", "end", original, replacement, category, severity, ord from sel where category <> 'style'
    union all select doc_id, rule, "start", "end", original, replacement, category, severity, ord from cap"""
