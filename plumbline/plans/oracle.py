"""What the queries return, in DuckDB's SQL. Expressions of their own; only the word lists and patterns are shared."""

from __future__ import annotations

from plumbline.functions import features as f
from plumbline.functions.text import ABBREVIATION, INNER_STOP, PIECE
from plumbline.plans.planted import PLANTED_SQL, q
from plumbline.rules import CODED, EM_DASH, LEXICON, PARTICIPLE, REWRITES, RULES, SEVERITIES, TRICOLON, Rule, pack
from plumbline.settings import BIAS, DIMENSIONS, ELEVATED, GAINS, HUMAN, LONE_WEAK, MODEL, MODEL_A, MODEL_B, MODEL_BIAS, PROFILES, WEAK, WEIGHTS

_WORDS = "len(regexp_extract_all({0}, '\\S+'))"
#: Expressions that RE2 needs in place of look-around.
_RE2 = {
    "CLAIM_AUTHORITY_NO_CITATION": (
        r"(?im)\b(?:data|evidence|research|science|studies) (?:confirm|demonstrate|prove|reveal|show)s? (?:that )?",
        r"(?im)\b(?:data|evidence|research|science|studies) (?:confirm|demonstrate|prove|reveal|show)s? (?:that )?[^.?!]{0,80}?(?:et al|https?://|\(\d{4}|\[)",
    ),
    "PARALLEL_X_NOT_Y": (r"(?im)(?:^|[.!?:]\s|\*\*)[A-Z][^.?!,;:]{1,30},\s+not\s+[^.?!,;:]{1,30}[.!?]", None),
}


def count(regex: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, {q(regex)}))"


def rule(r: Rule) -> str:
    if r.rule_id in _RE2:
        base, less = _RE2[r.rule_id]
        # a stop that ends one slogan may stand before the next, so stops are doubled
        text = "regexp_replace(t, '([.!?:])(\\s)', '\\1\\2\\1\\2', 'g')" if r.rule_id == "PARALLEL_X_NOT_Y" else "t"
        return f"({count(base, text)}{f' - {count(less)}' if less else ''})"
    return count(f"(?im){r.regex}")


def _list(words: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def cleaned(source: str = PLANTED_SQL, table: str = "planted", keys: str = "doc_id, lang, source") -> str:
    """CTEs up to d(keys, original, t, low, w, sents)."""
    sents = f"regexp_replace(regexp_replace(t, {q(ABBREVIATION)}, E'\\\\1․', 'g'), {q(INNER_STOP)}, E'․\\\\1', 'g')"
    return f"""WITH {source},
    a AS MATERIALIZED (SELECT {keys}, regexp_replace(translate(CASE WHEN contains(text, '&') AND NOT contains(text, '<') THEN {_ENTITIES.format('text')} ELSE text END, '“”„‘’‚', '\"\"\"'''''''), E'\\r\\n?', E'\\n', 'g') AS original FROM {table}),
    b AS MATERIALIZED (SELECT *, regexp_replace(original, E'[ \\t]+', ' ', 'g') AS t FROM a),
    d AS MATERIALIZED (SELECT *, lower(t) AS low, {_WORDS.format('t')} AS w, list_filter(list_transform(regexp_extract_all({sents}, {q(PIECE)}), lambda x: translate(x, '․', '.')), lambda x: regexp_matches(x, '\\S')) AS sents FROM b)"""


def rate(amount: str, full: float) -> str:
    return f"CASE WHEN w > 0 THEN least(1.0::DOUBLE, ({amount}) * 100.0::DOUBLE / w / {full}::DOUBLE) ELSE 0.0::DOUBLE END"


def weighted(dimension: str) -> str:
    return " + ".join(f"{SEVERITIES[r.severity]} * {rule(r)}" for r in pack(dimension))


def _lexical(profile: str) -> str:
    groups: dict[float, list[str]] = {}
    for c in LEXICON:
        groups.setdefault(c.weight_in(profile), []).extend(c.terms)
    case = "CASE " + " ".join(f"WHEN x IN {_list(t)} THEN {w}::DOUBLE" for w, t in groups.items()) + " ELSE 0.0::DOUBLE END"
    every = _list([t for c in LEXICON for t in c.terms])
    toks = "string_split_regex(lower(s), '[^\\p{L}\\p{N}_]+')"
    return rate(f"list_sum(list_transform(sents, lambda s: coalesce(list_sum(list_transform({toks}, lambda x: {case})), 0) + CASE WHEN len(list_filter({toks}, lambda x: x IN {every})) >= 3 THEN 0.5 ELSE 0 END))", 4.0)


def _superficial() -> str:
    pairs = f"list_zip(regexp_extract_all(t, {q(f.PARTICIPLE)}, 1), regexp_extract_all(t, {q(f.PARTICIPLE)}, 2))"
    keep = f"lower(x[1]) IN {_list(f.ANALYSIS)} OR list_has_any(string_split_regex(lower(x[2]), '[^a-z]+'), [{', '.join(map(q, f.VAGUE))}])"
    return f"len(list_filter({pairs}, lambda x: {keep}))"


def _tricolons() -> str:
    w = r"[\p{L}\p{N}_]+"
    group = [f"regexp_extract_all(t, {q(f'({w}), ({w}),? and ({w})')}, {k})" for k in (1, 2, 3)]
    one = lambda k: f"(CASE WHEN len(x[{k}]) > 4 AND regexp_matches(lower(x[{k}]), {q(f.ABSTRACT)}) THEN 1 ELSE 0 END)"
    return f"len(list_filter(list_zip({', '.join(group)}), lambda x: {one(1)} + {one(2)} + {one(3)} >= 2))"


def dims(profile: str = "blog") -> dict[str, str]:
    """Each dimension but redundancy, over d."""
    lengths = f"list_transform(sents, lambda s: {_WORDS.format('s')}::DOUBLE)"
    dash, comma, curly, straight = (count(x) for x in (f.DASH, f.COMMA, f.CURLY, f.STRAIGHT))
    repeats = " + ".join(f"0.5 * greatest({rule(r)} - 1, 0)" for r in pack("formulaic_structure"))
    proper = "len(regexp_extract_all(regexp_replace(t, '([a-z,;:])(\\s)', '\\1\\2\\1\\2', 'g'), '[a-z,;:]\\s\\p{Lu}\\p{Ll}+'))"
    out = {
        "cadence_sameness": f"CASE WHEN len(sents) >= 3 THEN greatest(0.0::DOUBLE, 1 - list_stddev_pop({lengths}) / list_avg({lengths}) / 0.6) ELSE 0.0::DOUBLE END",
        "formatting_tells": f"least(1.0::DOUBLE, 0.6::DOUBLE * CASE WHEN {dash} >= 2 THEN least(1.0::DOUBLE, {dash}::DOUBLE / ({dash} + {comma}) / 0.25) ELSE 0 END + 0.4::DOUBLE * CASE WHEN {curly} >= 2 THEN {curly}::DOUBLE / ({curly} + {straight}) ELSE 0 END)",
        "formulaic_structure": rate(f"{weighted('formulaic_structure')} + {repeats}", 3.0),
        HUMAN: rate(f"{count(f.PLAIN_VERBS)} + 1.5 * {count(f.SUPERLATIVES)} + {count(f.HEDGES)} + {count(f.CONCRETE)}", 6.0),
        "lexical_markers": _lexical(profile),
        "prompt_residue": f"least(1.0::DOUBLE, ({weighted('prompt_residue')})::DOUBLE / 4)",
        "genericity": f"1 - least(1.0::DOUBLE, ({count(f.NUMBER)} + {count(f.YEAR)} + {count(f.URL)} + {proper})::DOUBLE / greatest(len(sents), 1) / 1.5)",
        "superficial_analysis": rate(_superficial(), 2.0),
        "parallelism": rate(f"{weighted('parallelism')} + {_tricolons()}", 3.0),
    }
    for d in ("significance_inflation", "weasel_attribution", "unsupported_claims", "copula_avoidance"):
        out[d] = rate(weighted(d), f.FULL[d])
    return out


REDUNDANCY = """
    rs AS (SELECT doc_id, unnest(sents) AS s, generate_subscripts(sents, 1) AS i FROM d),
    rw AS (SELECT doc_id, i, regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]{2,}') AS ws FROM rs),
    rt AS (SELECT doc_id, i, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS term FROM rw),
    tf AS (SELECT doc_id, i, term, count(*) AS k FROM rt GROUP BY ALL),
    df AS (SELECT doc_id, term, count(*) AS k FROM tf GROUP BY ALL),
    ns AS (SELECT doc_id, len(sents) AS n FROM d),
    wt AS (SELECT tf.doc_id, tf.i, tf.term, tf.k * (ln((1 + ns.n)::DOUBLE / (1 + df.k)) + 1) AS x FROM tf JOIN df USING (doc_id, term) JOIN ns USING (doc_id)),
    nm AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm FROM wt GROUP BY ALL),
    cs AS (SELECT a.doc_id, a.i, sum(a.x * b.x) / any_value(na.norm * nb.norm) AS cos FROM wt a JOIN wt b ON a.doc_id = b.doc_id AND a.term = b.term AND b.i = a.i + 1
           JOIN nm na ON na.doc_id = a.doc_id AND na.i = a.i JOIN nm nb ON nb.doc_id = b.doc_id AND nb.i = b.i GROUP BY a.doc_id, a.i),
    rd AS MATERIALIZED (SELECT ns.doc_id, CASE WHEN ns.n >= 2 THEN count(cs.cos) FILTER (cs.cos >= 0.6 - 1e-12)::DOUBLE / (ns.n - 1) ELSE 0.0::DOUBLE END AS redundancy FROM ns LEFT JOIN cs USING (doc_id) GROUP BY ns.doc_id, ns.n)"""


def dimension(name: str, profile: str = "blog") -> str:
    return f"{cleaned()} SELECT doc_id, round({dims(profile)[name]}, 6) AS {name} FROM d"


def scores(profile: str = "blog", strictness: str = "conservative", scorer: str = "rules", base: str | None = None) -> str:
    """CTEs up to s: dimensions, n_elevated, slop_score, label, abstained, confidence."""
    columns = ", ".join(f"{e} AS {n}" for n, e in dims(profile).items())
    elevated = " + ".join(f"({d} > {ELEVATED})::INT" for d in DIMENSIONS if d != HUMAN)
    if scorer == "rules":
        z = f"{BIAS}::DOUBLE"
        for d, w in WEIGHTS.items():
            part = f"{w * PROFILES.get(profile, {}).get(d, 1.0)!r}::DOUBLE * {d}"
            z += f" + CASE WHEN {d} > {ELEVATED} AND n_elevated = 1 THEN {LONE_WEAK}::DOUBLE * ({part}) ELSE {part} END" if d in WEAK else f" + {part}"
        z = f"({z}) * {GAINS[strictness]}::DOUBLE"
    else:
        z = f"{MODEL_BIAS}::DOUBLE" + "".join(f" + {w}::DOUBLE * {d}" for d, w in MODEL.items())
        z = f"{MODEL_A}::DOUBLE * ({z}) + {MODEL_B}::DOUBLE"
    return f"""{base or cleaned()}, {REDUNDANCY},
    e0 AS MATERIALIZED (SELECT doc_id, w, original, CASE WHEN w < 20 OR lang IS NULL THEN 'en' ELSE lower(lang) END AS language, CASE WHEN w < 20 THEN 0.5 ELSE 1.0 END AS lc, {columns} FROM d),
    e1 AS MATERIALIZED (SELECT e0.*, redundancy FROM e0 JOIN rd USING (doc_id)),
    e2 AS MATERIALIZED (SELECT *, {elevated} AS n_elevated FROM e1),
    e3 AS MATERIALIZED (SELECT *, round_even(100 / (1 + exp(-({z}))), 1) AS slop_score FROM e2),
    s AS MATERIALIZED (SELECT *, w < 100 OR language <> 'en' AS abstained,
        CASE WHEN slop_score < 25 THEN 'low' WHEN slop_score < 50 OR w < 100 OR language <> 'en' THEN 'mild' WHEN slop_score < 75 THEN 'elevated' ELSE 'severe' END AS label,
        round_even(CASE WHEN w < 100 THEN 0.25 WHEN w < 300 THEN 0.6 WHEN w < 1000 THEN 0.85 ELSE 1 END::DOUBLE * CASE WHEN language <> 'en' THEN 0.5 WHEN lc < 0.7 THEN 0.8 ELSE 1 END, 3) AS confidence FROM e3)"""


def _meta(order: int, rule_id: str, dimension: str, severity: str, regex: str) -> str:
    return f"({order}, {q(rule_id)}, {q(dimension)}, {q(severity)}, {q(regex)})"


#: What follows an unsupported claim that has a source after all.
_CITED = r"(?i)^[^.?!]{0,80}?(?:et al|https?://|\(\d{4}|\[)"
_SLOGAN = r"(?i)^[A-Z][^.?!,;:]{1,30},\s+not\s+[^.?!,;:]{1,30}[.!?]"
_TRICOLON = r"([\p{L}\p{N}_]+), ([\p{L}\p{N}_]+),? and ([\p{L}\p{N}_]+)"


def matches(rules: list[Rule] | None = None, cte: str = "ev") -> str:
    """CTE of all matches (doc_id, ord, n, rule_id, dimension, severity, start_char, end_char, span) in original offsets: of these rules, or of all there are.

    Look-around is said by what stands before or after a match; clauses and threes are kept by a look at their parts.
    """
    everything = rules is None
    at = {d: k * 1000 for k, d in enumerate(DIMENSIONS)}
    known = list(enumerate(RULES)) if everything else list(enumerate(rules))
    rows = [_meta(at.get(r.dimension, 14_000) + k, r.rule_id, r.dimension, r.severity, "(?im)" + _RE2.get(r.rule_id, (r.regex,))[0].removeprefix("(?im)")) for k, r in known if r.rule_id != "PARALLEL_X_NOT_Y"]
    extra = ""
    if everything:
        for k, c in enumerate(LEXICON):
            rows.append(_meta(at["lexical_markers"] + k, c.rule_id, "lexical_markers", c.severity, rf"(?i)\b(?:{'|'.join(sorted(c.terms, key=lambda t: (-len(t), t)))})\b"))
        rows.append(_meta(at["superficial_analysis"], PARTICIPLE, "superficial_analysis", CODED[PARTICIPLE][1], f.PARTICIPLE))
        rows.append(_meta(at["parallelism"] + 900, TRICOLON, "parallelism", CODED[TRICOLON][1], _TRICOLON))
        slogan = next((k, r) for k, r in known if r.rule_id == "PARALLEL_X_NOT_Y")
        dash = f"least(coalesce(nullif(strpos(t, '—'), 0), 2147483647), coalesce(nullif(strpos(t, '–'), 0), 2147483647)) - 1"
        extra = f"""
    UNION ALL SELECT doc_id, original, t, gone, {at['formatting_tells']} AS ord, {q(EM_DASH)}, 'formatting_tells', {q(CODED[EM_DASH][1])}, 0 AS n, {dash} AS a, 1 AS len FROM gn WHERE {count(f.DASH)} >= 2
    UNION ALL SELECT doc_id, original, t, gone, {at['parallelism'] + slogan[0]} AS ord, {q(slogan[1].rule_id)}, 'parallelism', {q(slogan[1].severity)}, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1, a, len(regexp_extract(substring(t, a::INT + 1), {q(_SLOGAN)})) FROM
        (SELECT *, unnest(range(0, len(t))) AS a FROM gn WHERE regexp_matches(t, {q(_RE2['PARALLEL_X_NOT_Y'][0])}))
        WHERE (a = 0 OR substring(t, a::INT, 1) = E'\\n' OR regexp_matches(substring(t, a::INT - 1, 2), '^(?:[.!?:]\\s|\\*\\*)$') AND a > 1) AND regexp_matches(substring(t, a::INT + 1), {q(_SLOGAN)})"""
    one = lambda k: f"(CASE WHEN len(regexp_extract(m, {q(_TRICOLON)}, {k})) > 4 AND regexp_matches(lower(regexp_extract(m, {q(_TRICOLON)}, {k})), {q(f.ABSTRACT)}) THEN 1 ELSE 0 END)"
    vague = f"lower(regexp_extract(m, {q(f.PARTICIPLE)}, 1)) IN {_list(f.ANALYSIS)} OR list_has_any(string_split_regex(lower(regexp_extract(m, {q(f.PARTICIPLE)}, 2)), '[^a-z]+'), [{', '.join(map(q, f.VAGUE))}])"
    keep = f"""CASE rule_id WHEN {q(PARTICIPLE)} THEN {vague} WHEN {q(TRICOLON)} THEN {one(1)} + {one(2)} + {one(3)} >= 2
        WHEN 'CLAIM_AUTHORITY_NO_CITATION' THEN NOT regexp_matches(substring(t, (a + len)::INT + 1), {q(_CITED)}) ELSE true END"""
    parts = "regexp_extract_all(original, E'\\r\\n|[ \\t]{2,}')"
    gaps = "string_split_regex(original, E'\\r\\n|[ \\t]{2,}')"
    return f"""rl(ord, rule_id, dimension, severity, regex) AS (VALUES {', '.join(rows)}),
    gn AS MATERIALIZED (SELECT doc_id, original, t, list_transform(range(1, len({parts}) + 1), lambda i: {{'at': coalesce(list_sum(list_transform(({gaps})[1:i], lambda g: len(g))), 0) + i - 1, 'extra': len(({parts})[i]) - 1}}) AS gone FROM d),
    m0 AS MATERIALIZED (SELECT doc_id, original, t, gone, ord, rule_id, dimension, severity, regexp_extract_all(t, regex) AS ms, string_split_regex(t, regex) AS gs FROM gn, rl WHERE regexp_matches(t, regex)),
    m1 AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m0),
    m2 AS (SELECT *, coalesce(list_sum(list_transform(gs[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: len(g))), 0) AS a, len(ms[i]) AS len, ms[i] AS m FROM m1),
    mk AS (SELECT doc_id, original, t, gone, ord, rule_id, dimension, severity, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY i) - 1 AS n, a, len FROM m2 WHERE {keep}{extra}),
    m3 AS (SELECT *, a + coalesce(list_sum(list_transform(list_filter(gone, lambda g: g.at < a), lambda g: g.extra)), 0) AS s0, a + len + coalesce(list_sum(list_transform(list_filter(gone, lambda g: g.at < a + len - 1), lambda g: g.extra)), 0) AS e0 FROM mk),
    {cte} AS MATERIALIZED (SELECT doc_id, original, ord, n, rule_id, dimension, severity, s0::INT AS start_char, e0::INT AS end_char, substring(original, s0::INT + 1, (e0 - s0)::INT) AS span FROM m3)"""


#: CTEs up to rg(doc_id, s, e, names): the ranges that control comments silence. Lines, blocks and files are read off the text.
SUPPRESSION = r"""
    c0 AS (SELECT doc_id, original, regexp_extract_all(original, '(?i)<!--\s*plumbline-(?:disable-file|disable-line|disable-next-line|disable|enable)\b[^>]*?-->') AS ms, string_split_regex(original, '(?i)<!--\s*plumbline-(?:disable-file|disable-line|disable-next-line|disable|enable)\b[^>]*?-->') AS gs FROM d),
    c1 AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM c0),
    c2 AS (SELECT doc_id, original, i, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: len(g))), 0))::INT AS s FROM c1),
    c3 AS (SELECT doc_id, original, i, s, s + len(m) AS e, lower(regexp_extract(m, '(?i)plumbline-([a-z-]+)', 1)) AS kind, list_filter(string_split_regex(regexp_extract(m, '(?i)plumbline-(?:disable-file|disable-line|disable-next-line|disable|enable)\b([^>]*?)-->', 1), '[,\s]+'), lambda x: x <> '') AS names FROM c2),
    c4 AS MATERIALIZED (SELECT *, s - len(list_last(string_split(substring(original, 1, s), chr(10)))) AS line, s + len(string_split(substring(original, s + 1), chr(10))[1]) AS stop, len(original) AS size FROM c3),
    rg AS MATERIALIZED (
        SELECT doc_id, s, size AS e, names FROM c4 WHERE kind = 'disable-file' UNION ALL SELECT doc_id, line, stop, names FROM c4 WHERE kind = 'disable-line'
        UNION ALL SELECT doc_id, CASE WHEN stop < size THEN stop + 1 ELSE 0 END, CASE WHEN stop < size THEN stop + 1 + len(string_split(substring(original, stop::INT + 2), chr(10))[1]) ELSE 0 END, names FROM c4 WHERE kind = 'disable-next-line'
        UNION ALL SELECT a.doc_id, a.e, coalesce(min(b.s), any_value(a.size)), any_value(a.names) FROM c4 a LEFT JOIN c4 b ON a.doc_id = b.doc_id AND b.i > a.i AND b.kind = 'enable' AND (len(b.names) = 0 OR list_has_any(b.names, a.names)) WHERE a.kind = 'disable' GROUP BY a.doc_id, a.i, a.e)"""
QUIET = "EXISTS (SELECT 1 FROM rg WHERE rg.doc_id = ev.doc_id AND rg.s <= ev.start_char AND ev.start_char < rg.e AND (len(rg.names) = 0 OR list_contains(rg.names, ev.rule_id) OR list_contains(rg.names, ev.dimension)))"


REWRITE_RULES = [r.rule for r in REWRITES]
