"""The scorers' tokens and alignments as SQL expressions, for comparison with another engine."""

from __future__ import annotations

import unicodedata

from ..functions import spellings
from ..functions.lexicon import BRACKETED_WORDS, CANONICAL, CLITIC_S, FILLERS, NASAL_VARIANTS, NOT_SPELLING, SMALL_FORMS, UNCLEAR

#: Compatibility forms of single ASCII letters and digits, by rule, and of fractions and ligatures.
_FORMS = [
    (c, n)
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)])
    if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii() and n.isalnum()
]
_LIGATURES = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, [*range(0xBC, 0xBF), *range(0x2150, 0x215F), *range(0xFB00, 0xFB07)])]

# An alignment's matrix is made row by row, each cell one number of cost (from bit 48), how it was reached (46: diagonal,
# deletion, insertion, in this order), substitutions (37), masks without a word (32) and true positives of four kinds.
_UNIT, _SUB, _FREE = 1 << 48, (1 << 48) + (1 << 37), 1 << 32
_SHIFTS = {"fillers": 24, "fragments": 16, "repetitions": 8, "small_forms": 0}


def _quoted(words) -> str:
    return ", ".join(f"'{x}'" for x in words)


def folded(text: str) -> str:
    """Compatibility forms of letters and digits unified and composed, as far as tokens of ASCII letters show it."""
    out = f"translate({text}, '{''.join(c for c, _ in _FORMS)}', '{''.join(n for _, n in _FORMS)}')"
    for c, n in _LIGATURES:
        out = f"replace({out}, '{c}', '{n}')"
    return f"nfc_normalize({out})"


def aligned(source: str, fillers: list[str], masked: bool = False, name: str = "al") -> str:
    """CTEs that align the lists r and h of ``source`` (pred_id, system, mode, corpus, r, h): rows of counts called ``name``."""
    bits = f"CASE WHEN list_contains([{_quoted(fillers)}], t) THEN {1 << 24} ELSE 0 END + CASE WHEN t[-1] = '-' THEN {1 << 16} ELSE 0 END + CASE WHEN list_contains([{_quoted(SMALL_FORMS)}], t) THEN 1 ELSE 0 END"
    # a token: its number, whether it repeats the one before, its events, 1 for a mask, 2 for 's, 3 for is and has
    row = f"list_transform({{0}}, lambda t, i: [CAST(hash(t) // 4 AS BIGINT), CASE WHEN i > 1 AND {{0}}[i - 1] = t THEN 1 ELSE 0 END, CAST({bits} AS BIGINT), CASE t WHEN '{UNCLEAR}' THEN 1 WHEN '{CLITIC_S}' THEN 2 WHEN 'is' THEN 3 WHEN 'has' THEN 3 ELSE 0 END])"
    free = "x[4] = 1 OR (x[4] = 2 AND y[4] = 3) OR (x[4] = 3 AND y[4] = 2)" if masked else "FALSE"
    gone = f"CASE WHEN x[4] = 1 THEN {_FREE} ELSE {_UNIT} END" if masked else str(_UNIT)
    inner = f"""list_reduce(hc, lambda a, y: list_append(a, least(
      acc[len(a)] + CASE WHEN y[1] = x[1] THEN x[3] + CASE WHEN x[2] = 1 AND y[2] = 1 THEN 256 ELSE 0 END WHEN {free} THEN 0 ELSE {_SUB} END,
      acc[len(a) + 1] + {gone} + {1 << 46}, a[len(a)] + {_UNIT + (2 << 46)}) & {~(3 << 46)}), [acc[1] + {gone}])"""
    count = lambda side, what: f"len(list_filter({side}, lambda x: {what}))"
    kinds = {"fillers": f"(x[3] // {1 << 24}) % 256 > 0", "fragments": f"(x[3] // {1 << 16}) % 256 > 0", "repetitions": "x[2] = 1", "small_forms": "x[3] % 256 > 0"}
    events = ", ".join(f"{count('rc', w)} AS {k}_ref, {count('hc', w)} AS {k}_hyp, (v >> {_SHIFTS[k]}) & 255 AS {k}_tp" for k, w in kinds.items())
    more = "len(hc) - len(rc) + free"
    return f"""{name}_c AS (SELECT pred_id, system, mode, corpus, {row.format("r")} AS rc, {row.format("h")} AS hc FROM {source}),
{name}_m AS (SELECT *, list_reduce(rc, lambda acc, x: {inner}, list_transform(range(0, len(hc) + 1), lambda j: CAST(j AS BIGINT) * {_UNIT}))[-1] AS v FROM {name}_c),
{name}_v AS (SELECT *, v >> 48 AS cost, (v >> 37) & 511 AS subs, (v >> 32) & 31 AS free FROM {name}_m),
{name} AS (SELECT pred_id, system, mode, corpus, {count("rc", "x[4] <> 1") if masked else "len(rc)"} AS units, {count("rc", "x[4] = 1")} AS unclear, subs, (cost - subs - ({more})) // 2 AS dels, (cost - subs + ({more})) // 2 AS ins, {events} FROM {name}_v)"""


def events(rows: str, nullable: bool) -> str:
    """CTEs of precision, recall and F1 by system and kind, called ``ev``."""
    none = "WHEN reference + hypothesis = 0 THEN NULL" if nullable else ""
    kinds = " UNION ALL ".join(
        f"SELECT system, '{k}' AS kind, CAST(sum({k}_ref) AS BIGINT) AS reference, CAST(sum({k}_hyp) AS BIGINT) AS hypothesis, CAST(sum({k}_tp) AS BIGINT) AS true_positive FROM {rows} GROUP BY system" for k in _SHIFTS
    )
    return f"""ev_k AS ({kinds}),
ev_r AS (SELECT *, CASE {none} WHEN hypothesis = 0 THEN 0.0 ELSE true_positive / hypothesis END AS precision, CASE {none} WHEN reference = 0 THEN 0.0 ELSE true_positive / reference END AS recall FROM ev_k),
ev AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ev_r)"""


def canonical_word(w: str) -> str:
    """The canonical spelling of a folded word."""
    table = lambda d: "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in d.items()) + "}"
    ise = spellings.ISE.pattern
    stem, ending = (f"regexp_extract({w}, '^(.*?){ise}', {i})" for i in (1, 2))
    suffix = f"CASE WHEN regexp_matches({w}, '{ise}') AND length({stem}) > 2 AND NOT list_contains([{_quoted(sorted(spellings.NOT_ISE))}], {stem}) THEN {stem} || 'iz' || {ending} ELSE {w} END"
    yse = f"regexp_matches({w}, '[a-z]{{3}}lys(e[drs]?|ers|ing)$') AND NOT regexp_matches({w}, '{ise}')"
    rules = " ".join(f"WHEN regexp_matches(x, '{p.pattern}') THEN regexp_replace(x, '{p.pattern}', '{to}')" for p, to in spellings.RULES)
    digraph = spellings.DIGRAPH.pattern
    prefix = f"regexp_extract(x, '{digraph}')"
    common = f"list_transform([{suffix}], lambda x: CASE {rules} WHEN regexp_matches(x, '{digraph}') THEN regexp_replace({prefix}, '[ao]e', 'e', 'g') || x[length({prefix}) + 1 :] ELSE x END)[1]"
    form = f"CASE WHEN {w} IN ({_quoted(spellings.SINGLE)}) THEN {table(spellings.SINGLE)}[{w}] WHEN {yse} THEN regexp_replace({w}, 'ys(e[drs]?|ers|ing)$', 'yz\\1') ELSE {common} END"
    return f"CASE WHEN {w} IN ({_quoted(CANONICAL)}) THEN {table(CANONICAL)}[{w}] WHEN {w} IN ({_quoted(NOT_SPELLING)}) THEN {w} ELSE list_transform([{form}], lambda y: coalesce({table(CANONICAL)}[y], y))[1] END"


_PIECE = "<unclear>|[a-z0-9]+(?:''[a-z0-9]+)*(?:-[a-z0-9]+(?:''[a-z0-9]+)*)*-?"
_INITIALS = r"\b(?:[A-Z](?:\s*[.-]\s*|\s+)){1,7}[A-Z]\b\.?"
#: Longest span of unclear words that is spelled out; the tables' are shorter.
_MOST_UNCLEAR = 12


def canonical(values: str) -> str:
    """CTEs with the canonical tokens ``verbatim`` and ``conventional`` of each distinct ``t`` of the CTE ``values``, called ``ct``."""
    letters = "regexp_replace(z[2], '[^A-Z]', '', 'g')"
    pieces = f"list_zip(string_split_regex(t, '{_INITIALS}'), regexp_extract_all(t, '{_INITIALS}'))"
    joined = f"array_to_string(list_transform({pieces}, lambda z: z[1] || coalesce(CASE WHEN len(list_distinct(string_split({letters}, ''))) < 2 THEN z[2] ELSE {letters} END, '')), '')"
    text = f"strip_accents(replace(lower({folded(joined)}), '’', ''''))"
    for n in range(1, _MOST_UNCLEAR + 1):
        number = r"(?:\s+1)?" if n == 1 else rf"\s+{n}"
        text = rf"regexp_replace({text}, '\[\s*unclear{number}\s*\]', '{' <unclear>' * n} ', 'g')"
    text = rf"regexp_replace({text}, '\[\s*({'|'.join(BRACKETED_WORDS)})\s*\]', ' \1 ', 'g')"
    text = rf"regexp_replace({text}, '\[[^\]]+\]', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '\bm+\s+h+m+\b', 'mm-hmm', 'g'), '\buh+\s+huh+\b', 'uh-huh', 'g')"
    return f"""ct_v AS (SELECT DISTINCT t FROM {values} WHERE t IS NOT NULL),
ct_p AS (SELECT t, regexp_extract_all({text}, '{_PIECE}') AS p FROM ct_v),
ct_q AS (SELECT t, flatten(list_transform(p, lambda x: CASE WHEN list_contains([{_quoted(NASAL_VARIANTS)}], x) THEN ['mm'] WHEN x = 'uh-huh' OR x = '<unclear>' OR NOT contains(x, '-') OR x[-1] = '-' THEN [x] ELSE list_filter(string_split(x, '-'), lambda y: y <> '') END)) AS q FROM ct_p),
ct_d AS (SELECT DISTINCT CASE WHEN w[-1] = '-' THEN w[: -2] ELSE w END AS w FROM (SELECT unnest(q) AS w FROM ct_q)),
ct_w AS (SELECT w, {canonical_word("w")} AS c FROM ct_d),
ct_u AS (SELECT t, generate_subscripts(q, 1) AS i, unnest(q) AS x FROM ct_q),
ct_j AS (SELECT t, list(CASE WHEN x IN ('uh-huh', 'mm', '<unclear>') THEN x WHEN x[-1] = '-' THEN c || '-' ELSE c END ORDER BY i) AS verbatim FROM ct_u JOIN ct_w ON w = CASE WHEN x[-1] = '-' THEN x[: -2] ELSE x END GROUP BY t),
ct_e AS (SELECT t, coalesce(verbatim, []) AS verbatim FROM ct_q LEFT JOIN ct_j USING (t)),
ct_s AS (SELECT *, list_filter(flatten(list_transform(verbatim, lambda x: CASE WHEN ends_with(x, '''s') AND length(x) > 2 THEN [x[: -3], '{CLITIC_S}'] WHEN x = 'em' THEN ['them'] ELSE [x] END)), lambda x: x = '{UNCLEAR}' OR NOT (list_contains([{_quoted(FILLERS)}], x) OR x[-1] = '-')) AS s FROM ct_e),
ct AS (SELECT t, verbatim, list_filter(s, lambda x, i: x = '{UNCLEAR}' OR i = 1 OR s[i - 1] <> x) AS conventional FROM ct_s)"""


def pairs(field: str, name: str) -> str:
    """CTE of pairs of canonical tokens, called ``name``, from the CTEs of ``start``."""
    return f"{name} AS (SELECT pred_id, system, mode, corpus, coalesce(a.{field}, []) AS r, coalesce(b.{field}, []) AS h FROM cp LEFT JOIN ct a ON a.t = reference LEFT JOIN ct b ON b.t = hypothesis)"


def start() -> str:
    """CTEs of the predictions, once each, and the canonical tokens of their texts."""
    return f"""cp AS (SELECT DISTINCT pred_id, system, mode, corpus, example_id, blind_id, reference, hypothesis FROM predictions WHERE reference IS NOT NULL),
cv AS (SELECT reference AS t FROM cp UNION SELECT hypothesis FROM cp), {canonical("cv")}"""


def one(field: str, then: str = "") -> str:
    """The start, its pairs of one kind, and their alignment ``al``."""
    return f"WITH {start()}, {pairs(field, 'pv')}, {aligned('pv', FILLERS, True)}{then}"


def micro(rows: str, by: str) -> str:
    s = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
    return f"SELECT {by}, count(*) AS examples, {', '.join(map(s, ('units', 'subs', 'dels', 'ins')))}, (coalesce(sum(subs), 0) + coalesce(sum(dels), 0) + coalesce(sum(ins), 0)) / greatest(coalesce(sum(units), 0), 1) AS error_rate FROM {rows} GROUP BY {by}"


def scored() -> str:
    """One row per prediction with units and errors of words, conventional words and characters, called ``e``."""
    return f"""WITH {start()}, {pairs('verbatim', 'pv')}, {aligned('pv', FILLERS, True, 'av')}, {pairs('conventional', 'pc')}, {aligned('pc', FILLERS, True, 'ac')},
ch AS (SELECT pred_id, array_to_string(r, '') AS r, replace(array_to_string(h, ''), '{UNCLEAR}', '#') AS h FROM pv), cc AS (SELECT pred_id, length(r) AS units, levenshtein(r, h) AS errors FROM ch),
e AS (SELECT av.system, av.mode, av.unclear, av.units AS vu, av.subs + av.dels + av.ins AS ve, ac.units AS cu, ac.subs + ac.dels + ac.ins AS ce, CASE WHEN av.unclear = 0 THEN cc.units END AS xu, CASE WHEN av.unclear = 0 THEN cc.errors END AS xe FROM av JOIN ac USING (pred_id) JOIN cc USING (pred_id))"""


RATES = [(p, f"coalesce(sum({x}e) / greatest(sum({x}u), 1), 0.0)") for p, x in (("verbatim", "v"), ("conventional", "c"), ("cer", "x"))]
