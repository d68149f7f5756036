"""SQL of queries whose definition takes more than a line: splitters as nested list expressions, segmenters as recursions.

A splitter here is a function from an SQL string expression to an SQL list expression, written from the splitter's definition without
look-around (DuckDB's engine has none): what a look-around asserts is captured and put back.
"""

from __future__ import annotations

import unicodedata
from itertools import count
from string import punctuation

from tessera.functions.bytes import latin_table, pseudo_table
from tessera.plans.catalog import ORACLES, TOKENS, WORDS

SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = SPACE + r"\x{200b}"
_names = count()


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def each(items: str, f) -> str:
    """Flat map of f over a list expression."""
    v = f"v{next(_names)}"
    return f"flatten(list_transform({items}, lambda {v}: {f(v)}))"


def cut(x: str) -> str:
    v = f"v{next(_names)}"
    return f"list_filter(string_split({x}, chr(1)), lambda {v}: {v} <> '')"


def marked(x: str, pattern: str, new: str = r"\1") -> str:
    """Matches between marks: new says what of the groups is marked ('\\1'), with what beside it."""
    left, _, right = new.partition(r"\1") if new.count(r"\1") else ("", "", "")
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(left)} || chr(1) || '\\1' || chr(1) || {quoted(right)}, 'g')"


def sequence(*steps):
    def run(x: str) -> str:
        out = f"[{x}]"
        for s in steps:
            out = each(out, s)
        return out

    return run


def signs(hyphens: str) -> str:
    """Inside of a class."""
    rest = "".join(c for c in punctuation + "€£…‘’“”„«»" if c not in "-–_")
    return "".join(rf"\x{{{ord(c):x}}}" for c in {"only": "-–_", "excluded": rest, "included": "-–_" + rest}[hyphens])


def punctuation_runs(hyphens: str, protect: bool = True, space_first: bool = False):
    p, q = f"[{signs(hyphens)}]", f"[{signs(hyphens).replace(r'\x{27}', '')}]"

    def run(x: str) -> str:
        if hyphens == "only" or not protect:
            return cut(marked(x, f"({p}+)"))
        runs = marked(x, f"([{SPACE}]?{p}*{q}+{p}*)" if space_first else f"({p}*{q}+{p}*)")
        opened = marked(runs, rf"((?:\A|[{SPACE}])')") if space_first else f"regexp_replace({runs}, {quoted(rf'(\A|[{SPACE}])' + chr(39))}, '\\1' || chr(1) || '''' || chr(1), 'g')"
        return cut(f"regexp_replace({opened}, {quoted(chr(39) + rf'([{SPACE}]|\z)')}, chr(1) || '''' || chr(1) || '\\1', 'g')")

    return run


def on_blanks(x: str) -> str:
    v = f"v{next(_names)}"
    return f"list_filter(string_split_regex({x}, '[{BLANK}]+'), lambda {v}: {v} <> '')"


def on_ascii_blanks(x: str) -> str:
    v = f"v{next(_names)}"
    return f"list_filter(string_split_regex({x}, '[ \\n\\t\\r]+'), lambda {v}: {v} <> '')"


def digits(x: str) -> str:
    return cut(marked(x, r"(\p{N})"))


def numbers(x: str) -> str:
    return cut(marked(x, r"((?:[.,]?\p{N})+)"))


def digit_groups(x: str) -> str:
    """Runs of digits in groups of three from the right."""
    return each(cut(marked(x, r"(\p{Nd}+)")), lambda v: f"case when regexp_full_match({v}, '\\p{{Nd}}+') then list_filter([left({v}, length({v}) % 3)] || list_transform(range(length({v}) // 3), lambda g: substr({v}, length({v}) % 3 + 3 * g + 1, 3)), lambda g: g <> '') else [{v}] end")


def hyphens(x: str) -> str:
    """Twice, since a sign between two hyphens belongs to both."""
    once = lambda y: f"regexp_replace({y}, '([^{SPACE}\\x{{1}}-])(-+)([^{SPACE}-])', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    return cut(once(once(x)))


def contractions(x: str) -> str:
    once = lambda y: f"regexp_replace({y}, {quoted(rf'(?i)({chr(39)}(?:s|re|ve|m|ll|d)|n{chr(39)}t|{chr(39)}t)([{SPACE}]|\p{{P}}|\z)')}, chr(1) || '\\1' || chr(1) || '\\2', 'g')"
    return cut(once(once(x)))


def apostrophes(x: str) -> str:
    """Each to its shorter neighbour, the left one on ties; never to nothing."""
    p = f"string_split({x}, '''')"
    n = lambda i: f"length(({p})[{i}])"
    left = lambda i: f"({n(f'{i} + 1')} = 0 or ({n(i)} <> 0 and {n(i)} <= {n(f'{i} + 1')}))"
    v, i = f"v{next(_names)}", f"i{next(_names)}"
    glued = f"list_transform({p}, lambda {v}, {i}: (case when {i} > 1 and not {left(f'{i} - 1')} then '''' else '' end) || {v} || (case when {i} < len({p}) and {left(i)} then '''' else '' end))"
    return f"list_filter({glued}, lambda {v}: {v} <> '')"


def capitals(mark: str = ""):
    """Words in capitals, or with a capital first; a mark before the word isn't part of it."""

    def run(x: str) -> str:
        m = f"(case when starts_with({x}, {quoted(mark)}) then {quoted(mark)} else '' end)" if mark else "''"
        root = f"(case when starts_with({x}, {quoted(mark)}) then substr({x}, {len(mark) + 1}) else {x} end)" if mark else x
        capital = lambda y: f"({y} = upper({y}) and {y} <> lower({y}))"
        first = f"left({root}, 1)"
        return f"case when {root} = '' then list_filter([{m}], lambda z: z <> '') when {capital(root)} then ['⇪', {m} || lower({root})] when {capital(first)} then ['⇧', {m} || lower({first}) || substr({root}, 2)] else [{x}] end"

    return run


def prefixed(mark: str):
    return lambda x: f"[{quoted(mark)} || {x}]"


def as_bytes(x: str, table: list[str], h: str | None = None) -> str:
    """h: an expression of the bytes in hexadecimal, where that is at hand."""
    codes = "[" + ", ".join(map(quoted, table)) + "]"
    h = h or f"hex(encode({x}))"
    return f"array_to_string(list_transform(range(length({h}) // 2), lambda b: ({codes})[('0x' || substr({h}, 2 * b + 1, 2))::int + 1]), '')"


def nfkc(x: str) -> str:
    """Compatibility forms of Latin letters and common signs, then composition."""
    for c in [*range(0xA0, 0x250), *range(0x2000, 0x2080), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x3000]:
        one, flat = unicodedata.normalize("NFKC", chr(c)), unicodedata.normalize("NFC", chr(c))
        if one != flat and c in KNOWN:
            x = f"replace({x}, {quoted(chr(c))}, {quoted(one)})"
    return f"nfc_normalize({x})"


#: Compatibility characters that texts are likely to hold; all others of the ranges are left to the kernels' own tests.
KNOWN = frozenset(map(ord, "\xa0¨ª¯²³´µ¸¹º¼½¾ſ…‘’“”„‹›™℃№ﬀﬁﬂﬃﬄ！？，．：；（）　①②③")) - frozenset(map(ord, "‘’“”„‹›"))

PSEUDO, LATIN = pseudo_table(), latin_table()
EXCLUDED = punctuation_runs("excluded")
SPLITS = {
    "spl01_sequence": sequence(on_ascii_blanks, digits),
    "spl04_punctuation_excluded": EXCLUDED,
    "spl04_punctuation_unprotected": punctuation_runs("included", False),
    "spl04_punctuation_grouped": punctuation_runs("included", True, True),
    "spl05_group_distinct_punctuation": sequence(punctuation_runs("included", False), lambda x: f"case when regexp_full_match({x}, '[{SPACE}]?[{signs('included')}]+') then {runs(x)} else [{x}] end"),
    "spl10_space_prefixed": lambda x: f"regexp_extract_all({x}, '[{BLANK}][^{BLANK}]*|[^{BLANK}]+')",
    "spl12_numbers": numbers,
    "spl14_group_digits": digit_groups,
    "spl15_connecting_hyphens": hyphens,
    "spl16_polarise_apostrophes": sequence(on_ascii_blanks, apostrophes),
    "spl17_contractions": sequence(on_ascii_blanks, contractions),
    "spl21_capital_marker": sequence(on_ascii_blanks, capitals()),
    "spl26_kudo_words": lambda x: f"regexp_extract_all(replace({x}, ' ', '▁'), '▁?[^▁]+|▁')",
}
PREFABS = {
    "traditional": [on_blanks, EXCLUDED],
    "modern_english": [EXCLUDED, on_blanks, contractions, lambda x: f"[{as_bytes(x, PSEUDO)}]", prefixed("Ġ"), digits, punctuation_runs("only")],
    "prefab2": [EXCLUDED, on_blanks, contractions, apostrophes, prefixed("Ġ"), digit_groups, hyphens, capitals("Ġ")],
    "sentencepiece": [EXCLUDED, on_blanks, contractions, prefixed(" "), punctuation_runs("only"), digits, lambda x: f"[replace({as_bytes(x, LATIN)}, 'Ġ', ' ')]"],
    "roberta": [punctuation_runs("included", True, True), lambda x: f"regexp_extract_all({x}, '[{BLANK}][^{BLANK}]*|[^{BLANK}]+')", lambda x: f"[{as_bytes(x, PSEUDO)}]"],
}


def runs(x: str) -> str:
    """Runs of equal characters."""
    c = f"list_filter(string_split({x}, ''), lambda z: z <> '')"
    return f"string_split(substr(array_to_string(list_transform({c}, lambda z, k: case when k = 1 or z <> ({c})[k - 1] then chr(1) || z else z end), ''), 2), chr(1))"


def rows_of_list(x: str) -> str:
    return f"select doc_id, md5(array_to_string(x, chr(1))) as h, len(x)::bigint as n from (select doc_id, {x} as x from documents)"


def rows_of_text(x: str) -> str:
    return f"select doc_id, md5(x) as h, length(x)::bigint as n from (select doc_id, {x} as x from documents)"


for _name, _split in SPLITS.items():
    ORACLES[_name] = rows_of_list(_split("replace(text, chr(1), '')"))
for _name, _steps in PREFABS.items():
    ORACLES[f"spl28_{_name}"] = rows_of_list(sequence(*_steps)("t")).replace("from documents", f"from (select doc_id, {nfkc('text')} as t from documents)")
_chars = "list_filter(string_split(text, ''), lambda z: z <> '')"
ORACLES["map13_limit_repetitions"] = rows_of_text("array_to_string(list_filter(c, lambda z, k: not (k > 2 and z = c[k - 1] and z = c[k - 2])), '')").replace("from documents", f"from (select doc_id, {_chars} as c from documents)")
ORACLES["map22_pseudo_bytes"] = rows_of_text(as_bytes("text", PSEUDO, "h")).replace("from documents", "from (select doc_id, hex(encode(text)) as h from documents)")
ORACLES["map25_nfkc"] = rows_of_text(nfkc("text"))
_back = "strpos(reverse(substr(text, 450, 51)), ' ')"
ORACLES["map26_truncate_and_normalise"] = rows_of_text(nfkc(f"case when length(text) <= 500 then text when {_back} > 0 then left(text, 500 - {_back}) else left(text, 500) end"))

#: Words of benchmark with counts, the vocabulary of most segmenters, and the words of documents.
COUNTED = f"b as (select w, count(*) as n from (select unnest({WORDS}) as w from benchmark) group by w)"
VOCABULARY = f"""{COUNTED}, g as (select substr(w, i::int, k::int) as t, sum(n) as c from b, unnest(generate_series(2, 5)) h(k), unnest(generate_series(1, 400)) j(i) where i + k - 1 <= length(w) group by 1 having sum(n) >= 2),
v as materialized (select t from (select t from g order by c desc, t limit 2000) union select unnest(list_filter(string_split(w, ''), lambda z: z <> '')) from b)"""
ALL = f"(select distinct token from {TOKENS})"


def recursion(state: str, start: str, step: str, more: str, result: str, given: str = VOCABULARY) -> str:
    """One row per word of documents: columns of the state, their start, the next ones while `more` holds, and the joined tokens."""
    return f"""with recursive {given}, r({state}) as (select {start} from {ALL} union all select {step} from r where {more})
    select word, (length(t) - length(replace(t, chr(1), '')) + (case when t = '' then 0 else 1 end))::bigint as n, md5(t) as h from (select word, ltrim({result}, chr(1)) as t from r where not ({more}))"""


def known(x: str) -> str:
    return f"{x} in (select t from v)"


def longest(take) -> str:
    return "case " + " ".join(f"when length(rest) >= {k} and {known(take(k))} then {k}" for k in (5, 4, 3, 2)) + " else 1 end"


_left, _right = (lambda k: f"left(rest, {k})"), (lambda k: f"right(rest, {k})")
_step = "select word, substr(rest, k + 1) as rest, out || chr(1) || {} as out from"
ORACLES["tok16_left_greedy"] = recursion("word, rest, out", "token, token, ''", f"word, substr(rest, k + 1), out || chr(1) || left(rest, k) from (select *, {longest(_left)} as k", "rest <> ''", "out").replace("from r where rest <> '')\n", "from r where rest <> ''))\n")
ORACLES["tok17_right_greedy"] = recursion("word, rest, out", "token, token, ''", f"word, left(rest, length(rest) - k), chr(1) || right(rest, k) || out from (select *, {longest(_right)} as k", "rest <> ''", "out").replace("from r where rest <> '')\n", "from r where rest <> ''))\n")
_lazy = f"case when length(rest) < 2 or not {known(_left(1))} or not {known(_left(2))} then 1 when length(rest) < 3 or not {known(_left(3))} then 2 when length(rest) < 4 or not {known(_left(4))} then 3 when length(rest) < 5 or not {known(_left(5))} then 4 else 5 end"
ORACLES["tok17_left_lazy"] = recursion("word, rest, out", "token, token, ''", f"word, substr(rest, k + 1), out || chr(1) || left(rest, k) from (select *, {_lazy} as k", "rest <> ''", "out").replace("from r where rest <> '')\n", "from r where rest <> ''))\n")
_bytes = "array_to_string(list_transform(range(length(hex(encode(left(rest, k)))) // 2), lambda i: '[BYTE ' || ('0x' || substr(hex(encode(left(rest, k))), 2 * i + 1, 2))::int || ']'), chr(1))"
ORACLES["wrp07_byte_fallback"] = recursion("word, rest, out", "token, token, ''", f"word, substr(rest, k + 1), out || chr(1) || (case when unknown then {_bytes} else left(rest, k) end) from (select *, {longest(_left)} as k, not {known(_left(1))} and ({longest(_left)}) = 1 as unknown", "rest <> ''", "out").replace("from r where rest <> '')\n", "from r where rest <> ''))\n")
_v = "[aeıioöuüâîû]"
_c = "[^aeıioöuüâîû]"
_shape = "case " + " ".join(f"when regexp_matches(rest, '{''.join(_v if x == 'V' else _c for x in s)}\\z') then {len(s)}" for s in ("CVCC", "VCC", "CVC", "VC", "CV", "V")) + " else 1 end"
ORACLES["tok42_syllables"] = recursion("word, rest, out", "token, token, ''", f"word, left(rest, length(rest) - k), chr(1) || right(rest, k) || out from (select *, {_shape} as k", "rest <> ''", "out", "one as (select 1)").replace("from r where rest <> '')\n", "from r where rest <> ''))\n")
_p = "(case when (k % 3) = 0 then 0.9 else 0.2 end)"
_at = "coalesce(list_min(list_filter(range(i + 1, e[-1]), lambda k: k % 3 = 0)), i + 1)"
_seg = "substr(word, i + 1, e[-1] - i)"
ORACLES["tok29_top_down"] = recursion(
    "word, i, e, out", "token, 0::bigint, [length(token)], ''",
    f"word, case when done then e[-1] else i end, case when done then e[:-2] else e || [{_at}] end, case when done then out || chr(1) || {_seg} else out end from (select *, e[-1] - i <= 1 or {known(_seg)} as done", "len(e) > 0", "out",
).replace("from r where len(e) > 0)\n", "from r where len(e) > 0))\n")


def best_path(score, kind: str) -> str:
    """Dynamic programming from the left: states of offsets 0 to j in a list; score(before, k) of a step of k characters gives the new
    state's rank; of equal ones the longer step (the earlier predecessor) stays."""
    cands = ", ".join(
        f"case when j >= {k} and b[j - {k} + 1] is not null and {known(f'substr(word, j - {k} + 1, {k})')} then struct_pack(s := {score(f'b[j - {k} + 1]', k)}, k := {k}, p := b[j - {k} + 1].p || chr(1) || substr(word, j - {k} + 1, {k})) end" for k in (5, 4, 3, 2, 1)
    )
    return f"""with recursive {VOCABULARY}, r(word, j, b) as (select token, 1::bigint, [struct_pack(s := {kind}, k := 0, p := '')] from {ALL}
      union all select word, j + 1, b || [list_max(list_filter([{cands}], lambda z: z is not null))] from r where j <= length(word)),
    t as (select word, case when length(word) > 0 and b[-1] is null then array_to_string(list_filter(string_split(word, ''), lambda z: z <> ''), chr(1)) else ltrim(b[-1].p, chr(1)) end as t from r where j > length(word))
    select word, (length(t) - length(replace(t, chr(1), '')) + 1)::bigint as n, md5(t) as h from t"""


ORACLES["tok27_least_tokens"] = best_path(lambda b, k: f"struct_pack(c := {b}.s.c - 1, m := greatest({b}.s.m, {k}))", "struct_pack(c := 0, m := 0)")
ORACLES["tok27_longest_product"] = best_path(lambda b, k: f"{b}.s * {k}", "1::hugeint")
ORACLES["tok24_boundary_sum"] = best_path(lambda b, k: f"{b}.s + (case when j = length(word) then 0 when j % 3 = 0 then 2 * 0.9::double - 1 else 2 * 0.2::double - 1 end)", "0::double")


#: Byte-pair training: words as tokens between marks; a step counts pairs (of three equal tokens in a row, one), takes the commonest, the
#: smallest of equal ones, and replaces it everywhere from the left.
def trained(steps: str, score: str = "n", least: int = 1) -> str:
    """m: the merges as (step, a, b); steps: how many at most, as an expression over the alphabet's size `letters`."""
    return f"""{COUNTED}, letters as (select count(distinct c) as letters from (select unnest(list_filter(string_split(w, ''), lambda z: z <> '')) as c from b)),
    tr(step, w, n, t, a, b) as (
      select 0::bigint, w, n, array_to_string(list_transform(list_filter(string_split(w, ''), lambda z: z <> ''), lambda z: chr(1) || z || chr(2)), ''), null::varchar, null::varchar from b
      union all
      select tr.step + 1, tr.w, tr.n, replace(tr.t, chr(1) || best.a || chr(2) || chr(1) || best.b || chr(2), chr(1) || best.a || best.b || chr(2)), best.a, best.b
      from tr, (
        select a, b from (
          select a, b, sum(n * ((length(t) - length(replace(t, p, ''))) // length(p))) as n from (
            select distinct w, t, n, a, b, chr(1) || a || chr(2) || chr(1) || b || chr(2) as p from (
              select w, t, n, x[i] as a, x[i + 1] as b from (select w, t, n, string_split(substr(t, 2, length(t) - 2), chr(2) || chr(1)) as x from tr), unnest(generate_series(1, 400)) g(i) where i < len(x)))
          group by a, b) where n >= {least} order by {score} desc, a, b limit 1) best
      where tr.step < {steps}),
    m as materialized (select distinct step, a, b from tr where step > 0)"""


ORACLES["trn02_bpe_merges"] = f"with recursive {trained('(select 300 - letters from letters)')} select step - 1 as priority, a || b as type, 2::bigint as parts from m"


def encoded(steps: str, last: str = "1000000") -> str:
    """Merges one after the other over every word."""
    return f"""with recursive {trained(steps)}, ms as (select list(chr(1) || a || chr(2) || chr(1) || b || chr(2) || chr(3) || chr(1) || a || b || chr(2) order by step) as ms from m where step <= {last}),
    e as (select word, list_reduce([array_to_string(list_transform(list_filter(string_split(word, ''), lambda z: z <> ''), lambda z: chr(1) || z || chr(2)), '')] || ms, lambda acc, x: replace(acc, split_part(x, chr(3), 1), split_part(x, chr(3), 2))) as t from (select token as word from {ALL}), ms)
    select word, (length(t) - length(replace(t, chr(2), '')))::bigint as n, md5(replace(replace(replace(t, chr(2) || chr(1), chr(3)), chr(1), ''), chr(2), '').replace(chr(3), chr(1))) as h from e"""


ORACLES["tok01_bpe"] = encoded("(select 400 - letters from letters)")
ORACLES["tok11_truncated_bpe"] = encoded("(select 400 - letters from letters)", "(select max(step) - 100 from m)")


# Ways to write a word, and searches that other recursions can't show.
WAYS = f"""with recursive {VOCABULARY}, r(word, j, b) as (select token, 1::bigint, [1::hugeint] from {{words}}
  union all select word, j + 1, b || [{' + '.join(f"case when j >= {k} and b[j - {k} + 1] > 0 and substr(word, j - {k} + 1, {k}) in (select t from v) then b[j - {k} + 1] else 0::hugeint end" for k in (1, 2, 3, 4, 5))}] from r where j <= length(word)),
ways as (select word, b[-1] as ways from r where j > length(word))"""
_log = "case when ways = 0 then '-infinity'::double else log2(ways::double) end"
ORACLES["scl28_segmentation_counts"] = WAYS.format(words=ALL) + f" select word, ways::double as ways, round({_log}, 6) as log2_ways from ways"
ORACLES["tok35_path_counts"] = WAYS.format(words=ALL) + " select word as token, ways::double as ways from ways"
ORACLES["scl29_pretoken_segmentations"] = WAYS.format(words="(select distinct w as token from b)") + f", t as (select item_id, unnest({WORDS}) as word from benchmark) select item_id, round(sum({_log}), 4) as log2_ways, sum(length(word))::bigint as chars, count(*)::bigint as pretokens from t join ways using (word) group by item_id"
ORACLES["tok21_squared_lengths"] = best_path(lambda b, k: f"{b}.s + {k * k}", "0")
ORACLES["tok22_longest_token"] = best_path(lambda b, k: f"greatest({b}.s, {k})", "0").replace("select token, 1::bigint, [struct_pack(s := 0,", "select token, 1::bigint, [struct_pack(s := 0,")
ORACLES["fil13_at_least_all"] = ORACLES["tok24_boundary_sum"].replace("from g order by c desc, t limit 2000)", "from g order by c desc, t limit 2000)", 1).replace("v as materialized (select t from", "v as materialized (select distinct left(t, n::int) as t from (select t from", 1).replace("from b)", "from b) x, unnest(generate_series(1, 5)) h(n) where n <= length(t))", 1)

_every = VOCABULARY.replace("from b)", f"from b union select unnest(list_filter(string_split(token, ''), lambda z: z <> '')) from {ALL})")
_suffix = "case " + " ".join(f"when length(rest) >= {k} and {known(_right(k))} then {k}" for k in (5, 4, 3, 2)) + " else 1 end"
_two = f"(select *, {longest(_left)} as p, {_suffix} as q from r where rest <> '')"


def two_ended(left_now: str, state: str = "") -> str:
    return f"""with recursive {_every}, r(word, rest, head, tail, side) as (select token, token, '', '', true from {ALL}
      union all select word, case when {left_now} then substr(rest, p + 1) else left(rest, length(rest) - q) end, case when {left_now} then head || chr(1) || left(rest, p) else head end,
        case when {left_now} then tail else chr(1) || right(rest, q) || tail end, not side from {_two})
    select word, (length(t) - length(replace(t, chr(1), '')) + 1)::bigint as n, md5(t) as h from (select word, ltrim(head || tail, chr(1)) as t from r where rest = '')"""


ORACLES["tok18_alternating"] = two_ended("side")
ORACLES["tok18_both_ends"] = two_ended("p >= q")
ORACLES["tok19_pair_passes"] = f"""with recursive {VOCABULARY}, r(word, todo, out, moved) as (select token, list_filter(string_split(token, ''), lambda z: z <> ''), []::varchar[], false from {ALL}
  union all select word, case when len(todo) = 0 then out else todo[2:] end, case when len(todo) = 0 then []::varchar[] when join_ then out[:-2] || [out[-1] || todo[1]] else out || [todo[1]] end, case when len(todo) = 0 then false else moved or join_ end
  from (select *, len(todo) > 0 and len(out) > 0 and out[-1] || todo[1] in (select t from v) as join_ from r where len(todo) > 0 or moved))
select word, len(out)::bigint as n, md5(array_to_string(out, chr(1))) as h from r where len(todo) = 0 and not moved"""
ORACLES["tok20_longest_first"] = f"""with recursive {VOCABULARY}, r(word, a, b, k, i, token) as (select token, 0::bigint, length(token)::bigint, least(5, length(token))::bigint, 0::bigint, null::varchar from {ALL}
  union all select word, x.a, x.b, x.k, x.i, x.token from (
    select word, unnest(case
      when k = 1 then list_transform(range(a, b), lambda z: struct_pack(a := z, b := z + 1, k := 1::bigint, i := z, token := substr(word, z + 1, 1)))
      when found then list_filter([struct_pack(a := a, b := i, k := least(k, i - a), i := a, token := null::varchar), struct_pack(a := i, b := i + k, k := k, i := i, token := substr(word, i + 1, k)),
        struct_pack(a := i + k, b := b, k := least(k, b - i - k), i := i + k, token := null::varchar)], lambda z: z.a < z.b)
      when i + k < b then [struct_pack(a := a, b := b, k := k, i := i + 1, token := null::varchar)]
      else [struct_pack(a := a, b := b, k := k - 1, i := a, token := null::varchar)] end) as x
    from (select *, substr(word, i + 1, k) in (select t from v) as found from r where token is null)))
select word, count(*)::bigint as n, md5(string_agg(token, chr(1) order by a)) as h from r where token is not null group by word"""

ORACLES["srt07_first_pair"] = f"with recursive {trained('1')} select a, b from m"
ORACLES["trn04_merges_of_types"] = f"with recursive {trained('(select 300 - letters from letters)')} select step - 1 as priority, a || b as type from m"
_last = "last as (select w, n, string_split(substr(t, 2, length(t) - 2), chr(2) || chr(1)) as x from tr where step = (select max(step) from tr)), used as (select t, sum(n) as n from (select unnest(x) as t, n from last) group by t)"
_400 = f"with recursive {trained('(select 400 - letters from letters)')}, {_last}"
ORACLES["trn08_trimmed_bpe"] = f"{_400} select distinct a || b as type from m left join used on used.t = a || b where coalesce(used.n, 0) <= 3"
ORACLES["fil11_unused_types"] = f"{_400} select distinct a || b as type from m left join used on used.t = a || b where coalesce(used.n, 0) <= 0"
ORACLES["trn12_boundary_blame"] = f"""{_400}, s as (select x[i] as type, coalesce(list_sum(list_transform(x[:i - 1], lambda z: length(z))), 0) as a from last, unnest(generate_series(1, 400)) g(i) where i <= len(x)),
c as (select type, case when (a + length(type) - 1) // 4 > a // 4 then 1 else 0 end as x from s)
select type, sum(1 - x)::bigint as right, sum(x)::bigint as wrong, avg(x) as ratio from c group by type"""

# Pairs by count(xy) / (count(x) count(y)): the tokens' counts beside the pairs'.
_pmi = trained("(select 300 - letters from letters)", "n::double / (ca * cb)", 3)
_pmi = _pmi.replace("group by a, b) where n >= 3", "group by a, b) p join (select x as a, sum(n) as ca from (select unnest(string_split(substr(t, 2, length(t) - 2), chr(2) || chr(1))) as x, n from tr) group by x) using (a) join (select x as b, sum(n) as cb from (select unnest(string_split(substr(t, 2, length(t) - 2), chr(2) || chr(1))) as x, n from tr) group by x) using (b) where n >= 3")
ORACLES["trn09_pmi_bpe"] = f"with recursive {_pmi} select step - 1 as priority, a || b as type, 2::bigint as parts from m"

_suffixes, _prefixes = ("tion", "ing", "ed", "ly", "er"), ("un", "re", "in")
_s = "case " + " ".join(f"when ends_with(w, '{s}') and length(w) > {len(s) + 1} then '{s}'" for s in _suffixes) + " end"
_pre = "case " + " ".join(f"when starts_with(w, '{p}') and length(w) > {len(p) + 1} then '{p}'" for p in _prefixes) + " end"
_in = lambda x: f"{x} in (select w from stems)"
_stem = f"({_in('w')} or {_in(chr(40) + 'w || ' + quoted('e') + chr(41))} or (length(w) > 2 and right(w, 1) = left(right(w, 2), 1) and {_in('left(w, length(w) - 1)')}) or (ends_with(w, 'i') and {_in('(left(w, length(w) - 1) || ' + quoted('y') + ')')}) or (ends_with(w, 'abil') and {_in('(left(w, length(w) - 2) || ' + quoted('le') + ')')}) or (ends_with(w, 'ific') and {_in('(left(w, length(w) - 2) || ' + quoted('y') + ')')}))"
ORACLES["tok41_derivations"] = f"""with recursive {COUNTED}, stems as materialized (select w from b where length(w) >= 3), r(word, w, head, tail, st) as (select token, token, '', '', 0 from {ALL}
  union all select word, case when stem then w when s is not null then left(w, length(w) - length(s)) when p is not null then substr(w, length(p) + 1) else w end,
    case when not stem and s is null and p is not null then head || p || chr(1) else head end, case when not stem and s is not null then chr(1) || s || tail else tail end,
    case when stem then 1 when s is null and p is null then 2 else 0 end
  from (select *, {_stem} as stem, {_s} as s, {_pre} as p from r where st = 0)),
t as (select word, case st when 1 then head || w || tail else word end as t from r where st > 0)
select word, (length(t) - length(replace(t, chr(1), '')) + 1)::bigint as n, md5(t) as h from t"""
ORACLES["trn18_entropy_constrained_size"] = f"""{_400}, chars as (select sum(length(w) * n) as chars from b), k as (select n, row_number() over (order by n desc, t) as r from used),
h as (select s, -sum(n / total * log2(n / total)) / (any_value(chars) / any_value(total)) as h from (select s, n::double as n, sum(n) over (partition by s)::double as total from k, unnest(generate_series(50, (select count(*) from used), 50)) g(s) where r <= s), chars group by s),
g as (select s, lag(h) over (order by s) - h as gain from h)
select (select s from g where gain is not null order by gain desc, s limit 1)::bigint as size, count(*)::bigint as types from used"""
