"""Reading elements out of stored HTML with built-in expressions.

``tokens`` cuts a page at its tags, once. Every tag gets a number, an element is the range
from its opening to its closing tag, and its text is what stands between the tags of that
range. Which closing tag belongs to an element is found in one pass with a stack of open
elements, as browsers do: a closing tag also ends what is still open inside its element,
some elements end where another of their name begins, and void elements have no inside.
Elements of other names that nothing but the end of their parent closes are not listed.

Selectors are CSS of the dialect the selector lists use: tag, ``.class``, ``[attr op
"value"]``, ``:not(...)``, ``:has-text("...")``, descendants, ``>`` and ``+``. They are
filters over the elements: one is inside another if its number lies in the other's range.
Names of tags and attributes are in any case, attributes quoted or not.

The expressions are put together as SQL texts, since building them call by call takes
longer than running them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.functions.text import let

# A comment, a declaration, or a tag; a sign in a quoted attribute does not end the tag.
_TAG = (
    r"""(?s)<!--.*?-->|<![^>]*>|</?[a-zA-Z][^\s/>]*+"""
    r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>"""
)
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
_ATTRIBUTE = r"""(?s)(?<=[\s/"'])[^\s=>/"'<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
_REFERENCE = "&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]*);"

# Elements an opening tag of their own name closes.
_NEVER_NESTED = ["p", "a", "button", "option"]
# Elements without an inside.
_VOID = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
]


def _q(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(names: list[str]) -> str:
    return ", ".join(map(_q, names))


def _bind(value: Column, name: str, sql: str) -> Column:
    """A SQL text in which ``name`` stands for a column."""
    bound = F.call_function("transform", F.array(value), F.expr(f"{name} -> {sql}"))
    return F.element_at(bound, 1)


# --- character references ---------------------------------------------------------


def _decoded(text: str) -> str:
    """SQL for a text with its character references resolved."""
    names = ",".join(f"{name}={chr(code)}" for name, code in [*name2codepoint.items(), ("apos", 39)])
    number = "CAST(CASE WHEN lower(r) LIKE '#x%' THEN conv(substring(r, 3), 16, 10) ELSE substring(r, 2) END AS BIGINT)"
    character = f"""element_at(transform(array({number}), n -> decode(unhex(lpad(hex(
        CASE WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN n ELSE 65533 END), 8, '0')), 'UTF-32')), 1)"""
    resolved = f"""CASE WHEN r LIKE '#%' THEN {character}
        ELSE coalesce(str_to_map({_q(names)}, ',', '=')[r], concat('&', r, ';')) END"""
    signs = f"transform(regexp_extract_all({text}, {_q(_REFERENCE)}, 1), r -> {resolved})"
    # before the first reference stands nothing that is one
    pieces = f"zip_with(concat(array(''), {signs}), split({text}, {_q(_REFERENCE)}), (x, y) -> concat(x, y))"
    joined = f"array_join({pieces}, '')"
    return f"CASE WHEN contains({text}, '&') THEN {joined} ELSE {text} END"


def decode_entities(c: Column) -> Column:
    """Named and numeric character references to the characters they stand for."""
    return _bind(c, "c", _decoded("c"))


# --- pages ------------------------------------------------------------------------

# Per tag its number, lower-case name and kind: 0 none, 1 opening, 2 closing, 3 void.
_MARKS = f"""transform(transform(tags, tag -> lower(regexp_extract(tag, {_q(_NAME)}, 1))), (name, no) ->
    named_struct('no', no, 'name', name, 'kind', CASE WHEN name = '' THEN 0
        WHEN startswith(tags[no], '</') THEN 2 WHEN name IN ({_listed(_VOID)}) THEN 3 ELSE 1 END))"""
# Names and numbers of the open elements, and one number for each element that is done: its
# opening tag, its closing tag, and whether that one is its own.
_START = """named_struct('names', CAST(array() AS ARRAY<STRING>), 'opens', CAST(array() AS ARRAY<INT>),
    'done', CAST(array() AS ARRAY<BIGINT>))"""


def _packed(opened: str, closed: str, own: str) -> str:
    return f"(shiftleft(CAST({opened} AS BIGINT), 32) + shiftleft(CAST({closed} AS BIGINT), 1) + {own})"


_ENDED = f"array_append(s.done, {_packed('s.opens[at - 1]', 't.no', 't.kind - 1')})"
_STEP = f"""CASE
    WHEN t.kind = 0 THEN s
    WHEN t.kind = 3 THEN named_struct('names', s.names, 'opens', s.opens,
        'done', array_append(s.done, {_packed('t.no', 't.no', '1')}))
    WHEN t.kind = 1 AND NOT (t.name IN ({_listed(_NEVER_NESTED)}) AND array_contains(s.names, t.name)) THEN
        named_struct('names', array_append(s.names, t.name), 'opens', array_append(s.opens, t.no), 'done', s.done)
    WHEN NOT array_contains(s.names, t.name) THEN s
    ELSE element_at(transform(array(CAST(size(s.names) - array_position(reverse(s.names), t.name) + 1 AS INT)), at ->
        CASE WHEN t.kind = 2 THEN named_struct('names', slice(s.names, 1, at - 1),
            'opens', slice(s.opens, 1, at - 1), 'done', {_ENDED})
        ELSE named_struct('names', array_append(slice(s.names, 1, at - 1), t.name),
            'opens', array_append(slice(s.opens, 1, at - 1), t.no), 'done', {_ENDED}) END), 1) END"""
# What a never nested element left open ends with the page.
_FINISH = f"""concat(s.done, array_compact(transform(s.names, (name, i) ->
    CASE WHEN name IN ({_listed(_NEVER_NESTED)}) THEN {_packed('s.opens[i]', 'size(tags)', '0')} END)))"""
_VALUE = "btrim(substring(a, instr(a, '=') + 1), ' \\t\\n\\r')"
_UNQUOTED = f"""CASE WHEN instr(a, '=') = 0 THEN '' WHEN left({_VALUE}, 1) IN ('"', '\\'')
    THEN substring({_VALUE}, 2, length({_VALUE}) - 2) ELSE {_VALUE} END"""
_RAW = f"CASE WHEN contains(tag, ' ') OR contains(tag, '=') THEN regexp_extract_all(tag, {_q(_ATTRIBUTE)}, 0) ELSE array() END"
_DESCRIBED = f"""transform(array(d), d -> named_struct(
    'name', d.name,
    'attributes', transform(d.raw, a -> lower(btrim(substring_index(a, '=', 1), ' \\t\\n\\r'))),
    'values', transform(transform(d.raw, a -> {_UNQUOTED}), v -> {_decoded('v')}),
    'open', d.open, 'close', d.close, 'after', d.after))[0]"""
_ELEMENT = f"""element_at(transform(array(named_struct(
        'open', CAST(shiftright(n, 32) AS INT), 'close', CAST(shiftright(n & 4294967295, 1) AS INT),
        'after', CAST(shiftright(n & 4294967295, 1) + (n & 1) AS INT))), d ->
    element_at(transform(array(tags[d.open]), tag -> named_struct(
        'name', marks[d.open].name, 'raw', {_RAW},
        'open', d.open, 'close', d.close, 'after', d.after)), 1)), 1)"""
_ELEMENTS = f"""transform(transform(transform(
        array_sort(aggregate(marks, {_START}, (s, t) -> {_STEP}, s -> {_FINISH})),
    n -> {_ELEMENT}), d -> {_DESCRIBED}),
    e -> named_struct('name', e.name, 'attributes', e.attributes, 'values', e.values,
        'classes', split(coalesce(get(e.values, CAST(array_position(e.attributes, 'class') AS INT) - 1), ''), '\\\\s+'),
        'open', e.open, 'close', e.close, 'after', e.after))"""
_PAGE = f"""element_at(transform(array(regexp_extract_all(h, {_q(_TAG)}, 0)), tags ->
    element_at(transform(array({_MARKS}), marks -> named_struct(
        'texts', transform(split(h, {_q(_TAG)}), c -> {_decoded('c')}), 'elements', {_ELEMENTS})), 1)), 1)"""


def tokens(html: Column) -> Column:
    """A page as ``struct(texts, elements)``.

    ``texts[0]`` stands before the first tag, ``texts[i + 1]`` behind tag number i.
    ``elements`` are in page order: name, attributes and their values, classes, the numbers
    of the opening and the closing tag, and that of the first tag after the element.
    """
    return _bind(html, "h", _PAGE)


def text_in(page: Column, element: Column) -> Column:
    """Text content of an element of a page; null for no element."""
    inside = F.slice(page["texts"], element["open"] + 2, element["close"] - element["open"])
    return F.array_join(inside, "")


def _attribute(element: str, name: str) -> str:
    place = f"CAST(array_position({element}.attributes, {_q(name)}) AS INT) - 1"
    return f"get({element}.values, {place})"


def element_attribute(element: Column, name: str) -> Column:
    """Attribute of an element; empty if it has none."""
    return F.coalesce(_bind(element, "e", _attribute("e", name)), F.lit(""))


# --- selectors --------------------------------------------------------------------

_PART = re.compile(
    r"""(?P<tag>^[a-zA-Z][a-zA-Z0-9]*)
      | \.(?P<cls>[\w-]+)
      | \[(?P<attr>[\w-]+)(?:(?P<op>[*^]?)="(?P<val>[^"]*)")?\]
      | :has-text\("(?P<word>[^"]*)"\)
      | :not\((?P<neg>:has-text\("[^"]*"\)|[^()]+)\)""",
    re.VERBOSE,
)


def _compound(compound: str) -> str:
    """SQL for the test that element ``e`` of page ``p`` must pass, its cheap parts first."""
    tests: list[str] = []
    late: list[str] = []
    for part in _PART.finditer(compound):
        if part["tag"]:
            tests.append(f"e.name = {_q(part['tag'].lower())}")
        elif part["cls"]:
            tests.append(f"array_contains(e.classes, {_q(part['cls'])})")
        elif part["attr"]:
            found = _attribute("e", part["attr"])
            value = _q(part["val"] or "")
            if part["val"] is None:
                tests.append(f"{found} IS NOT NULL")
            elif part["op"]:
                function = {"^": "startswith", "*": "contains"}[part["op"]]
                tests.append(f"coalesce({function}({found}, {value}), false)")
            else:
                tests.append(f"{found} <=> {value}")
        elif part["word"] is not None:
            text = "array_join(slice(p.texts, e.open + 2, e.close - e.open), '')"
            late.append(f"contains(lower({text}), {_q(part['word'].lower())})")
        else:
            late.append(f"NOT ({_compound(part['neg'])})")
    return " AND ".join(tests + late)


def _steps(css: str) -> list[tuple[str, str]]:
    """Steps of a selector: how an element lies to those of the step before, and its test."""
    words = re.findall(r"""(?:"[^"]*"|\([^)]*\)\)?|[^\s"(]+)+""", css.strip())
    steps, relation = [], ""
    for word in words:
        if word in ("+", ">"):
            relation = word
            continue
        steps.append((relation or " ", _compound(word)))
        relation = ""
    return steps


_INSIDE = "o.open < e.open AND e.open < o.close"
# how an element lies to one of those of the step before; a child's parent is the innermost
# element around it
_RELATIONS = {
    " ": f"exists(outer, o -> {_INSIDE})",
    "+": "exists(outer, o -> o.after = e.open)",
    ">": f"""exists(outer, o -> {_INSIDE} AND NOT exists(p.elements, m ->
        o.open < m.open AND m.open < e.open AND e.open < m.close))""",
}


def _find_all(css: str) -> str:
    """SQL for all elements of page ``p`` that match, in page order."""
    (_, first), *rest = _steps(css)
    found = f"filter(p.elements, e -> {first})"
    for relation, test in rest:
        inner = f"filter(p.elements, e -> {test} AND {_RELATIONS[relation]})"
        found = f"""element_at(transform(array({found}), outer ->
            CASE WHEN size(outer) > 0 THEN {inner} ELSE slice(p.elements, 1, 0) END), 1)"""
    return found


def find_all(page: Column, css: str) -> Column:
    """All elements of a page that match, in page order."""
    return _bind(page, "p", _find_all(css))


def find(page: Column, css: str) -> Column:
    """The first matching element; null if there is none."""
    return _bind(page, "p", f"get({_find_all(css)}, 0)")


def from_element(html: Column, css: str) -> Column:
    """:func:`find` on markup."""
    return let(tokens(html), lambda page: find(page, css))


def first_text(html: Column, css: str) -> Column:
    """Text of the first matching element of some markup; null if there is none."""
    return let(tokens(html), lambda page: let(find(page, css), lambda e: text_in(page, e)))


def first_accepted(
    page: Column, selectors: list[str], accept: Callable[[Column], Column]
) -> Column:
    """``accept`` of the first selector's element for which it is not null; a text.

    A selector is only looked for while the ones before it gave nothing.
    """
    cases = " ".join(f"WHEN {no} THEN get({_find_all(css)}, 0)" for no, css in enumerate(selectors))
    nth = f"element_at(transform(array(b.p), p -> CASE b.no {cases} END), 1)"

    def element_no(no: Column) -> Column:
        return _bind(F.struct(page.alias("p"), no.alias("no")), "b", nth)

    return F.aggregate(
        F.expr(f"sequence(0, {len(selectors) - 1})"),
        F.lit(None).cast("string"),
        lambda accepted, no: F.coalesce(accepted, let(element_no(no), accept)),
    )


def all_texts(page: Column, selectors: list[str]) -> Column:
    """Per selector the texts of all matching elements in page order, as
    ``array<array<string>>`` in the order of the selectors."""
    text = "array_join(slice(p.texts, e.open + 2, e.close - e.open), '')"
    found = ", ".join(f"transform({_find_all(css)}, e -> {text})" for css in selectors)
    return _bind(page, "p", f"array({found})")


def link_targets(page: Column) -> Column:
    """``href`` of every link, in page order."""
    links = f"transform(filter(p.elements, e -> e.name = 'a'), e -> {_attribute('e', 'href')})"
    return _bind(page, "p", f"array_compact({links})")


# --- running text -----------------------------------------------------------------


def readable(html: Column) -> Column:
    """A page without scripts, styles and comments. They make up most of a page and hold
    no elements, so every later look at the page gets shorter. A ``>`` in an attribute,
    which browsers write as it is, becomes its reference."""
    unread = "script|style|svg|noscript|template"
    return _signs_in_attributes(F.regexp_replace(html, rf"(?is)<!--.*?-->|<({unread})\b.*?</\1>", " "))


def _signs_in_attributes(html: Column) -> Column:
    # from the attribute's opening quote, or on from the sign replaced before
    out = html
    for quote in ('"', "'"):
        pattern = rf"((?:\s[\w:@.-]+={quote}|\G(?!^))[^{quote}<>]*)>"
        out = F.when(out.rlike(rf"\s[\w:@.-]+={quote}[^{quote}<>]*>"), F.regexp_replace(out, pattern, "$1&gt;")).otherwise(out)
    return out


def page_text(body: Column) -> Column:
    """Text of a ``readable`` page; blocks start a new line."""
    # Elements that break the line.
    blocks = "p|div|li|ul|ol|br|tr|table|h[1-6]|nav|article|section|header|footer|main"
    out = F.regexp_replace(body, r"(?is)<head\b.*?</head>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{blocks})\b[^>]*>", "\n")
    return decode_entities(F.regexp_replace(out, "(?s)<[^>]*>", ""))
