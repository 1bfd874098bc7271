"""Cross references in French normative texts, as one column expression.

A text is cut where the word ``article`` or ``articles`` begins. What stands there is a list of numbers, plain or with a letter,
and what follows the list says whose numbers they are: a code's, or else the texts' own.
Regulations and opinions are found by their own names. A number is the texts' own unless a code follows
it within thirty characters of the same line; it is never taken in part. The expression is SQL text, since
it uses values inside lambdas many times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Article numbers, and the legal codes that are recognised with their short names.
NUMBER = r"\d{3,4}-\d+(?:-\d+)?"
CODES = {
    "code monétaire et financier": "comofi",
    "code de commerce": "code-de-commerce",
    "code général des impôts": "cgi",
    "code civil": "code-civil",
    "code de la sécurité sociale": "css",
    "code de la construction et de l'habitation": "cch",
    "code des assurances": "code-des-assurances",
    "code de l'urbanisme": "code-de-l-urbanisme",
    "code du travail": "code-du-travail",
    "code du sport": "code-du-sport",
    "code rural et de la pêche maritime": "code-rural",
    "code de l'environnement": "code-de-l-environnement",
    "code de l'énergie": "code-de-l-energie",
    "code du patrimoine": "code-du-patrimoine",
    "code de la propriété intellectuelle": "cpi",
    "code minier": "code-minier",
}
# What separates numbers, how far after a number a code still owns it, and the two kinds of historical texts.
BETWEEN_PLAIN, BETWEEN_LETTERED = r"\s*(?:,|et|à)\s*", r"\s+(?:et|à|,)\s*"
LETTERED = r"[LRD]\.\s*[\d.-]+"
OWNED = r"^[^\n]{0,30}?\bdu\s+(?:même\s+)?code\b"
REGULATION = r"(?i)règlement\s+(?:n°\s*\d{2,4}-\d{2}\s+du\s+CRC|CRC\s+n°\s*\d{2,4}-\d{2})"
OPINION = r"(?i)Avis\s+(?:CNC|CU)\s+n°\s*\d{4}-[\p{L}\p{N}_]+"

HEAD, MARK = r"(?i)\b(articles?\s)", "\x01"
#: Blanks that aren't ASCII are read as blanks, typographic apostrophes as straight ones.
ODD, EVEN = "\u00a0\u202f\u2009’‘", "   ''"
#: Pieces after a cut in which what follows a number is looked for.
AHEAD = 6

_LISTS = {"plain": rf"(?i)^{NUMBER}(?:{BETWEEN_PLAIN}{NUMBER})*", "lettered": rf"(?i)^{LETTERED}(?:{BETWEEN_LETTERED}{LETTERED})*"}
_OF_CODE = rf"(?i)^\s+du\s+({'|'.join(CODES)})"
_OF_SAME = r"(?i)^\s+du\s+même\s+code"
EDGE = "array<struct<target: string, family: string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is a value that is made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _edges(targets: str, family: str) -> str:
    return f"transform({targets}, x -> named_struct('target', x, 'family', '{family}'))"


def references_sql(text: str) -> str:
    """The references of an expression as Spark SQL: array of (target, family), each once.

    ``du même code`` means the code that was named last: after a lettered list, if there is any.
    """
    pattern = lambda p: _quoted(p.replace("(?i)", "(?iu)"))
    pieces = f"split(regexp_replace(translate(coalesce({text}, ''), {_quoted(ODD)}, {_quoted(EVEN)}), {pattern(HEAD)}, '{MARK}$1'), '{MARK}')"
    after_head = f"regexp_replace(concat(p, array_join(slice(pieces, i + 2, {AHEAD}), '')), {pattern(r'(?i)^articles?\s+')}, '')"
    listed = lambda kind: f"regexp_extract(body, {pattern(_LISTS[kind])}, 0)"
    code = lambda rest: f"lower(regexp_extract({rest}, {pattern(_OF_CODE)}, 1))"
    found = "named_struct('body', body, 'plain', plain, 'of', {of}, 'lettered', lettered, 'letters_of', {letters}, 'same', {same})".format(
        of=code("substring(body, length(plain) + 1)"), letters=code("substring(body, length(lettered) + 1)"), same=f"substring(body, length(lettered) + 1) rlike {pattern(_OF_SAME)}"
    )
    each = _let(after_head, "body", _let(listed("plain"), "plain", _let(listed("lettered"), "lettered", found)))
    heads = _let(pieces, "pieces", f"slice(transform(pieces, (p, i) -> {each}), 2, size(pieces))")

    numbers = f"regexp_extract_all(h.plain, {_quoted(NUMBER)}, 0)"
    letters = f"transform(regexp_extract_all(h.lettered, {pattern('(?i)' + LETTERED)}, 0), x -> replace(rtrim('.', regexp_replace(upper(x), {_quoted(r'^([LRD])\.\s*')}, '$1')), '.', '-'))"
    # The list up to and with a number is as long as all that stands before the next one.
    until = f"length(regexp_extract(h.plain, concat({_quoted('^(?:' + NUMBER + BETWEEN_PLAIN + '){')}, cast(k - 1 as string), '}}', {_quoted(NUMBER)}), 0))"
    own = f"transform(filter(sequence(1, size(numbers)), k -> not substring(h.body, {until} + 1, 80) rlike {pattern('(?i)' + OWNED)}), k -> concat('pcg-', element_at(numbers, k)))"
    names = "case {c} " + " ".join(f"when {_quoted(name)} then '{short}'" for name, short in CODES.items()) + " end"
    legi = lambda listed, c: f"transform({listed}, x -> concat('legi-', x, '-', {names.format(c=c)}))"
    flat = lambda test, body: f"flatten(transform(filter(heads, h -> {test}), h -> {body}))"
    last = "coalesce(try_element_at(filter(heads, h -> h.lettered <> '' and h.letters_of <> ''), -1).letters_of, try_element_at(filter(heads, h -> h.plain <> '' and h.of <> ''), -1).of)"
    every = ", ".join([
        _edges(flat("h.plain <> ''", _let(numbers, "numbers", own)), "internal"),
        _edges(flat("h.plain <> '' and h.of <> ''", legi(numbers, "h.of")), "external"),
        _edges(flat("h.lettered <> '' and h.letters_of <> ''", legi(letters, "h.letters_of")), "external"),
        _edges(f"coalesce({flat(f'h.lettered <> {chr(39) * 2} and h.same and {last} is not null', legi(letters, last))}, array())", "external"),
        _edges(f"transform(regexp_extract_all(coalesce({text}, ''), {pattern(REGULATION)}, 0), x -> concat('crc-', regexp_extract(x, {_quoted(r'\d{2,4}-\d{2}')}, 0)))", "historical"),
        _edges(f"transform(regexp_extract_all(coalesce({text}, ''), {pattern(OPINION)}, 0), x -> concat('avis-', lower(regexp_extract(x, '(?i)CNC|CU', 0)), '-', regexp_extract(x, {_quoted(r'\d{4}-.*$')}, 0)))", "historical"),
    ])
    return _let(heads, "heads", f"cast(array_distinct(concat({every})) as {EDGE})")


def extract_references(column: str) -> Column:
    """The references of a text column as an array of (target, family)."""
    return F.expr(references_sql(f"`{column}`"))


def references_duckdb(text: str) -> str:
    """The same list in DuckDB SQL, as an array of (target, family) without repeats, in no order."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    heads = (
        f"list_transform(list_transform(range(2, len(pieces) + 1), lambda i: regexp_replace(array_to_string(pieces[i : i + {AHEAD}], ''), {q(r'(?i)^articles?\s+')}, '')),"
        f" lambda b: {{'body': b, 'plain': regexp_extract(b, {q(_LISTS['plain'])}, 0), 'lettered': regexp_extract(b, {q(_LISTS['lettered'])}, 0)}})"
    )
    code = lambda which: f"lower(regexp_extract(substring(h.body, length(h.{which}) + 1), {q(_OF_CODE)}, 1))"
    named = f"list_transform(heads, lambda h: {{'body': h.body, 'plain': h.plain, 'lettered': h.lettered, 'of': {code('plain')}, 'letters_of': {code('lettered')}, 'same': regexp_matches(substring(h.body, length(h.lettered) + 1), {q(_OF_SAME)})}})"
    numbers = f"regexp_extract_all(h.plain, {q(NUMBER)})"
    letters = f"list_transform(regexp_extract_all(h.lettered, {q('(?i)' + LETTERED)}), lambda x: replace(rtrim(regexp_replace(upper(x), {q(r'^([LRD])\.\s*')}, {q(chr(92) + '1')}), '.'), '.', '-'))"
    # The numbers up to one, and what lies between them.
    until = f"list_sum(list_transform(({numbers})[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_split_to_array(h.plain, {q(NUMBER)})[1 : k], lambda x: length(x))), 0)"
    names = "CASE {c} " + " ".join(f"WHEN {q(name)} THEN '{short}'" for name, short in CODES.items()) + " END"
    edge = lambda listed, family: f"list_transform({listed}, lambda x: {{'target': x, 'family': '{family}'}})"
    flat = lambda test, body: f"flatten(list_transform(list_filter(named, lambda h: {test}), lambda h: {body}))"
    legi = lambda listed, c: f"list_transform({listed}, lambda x: 'legi-' || x || '-' || {names.format(c=c)})"
    own = f"list_transform(list_filter(range(1, len({numbers}) + 1), lambda k: NOT regexp_matches(substring(h.body, CAST({until} AS BIGINT) + 1, 80), {q('(?i)' + OWNED)})), lambda k: 'pcg-' || ({numbers})[k])"
    last = "coalesce(list_filter(named, lambda g: g.lettered <> '' AND g.letters_of <> '')[-1].letters_of, list_filter(named, lambda g: g.plain <> '' AND g.of <> '')[-1].of)"
    every = " || ".join([
        edge(flat("h.plain <> ''", own), "internal"), edge(flat("h.plain <> '' AND h.of <> ''", legi(numbers, "h.of")), "external"), edge(flat("h.lettered <> '' AND h.letters_of <> ''", legi(letters, "h.letters_of")), "external"),
        edge(flat(f"h.lettered <> '' AND h.same AND {last} IS NOT NULL", legi(letters, last)), "external"),
        edge(f"list_transform(regexp_extract_all(t, {q(REGULATION)}), lambda x: 'crc-' || regexp_extract(x, {q(r'[0-9]{2,4}-[0-9]{2}')}))", "historical"),
        edge(f"list_transform(regexp_extract_all(t, {q(OPINION)}), lambda x: 'avis-' || lower(regexp_extract(x, '(?i)CNC|CU')) || '-' || regexp_extract(x, {q(r'[0-9]{4}-.*$')}))", "historical"),
    ])
    cut = f"string_split(regexp_replace(translate(t, {q(ODD)}, {q(EVEN)}), {q(HEAD)}, chr(1) || {q(chr(92) + '1')}, 'g'), chr(1))"
    return f"(SELECT list_distinct({every}) FROM (SELECT t, {named} AS named FROM (SELECT t, {heads} AS heads FROM (SELECT t, {cut} AS pieces FROM (SELECT coalesce({text}, '') AS t)))))"
