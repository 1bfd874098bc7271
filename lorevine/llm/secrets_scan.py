r"""Operator 10 [native]: secret scans with a battery of randomness tests.

Spans of three patterns come first: assignments to names like ``token``, access keys and
long hex runs. The battery then looks at every other run of at least ``LEAST`` characters
of the base64 and URL alphabets. Its encoding is inferred from the characters (the
narrowest alphabet of ``ENCODINGS`` that has them all), the characters become numbers, and three tests ask whether these
are uniform and independent: chi-squared over the alphabet, the number of runs above and
below its middle, and the serial correlation at lag 1. A run that none of them rejects at
``REJECT`` may be random; how surprising it would be for ordinary text of its length is a
p-value, and a
Benjamini-Hochberg procedure over the runs of a document, weighted by length, keeps the
share of false finds at ``FALSE_SHARE``. Short runs therefore need more evidence.

Ordinary text is words, identifiers and paths: a table of how many bits each character
takes after the one before it (changes between small and capital letters, digits and
marks, and letters after letters) gives a run's bits a character, and these have known moments over
such text. Digits alone all take the same bits, so for decimal runs the p-value is from
the moments of the chi-squared statistic for ordinary numbers instead.

Only column expressions are used and nothing is shuffled, so hot sources or copies don't
matter. Positions are code points. A text without any candidate costs four scans.

Null text is empty and has no spans. Repeated rows, null ids and further columns need no
care, since rows are handled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevine.llm import common

#: The three base patterns, and the kinds in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8

#: Shortest run that the battery looks at, level at which a test rejects, share of false finds.
LEAST, REJECT, FALSE_SHARE = 20, 0.01, 0.05
RUNS = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding: alphabet, and what a value in it looks like; the first that fits holds, narrow alphabets before wide ones.
ENCODINGS = {
    "decimal": (_DIGITS, "^[0-9]+$"),
    "hex": (_DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$"),
    "upper": (_UPPER, "^[A-Z]+$"),
    "lower": (_LOWER, "^[a-z]+$"),
    "base32": (_UPPER + "234567", "^[A-Z2-7]+$"),
    "base32_lower": (_LOWER + "234567", "^[a-z2-7]+$"),
    "base36_upper": (_DIGITS + _UPPER, "^[0-9A-Z]+$"),
    "base36_lower": (_DIGITS + _LOWER, "^[0-9a-z]+$"),
    "letters": (_UPPER + _LOWER, "^[A-Za-z]+$"),
    "base62": (_DIGITS + _UPPER + _LOWER, "^[0-9A-Za-z]+$"),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", "^"),
}
#: Share of coinciding characters in ordinary numbers, and of triples.
SAME_TWO, SAME_THREE = 0.20, 0.060
#: Bits of a change from a small letter, capital, digit or mark (rows) to each of these (columns).
CHANGE_BITS = ((0.21, 4.78, 8.63, 3.36), (1.72, 0.73, 6.35, 3.66), (4.78, 3.92, 0.43, 2.69), (0.41, 3.1, 5.11, 3.34))
#: Quarters of a bit, as base64 digits, of the letters a-z after a-z (rows) and at a start (last row), case aside.
LETTER_BITS = """
WWRUUjZaQiiSXJWYhPQKPedjgs SgdgHkkuVcoFhlOiyWXgUmrsYq RlagQgjFPxVVhkLgpVbQWoqvg0
OWdZIdhTLmoVgUJftURQWlYriv OaWQSddZQmjUYKWaeJNSXcdakb NYadMSbWKvdThaLdxPVNTeftce
MWbhGjZSR0eTdSRc0RRSVeavne JVcrHtdSR0dVjTPcpVSPcdX0ld VaRYMaZfbnpVXHLbdWSNlajg0e
DmchNmn0a0fhhjPg0oRhPlY0o0 TcYcCdZjRnnYdZbbleRaZhZrfx PhcYGgipMnmNgkSgmfYYYhrvKw
MVfcFjjlL0iZUdPOuhXcWlnpgt QWVMMeMUSmdWeUQcgWRJaZZxng ZcXXcRcmUihXVGaZjLSXLfblps
JlbbMMkXTvgPhiOSnNXRVolsWx jsnjqouvj00ZnlopjgdpArm0w0 NWXaGjZVPmcXZVPbjRSQZcawdg
SbOcNhdLRfhYZaSXcXSHVneqcy QaciLiiHJxjZiZSdoRUTahdrbV SVXdIdbZSrgSWLUUfPRPfZeNvg
MhdkElilIv0khfSiyYcgfnhrmz RjhgVirCQyhgkXVivVYhqpjnsz OdPaKckdOtuUUjPOVSaKhVkbZm
QUZaLecRQipSXPONqTONnhUnlh QUUcMoXZUcZXY0ZZdaUUEZrugY OVRULXYURgfTWSOUbRRLXZZkmh
""".split()
#: Bits a character over runs of ordinary text: mean, and variance between runs and, by the number of characters, within.
TEXT_MEAN, TEXT_BETWEEN, TEXT_WITHIN = 4.46, 0.0625, 5.2
#: The characters that the bits tell apart: letters, any digit, any mark.
_SIGNS = _LOWER + _UPPER + "0+"
_BLOCK = 256


# The expressions below are SQL text: one call each, where thousands of Column objects would take seconds to build.


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` is a value that is made once, inside lambdas too."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sum(xs: str, zero: str = "0L") -> str:
    return f"aggregate({xs}, {zero}, (sum, x) -> sum + x)"


def _before(lengths: str) -> str:
    """Sums of all elements before each one, in blocks of ``_BLOCK``, each array made once."""
    n = _BLOCK
    within = f"transform(sequence(b * {n}, least(size(own), (b + 1) * {n}) - 1), i -> base + {_sum(f'slice(own, b * {n} + 1, i - b * {n})')})"
    each = f"flatten(transform(blocks, (unused, b) -> {_let(_sum('slice(blocks, 1, b)'), 'base', within)}))"
    sums = f"transform(sequence(0, cast(floor((size(own) - 1) / {n}) as int)), b -> {_sum(f'slice(own, b * {n} + 1, {n})')})"
    return _let(lengths, "own", f"if(size(own) > 0, {_let(sums, 'blocks', each)}, cast(array() as array<bigint>))")


def _found(df: DataFrame, name: str, pattern: str, maybe: str, value_group: int = 0) -> DataFrame:
    """``name``: array of (start, end, value) of the leftmost matches of ``pattern`` that don't overlap."""
    p = _text(pattern)
    df = df.withColumn("_m", F.expr(f"if({maybe} and text rlike {p}, regexp_extract_all(text, {p}, 0), cast(array() as array<string>))"))
    values = f"if(size(_m) > 0, regexp_extract_all(text, {p}, {value_group}), _m)" if value_group else "_m"
    # What lies between matches, and the matches, add up to the starts.
    gaps = f"if(size(_m) > 0, transform(split(text, {p}, -1), x -> cast(length(x) as bigint)), cast(array() as array<bigint>))"
    df = df.withColumns({"_v": F.expr(values), "_g": F.expr(gaps)})
    starts = f"zip_with({_before('zip_with(slice(_g, 1, size(_m)), _m, (gap, m) -> gap + length(m))')}, slice(_g, 1, size(_m)), (b, gap) -> b + gap)"
    spans = f"zip_with({starts}, arrays_zip(_m, _v), (at, x) -> named_struct('start', at, 'end', at + length(x._m), 'value', x._v))"
    return df.withColumn(name, F.expr(spans)).drop("_m", "_v", "_g")


def _upper_tail(z: str) -> str:
    """1 - normal distribution function, by the rational approximation of Abramowitz and Stegun (26.2.17)."""
    poly = "t * (0.319381530D + t * (-0.356563782D + t * (1.781477937D + t * (-1.821255978D + t * 1.330274429D))))"
    tail = _let("1 / (1 + 0.2316419D * abs(z))", "t", f"exp(-z * z / 2) * 0.3989422804014327D * {poly}")
    return _let(z, "z", _let(tail, "tail", "if(z >= 0, tail, 1 - tail)"))


def encoding_of(value: str) -> str:
    """The narrowest alphabet that has all characters of a value."""
    return "case " + " ".join(f"when {value} rlike {_text(pattern)} then '{name}'" for name, (_, pattern) in ENCODINGS.items()) + " end"


def _by_encoding(pick) -> str:
    return "case e " + " ".join(f"when '{name}' then {pick(alphabet)}" for name, (alphabet, _) in ENCODINGS.items()) + " end"


def sign_bits() -> list[float]:
    """Bits of each of ``_SIGNS`` after each of them, row by row."""
    base64, out = ENCODINGS["base64"][0], []
    for a in range(len(_SIGNS)):
        for b in range(len(_SIGNS)):
            one, two = (min(x // 26, 2) + (x == 53) for x in (a, b))
            after = a % 26 if (one, two) in ((0, 0), (1, 1), (1, 0)) else 26
            here = base64.index(LETTER_BITS[after][b % 26]) / 4 if two < 2 else 3.32 if two == 2 else 1.0
            out.append(round(CHANGE_BITS[one][two] + here, 2))
    return out


def _coded() -> str:
    """A span ``s`` with encoding ``e`` -> its alphabet's size, numbers by character, and bits by pair."""
    characters = lambda text: f"filter(split({text}, ''), c -> c <> '')"
    plain = characters("translate(if(e = 'hex', lower(s.value), s.value), '-_', '+/')")
    signs = f"transform({characters("translate(s.value, '123456789-_/', '000000000+++')")}, c -> instr({_text(_SIGNS)}, c))"
    # One literal after constant folding.
    bits = f"cast(split('{','.join(map(str, sign_bits()))}', ',') as array<double>)"
    taken = f"zip_with(slice(signs, 1, size(signs) - 1), slice(signs, 2, size(signs)), (a, b) -> element_at({bits}, cast((a - 1) * {len(_SIGNS)} + b as int)))"
    alphabet = _by_encoding(_text)
    numbers = _let(alphabet, "alphabet", f"transform({plain}, c -> instr(alphabet, c) - 1)")
    return f"named_struct('start', s.start, 'end', s.end, 'k', {_by_encoding(lambda a: f'{len(a)}D')}, 'number', e = 'decimal', 'codes', {numbers}, 'bits', {_let(signs, 'signs', taken)})"


def _moments() -> str:
    """What the statistics of a coded span ``s`` are made of."""
    pairs = "zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (a, b) -> named_struct('a', a, 'b', b))"
    fields = {
        "start": "s.start", "end": "s.end", "k": "s.k", "number": "s.number", "bits": _sum("s.bits", "0D"), "n": "cast(size(v) as double)",
        "squares": "aggregate(sequence(0, 63), 0D, (sum, k) -> sum + pow(cast(size(filter(v, x -> x = k)) as double), 2D))",
        "above": "cast(size(filter(v, x -> x >= s.k / 2)) as double)",
        "runs": "cast(size(filter(pairs, p -> (p.a >= s.k / 2) <> (p.b >= s.k / 2))) + 1 as double)",
        "s1": "aggregate(v, 0D, (sum, x) -> sum + x)", "s2": "aggregate(v, 0D, (sum, x) -> sum + x * x)", "s11": "aggregate(pairs, 0D, (sum, p) -> sum + p.a * p.b)",
        "v1": "element_at(v, 1)", "vn": "element_at(v, -1)",
    }
    return _let("s.codes", "v", _let(pairs, "pairs", "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"))


def _statistics() -> str:
    """The tests' p-values of a span with moments ``s``, and how surprising it is for text."""
    chi = "(s.k / s.n * s.squares - s.n)"
    pq = "(2 * s.above * (s.n - s.above))"
    spread = f"({pq} * ({pq} - s.n) / (s.n * s.n * (s.n - 1)))"
    mean = "(s.s1 / s.n)"
    variance = f"(s.s2 - s.n * {mean} * {mean})"
    covariance = f"(s.s11 - {mean} * (2 * s.s1 - s.v1 - s.vn) + (s.n - 1) * {mean} * {mean})"
    uniform = _upper_tail(f"({chi} - (s.k - 1)) / sqrt(2 * (s.k - 1))")
    runs = f"if({spread} > 0, 2 * {_upper_tail(f'abs(s.runs - {pq} / s.n - 1) / sqrt({spread})')}, 0D)"
    serial = f"if({variance} > 0, 2 * {_upper_tail(f'abs({covariance} / {variance}) * sqrt(s.n)')}, 0D)"
    numbers = _upper_tail(f"({10 * SAME_TWO - 1!r}D - {chi} / s.n) / {20 * (SAME_THREE - SAME_TWO**2) ** 0.5!r}D * sqrt(s.n)")
    letters = _upper_tail(f"(s.bits / (s.n - 1) - {TEXT_MEAN}D) / sqrt({TEXT_BETWEEN}D + {TEXT_WITHIN}D / (s.n - 1))")
    return f"named_struct('start', s.start, 'end', s.end, 'n', s.n, 'least', least({uniform}, {runs}, {serial}), 'p_text', if(s.number, {numbers}, {letters}))"


def _battery(df: DataFrame, name: str) -> DataFrame:
    """``name`` as array of (start, end, value) -> (start, end, least, p) of those that the battery keeps."""
    for step in (_let(encoding_of("s.value"), "e", _coded()), _moments(), _statistics()):
        df = df.withColumn(name, F.expr(f"transform({name}, s -> {step})"))
    # Each run's p-value is weighted by its length: times the mean length, over its own.
    mean = f"aggregate({name}, 0D, (sum, s) -> sum + s.n) / size({name})"
    weighted = _let(mean, "mean", f"transform({name}, s -> named_struct('start', s.start, 'end', s.end, 'least', s.least, 'p', s.p_text * mean / s.n))")
    # The procedure: all up to the last p-value that is below its step.
    limit = _let("array_sort(transform(every, s -> s.p))", "ps", f"coalesce(array_max(transform(ps, (p, i) -> if(p <= {FALSE_SHARE}D * (i + 1) / size(ps), p, null))), -1D)")
    kept = _let(limit, "most", f"filter(every, s -> s.least >= {REJECT}D and s.p <= most)")
    return df.withColumn(name, F.expr(f"if(size({name}) > 0, {_let(weighted, 'every', kept)}, cast(array() as array<struct<start: bigint, end: bigint, least: double, p: double>>))"))


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and ``found``: array of (start, kind number, end), by start and kind."""
    df = common.document_text(documents)
    df = _found(df, "assign", ASSIGN, "(contains(text, ':') or contains(text, '='))", 2)
    df = df.withColumn("assign", F.expr(f"filter(assign, s -> length(s.value) >= {LEAST_VALUE})"))
    df = _found(df, "access", ACCESS, "contains(text, 'AKIA')")
    df = _found(df, "hex", HEX, "true")
    df = _battery(_found(df, "random", RUNS, "true"), "random")
    every = ", ".join(f"transform({kind}, s -> named_struct('start', s.start, 'kind', {k}, 'end', s.end))" for k, kind in enumerate(KINDS))
    return df.select("doc_id", F.expr(f"array_sort(concat({every}))").alias("found"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), cast(s.start as string), cast(s.end as string))), ',')"


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans counted and digested, and all spans."""
    found = scan_secrets(common.table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.expr(f"sha2({_listed('filter(found, s -> s.kind < 3)')}, 256)").alias("base_sha256")
    return found.select("doc_id", *counts, base, F.expr(_listed("found")).alias("spans"))
