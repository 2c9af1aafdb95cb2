"""Personal data in texts, in DataFrame functions alone.

Regular expressions propose spans, one kind after another; arithmetic confirms them (octets of an address, Luhn for
cards, mod-97 for IBANs, areas and groups of social security numbers, counts of digits); and words nearby raise the
score.  A text is cut at the matches of a pattern, so the lengths of the pieces and of the matches give every
position, and the context of a match is the end of the piece before it and the beginning of the piece after it.
Rows are independent: no shuffle, and the work is linear in the text.  The patterns can't backtrack over a run of
characters twice, so a text without blanks costs no more than another.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` are reported whatever their score.  ``iban`` (of the length that its
country has, remainder 1), ``ssn`` and ``local`` (a telephone number without its country) are reported from
``threshold`` on; for the last two this takes a word that names them within 40 characters before or 20 after.
A proposal that fails is dropped without another try inside of it.  Kinds may overlap; each span is reported.

Defined cases: a null text is empty and has no spans; repeated rows get equal results; an input column named findings
is replaced, all others stay; an empty table gives an empty one.  Positions count code points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import unclashed

# fixed values: the lengths of IBANs by country
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
WORDS = {
    "email": "email|mail|e-mail|contact|write",
    "ip": "ip|ipv4|host|server|address",
    "card": "card|visa|credit|debit|mastercard|payment",
    "phone": "phone|tel|telephone|call|mobile|cell|fax",
    "iban": "iban|account|bank|konto|transfer",
    "ssn": "ssn|social|security|taxpayer",
    "local": "phone|tel|telephone|call|mobile|cell|fax",
}
BEFORE, AFTER = 40, 20
CONTEXT = 0.3
CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _running(values: Column) -> Column:
    """The sum of all earlier values, for each value; by chunks, so that long arrays aren't copied once for each value."""
    count = F.ceil(F.size(values) / CHUNK).cast("int")
    chunks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))).otherwise(F.array().cast("array<array<bigint>>"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    within = lambda part, first: F.transform(F.slice(_sums(part), 1, F.size(part)), lambda v: v + first)
    return _let(chunks, lambda parts: _let(_sums(F.transform(parts, total)), lambda firsts: F.flatten(F.transform(parts, lambda part, i: within(part, F.get(firsts, i))))))


@dataclass
class Match:
    """Columns of one match: its text, place, and the characters around it."""

    text: Column
    start: Column
    before: Column
    after: Column


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _whole(m: Match) -> Column:
    return F.length(m.text)


def _alone(m: Match, size: Column) -> Column:
    """No letter, digit, dot or hyphen that would continue it stands next to it."""
    following = F.concat(F.substring(m.text, size + 1, F.lit(1)), m.after)
    return ~m.before.rlike("[0-9A-Za-z.-]\\z") & ~following.rlike("^(?:[0-9A-Za-z]|[.-][0-9])")


def _octets(m: Match) -> Column:
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
    # the possessive zeros may leave an empty rest: the proposal has a digit in each part
    return m.text.rlike(f"^{octet}(?:\\.{octet}){{3}}$")


def _luhn(m: Match) -> Column:
    digits = _digits(m.text)
    return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)


def _telephone(m: Match) -> Column:
    return F.length(_digits(m.text)).between(9, 15)


def _iban_size(m: Match) -> Column:
    """Characters of the proposal up to its country's length, or 0."""
    sizes = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.split() for x in (pair[:2], int(pair[2:]))])
    wanted = F.coalesce(F.try_element_at(sizes, F.substring(m.text, 1, 2)), F.lit(99))
    pattern = F.concat(F.lit("^(?:[A-Z0-9] ?){"), (wanted - 1).cast("string"), F.lit("}[A-Z0-9]"))
    return F.length(F.call_function("regexp_extract", m.text, pattern, F.lit(0)))


def _mod97(m: Match, size: Column) -> Column:
    plain = F.replace(F.substring(m.text, F.lit(1), size), F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: (acc * F.when(c >= "A", 100).otherwise(10) + F.when(c == "", 0).otherwise(value(c))) % 97)
    return F.when(size > 0, rest == 1).otherwise(False)


def _social(m: Match) -> Column:
    return m.text.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _national(m: Match) -> Column:
    # the rest of a number that begins with a plus sign is its own kind
    return ~m.before.rlike("\\+[0-9 ().-]*\\z")


@dataclass
class Kind:
    """A pattern, a cheap test of whole texts, the score of a confirmed match, its size and its confirmation."""

    name: str
    pattern: str
    needs: str
    score: float
    size: Callable[[Match], Column]
    confirmed: Callable[[Match, Column], Column]
    base: bool = True


KINDS = [
    # a local part starts where its run of characters starts, or where the match before has ended
    Kind("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", 0.8, _whole, lambda m, n: F.lit(True)),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", 0.6, _whole, lambda m, n: _octets(m)),
    # a run of fewer than 12 digits is never a card, so the pattern asks for them
    Kind("card", "[0-9](?:[ -]?+[0-9]){11,}+", "[0-9](?:[ -]?[0-9]){11}", 0.7, _whole, lambda m, n: _luhn(m)),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", "\\+[0-9]", 0.6, _whole, lambda m, n: _telephone(m)),
    Kind("iban", "[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}", "[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]", 0.7, _iban_size, lambda m, n: _mod97(m, n) & _alone(m, n), base=False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", 0.4, _whole, lambda m, n: _social(m) & _alone(m, n), base=False),
    Kind("local", "\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[0-9]\\)?[ .-][0-9]{3}[ .-][0-9]", 0.4, _whole, lambda m, n: _national(m) & _alone(m, n), base=False),
]
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double,base:boolean>"


def spans_of(text: Column, kind: Kind, threshold: float) -> Column:
    """The confirmed spans of one kind, in order: start, rank of the kind, end, kind, score, base."""
    near = f"(?i)(?:^|[^a-z])(?:{WORDS[kind.name]})(?:[^a-z]|$)"

    def judged(m: Match) -> Column:
        return _let(kind.size(m), lambda n: F.when(
            kind.confirmed(m, n),
            F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m.start + n).alias("end"), F.lit(kind.name).alias("kind"),
                     (F.lit(kind.score) + F.when(m.before.rlike(near) | m.after.rlike(near), CONTEXT).otherwise(0.0)).alias("score"), F.lit(kind.base).alias("base")),
        ).cast(SPAN))

    def placed(pieces: Column, matches: Column) -> Column:
        sizes = F.transform(matches, lambda x, i: (F.length(F.get(pieces, i)) + F.length(x)).cast("long"))
        return _let(_running(sizes), lambda starts: F.transform(matches, lambda x, i: judged(Match(x, F.get(starts, i) + F.length(F.get(pieces, i)), F.right(F.get(pieces, i), F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER))))))

    found = _let(F.split(text, kind.pattern, -1), lambda pieces: _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda matches: placed(pieces, matches)))
    kept = F.filter(found, lambda s: s.isNotNull() & (F.lit(kind.base) | (s["score"] >= threshold)))
    return F.when(text.rlike(kind.needs), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.65) -> DataFrame:
    """The rows with ``findings``: spans by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return unclashed(docs, ["findings"] if text_col.lower() != "findings" else []).withColumn("findings", F.array_sort(F.concat(*[spans_of(text, k, threshold) for k in KINDS])))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans, for rows of find_pii."""
    number = lambda name: F.size(F.filter("findings", lambda s: s["kind"] == name)).cast("long")
    counts = [number(k.name).alias(f"n_{k.name}") for k in KINDS if k.base]
    base = F.filter("findings", lambda s: s["base"])
    return found.select(id_col, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))


def oracle_sql() -> str:
    """The same kinds with the patterns as they are told, all proposals confirmed row by row."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+"}
    kinds = [(k, patterns.get(k.name, k.pattern)) for k in KINDS]
    proposals = "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k.name}' AS kind, {k.score} AS score, '(?i)(?:^|[^a-z])(?:{WORDS[k.name]})(?:[^a-z]|$)' AS words, {'true' if k.base else 'false'} AS base, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM d"
        for i, (k, p) in enumerate(kinds))
    countries = ", ".join(f"'{x[:2]}': {x[2:]}" for x in IBAN_LENGTHS.split())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({proposals}),
e AS (SELECT doc_id, rank, kind, score, words, base, m[i] AS s, right(p[i], {BEFORE}) AS b, left(p[i + 1], {AFTER}) AS a,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
  regexp_replace(m[i], '[^0-9]', '', 'g') AS digits FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
n AS (SELECT *, CASE WHEN kind = 'iban' THEN length(regexp_extract(s, '^(?:[A-Z0-9] ?){{' || (coalesce(MAP {{{countries}}}[left(s, 2)], 99) - 1) || '}}[A-Z0-9]')) ELSE length(s) END AS size FROM e),
j AS (SELECT *, replace(left(s, size), ' ', '') AS plain, substr(s, size + 1, 1) || a AS following FROM n),
c AS (SELECT *, NOT regexp_matches(b, '[0-9A-Za-z.-]\\z') AND NOT regexp_matches(following, '^(?:[0-9A-Za-z]|[.-][0-9])') AS alone,
  score + CASE WHEN regexp_matches(b, words) OR regexp_matches(a, words) THEN {CONTEXT} ELSE 0 END AS total FROM j),
f AS (SELECT * FROM c WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND right(x, 3)::INT <= 255))
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN (length(digits) - i) % 2 = 1 THEN (2 * digits[i]::INT) // 10 + (2 * digits[i]::INT) % 10 ELSE digits[i]::INT END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN size > 0 AND alone AND list_reduce(list_transform(string_split(plain[5:] || left(plain, 4), ''), lambda x: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1),
    lambda acc, x: (acc * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, 0) = 1
  WHEN 'ssn' THEN alone AND left(digits, 3) NOT IN ('000', '666') AND digits[1] <> '9' AND digits[4:5] <> '00' AND digits[6:] <> '0000'
  ELSE alone AND NOT regexp_matches(b, '\\+[0-9 ().-]*\\z') END AND (base OR total >= 0.65)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (base) AS bases, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
