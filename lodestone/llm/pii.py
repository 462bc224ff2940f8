"""Format-preserving pseudonyms for personal data (operator 7), with DataFrame functions only.

Values found by pattern are checked (checksum of a card number, octets of an address, a day that exists) and replaced by a keyed permutation of
all values of the same format, built as a Feistel network: equal values get equal pseudonyms in every document, different ones different ones,
and a pseudonym passes the same check. The round function is SHA-256 over the key.

* dates (year, month, day or day, month, year, with - / or .; month, day, year where only that is a day): the number of the day within
  1900-2099, by a network over 18 bits that is walked until it lands in the range; same layout;
* IPv4 addresses: 32 bits;
* card numbers (13 to 19 digits that pass Luhn's check, also beside other numbers): all digits but the last, which is computed anew; separators stay;
* telephone and social security numbers: their digits; a country code and the separators stay;
* e-mail addresses (the part before the @) and secrets (access keys; the whole value behind password, token, secret or api_key and = or :): each
  character within its class, digit, capital or small letter; others stay.

What doesn't pass its check stays as it is.

Defined results: null texts stay null; texts without a find stay as they are, byte for byte; repeated rows get equal results; other columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, packed, unpacked

#: What stands before a secret.
SECRET = r"(?:[Pp]ass(?:word|wd)|PASSWORD|PASSWD|[Pp]wd|PWD|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[_\- ]?[Kk]ey|API[_\- ]?KEY)[\x22\x27]?[ \t]*(?:=>|:=|[=:])[ \t]*"
#: No card number begins here.
_NO_CARD = r"(?![ \-][0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9]))(?![ \-][0-9]{13,19}(?![0-9]))"
#: What is looked for, in this order at each place; a run of characters is tried at its start only.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|" + SECRET + r"(?:\x22[^\x22\r\n]+\x22|\x27[^\x27\r\n]+\x27|[\x22\x27]?[^\s\x22\x27](?:\S*[^\s\x22\x27.,;:!?)\]}>])?)",
    "date": r"(?<![0-9\-/.])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9\-])|(?<![0-9\-/.])[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?:(?:\+[0-9]{1,3}[ .\-]?|(?<![0-9.\-+])1[ .\-]|(?<![0-9.\-]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])|\([0-9]{3}\) ?)[0-9]{3}[ .\-][0-9]{4}(?![0-9\-])"
    r"|\+[0-9](?:" + _NO_CARD + r"[ .\-/]?\(?[0-9]\)?){6,14}(?![0-9])|(?<![0-9.\-/])\(?0[0-9]{2,4}\)?[ /\-](?:[0-9]{5,8}|[0-9]{3,4}[ \-][0-9]{3,4})(?![0-9\-])",
    # Digits and what may stand between numbers; the cards, dates, addresses and telephone numbers in it are told apart by _parts.
    "run": r"(?<![0-9\-])[0-9](?:[ \-]?[0-9]){12}(?:[0-9 \-./]*[0-9])?(?![0-9\-])",
}
#: Usual groups of a card's digits, and what such a number begins with.
USUAL, ISSUER = r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})$", "^[3-6]"
#: A telephone number's country code, told by what separates it or else by the codes in use.
CODE = r"^(?:[+](?:[0-9]{1,3}(?=[ .(/-])[ .-]?|1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|1[ .-](?=[(]?[0-9]{3}))"
ROUNDS = 8


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _upto(n: str) -> str:
    """1 to n, nothing for 0."""
    return f"filter(sequence(0, {n}), u -> u > 0)"


def _text_feistel(value: str, key: str, kind: str) -> str:
    """Each half of a text shifts the other's characters within their classes, by turns."""
    # `other` stands for the half that is hashed, `own` for the one that is shifted
    shift = """array_join(transform(filter(sequence(0, length(own)), u -> u > 0), i -> element_at(transform(array(struct(
        ascii(substr(own, i, 1)) as c, cast(conv(substr(digest, 2 * ((i - 1) % 32) + 1, 2), 16, 10) as int) as d)), y -> case
        when y.c between 48 and 57 then chr(48 + (y.c - 48 + y.d) % 10) when y.c between 65 and 90 then chr(65 + (y.c - 65 + y.d) % 26)
        when y.c between 97 and 122 then chr(97 + (y.c - 97 + y.d) % 26) else substr(own, i, 1) end), 1)), '')"""
    digest = f"sha2(concat({_q(key + kind)}, '|', r, '|', length({value}), '|', OTHER), 256)"
    left = shift.replace("own", "s.l").replace("digest", "g")
    right = shift.replace("own", "s.r").replace("digest", "g")
    step = f"if(r % 2 = 0, {_let('g', digest.replace('OTHER', 's.r'), f'struct({left} as l, s.r as r)')}, {_let('g', digest.replace('OTHER', 's.l'), f'struct(s.l as l, {right} as r)')})"
    half = f"cast(length({value}) div 2 as int)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), struct(substr({value}, 1, {half}) as l, substr({value}, {half} + 1) as r), (s, r) -> {step}, s -> concat(s.l, s.r))"


def _number_feistel(value: str, bits: int, key: str, kind: str) -> str:
    """A permutation of the numbers of 2 * bits bits."""
    size = 1 << bits
    f = f"conv(substr(sha2(concat({_q(key + kind)}, '|', r, '|', s.r), 256), 1, 8), 16, 10)"
    step = f"struct(s.r as l, (s.l + cast({f} as bigint)) % {size} as r)"
    return f"aggregate(sequence(1, {ROUNDS}), struct(({value}) div {size} as l, ({value}) % {size} as r), (s, r) -> {step}, s -> s.l * {size} + s.r)"


def _luhn(digits: str) -> str:
    """Luhn's sum of a text of digits, the last one with weight 1."""
    digit = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0)))"


def _refill(layout: str, digits: str) -> str:
    """digits in the places of the layout's digits."""
    return f"array_join(transform({_upto(f'length({layout})')}, i -> if(substr({layout}, i, 1) between '0' and '9', substr({digits}, length(regexp_replace(substr({layout}, 1, i), '[^0-9]', '')), 1), substr({layout}, i, 1))), '')"


def _day(v: str, key: str) -> str:
    first, days = "date'1900-01-01'", 73049
    walk = f"aggregate(sequence(1, 256), struct(false as done, cast(datediff(day, {first}) as bigint) as n), (w, k) -> if(w.done, w, {_let('z', _number_feistel('w.n', 9, key, 'date'), f'struct(z < {days} as done, z as n)')}), w -> date_add({first}, cast(w.n as int)))"
    # Day first, or month first where only that is a day that exists
    ordered = f"try_cast(concat_ws('-', element_at(p, 3), element_at(p, {{}}), element_at(p, {{}})) as date)"
    first_day, first_month = ordered.format(2, 1), ordered.format(1, 2)
    two = "length(element_at(p, 1)) = 2 and length(element_at(p, 2)) = 2"
    sep = f"regexp_extract({v}, '[-/.]', 0)"
    for_layout = f"case when {v} rlike '^[0-9]{{4}}' then concat_ws({sep}, 'yyyy', 'MM', 'dd') when {first_day} is not null then concat_ws({sep}, if({two}, 'dd', 'd'), if({two}, 'MM', 'M'), 'yyyy') else concat_ws({sep}, if({two}, 'MM', 'M'), if({two}, 'dd', 'd'), 'yyyy') end"
    inside = f"day is not null and day >= {first} and datediff(day, {first}) < {days}"
    read = f"if({v} rlike '^[0-9]{{4}}', try_cast(concat_ws('-', p) as date), coalesce({first_day}, {first_month}))"
    return _let("p", f"split({v}, '[-/.]')", _let("day", read, f"if({inside}, date_format({walk}, {for_layout}), {v})"))


def _parts(v: str) -> str:
    """The parts of a run of digits: cards, what else is looked for, and what is between.

    Runs of 13 to 19 digits that begin and end at a group of digits and pass Luhn's check are cards, if they don't overlap: those in
    usual groups that begin like a card first, then the longest, then the first.
    """
    at = f"substr({v}, i, 38)"
    sizes = ", ".join(f"regexp_extract({at}, '^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])', 0)" for n in range(13, 20))
    rank = f"case when c rlike {_q(USUAL)} and c rlike '{ISSUER}' then 0 when c rlike {_q(USUAL)} then 1 else 2 end"
    digits = "regexp_replace(c, '[^0-9]', '')"
    luhn = _let("ds", digits, f"{_luhn('ds')} % 10 = 0")
    tried = f"transform(filter(array({sizes}), c -> c <> '' and {luhn}), c -> struct({rank} as rank, -length({digits}) as n, i as i, c as c))"
    starts = f"filter(sequence(1, length({v})), i -> substr({v}, i, 1) between '0' and '9' and (i = 1 or not substr({v}, i - 1, 1) between '0' and '9'))"
    cards = f"array_sort(flatten(transform({starts}, i -> {tried})))"
    kind = "array<struct<i:int,c:string>>"
    chosen = f"array_sort(aggregate({cards}, cast(array() as {kind}), (a, x) -> if(exists(a, y -> x.i < y.i + length(y.c) and y.i < x.i + length(x.c)), a, concat(a, array(struct(x.i as i, x.c as c))))))"
    before = "if(j = 0, 1, element_at(cs, greatest(j, 1)).i + length(element_at(cs, greatest(j, 1)).c))"
    rest = f"if(size(cs) = 0, {v}, substr({v}, element_at(cs, -1).i + length(element_at(cs, -1).c)))"
    other = _q("|".join(PATTERNS[k] for k in ("date", "ip", "ssn", "phone")))
    cut = lambda t: _let("t", t, f"flatten(zip_with(split(t, {other}, -1), regexp_extract_all(t, {other}, 0), (x, y) -> array(x, coalesce(y, ''))))")
    between = cut(f"substr({v}, {before}, x.i - {before})")
    return _let("cs", chosen, f"if(size(cs) = 0, {cut(v)}, concat(flatten(transform(cs, (x, j) -> concat({between}, array(x.c)))), {cut(rest)}))")


def _pseudonym(v: str, key: str) -> str:
    """The pseudonym of a find."""
    full = {k: _q(f"^(?:{p})$") for k, p in PATTERNS.items()}
    octets = f"transform(split({v}, '[.]'), o -> cast(o as int))"
    address = f"cast(element_at(o, 1) as bigint) * 16777216 + element_at(o, 2) * 65536 + element_at(o, 3) * 256 + element_at(o, 4)"
    dotted = "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)"
    ip = _let("o", octets, f"if(forall(o, e -> e <= 255), {_let('n', _number_feistel(address, 16, key, 'ip'), dotted)}, {v})")
    body = _text_feistel("substr(digits, 1, length(digits) - 1)", key, "card")
    card = _let("digits", f"regexp_replace({v}, '[^0-9]', '')", f"if({_luhn('digits')} % 10 = 0, {_let('fresh', body, _refill(v, 'concat(fresh, (10 - ' + _luhn('concat(fresh, 0)') + ' % 10) % 10)'))}, {v})")

    def number(kind: str) -> str:
        code = f"regexp_extract({v}, '{CODE}', 0)"
        rest = _let("rest", f"substr({v}, length(code) + 1)", f"concat(code, {_let('digits', _text_feistel('regexp_replace(rest, ' + _q('[^0-9]') + ', ' + _q('') + ')', key, kind), _refill('rest', 'digits'))})")
        return _let("code", code, rest)

    email = _let("name", f"substring_index({v}, '@', 1)", f"concat({_text_feistel('name', key, 'email')}, substr({v}, length(name) + 1))")
    # The value alone, without the quotes around it and what stands before
    head, tail = (f"regexp_extract({v}, {_q(p)}, 0)" for p in ("^" + SECRET + r"[\x22\x27]?", r"[\x22\x27]$"))
    value = f"substr({v}, length(head) + 1, length({v}) - length(head) - length(tail))"
    secret = _let("head", head, _let("tail", tail, f"concat(head, {_let('value', value, _text_feistel('value', key, 'secret'))}, tail)"))
    return f"""case when {v} rlike {_q('^' + SECRET)} then {secret}
        when {v} rlike '^AKIA[0-9A-Z]{{16}}$' then concat('AKIA', {_text_feistel(f'substr({v}, 5)', key, 'secret')})
        when {v} like '%@%' then {email}
        when {v} rlike {full['date']} then {_day(v, key)}
        when {v} rlike {full['ip']} then {ip}
        when {v} rlike {full['ssn']} then {number('ssn')}
        when {v} rlike {full['phone']} then {number('phone')}
        when {v} rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$' then {card}
        else {v} end"""


def pseudonymize(docs: DataFrame, key: str, text: str = "text", added: str = "__n_found") -> DataFrame:
    """docs with the text's personal data replaced, and the number of values that were, under the added name (what is found in one run of numbers counts as one)."""
    pattern = _q("|".join(PATTERNS.values()))
    out = packed(docs, col(text).alias("text")).withColumn("found", F.expr(f"regexp_extract_all(text, {pattern}, 0)"))
    run = _q(f"^(?:{PATTERNS['run']})$")
    out = out.withColumn("parts", F.expr(f"transform(found, f -> if(f rlike {run}, {_parts('f')}, array(f)))"))
    out = out.withColumn("fresh", F.expr(f"transform(parts, part -> array_join(transform(part, v -> {_pseudonym('v', key)}), ''))"))
    woven = _let("rest", f"split(text, {pattern}, -1)", "concat(element_at(rest, 1), array_join(flatten(zip_with(fresh, slice(rest, 2, size(found)), (a, b) -> array(a, b))), ''))")
    out = out.withColumn("changed", F.expr("coalesce(size(filter(zip_with(found, fresh, (a, b) -> a <> b), c -> c)), 0)"))
    return out.select(*unpacked(docs.columns, **{text: F.expr(f"if(changed > 0, {woven}, text)")}), F.col("changed").alias(added))
