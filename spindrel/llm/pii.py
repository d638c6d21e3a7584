"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame operations alone.

Found and validated: payment numbers (13 to 19 digits with a right check digit, bare or in
groups), IPv4 addresses, North American phone numbers, social security numbers, and dates
(YYYY-MM-DD, DD/MM/YYYY, DD.MM.YYYY).  Each value is permuted within its own format: the digits
by a Feistel network over a pair of residues, keyed and per kind, so equal values get equal
pseudonyms in every document and different values different ones; separators stay.  Payment
numbers get their check digit anew; dates are permuted as days of one 400-year cycle, whose
146,097 days are 189 * 773, so no date leaves the calendar.

E-mail addresses have no fixed format to permute within; their local part becomes ``u`` and 12
hex digits of a keyed hash.

Phone numbers are taken by their format alone, since unassigned area codes are written down as
often as others; the areas 900 to 999 of social security numbers are those of taxpayer numbers,
which are as personal.

The key is the caller's secret: whoever has it can undo the pseudonyms.  It stands in the query's
plan, so keep plans and event logs of these jobs as safe as the key.

There is no shuffle and no state: each row is rewritten alone.  Edge cases: null text stays
null with no findings; empty and very long texts are read whole; numbers that fail validation
stay; repeated rows and ties are rewritten alike; other columns stay as they are whatever their
names, and columns named like the counts are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of 400 Gregorian years, and the two factors they are dealt into.
CYCLE, LEFT_DAYS, RIGHT_DAYS = 146_097, 189, 773
#: The cycle's first day.
EPOCH = "1800-01-01"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds with the patterns that find them, in order of preference.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "phone": r"(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])(?:\+1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z.-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,4}(?: \d{1,3})?|\d{4}(?:-\d{4}){2}-\d{1,4}(?:-\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z-])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(left: str, right: str, a: str, b: str, key: str, kind: str) -> str:
    """SQL of a struct (l, r): a keyed permutation of residues modulo ``a`` and ``b``."""
    f = lambda side, half, mod: f"cast(conv(substr(sha2(concat({_sql(key + chr(31) + kind + chr(31) + side)}, i, ':', {a}, ':', {b}, ':', {half}), 256), 1, 14), 16, 10) as bigint) % {mod}"
    first = f"named_struct('l', (s.l + {f('l', 's.r', a)}) % {a}, 'r', s.r)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> transform(array({first}), t -> named_struct('l', t.l, 'r', (t.r + {f('r', 't.l', b)}) % {b}))[0])"


def _permuted(digits: str, key: str, kind: str) -> str:
    """SQL of as many digits: a permutation of the strings of that length."""
    half = f"cast(length({digits}) / 2 as int)"
    power = lambda n: f"cast(power(10, {n}) as bigint)"
    state = _feistel(f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", power(half), power(f"(length({digits}) - {half})"), key, kind)
    return f"transform(array({state}), z -> concat(lpad(cast(z.l as string), {half}, '0'), lpad(cast(z.r as string), length({digits}) - {half}, '0')))[0]"


def _luhn_sum(digits: str, odd: int) -> str:
    """SQL of the check sum of digits, every second one doubled, the last too if ``odd`` is 1."""
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + transform(array(cast(substr({digits}, i, 1) as int) * if((length({digits}) - i) % 2 = {1 - odd}, 2, 1)), d -> if(d > 9, d - 9, d))[0])"


def _refilled(found: str, digits: str) -> str:
    """SQL of ``found`` with its digits, from left to right, replaced by others."""
    return f"aggregate(split({found}, ''), named_struct('out', '', 'at', 1), (s, c) -> if(c rlike '^[0-9]$', named_struct('out', concat(s.out, substr({digits}, s.at, 1)), 'at', s.at + 1), named_struct('out', concat(s.out, c), 'at', s.at)), s -> s.out)"


def _kind(found: str) -> str:
    """SQL of the kind of a match, by its whole pattern and what validates it; else null."""
    bare = f"regexp_replace({found}, '[^0-9]', '')"
    tests = {
        "email": "true",
        "date": f"coalesce({_date(found)}, date'0001-01-01') between date'{EPOCH}' and date'2199-12-31'",
        "ip": "true",
        "phone": "true",
        "ssn": f"substr({found}, 1, 3) not in ('000', '666') and substr({found}, 5, 2) <> '00' and substr({found}, 8, 4) <> '0000'",
        "card": f"transform(array({bare}), n -> length(n) between 13 and 19 and {_luhn_sum('n', 0)} % 10 = 0 and not n rlike '^0+$')[0]",
    }
    inner = {k: p.replace("(?<![\\dA-Za-z.-])", "").replace("(?<![\\d/.-])", "").replace("(?<![\\d.])", "").replace("(?<![\\d-])", "").split("(?![\\")[0] if k not in ("phone", "email") else p for k, p in PATTERNS.items()}
    return "case " + " ".join(f"when {found} rlike {_sql(f'^(?:{inner[k]})$')} then if({test}, '{k}', null)" for k, test in tests.items()) + " end"


def _date(found: str) -> str:
    """SQL of the date that a match stands for, or null."""
    return f"case when substr({found}, 5, 1) = '-' then try_to_date({found}, 'yyyy-MM-dd') when substr({found}, 3, 1) = '/' then try_to_date({found}, 'dd/MM/yyyy') else try_to_date({found}, 'dd.MM.yyyy') end"


def _pseudonym(found: str, kind: str, key: str) -> str:
    bare = f"regexp_replace({found}, '[^0-9]', '')"
    day = f"datediff({_date(found)}, date'{EPOCH}')"
    moved = f"transform(array({_feistel(f'floor({day} / {RIGHT_DAYS})', f'{day} % {RIGHT_DAYS}', str(LEFT_DAYS), str(RIGHT_DAYS), key, 'date')}), z -> date_add(date'{EPOCH}', cast(z.l * {RIGHT_DAYS} + z.r as int)))[0]"
    dated = f"transform(array({moved}), m -> date_format(m, case when substr({found}, 5, 1) = '-' then 'yyyy-MM-dd' when substr({found}, 3, 1) = '/' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end))[0]"
    # The check digit follows from the other digits, so permuting those is enough.
    payload = f"transform(array(substr({bare}, 1, length({bare}) - 1)), p -> {_permuted('p', key, 'card')})[0]"
    card = f"transform(array({payload}), p -> concat(p, cast((10 - {_luhn_sum('p', 1)} % 10) % 10 as string)))[0]"
    # An address is one number of 32 bits, two halves of 16.
    octet = lambda i: f"cast(split({found}, '[.]')[{i}] as bigint)"
    ip = f"transform(array({_feistel(f'({octet(0)} * 256 + {octet(1)})', f'({octet(2)} * 256 + {octet(3)})', '65536', '65536', key, 'ip')}), z -> concat_ws('.', cast(floor(z.l / 256) as string), cast(z.l % 256 as string), cast(floor(z.r / 256) as string), cast(z.r % 256 as string)))[0]"
    # A leading country code stays; the ten digits are permuted.
    phone = f"transform(array({bare}), n -> transform(array({_permuted('right(n, 10)', key, 'phone')}), q -> {_refilled(found, 'concat(left(n, length(n) - 10), q)')})[0])[0]"
    # Three groups, each permuted within what is valid; area 666 is left out by its place.
    ssn = f"transform(array({_feistel(f'(cast(substr({found}, 1, 3) as int) - if(substr({found}, 1, 3) > {_sql('666')}, 2, 1))', f'((cast(substr({found}, 5, 2) as int) - 1) * 9999 + cast(substr({found}, 8, 4) as int) - 1)', '998', '989901', key, 'ssn')}), z -> concat_ws('-', lpad(cast(z.l + if(z.l >= 665, 2, 1) as string), 3, '0'), lpad(cast(floor(z.r / 9999) + 1 as string), 2, '0'), lpad(cast(z.r % 9999 + 1 as string), 4, '0')))[0]"
    email = f"concat('u', substr(sha2(concat({_sql(key)}, lower({found})), 256), 1, 12), substr({found}, instr({found}, '@')))"
    refilled = f"transform(array({card}), q -> {_refilled(found, 'q')})[0]"
    return f"case {kind} when 'email' then {email} when 'date' then {dated} when 'ip' then {ip} when 'phone' then {phone} when 'ssn' then {ssn} when 'card' then {refilled} else {found} end"


def pseudonymise(docs: DataFrame, *, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the column rewritten and n_email, n_date, n_ip, n_phone, n_ssn, n_card."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = f"`{column}`"
    taken, spare = {c.lower() for c in docs.columns}, "p"
    while taken & {f"{spare}_{c}" for c in ("found", "kinds", "new")}:
        spare += "_"
    counts = [f"n_{k}" for k in PATTERNS]
    # Texts without a digit or an at sign have nothing to find.
    found = docs.withColumn(f"{spare}_found", F.expr(f"if({text} rlike '[0-9@]', regexp_extract_all({text}, {_sql(_ANY)}, 0), cast(array() as array<string>))"))
    found = found.withColumn(f"{spare}_kinds", F.expr(f"transform({spare}_found, x -> {_kind('x')})"))
    found = found.withColumn(f"{spare}_new", F.expr(f"transform(arrays_zip({spare}_found, {spare}_kinds), y -> {_pseudonym(f'y.{spare}_found', f'y.{spare}_kinds', key)})"))
    new = F.expr(f"if(size(filter({spare}_kinds, k -> k is not null)) > 0, array_join(zip_with(split({text}, {_sql(_ANY)}, -1), {spare}_new, (a, b) -> concat(a, coalesce(b, ''))), ''), {text})")
    found = found.withColumns({column: new, **{c: F.expr(f"cast(coalesce(size(filter({spare}_kinds, k -> k <=> '{c[2:]}')), 0) as bigint)") for c in counts}})
    return found.drop(f"{spare}_found", f"{spare}_kinds", f"{spare}_new")
