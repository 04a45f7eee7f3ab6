"""Key-values, normalisers of dates, amounts and rates, and typed output."""

from __future__ import annotations

from quire.functions import text as X
from quire.functions.text import f
from quire.plans.registry import query, relation

_KEY = r"([A-Z][A-Za-z0-9 /&'()-]{2,40}?)"
PATTERNS = (
    rf"(?m)^[ \t]*{_KEY}\s*:\s*(.+?)$",
    rf"(?m)^[ \t]*{_KEY}\.{{3,}}\s*(.+?)$",
    rf"(?m)^[ \t]*{_KEY}[ \t]{{4,}}(\S.{{1,60}}?)$",
)
KNOWN = (
    "apr", "annual percentage rate", "account number", "available balance", "available credit", "card number", "closing balance", "credit limit",
    "customer id", "date", "due date", "finance charge", "finance charges", "interest rate", "invoice date", "invoice number", "minimum amount due",
    "minimum payment", "minimum payment due", "new balance", "opening balance", "order number", "outstanding balance", "page", "patient id",
    "patient name", "payment due date", "previous balance", "report date", "statement date", "total amount due", "total outstanding",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_WORDS = r"(?i)([a-z]{3,9})"


@relation
def kv_raw(d):
    keep = f"length(key) >= 2 AND value <> '' AND {d.count('value', r'[|]')} < 2 AND NOT (key = upper(key) AND key <> lower(key) AND length(key) > 30)"
    if d.name == "spark":  # one row a text until all patterns are met, so its key's partitioning holds for what follows
        found = ", ".join(
            f"transform({d.all('text', p)}, (m, i) -> named_struct('pattern', {no}, 'pos', cast(i AS BIGINT), 'key', {X.strip(d, d.group('m', p, 1))}, 'value', {X.strip(d, d.group('m', p, 2))}))"
            for no, p in enumerate(PATTERNS)
        )
        kept = f"filter(concat({found}), x -> {keep.replace('key', 'x.key').replace('value', 'x.value')})"
        placed = f"(SELECT doc_id, transform({kept}, x -> struct(x.pattern, x.pos, x.key, x.value, instr(text, x.key) AS place)) AS ms FROM {{invoice}}) AS t"
        return f"SELECT doc_id, m.* FROM {d.explode(placed, 'doc_id', 'ms', 'm')} AS e"
    parts = []
    for no, p in enumerate(PATTERNS):
        e = d.explode(f"(SELECT doc_id, text, {d.all('text', p)} AS ms FROM {{invoice}}) AS t", "doc_id, text", "ms", "m", "pos")
        key, value = X.strip(d, d.group("m", p, 1)), X.strip(d, d.group("m", p, 2))
        parts.append(f"SELECT doc_id, {no} AS pattern, pos, {key} AS key, {value} AS value, text FROM {e} AS e")
    return f"SELECT doc_id, pattern, pos, key, value, instr(text, key) AS place FROM ({' UNION ALL '.join(parts)}) AS u WHERE {keep}"


@relation
def kv(d):
    """One pair a page and key: the longest value, then the first; known labels come first, then by place."""
    known = ", ".join(f"'{k}'" for k in KNOWN)
    return f"""SELECT doc_id, key, value, cast(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN lower(key) IN ({known}) THEN 0 ELSE 1 END, place, key) AS BIGINT) AS rank FROM (
SELECT doc_id, key, value, place, row_number() OVER (PARTITION BY doc_id, lower(key) ORDER BY length(value) DESC, pattern, pos) AS r FROM {{kv_raw}}) AS k WHERE r = 1"""


@query
def key_values(d):
    return "SELECT doc_id, rank, key, value FROM {kv}"


@query
def key_values_dedup(d):
    """Document grain: 50 orders to a document, the first page's value of each key stays."""
    return f"SELECT file_id, doc_id, key, value FROM (SELECT {d.idiv('doc_id', '50')} AS file_id, doc_id, key, value, row_number() OVER (PARTITION BY {d.idiv('doc_id', '50')}, lower(key) ORDER BY doc_id, rank) AS r FROM {{kv}}) AS k WHERE r = 1"


def _month(d, s: str) -> str:
    number = lambda x: f"CASE {x} " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(MONTHS)) + " END"
    return d.let(f"substring(lower({s}), 1, 3)", "mo_", number)


def date(d, s: str, year: int = 2026) -> str:
    """ISO date of the first pattern that gives a calendar date, day before month; null without one."""
    num = lambda x: f"try_cast({x} AS INTEGER)"

    def one(p: str, y, m: int, day: int, word: bool, short: bool = False) -> str:
        yy = str(y) if isinstance(y, int) and y > 9 else num(d.group(s, p, y))
        yy = f"(2000 + {yy})" if short else yy
        mm = _month(d, d.group(s, p, m)) if word else num(d.group(s, p, m))
        dd = num(d.group(s, p, day))
        valid = lambda y_, m_, d_, then: f"CASE WHEN {m_} BETWEEN 1 AND 12 AND {d_} BETWEEN 1 AND 31 AND {y_} BETWEEN 1900 AND 2100 THEN {then} END"
        if d.name != "spark":
            return valid(yy, mm, dd, d.try_date(yy, mm, dd))
        last = "CASE WHEN mm_ IN (4, 6, 9, 11) THEN 30 WHEN mm_ <> 2 THEN 31 WHEN yy_ % 4 = 0 AND (yy_ % 100 <> 0 OR yy_ % 400 = 0) THEN 29 ELSE 28 END"
        iso = f"CASE WHEN dd_ <= {last} THEN concat(cast(yy_ AS STRING), '-', lpad(cast(mm_ AS STRING), 2, '0'), '-', lpad(cast(dd_ AS STRING), 2, '0')) END"
        # each part is read once, and only where the pattern matches
        parts = d.let(yy, "yy_", lambda y_: d.let(mm, "mm_", lambda m_: d.let(dd, "dd_", lambda d_: valid(y_, m_, d_, iso))))
        return f"CASE WHEN {d.has(s, p)} THEN {parts} END"

    return (
        "coalesce("
        + ", ".join(
            (
                one(r"(?i)(\d{1,2})\s+([a-z]{3,9})\s+(\d{4})", 3, 2, 1, True),
                one(r"(?i)([a-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})", 3, 1, 2, True),
                one(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 3, 2, 1, False),
                one(r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3, False),
                one(r"(?i)(\d{1,2})\s+([a-z]{3,9})$", year, 2, 1, True),
                one(r"(?i)(\d{1,2})-([a-z]{3,9})-(\d{2})", 3, 2, 1, True, True),
            )
        )
        + ")"
    )


CURRENCY = r"(?i)(AED|BHD|Dhs|EUR|GBP|INR|KWD|OMR|QAR|Rs|SAR|USD|[$£¥€])\s*"


def currency(d, s: str) -> str:
    c = f"upper({d.group(s, CURRENCY, 1)})"
    return f"CASE {c} WHEN '' THEN NULL WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN 'DHS' THEN 'AED' WHEN 'RS' THEN 'INR' ELSE {c} END"


def _number(d, s: str) -> str:
    c = d.sub(d.sub(d.sub(s, CURRENCY), r"(?i)\b(debit|credit|dr|cr|d|c)\b\.?"), r"[()]")
    c = d.sub(c, r"^[ \t+-]+|[ \t+-]+$")
    return f"CASE WHEN {d.has(c, r'^[0-9]{1,3}([.][0-9]{3})+(,[0-9]{2})?$')} THEN replace(replace({c}, '.', ''), ',', '.') ELSE replace({c}, ',', '') END"


def amount(d, s: str) -> str:
    n = _number(d, s)
    return f"CASE WHEN {d.has(n, r'^[0-9]*[.]?[0-9]+$|^[0-9]+[.]$')} THEN round(abs(try_cast({n} AS DOUBLE)), 2) END"


def direction(d, s: str) -> str:
    debit, credit = r"(?i)(^|[\s.,;:()])(dr|debit|d|withdrawal)([\s.,;:()]|$)", r"(?i)(^|[\s.,;:()])(cr|credit|c|deposit|payment)([\s.,;:()]|$)"
    return f"CASE WHEN {d.has(s, r'^\s*-')} THEN 'debit' WHEN {d.has(s, debit)} THEN 'debit' WHEN {d.has(s, credit)} THEN 'credit' WHEN {d.has(s, r'[(]')} AND {d.has(s, r'[)]')} THEN 'debit' ELSE 'unknown' END"


def rate(d, s: str) -> str:
    return f"try_cast({d.group(s, r'(\d+\.?\d*)\s*%', 1)} AS DOUBLE)"


def period(d, s: str) -> str:
    return f"CASE WHEN {d.has(s, r'(?i)month|p\.m\.')} THEN 'monthly' WHEN {d.has(s, r'(?i)year|annual|p\.a\.|per annum')} THEN 'annual' ELSE 'unknown' END"


@relation
def raw_value(d):
    """Values as documents spell them, from order dates and prices."""
    m = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{x.title()}'" for i, x in enumerate(MONTHS)) + " END"
    v = lambda e: f"cast({e} AS VARCHAR(20))"
    day, year, cents = v("day(o_orderdate)"), v("year(o_orderdate)"), "cast(round(o_totalprice * 100) AS BIGINT)"
    whole, part = v(d.idiv(cents, "100")), f"lpad({v(f'{cents} % 100')}, 2, '0')"
    return f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN concat({day}, ' ', {m}, ' ', {year}) WHEN 1 THEN concat({m}, ' ', {day}, ', ', {year}) WHEN 2 THEN concat({day}, '/', {v('month(o_orderdate)')}, '/', {year})
 WHEN 3 THEN concat({year}, '-', {v('month(o_orderdate)')}, '-', {day}) WHEN 4 THEN concat('31/', {v('month(o_orderdate)')}, '/', {year}) WHEN 5 THEN concat({day}, '-', {m}, '-', substring({year}, 3, 2)) ELSE 'no date' END AS date_text,
 CASE o_orderkey % 6 WHEN 0 THEN concat('USD ', {whole}, '.', {part}) WHEN 1 THEN concat('(', {whole}, '.', {part}, ')') WHEN 2 THEN concat('$', {whole}, '.', {part}, ' CR') WHEN 3 THEN concat('-', {whole}, '.', {part})
 WHEN 4 THEN concat({whole}, '.', {part}, ' DR') ELSE 'n/a' END AS amount_text,
 CASE o_orderkey % 4 WHEN 0 THEN concat({v('o_orderkey % 50')}, '.25% per month') WHEN 1 THEN concat({v('o_orderkey % 50')}, '% p.a.') WHEN 2 THEN concat({v('o_orderkey % 50')}, '.5 %') ELSE 'none' END AS rate_text FROM orders"""


@query
def normalize_date(d):
    return f"SELECT doc_id, {date(d, 'date_text')} AS iso_date FROM {{raw_value}}"


@query
def normalize_amount(d):
    return f"SELECT doc_id, {amount(d, 'amount_text')} AS amount, {direction(d, 'amount_text')} AS direction, {currency(d, 'amount_text')} AS currency FROM {{raw_value}}"


@query
def normalize_rate(d):
    return f"SELECT doc_id, {rate(d, 'rate_text')} AS rate, {period(d, 'rate_text')} AS period FROM {{raw_value}}"


@query
def auto_normalize(d):
    """A tagged value by key and value hints: rate before amount before date, else the text itself."""
    k = "lower(key)"
    hint = lambda p: d.has(k, p)
    r = f"{hint('rate|^apr$')} OR {d.has('value', '%')}"
    a = hint("amount|balance|total|fee|charge|payment|limit|^tax$|^subtotal$")
    t = f"{hint('date')} OR {k} IN ('from', 'to', 'period', 'issued', 'expiry')"
    # each reading is made once, and only where the hints ask for it
    return f"""SELECT doc_id, key, CASE WHEN r IS NOT NULL THEN 'rate' WHEN a IS NOT NULL THEN 'amount' WHEN t IS NOT NULL THEN 'date' ELSE 'raw' END AS kind, coalesce(r, a) AS number,
 CASE WHEN r IS NULL AND a IS NULL THEN coalesce(t, value) END AS text FROM (SELECT doc_id, key, value, CASE WHEN {r} THEN {rate(d, 'value')} END AS r, CASE WHEN {a} THEN {amount(d, 'value')} END AS a, CASE WHEN {t} THEN {date(d, 'value')} END AS t FROM {{kv}}) AS k"""


@query
def schema_validate(d):
    """Typed invoice records from key-values, with the list of what is missing or mistyped."""
    get = lambda k: f"max(CASE WHEN lower(key) = '{k}' THEN value END)"
    errors = d.join(d.compact(d.array("CASE WHEN no IS NULL THEN 'missing invoice_number' END", "CASE WHEN day IS NULL THEN 'type order_date' END", "CASE WHEN total IS NULL THEN 'type total' END")), "'; '")
    return f"""SELECT doc_id, no AS invoice_number, day AS order_date, total, customer, {errors} AS errors FROM (SELECT doc_id, no, {date(d, 'dt')} AS day, {amount(d, 'am')} AS total, customer FROM (
SELECT doc_id, {get('invoice number')} AS no, {get('order date')} AS dt, {get('total amount due')} AS am, {get('customer id')} AS customer FROM {{kv}} GROUP BY doc_id) AS g) AS t"""
