"""Scalar text functions as SQL fragments: strip, page score, page class, scripts, cleaning."""

from __future__ import annotations

from quire.plans.dialect import Spark

GOOD, MINIMAL, EMPTY = 200, 50, 20
#: What ``\\s`` takes in Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def f(x: float) -> str:
    return f"cast({x!r} AS DOUBLE)"


def strip(d: Spark, s: str) -> str:
    if d.name == "spark":  # only the ends are looked at
        return f"trim(BOTH '{SPACE}' FROM {s})"
    return d.sub(s, rf"^{d.ws}+|{d.ws}+$")


def dense(d: Spark, s: str) -> str:
    """The text without white space."""
    return blanks_out(d, s, "") if d.name == "spark" else d.sub(s, d.ws)


def blanks_out(d: Spark, s: str, to: str) -> str:
    """Runs of white space replaced in Spark; the wide class is slow, so it is taken only where its characters stand."""
    rare = " OR ".join(f"contains({s}, '{c}')" for c in SPACE if ord(c) > 127)
    return f"CASE WHEN {rare} THEN {d.sub(s, f'[{SPACE}]+', to)} ELSE {d.sub(s, '[' + chr(92) + 't-' + chr(92) + 'r ]+', to)} END"


def letters(d: Spark, s: str) -> str:
    if d.name == "spark":  # runs go faster than letters one by one
        return f"length({d.sub(s, chr(92) + 'P{L}+')})"
    return d.count(s, r"\p{L}")


def word_length(d: Spark, s: str) -> str:
    """Mean characters of a word, null without words."""
    if d.name != "spark":
        words = d.filter(d.split_re(strip(d, s), d.ws + "+"), "x <> ''")
        return f"cast(length({dense(d, s)}) AS DOUBLE) / nullif({d.size(words)}, 0)"
    mean = lambda k: f"cast({k} AS DOUBLE) / nullif(CASE WHEN r_ = '' THEN 0 ELSE length(r_) - {k} + 1 END, 0)"
    return d.let(strip(d, s), "s_", lambda t: d.let(blanks_out(d, t, " "), "r_", lambda r: d.let(f"length(replace({r}, ' ', ''))", "k_", mean)))


def lines(d: Spark, s: str) -> str:
    return d.split(s, d.char(10))


def score_page(d: Spark, text: str, images: str = "0") -> str:
    """Page quality in [0, 1]; deductions in a fixed order so that both engines add alike."""
    def scored(t: str, alpha: str, mean: str, moji: str, gaps: str) -> str:
        n = f"length({t})"
        score = (
            f"{f(1.0)}"
            f" - CASE WHEN {n} < {MINIMAL} THEN {f(0.3)} WHEN {n} < {GOOD} THEN CASE WHEN {images} > 0 THEN {f(0.2)} ELSE {f(0.1)} END ELSE {f(0.0)} END"
            f" - CASE WHEN {alpha} < {f(0.3)} THEN {f(0.25)} WHEN {alpha} < {f(0.5)} THEN {f(0.1)} ELSE {f(0.0)} END"
            f" - CASE WHEN {mean} < 2 OR {mean} > 25 THEN {f(0.15)} ELSE {f(0.0)} END"
            f" - CASE WHEN {gaps} > 10 THEN {f(0.1)} ELSE {f(0.0)} END"
            f" - CASE WHEN {moji} > 5 THEN {f(0.2)} WHEN {moji} > 0 THEN {f(0.05)} ELSE {f(0.0)} END"
        )
        return f"CASE WHEN {text} IS NULL OR {n} < {EMPTY} THEN {f(0.0)} ELSE greatest({f(0.0)}, least({f(1.0)}, {score})) END"

    moji, gaps = r"ï¿½|Ã[¨©]|â€", r"  {5,}"
    if d.name != "spark":
        t = strip(d, text)
        ns = dense(d, t)
        alpha = f"cast({letters(d, ns)} AS DOUBLE) / length({ns})"
        mean = f"cast(length({ns}) AS DOUBLE) / {d.size(d.split_re(t, d.ws + '+'))}"
        return scored(t, alpha, mean, d.count(text, moji), d.count(text, gaps))
    # each count is made once, in whole runs, and rare marks are looked for before they are counted
    marks = f"CASE WHEN contains({text}, 'ï¿½') OR contains({text}, 'Ã') OR contains({text}, 'â€') THEN {d.count(text, moji)} ELSE 0 END"
    wide = f"CASE WHEN contains({text}, '      ') THEN {d.count(text, gaps)} ELSE 0 END"
    alpha = f"cast(length({d.sub('ns_', chr(92) + 'P{L}+')}) AS DOUBLE) / length(ns_)"
    # a stripped text has a word more than runs of blanks
    mean = "cast(length(ns_) AS DOUBLE) / (length(r_) - length(ns_) + 1)"

    def counted(_: str) -> str:
        return d.let(alpha, "al_", lambda a: d.let(mean, "me_", lambda m: d.let(marks, "mo_", lambda o: d.let(wide, "ga_", lambda g: scored("t_", a, m, o, g)))))

    runs = d.let(blanks_out(d, "t_", " "), "r_", lambda r: d.let(f"replace({r}, ' ', '')", "ns_", counted))
    return d.let(strip(d, text), "t_", lambda t: f"CASE WHEN {t} IS NULL OR length({t}) < {EMPTY} THEN {f(0.0)} ELSE {runs} END")


def page_quality(chars: str, images: str) -> str:
    return f"CASE WHEN {chars} < {EMPTY} THEN 'empty' WHEN {chars} < {GOOD} AND {images} > 0 THEN 'bad' ELSE 'good' END"


ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN cast({a} AS DOUBLE) / {b} ELSE {f(0.0)} END"


def arabic_ratio(d: Spark, s: str) -> str:
    return ratio(d.count(s, ARABIC), f"length({dense(d, s)})")


def rtl_dominant(d: Spark, s: str) -> str:
    return f"({ratio(d.count(s, RTL), letters(d, s))} > {f(0.5)})"


def normalize_arabic(d: Spark, s: str) -> str:
    """Tatweel and vowel marks out, alef and yeh forms united, runs of blanks collapsed."""
    s = d.sub(s, r"[\x{0640}\x{064B}-\x{065F}\x{0670}]")
    s = d.sub(s, r"[\x{0622}\x{0623}\x{0625}\x{0671}]", "ا")
    s = d.sub(s, r"\x{0649}", "ي")
    return d.sub(s, r"[ \t]+", " ")


_FROM = "“”‘’–—⁄∼−∗�′●○◦•✗✓ "
_TO = "\"\"''--/~-* '----xv "
_ACCENTS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿŠšŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyySsZz"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def translate(s: str, a: str, b: str) -> str:
    """Both engines' translate, with the quote written as a doubled one."""
    return f"translate({s}, {q(a)}, {q(b)})"


def clean_text(d: Spark, s: str) -> str:
    """The ordered cleaning pipeline for left-to-right text with composed Latin letters (its other steps are in
    ``quire.operators.unicode``): punctuation, accents, bullets, control characters, blank lines, headings,
    emphasis, links and citations, hyphenation, blanks outside tables, line ends."""
    s = d.sub(s, r"\r\n?", "\n") if d.name == "spark" else f"replace(replace({s}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    quote = d.char(39)
    for a, b in zip(_FROM, _TO, strict=True):
        s = f"replace({s}, '{a}', {quote if b == chr(39) else q(b)})"
    s = d.sub(s, "­")
    for a, b in (("þ", "+"), ("С", "C"), ("Þ", "TH")):
        s = f"replace({s}, '{a}', '{b}')"
    s = d.sub(s, r"[\x{0300}-\x{036F}]")
    s = translate(s, _ACCENTS, _PLAIN)
    s = d.sub(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{200B}-\x{200D}\x{FEFF}]")
    nl = d.char(10)
    s = f"{d.sub(s, chr(92) + 'n{4,}', '@@QUIRE@@')}"
    s = f"replace({s}, '@@QUIRE@@', concat({nl}, {nl}, {nl}))"
    s = d.sub(s, r"(?m)^#{2,6}[ \t]+", "# ")
    s = d.sub(s, r"\*\*|__")
    s = d.sub(s, r"\[([^\]\n]+)\]\([^)\n]+\)", "$1")
    s = d.sub(s, r"[ \t]?\[\d{1,3}\]")
    s = d.sub(s, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    s = d.join(d.map(d.split(s, nl), f"CASE WHEN x LIKE '%|%' THEN x ELSE {d.sub('x', '[ ' + chr(92) + 't]{2,}', ' ')} END"), nl)
    s = d.sub(s, r"(?m)[ \t]+$")
    return strip(d, s)
