"""One vocabulary of SQL fragments for the two engines that run our plans.

Operators are declared once as SQL over named relations; Catalyst optimises the Spark text, and the DuckDB text is the
check on it. Only what the engines spell differently lives here: regular expressions (Java and RE2), integer
division, array functions, exploding, ordered string aggregates.
"""

from __future__ import annotations

from collections.abc import Callable


#: Java's ``\\b`` knows letters beyond ASCII, RE2's doesn't.
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


class Spark:
    name = "spark"
    ws = r"(?U)\s"
    not_ws = r"(?U)\S"

    def lit(self, pattern: str) -> str:
        quote = '"' if "'" in pattern else "'"
        return f"r{quote}{pattern}{quote}"

    def regex(self, pattern: str) -> str:
        """With RE2's ends of words, and of lines: the line feed alone."""
        return self.lit("(?d)" + pattern.replace(r"\b", _EDGE))

    def char(self, code: int) -> str:
        return f"char({code})"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.regex(pattern)}, {self.lit(to)})"

    def count(self, s: str, pattern: str) -> str:
        return f"regexp_count({s}, {self.regex(pattern)})"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_like({s}, {self.regex(pattern)})"

    def group(self, s: str, pattern: str, i: int = 1) -> str:
        """Group ``i`` of the first match, '' without a match."""
        return f"regexp_extract({s}, {self.regex(pattern)}, {i})"

    def all(self, s: str, pattern: str, i: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.regex(pattern)}, {i})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def split(self, s: str, on: str) -> str:
        """Split at a literal character."""
        return f"split({s}, {self.lit(chr(92) + on) if on in '|.' else on})"

    def split_re(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.regex(pattern)})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) AS BIGINT)"

    def let(self, value: str, name: str, body: Callable[[str], str]) -> str:
        """``body`` with ``value``, computed once."""
        return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"

    def at(self, a: str, i: str) -> str:
        """Element ``i``, from 0; null beyond."""
        return f"get({a}, cast({i} AS INT))"

    def filter(self, a: str, cond: str) -> str:
        return f"filter({a}, x -> {cond})"

    def map(self, a: str, expr: str) -> str:
        return f"transform({a}, x -> {expr})"

    def common(self, a: str, b: str) -> str:
        return f"cast(size(array_intersect({a}, {b})) AS BIGINT)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def compact(self, a: str) -> str:
        return f"array_compact({a})"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_join({a}, {sep}), '')"

    def slice(self, a: str, first: str, last: str) -> str:
        """Elements ``first`` to ``last``, from 1, inclusive."""
        return f"slice({a}, cast({first} AS INT), cast(greatest(0, ({last}) - ({first}) + 1) AS INT))"

    def amax(self, a: str) -> str:
        return f"array_max({a})"

    def listagg(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})"

    def collect(self, x: str, order: str | None = None) -> str:
        """Array of ``x`` in the order of ``x`` itself."""
        return f"array_sort(collect_list({x}))"

    def explode(self, rel: str, cols: str, array: str, as_: str, pos: str | None = None) -> str:
        """``cols``, one element (and its place from 0) of ``array`` a row; null elements go.

        An outer view with a filter behind it: for an inner one the optimizer repeats the array's expression in
        inferred filters (not null, not empty), which for regular expressions costs more than the rows it saves.
        """
        if pos:
            return f"(SELECT {cols}, cast({pos} AS BIGINT) AS {pos}, {as_} FROM {rel} LATERAL VIEW OUTER posexplode({array}) AS {pos}, {as_} WHERE {as_} IS NOT NULL)"
        return f"(SELECT {cols}, {as_} FROM {rel} LATERAL VIEW OUTER explode({array}) AS {as_} WHERE {as_} IS NOT NULL)"

    def series(self, a: str, b: str) -> str:
        return f"sequence(cast({a} AS BIGINT), cast({b} AS BIGINT))"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def epoch(self, ts: str) -> str:
        return f"(unix_micros(cast({ts} AS TIMESTAMP)) / 1000000.0D)"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def try_date(self, y: str, m: str, d: str) -> str:
        return (
            f"date_format(try_to_date(concat(lpad(cast({y} AS STRING), 4, '0'), '-', lpad(cast({m} AS STRING), 2, '0'), '-',"
            f" lpad(cast({d} AS STRING), 2, '0')), 'yyyy-MM-dd'), 'yyyy-MM-dd')"
        )

    def values(self, rows: list[tuple], cols: list[str]) -> str:
        return _values(rows, cols)


class Duck(Spark):
    name = "duckdb"

    def let(self, value: str, name: str, body: Callable[[str], str]) -> str:
        return body(value)

    ws = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    not_ws = r"[^\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

    def lit(self, pattern: str) -> str:
        return "'" + pattern.replace("(?U)", "").replace("'", "''") + "'"

    def regex(self, pattern: str) -> str:
        return self.lit(pattern)

    def char(self, code: int) -> str:
        return f"chr({code})"

    def sub(self, s: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def count(self, s: str, pattern: str) -> str:
        return f"len(regexp_extract_all({s}, {self.lit(pattern)}))"

    def has(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def split(self, s: str, on: str) -> str:
        return f"string_split({s}, {self.lit(on) if on in '|.' else on})"

    def split_re(self, s: str, pattern: str) -> str:
        return f"string_split_regex({s}, {self.lit(pattern)})"

    def size(self, a: str) -> str:
        return f"cast(len({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"({a})[({i}) + 1]"

    def filter(self, a: str, cond: str) -> str:
        return f"list_filter({a}, lambda x: {cond})"

    def map(self, a: str, expr: str) -> str:
        return f"list_transform({a}, lambda x: {expr})"

    def common(self, a: str, b: str) -> str:
        return f"cast(len(list_intersect({a}, {b})) AS BIGINT)"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def compact(self, a: str) -> str:
        return f"list_filter({a}, lambda x: x IS NOT NULL)"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {sep}), '')"

    def slice(self, a: str, first: str, last: str) -> str:
        return f"({a})[{first}:{last}]"

    def amax(self, a: str) -> str:
        return f"list_max({a})"

    def listagg(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, {sep} ORDER BY {order})"

    def collect(self, x: str, order: str | None = None) -> str:
        return f"coalesce(list({x} ORDER BY {x}) FILTER (WHERE {x} IS NOT NULL), [])"

    def explode(self, rel: str, cols: str, array: str, as_: str, pos: str | None = None) -> str:
        if pos:
            return f"(SELECT {cols}, unnest({array}) AS {as_}, generate_subscripts({array}, 1) - 1 AS {pos} FROM {rel})"
        return f"(SELECT {cols}, unnest({array}) AS {as_} FROM {rel})"

    def series(self, a: str, b: str) -> str:
        return f"range(cast({a} AS BIGINT), cast({b} AS BIGINT) + 1)"

    def sha256(self, s: str) -> str:
        return f"sha256({s})"

    def epoch(self, ts: str) -> str:
        return f"epoch({ts})"

    def json(self, s: str, key: str) -> str:
        return f"json_extract_string({s}, '$.{key}')"

    def try_date(self, y: str, m: str, d: str) -> str:
        return (
            f"strftime(try_strptime(concat(lpad(cast({y} AS VARCHAR), 4, '0'), '-', lpad(cast({m} AS VARCHAR), 2, '0'), '-',"
            f" lpad(cast({d} AS VARCHAR), 2, '0')), '%Y-%m-%d'), '%Y-%m-%d')"
        )


def _values(rows: list[tuple], cols: list[str]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"cast({v!r} AS DOUBLE)"
        return f"cast({v} AS BIGINT)"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


SPARK, DUCK = Spark(), Duck()
