"""The few functions that checks need and that Spark and ANSI engines name differently.

A check is a SQL predicate over a page's record; it is written once with these names, runs in
Spark as an expression, and is handed to another SQL engine as its own reference.
"""

from __future__ import annotations


class Spark:
    """Spark's names."""

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def any(self, a, cond, v="x"):
        return f"exists({a}, {v} -> {cond})"

    def count(self, a, cond, v="x"):
        return f"size(filter({a}, {v} -> {cond}))"

    def pick(self, a, cond, v="x"):
        return f"filter({a}, {v} -> {cond})"

    def each(self, a, e, v="x"):
        return f"transform({a}, {v} -> {e})"

    def n(self, a):
        return f"size({a})"

    def keys(self, m):
        return f"size(map_keys({m}))"

    def first(self, a):
        return f"get({a}, 0)"

    def distinct(self, a):
        return f"array_distinct({a})"

    def sort(self, a):
        return f"array_sort({a})"

    def minus(self, a, b):
        return f"array_except({a}, {b})"

    def among(self, a, x):
        return f"array_contains({a}, {x})"

    def after(self, a, k):
        """The list without its first k elements."""
        return f"slice({a}, {k + 1}, greatest(size({a}) - {k}, 0))"

    def later(self, a, k):
        """A sorted list has a value again k places on."""
        return f"size(filter({a}, (v, i) -> v = get({a}, i + {k}))) > 0"

    def jumps(self, a, field):
        """Some element is more than one above the one before it."""
        return f"size(filter({a}, (v, i) -> i > 0 and v.{field} > get({a}, i - 1).{field} + 1)) > 0"

    def twins(self, a):
        """Neighbours are equal."""
        return f"size(filter({a}, (v, i) -> v = get({a}, i - 1))) > 0"

    def like(self, s, p):
        return f"rlike({s}, {self.text(p)})"

    def part(self, s, p, g=0):
        return f"regexp_extract({s}, {self.text(p)}, {g})"

    def all(self, s, p, g=0):
        return f"regexp_extract_all({s}, {self.text(p)}, {g})"

    def times(self, s, p):
        return f"regexp_count({s}, {self.text(p)})"

    def sub(self, s, p, r):
        return f"regexp_replace({s}, {self.text(p)}, {self.text(r)})"

    def starts(self, s, p):
        return f"startswith({s}, {self.text(p)})"

    def has(self, s, p):
        return f"contains({s}, {self.text(p)})"

    def units(self, s):
        """Length in UTF-16 units."""
        return f"(octet_length(encode({s}, 'UTF-16LE')) div 2)"

    def bytes(self, s):
        return f"octet_length({s})"

    def value(self, m, k):
        return f"try_element_at({m}, {self.text(k)})"

    def total(self, a):
        return f"aggregate({a}, cast(0 as bigint), (s, x) -> s + x)"

    def split(self, s, c):
        return f"split({s}, {self.text(c)})"

    def decode(self, s):
        return f"coalesce(try_url_decode({s}), {s})"

    def day(self, s):
        """The date in an HTTP header's time."""
        return f"try_to_date(regexp_extract({s}, '([0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}})', 1), 'd MMM yyyy')"

    def days(self, a, b):
        return f"datediff({a}, {b})"

    def whole(self, s):
        return f"try_cast({s} as bigint)"

    def json(self, s, p):
        return f"get_json_object({s}, '{p}')"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def map(self, **fields):
        return "map(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def pairs(self, *kv):
        return "map(" + ", ".join(f"'{k}', {v}" for k, v in kv) + ")"

    def upto(self, n, most, e):
        """A list of e for x from 1 to n, at most `most`."""
        return f"transform(case when {n} >= 1 then sequence(1, cast(least({n}, {most}) as int)) else cast(array() as array<int>) end, x -> {e})"

    def empty(self, kind):
        return f"cast(array() as array<{kind}>)"


class Duck(Spark):
    """The names of DuckDB, whose lists are counted from 1."""

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def any(self, a, cond, v="x"):
        return f"len(list_filter({a}, lambda {v}: {cond})) > 0"

    def count(self, a, cond, v="x"):
        return f"len(list_filter({a}, lambda {v}: {cond}))"

    def pick(self, a, cond, v="x"):
        return f"list_filter({a}, lambda {v}: {cond})"

    def each(self, a, e, v="x"):
        return f"list_transform({a}, lambda {v}: {e})"

    def n(self, a):
        return f"len({a})"

    def keys(self, m):
        return f"cardinality({m})"

    def first(self, a):
        return f"({a})[1]"

    def distinct(self, a):
        return f"list_distinct({a})"

    def sort(self, a):
        return f"list_sort({a})"

    def minus(self, a, b):
        return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"

    def among(self, a, x):
        return f"list_contains({a}, {x})"

    def after(self, a, k):
        return f"{a}[{k + 1}:]"

    def later(self, a, k):
        return f"len(list_filter({a}, lambda v, i: v = {a}[i + {k}])) > 0"

    def jumps(self, a, field):
        return f"len(list_filter({a}, lambda v, i: i > 1 AND v.{field} > {a}[i - 1].{field} + 1)) > 0"

    def twins(self, a):
        return f"len(list_filter({a}, lambda v, i: i > 1 AND v = {a}[i - 1])) > 0"

    def like(self, s, p):
        return f"regexp_matches({s}, {self.text(p)})"

    def times(self, s, p):
        return f"len(regexp_extract_all({s}, {self.text(p)}))"

    def sub(self, s, p, r):
        return f"regexp_replace({s}, {self.text(p)}, {self.text(r)}, 'g')"

    def starts(self, s, p):
        return f"starts_with({s}, {self.text(p)})"

    def units(self, s):
        return f"(length({s}) + length(regexp_replace({s}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"

    def bytes(self, s):
        return f"strlen({s})"

    def value(self, m, k):
        return f"{m}[{self.text(k)}]"

    def total(self, a):
        return f"coalesce(list_sum({a}), 0)"

    def split(self, s, c):
        return f"string_split({s}, {self.text(c)})"

    def decode(self, s):
        return f"url_decode({s})"

    def day(self, s):
        return f"CAST(try_strptime(regexp_extract({s}, '([0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}})', 1), '%d %b %Y') AS DATE)"

    def days(self, a, b):
        return f"date_diff('day', {b}, {a})"

    def whole(self, s):
        return f"TRY_CAST({s} AS BIGINT)"

    def json(self, s, p):
        return f"CAST(json_extract({s}, '{p}') AS VARCHAR)"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def struct(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def map(self, **fields):
        return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def pairs(self, *kv):
        return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in kv) + "}"

    def upto(self, n, most, e):
        return f"list_transform(list_filter(range(1, {most} + 1), lambda x: x <= {n}), lambda x: {e})"

    def empty(self, kind):
        return f"CAST([] AS {kind.replace('string', 'VARCHAR')}[])"
