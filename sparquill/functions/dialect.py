"""One SQL text for two engines: the few spots where Spark and DuckDB spell things differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        """A string literal without escape processing."""
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def replaced(self, x: str, pattern: str, by: str) -> str:
        """All matches of ``pattern`` replaced; groups are written $1."""
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def group(self, x: str, pattern: str, k: int = 1) -> str:
        """Group ``k`` of the first match, empty without one."""
        return f"regexp_extract({x}, {self.text(pattern)}, {k})"

    def every(self, x: str, pattern: str) -> str:
        """Array of the first groups of all matches."""
        return f"regexp_extract_all({x}, {self.text(pattern)}, 1)"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def split(self, x: str, separator: str) -> str:
        return f"split({x}, {self.text(separator)})"

    def mapped(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})"

    def kept(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})"

    def joined(self, array: str, separator: str) -> str:
        return f"array_join({array}, {self.text(separator)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def element(self, array: str, k: int) -> str:
        """Element ``k`` from 1, or from the end with a negative ``k``."""
        return f"element_at({array}, {k})"

    def flat(self, array: str) -> str:
        return f"flatten({array})"

    def number(self, x: str) -> str:
        """A plain decimal, null if ``x`` is no number."""
        return f"try_cast({x} AS DECIMAL(30,6))"

    def count(self, array: str) -> str:
        return f"size({array})"


class DuckDB(Spark):
    name = "duckdb"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replaced(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by.replace('$', chr(92)))}, 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def split(self, x: str, separator: str) -> str:
        return f"string_split({x}, {self.text(separator)})"

    def mapped(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, lambda {var}: {body})"

    def kept(self, array: str, var: str, body: str) -> str:
        return f"list_filter({array}, lambda {var}: {body})"

    def joined(self, array: str, separator: str) -> str:
        return f"array_to_string({array}, {self.text(separator)})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def element(self, array: str, k: int) -> str:
        return f"({array})[{k}]"

    def count(self, array: str) -> str:
        return f"len({array})"


SPARK, DUCKDB = Spark(), DuckDB()
