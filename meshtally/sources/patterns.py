"""Registry of log-line patterns.

A pattern turns one text line into one typed row. The expression is written
with Python named groups; ``Pattern`` derives from it what Spark's regex engine
needs: plain groups (Java rejects ``_`` in names), the group number of each
field, and flags that make character classes and line ends behave the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Line prefix, line patterns and field types of the log formats.
# ---------------------------------------------------------------------------
PREFIX = r"^\s*(?P<time>\d+):\s+(?P<node>\d+):"
PREFIX_NO_BLANK = r"^\s*(?P<time>\d+):\s*(?P<node>\d+):"

PATTERNS_TEXT = {
    "app": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?P<state>(TX|RX))\s+(?P<type>\S+)(?:\s+s:(?P<src>\d+)|\s+d:(?P<dest>\d+)|\s+a:(?P<app>\d+)|\s+id:(?P<seq>\d+)|\s+h:(?P<hops>[1-5])|\s+m:(?P<mac>\d+))+.*?$",
    "sdn": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?P<state>(OUT|BUF|IN))\s+(?P<type>\S+)(?:\s+s:(?P<src>\d+)|\s+d:(?P<dest>\d+)|\s+a:(?P<app>\d+)|\s+id:(?P<seq>\d+)|\s+h:(?P<hops>\d+)|\s+m:(?P<mac>\d+))+.*?$",
    "icmp": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?:\s+type:(?P<type>\d+)|\s+code:(?P<code>\d+))+.*?$",
    "node": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*h:(?P<hops>\d+), n:(?P<degree>\d+)",
    "join": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?:\s+n:(?P<id>\d+)|\s+c:(?P<controller>\d+)|\s+dag:(?P<dag>\d+)|\s+dao:(?P<dao>\d+))+.*?$",
    "pow": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*](?:\s*PW\s+\(r (?P<all_rdc>\d+\W{1,2}\d+)| \/ (?P<rdc>\d+\W{1,2}\d+))+.*?$",
    "all": r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?P<state>(TX|RX))\s+(?P<type>\S+)(?:\s+m:(?P<origin>\d+)|\s+t:(?P<target>\d+)|\s+s:(?P<src>\d+)|\s+d:(?P<dest>\d+)|\s+id:(?P<seq>\d+)|\s+h:(?P<hops>[0-5]))+.*?$",
    "atomic-energy": r"\s+(?P<level>[\w,-]+):\s+(?P<module>\w+)\s*ep:(?P<epoch>\d+)\s+(?P<type>\w+)(?:\s*h:(?P<hops>\d+)|\s+np:(?P<n_phases>\d+)|\s+gon:(?P<gon>\d+)|\s+ron:(?P<ron>\d+)|\s+con:(?P<con>\d+)\s+\(r (?P<all_rdc>\d+\W{1,2}\d+)| \/ (?P<rdc>\d+\W{1,2}\d+))+.*?$",
    "atomic-op": r"\s+(?P<level>[\w,-]+):\s+(?P<module>\w+)\s*ep:(?P<epoch>\d+)\s+(?P<type>\w+)(?:\s*h:(?P<hops>\d+)|\scp:\s*(?P<c_phase>\d+)|\s+tp:\s*(?P<n_phases>\d+)|\s+dur:\s*(?P<lat>\d+)|\s+tdur:\s*(?P<op_duration>\d+)|\s+an:(?P<active>\d+))+.*?$",
}

# The same sdn line, in logs whose states may also read TX or RX.
SDN_ANY_STATE = r"\s*\[(?P<level>STAT):\s*(?P<module>[\w,-]+)\s*]\s*(?P<state>(OUT|BUF|IN|TX|RX))\s+(?P<type>\S+)(?:\s+s:(?P<src>\d+)|\s+d:(?P<dest>\d+)|\s+a:(?P<app>\d+)|\s+id:(?P<seq>\d+)|\s+h:(?P<hops>\d+)|\s+m:(?P<mac>\d+))+.*?$"

TESTBED_PREFIX = r"^\[*(?:(?P<timestamp>.*))[\|\]]\s*"
TESTBED_TEXT = r"D:(?:\s*[ep:]+(?P<epoch>\d+)|\s+(?P<type>[FWDTRX-]+)\s+(?P<packet>.{1,16})|\s*[id:]+(?P<id>\d+)|\s*[s:]+(?P<src>\d+))*"

FIELD_TYPES = {
    "time": "bigint", "node": "int", "level": "string", "module": "string",
    "state": "string", "type": "string", "src": "int", "dest": "int",
    "app": "int", "seq": "bigint", "hops": "int", "mac": "int",
    "origin": "int", "target": "int", "degree": "int", "id": "int",
    "controller": "int", "dag": "int", "dao": "int", "all_rdc": "double",
    "rdc": "double", "epoch": "bigint", "n_phases": "int", "c_phase": "int",
    "gon": "bigint", "ron": "bigint", "con": "bigint", "lat": "bigint",
    "op_duration": "bigint", "active": "int", "code": "int",
    "timestamp": "timestamp", "packet": "string",
}
# What can stand right behind the module's bracket in a line of each format.
BEGINS = {
    "app": ("TX", "RX"),
    "sdn": ("OUT", "BUF", "IN"),
    "sdn-any-state": ("OUT", "BUF", "IN", "TX", "RX"),
    "icmp": ("type:", "code:"),
    "node": ("h:",),
    "join": ("n:", "c:", "dag:", "dao:"),
    "pow": ("PW", "/"),
    "all": ("TX", "RX"),
}
# ---------------------------------------------------------------------------

# Tags taken literally: a source number never lands in the epoch.
TESTBED_STRICT = (
    r"D:(?:\s*ep:(?P<epoch>\d+)"
    r"|\s+(?P<type>[FWDTRX-]+)\s+(?P<packet>.{1,16}?)(?=\s+(?:ep|id|s):|\s*$)"
    r"|\s*id:(?P<id>\d+)|\s*s:(?P<src>\d+))*"
)


@dataclass(frozen=True)
class Pattern:
    """One line format: ``regex`` is the full expression, prefix included."""

    name: str
    regex: str
    types: dict[str, str] = field(default_factory=dict)
    # Text every matching line holds: lines without it skip the regex.
    needs: str = ""
    # Repair ``.-`` to ``.`` before matching (negative fractions in power lines).
    repair: bool = True
    # Texts, one of which follows the first ``]`` and white space in every matching line: others skip the regex.
    begins: tuple[str, ...] = ()

    @property
    def groups(self) -> dict[str, int]:
        index = re.compile(self.regex).groupindex
        return dict(sorted(index.items(), key=lambda item: item[1]))

    @property
    def java(self) -> str:
        """For a whole-line replace: plain groups, Python-like classes, anchored.

        A repeated group at the end of an expression becomes possessive. Anything
        may follow it, so it never has to give back, and Java then loops instead
        of recursing: a line with any number of fields fits the stack.
        """
        plain = re.sub(r"\(\?P<\w+>", "(", self.regex)
        if plain.endswith((")+.*?$", ")*.*?$")):
            plain = plain.removesuffix(".*?$") + "+.*$"
        elif plain.endswith((")+", ")*")):
            plain += "+"
        tail = "" if plain.endswith("$") else ".*"
        return f"(?U)(?d){plain}{tail}"

    def type_of(self, name: str) -> str:
        return self.types.get(name, FIELD_TYPES.get(name, "string"))

    @property
    def schema(self) -> str:
        return ", ".join(f"`{g}` {self.type_of(g)}" for g in self.groups)


_registry: dict[str, Pattern] = {}


def register_pattern(name: str, regex: str, types: dict[str, str] | None = None,
                     prefix: str = PREFIX, needs: str = "", repair: bool = True, begins: tuple[str, ...] = ()) -> Pattern:
    """Add or replace a pattern; ``prefix`` is put before ``regex``."""
    pattern = Pattern(name, prefix + regex, dict(types or {}), needs, repair, tuple(begins))
    if not pattern.groups:
        raise ValueError(f"pattern {name!r} has no named groups")
    _registry[name] = pattern
    return pattern


def get_pattern(name: str) -> Pattern:
    """By exact name."""
    try:
        return _registry[name]
    except KeyError:
        raise KeyError(f"no pattern named {name!r}; known: {sorted(_registry)}") from None


def pattern_names() -> list[str]:
    return list(_registry)


for _name, _text in PATTERNS_TEXT.items():
    register_pattern(
        _name, _text,
        types={"type": "int"} if _name == "icmp" else None,
        needs="ep:" if _name.startswith("atomic-") else "[STAT:", begins=BEGINS.get(_name, ()),
    )
register_pattern("sdn-any-state", SDN_ANY_STATE, needs="[STAT:", begins=BEGINS["sdn-any-state"])
register_pattern("testbed", TESTBED_TEXT, {"id": "bigint"}, TESTBED_PREFIX, "D:", repair=False)
register_pattern("testbed-strict", TESTBED_STRICT, {"id": "bigint"}, TESTBED_PREFIX, "D:", repair=False)
