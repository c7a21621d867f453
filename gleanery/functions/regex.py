"""Rule patterns are written in the .NET dialect; Spark runs java.util.regex.

``to_java`` translates a rule pattern and reports where its named groups went.
The differences that matter here: named groups may repeat (the last capture
wins), ``.`` stops at line feeds only, and the shorthand classes are Unicode.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
SPACE = r"\f\n\r\t\x0B\x85\p{Z}"
DIGIT = r"\p{Nd}"
SHORTHAND = {"w": WORD, "s": SPACE, "d": DIGIT}
ANY_CHAR = {r"[\s\S]", r"[\S\s]", r"[\w\W]", r"[\W\w]", r"[\d\D]", r"[\D\d]"}

TOKEN = re.compile(
    r"""(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])   # character class
      | \\k<(?P<kref>\w+)>                    # named back reference
      | \\(?P<nref>[1-9][0-9]?)               # numbered back reference
      | \\(?P<esc>.)                          # other escape
      | \(\?<(?P<name>[A-Za-z_]\w*)>          # named group
      | \(\?'(?P<qname>[A-Za-z_]\w*)'         # named group, quoted form
      | (?P<look>\(\?<?[=!])                  # lookaround
      | (?P<atomic>\(\?>)                     # atomic group
      | (?P<special>\(\?[^<'])                # any other (?...) construct
      | (?P<open>\()                          # plain group
      | (?P<anchor>[\^$])
      | (?P<possessive>(?<=[*+?}])\+)
      | (?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Pattern:
    """A translated rule pattern.

    ``self_contained`` says that matching the pattern again on the matched
    text alone gives the same groups: nothing in it looks around the match.
    """

    java: str
    groups: dict[str, list[int]] = field(default_factory=dict)
    self_contained: bool = True

    @property
    def enabled(self) -> bool:
        return self.java != ""


def _char_class(text: str) -> str:
    if text in ANY_CHAR:
        return "(?s:.)"
    if re.search(r"(?<!\\)-\[", text[2:]):
        raise ValueError("a class minus a class")

    # Java reads '[' and '&&' inside a class as set syntax; .NET does not.
    def translate(m: re.Match) -> str:
        if m["set"]:
            return "".join("\\" + c for c in m["set"])
        c = m["esc"]
        if c.lower() not in SHORTHAND:
            return m.group(0)
        body = SHORTHAND[c.lower()]
        return body if c.islower() else f"[^{body}]"

    body = re.sub(r"\\(?P<esc>.)|(?P<set>\[|&&)", translate, text[1:-1], flags=re.DOTALL)
    return f"[{body}]"


def to_java(pattern: str | None) -> Pattern:
    """Translate a pattern; ValueError, KeyError or IndexError for what has no counterpart."""
    if not pattern:
        return Pattern("")
    tokens = list(TOKEN.finditer(pattern))
    groups: dict[str, list[int]] = {}
    unnamed: list[int] = []
    index = 0
    for t in tokens:
        name = t["name"] or t["qname"]
        if name or t["open"]:
            index += 1
            if name:
                groups.setdefault(name, []).append(index)
            else:
                unnamed.append(index)
    # .NET numbers plain groups first and named groups after them.
    by_number = unnamed + [i[0] for i in groups.values()]

    out: list[str] = []
    alone = True
    for t in tokens:
        if t["cls"]:
            out.append(_char_class(t["cls"]))
        elif t["kref"]:
            out.append(f"\\{groups[t['kref']][-1]}")
        elif t["nref"]:
            out.append(f"\\{by_number[int(t['nref']) - 1]}")
        elif t["esc"]:
            c = t["esc"]
            alone = alone and c not in "bBAzZG"
            if c.lower() in SHORTHAND:
                out.append(f"[{'' if c.islower() else '^'}{SHORTHAND[c.lower()]}]")
            else:
                out.append(t.group(0))
        elif t["name"] or t["qname"] or t["open"]:
            out.append("(")
        else:
            alone = alone and not (t["look"] or t["atomic"] or t["anchor"] or t["possessive"])
            out.append(t.group(0))
    return Pattern("(?d)" + "".join(out), groups, alone)


def to_java_replacement(text: str) -> str:
    """Replacement text: ``$1`` means the same, a backslash is plain text."""
    return text.replace("\\", "\\\\")
