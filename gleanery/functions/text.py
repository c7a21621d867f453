"""Text clean-up as Column functions.

Everything here stays in the JVM.  ``let`` binds an intermediate result to a
name; without it a value used twice would be written, and computed, twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gleanery.functions import fixed_values as fixed
from gleanery.functions.regex import to_java, to_java_replacement
from gleanery.session import write_out

# Rounds of a replacement that puts text in before the text is written out and looked at again.
ROUNDS = 8
# Rules that become one plan.
RULES_AT_ONCE = 100
# Characters that a text may have while a rule makes it longer.  Nothing else bounds how much longer it gets.
LONGEST = 1 << 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- defaults

def first_filled(*values: Column | str) -> Column:
    """First value that is neither null nor empty; the last one as it is."""
    cols = [F.lit(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def to_int(text: Column) -> Column:
    """Whole number in the text, 0 when there is none."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def status_code(status: Column) -> Column:
    """0 for a running serial, 1 for a finished one."""
    return F.when(status == fixed.ONGOING_STATUS, 0).otherwise(1).cast("short")


def strip_site_name(text: Column, site_name: Column) -> Column:
    return F.replace(text, site_name, F.lit(""))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def trim_dots(title: Column) -> Column:
    return F.regexp_replace(title, r"\.+\z", "")


# ------------------------------------------------------- replace until stable
#
# A clean-up chain is a list of steps, applied to a column one projection each:
# a step uses its input several times, which would multiply when nested.  Steps
# that repeat are written in SQL, where nested lambdas are short.

Step = Callable[[str], Column]
Sql = Callable[[str], str]


def apply_steps(df: DataFrame, column: str, steps: Sequence[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumn(column, step(column))
    return df


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def until_stable(once: Sql, matches: Sql, *, shrinks: bool = True) -> Step:
    """Step that applies ``once`` while ``matches`` holds.

    Nearly every text is stable after one round; that takes two tests.  Text
    that is not goes on in at most as many rounds as it has characters, enough
    for a replacement that shrinks the text.  These rounds come in blocks that
    are skipped when the text is stable.  A replacement that may not shrink
    does ``ROUNDS`` rounds; ``apply_replace_list`` goes on with the texts for which that is not enough.
    """

    def rounds(value: str, count: str, inner: Sql, acc: str) -> str:
        return (f"aggregate(sequence(1, {count}), {value}, "
                f"({acc}, {acc}_n) -> CASE WHEN {matches(acc)} THEN {inner(acc)} ELSE {acc} END)")

    block = "int(ceil(sqrt(length(w)))) + 1"
    if shrinks:
        rest = rounds("w", block, lambda a: rounds(a, block, once, "b"), "a")
    else:
        rest = rounds("w", str(ROUNDS - 1), once, "a")

    def step(column: str) -> Column:
        again = f"transform(array({once(column)}), w -> CASE WHEN {matches('w')} THEN {rest} ELSE w END)[0]"
        return F.expr(f"CASE WHEN {matches(column)} THEN {again} ELSE {column} END")

    return lambda column: step(f"`{column}`")


def delete_pattern(pattern: str, hint: str | None = None, test: str | None = None) -> Step:
    """Delete every match of a pattern until none is left.

    ``hint`` is a plain string that any match must hold, ``test`` a pattern
    that matches exactly where the pattern does and is cheaper to look for.
    """
    java, sign = quote(to_java(pattern).java), quote(to_java(test or pattern).java)
    first = f"contains({{v}}, {quote(hint)}) AND " if hint else ""
    return until_stable(lambda v: f"regexp_replace({v}, {java}, '')",
                        lambda v: first.replace("{v}", v) + f"rlike({v}, {sign})")


def delete_strings(strings: Sequence[str]) -> Step:
    """Delete plain strings until none is left."""

    def once(v: str) -> str:
        for s in strings:
            v = f"replace({v}, {quote(s)}, '')"
        return v

    return until_stable(once, lambda v: "(" + " OR ".join(f"contains({v}, {quote(s)})" for s in strings) + ")")


def replace_step(pattern: str, replacement: str) -> Step:
    """One rule of a replace list: the test is case-sensitive, the replacement is not."""
    java = to_java(pattern).java
    return until_stable(
        lambda v: f"regexp_replace({v}, {quote('(?iu)' + java)}, {quote(to_java_replacement(replacement))})",
        lambda v: f"rlike({v}, {quote(java)})" + (f" AND length({v}) <= {LONGEST}" if replacement else ""),
        shrinks=replacement == "",
    )


# ------------------------------------------------------------ content filter

def drop_symbols(text: Column) -> Column:
    return F.translate(text, fixed.DECORATIVE_SYMBOLS + fixed.ASCII_SYMBOLS, "")


def to_halfwidth(text: Column) -> Column:
    """Full-width forms (U+FF01..U+FF5E, U+3000) to ASCII."""
    codes = range(0x21, 0x7F)
    wide = "".join(chr(c + 0xFEE0) for c in codes) + "\u3000"
    return F.translate(text, wide, "".join(map(chr, codes)) + " ")


DROP_BLOCKS = [delete_pattern(rf"<{name} [\s\S]*?</{name}>", f"<{name} ") for name in fixed.BLOCK_ELEMENTS]
DROP_BARE_TAGS = [delete_strings([f"<{name}>", f"</{name}>"]) for name in fixed.BARE_TAGS]
DROP_SYNOPSIS_LEAD = [delete_pattern(fixed.SYNOPSIS_LEAD, "简单介绍:</strong>")]
DROP_URLS = [delete_strings([p]) for p in fixed.URL_PREFIXES] + [
    delete_pattern(fixed.SITE_NAME, test=fixed.SITE_NAME_TEST)]
CONTENT_FILTER = [
    lambda column: F.lower(to_halfwidth(drop_symbols(F.col(column)))), *DROP_BLOCKS, *DROP_BARE_TAGS, *DROP_SYNOPSIS_LEAD, *DROP_URLS
]


def apply_replace_list(df: DataFrame, column: str, rules: Sequence[tuple[str, str]],
                       flag: str | None = None) -> DataFrame:
    """Apply (pattern, replacement) rules in order, each until stable.

    All texts pass all rules once.  A text that a rule which puts text in still matches waits at that rule; only
    the waiting ones go on, in further passes over them alone.  A rule has no end for a text if the replacement
    itself holds a match, or if the text comes back to a state it has been in; ``flag`` names a column that marks such texts, and those
    that outgrow ``LONGEST``.
    """
    endless = flag or "_endless"
    rules = list(rules)
    df = df.withColumns({"_next": F.lit(0), endless: F.lit(False)})
    feeding = _feeding(df, rules)
    if not any(r for _, r in rules):
        df = _pass(df, column, rules, feeding, endless).drop("_next")
        return df if flag else df.drop(endless)

    def written(passed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        waits = (F.col("_next") < len(rules)) & ~F.col(endless)
        seen = Observation()
        passed = write_out(passed.observe(seen, F.count_if(waits).alias("waiting")), "replaced")
        return passed.where(~waits), passed.where(waits), seen.get["waiting"]

    state = F.xxhash64(column, F.length(column))
    ready, work, waiting = written(_pass(df, column, rules, feeding, endless))
    parts = [ready]
    work = work.withColumn("_states", F.array(state))
    while waiting:
        now = _pass(work.withColumn("_before", F.col("_next")), column, rules, feeding, endless)
        stays = F.col("_before") == F.col("_next")
        stuck = stays & (F.array_contains("_states", state) | (F.length(column) > LONGEST))
        now = now.withColumn(endless, F.col(endless) | F.coalesce(stuck, F.lit(False)))
        now = now.withColumn("_states", F.when(stays, F.array_append("_states", state)).otherwise(F.array(state)))
        ready, work, waiting = written(now.drop("_before"))
        parts.append(ready.drop("_states"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.drop("_next") if flag else whole.drop("_next", endless)


def _feeding(df: DataFrame, rules: Sequence[tuple[str, str]]) -> set[int]:
    """Rules whose replacement, a plain text, holds a match wherever it stands."""
    asked = [(i, to_java(p).java, r) for i, (p, r) in enumerate(rules) if r and "$" not in r and to_java(p).self_contained]
    if not asked:
        return set()
    held = df.sparkSession.createDataFrame(asked, "i int, java string, text string")
    return {row["i"] for row in held.where("rlike(text, java)").collect()}


def _pass(df: DataFrame, column: str, rules: Sequence[tuple[str, str]], feeding: set[int], endless: str) -> DataFrame:
    """Each text goes on from the rule at which it stands (``_next``), as far as it gets."""
    for i, (pattern, replacement) in enumerate(rules):
        here = (F.col("_next") == i) & ~F.col(endless)
        matches = F.coalesce(F.rlike(F.col(column), F.lit(to_java(pattern).java)), F.lit(False))
        if i in feeding:  # once, as it has no end
            once = F.regexp_replace(column, "(?iu)" + to_java(pattern).java, to_java_replacement(replacement))
            df = df.withColumn("_hit", here & matches).withColumn(column, F.when(F.col("_hit"), once).otherwise(F.col(column)))
            df = df.withColumn(endless, F.col(endless) | F.col("_hit")).drop("_hit")
        else:
            df = df.withColumn(column, F.when(here, replace_step(pattern, replacement)(column)).otherwise(F.col(column)))
        finished = here & ~matches if replacement else here
        df = df.withColumn("_next", F.when(finished, i + 1).otherwise(F.col("_next")))
        if i % RULES_AT_ONCE == RULES_AT_ONCE - 1 and i + 1 < len(rules):
            df = write_out(df, "replaced")
    return df


def content_filter(df: DataFrame, column: str, replace_list: Sequence[tuple[str, str]] = (), flag: str | None = None) -> DataFrame:
    """The whole clean-up of harvested text, in place; ``flag`` as in ``apply_replace_list``."""
    return apply_replace_list(apply_steps(df, column, CONTENT_FILTER), column, replace_list, flag)


# ------------------------------------------------------------------ decoding

def _code_point(number: Column) -> Column:
    """Character of a code point; null when it is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    raw = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(valid, F.decode(raw, "UTF-32"))


def html_decode(text: Column) -> Column:
    """Decode named and numeric character references in one pass."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))],
                         F.lit("apos"), F.lit("'"))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^([^;&]+);", 1)
        dec = F.regexp_extract(name, "^#0*([0-9]{1,7})$", 1).try_cast("bigint")
        hexa = F.conv(F.nullif(F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1), F.lit("")), 16, 10)
        char = F.coalesce(_code_point(F.coalesce(dec, hexa.try_cast("bigint"))), F.try_element_at(names, name))
        return F.when(name == "", F.concat(F.lit("&"), p)).otherwise(
            F.coalesce(F.concat(char, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p)))

    pieces = F.split(text, "&", -1)
    decoded = F.concat(F.element_at(pieces, 1),
                       F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def unescape_unicode(text: Column) -> Column:
    r"""``\uXXXX`` escapes to characters; a run is decoded whole, so pairs work."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    decoded = F.array_join(
        F.zip_with(
            F.split(text, run, -1),
            F.regexp_extract_all(text, F.lit(run), F.lit(0)),
            lambda plain, esc: F.concat(plain, F.coalesce(
                F.decode(F.unhex(F.replace(esc, F.lit("\\u"), F.lit(""))), "UTF-16BE"), F.lit(""))),
        ), "")
    return F.when(F.contains(text, F.lit("\\u")), decoded).otherwise(text)


def url_decode(text: Column) -> Column:
    """Percent-decode; malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(text), text)


def media_decode(text: Column) -> Column:
    return let(url_decode(text), unescape_unicode)
