"""Very many regex rules in one read of the content.

Rules are taken apart into their alternatives, and what several rules share is one part: it is
tried once on a line, whatever the number of its rules. A line can only match a part if it
holds a text that every match of the part holds. Of each part's necessary texts one gram of
four characters is taken, the one that the fewest parts need. Grams of lines meet grams of
parts in an equi-join, and only parts met that way are tried on a line. What is necessary is
read from a small part of the syntax; a rule that goes beyond it is one part. Parts without a
gram are tried on every line that holds their longest text, if any, during the same read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.operators.scan import LINE_MODE, applicable, holds_text, in_scope, is_small, rule_batches, scan_regex
from packsift.operators.skew import skew_safe_join
from packsift.session import settle

GRAM = 4
INDEX_ROWS, INDEX_BYTES = 200_000, 32 * 1024 * 1024
#: Up to this many grams are looked for by one pattern; of a line with others nothing is made.
PATTERN_GRAMS = 20_000

# Escapes that stand for a kind of character or a place, never for a text.
_KINDS = set("dDwWsSbBtnrf")
_COUNTED = re.compile(r"\{(\d+)(,\d*)?\}")


class _Beyond(Exception):
    """Syntax that is not read."""


def necessary_texts(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern the texts that all its matches hold, in lower case;
    None for a pattern that is not read."""
    body = pattern[4:] if pattern.startswith("(?i)") else pattern
    try:
        alternatives, end = _alternatives(body, 0)
    except _Beyond:
        return None
    return alternatives if end == len(body) else None


def _alternatives(body: str, at: int) -> tuple[list[list[str]], int]:
    found = []
    while True:
        texts, at = _sequence(body, at)
        found.append(texts)
        if at == len(body) or body[at] != "|":
            return found, at
        at += 1


def _sequence(body: str, at: int) -> tuple[list[str], int]:
    """Necessary texts from ``at`` to the end of an alternative."""
    texts, run = [], ""

    def end_run() -> None:
        nonlocal run
        if run:
            texts.append(run)
        run = ""

    while at < len(body) and body[at] not in "|)":
        char, group = body[at], None
        if char == "\\":
            if at + 1 == len(body):
                raise _Beyond
            char, at = body[at + 1], at + 2
            if char.isalnum() and char not in _KINDS:
                raise _Beyond
            literal = not char.isalnum()
        elif char == "[":
            literal, at = False, _class_end(body, at)
        elif char == "(":
            if body.startswith("(?", at) and not body.startswith("(?:", at):
                raise _Beyond
            group, at = _alternatives(body, at + (3 if body.startswith("(?:", at) else 1))
            if at == len(body):
                raise _Beyond
            literal, at = False, at + 1
        elif char in ".^$":
            literal, at = False, at + 1
        elif char in "*+?{":
            raise _Beyond
        else:
            literal, at = True, at + 1
        least, exact, at = _count(body, at)
        if literal and least == 1 and exact and ord(char) < 128:
            run += char.lower()
            continue
        # One occurrence at least ends a text here, and begins the next one.
        if literal and least and ord(char) < 128:
            run += char.lower()
            end_run()
            run = char.lower() if not exact else ""
            continue
        end_run()
        if group is not None and least and len(group) == 1:
            texts += group[0]
    end_run()
    return texts, at


def _class_end(body: str, at: int) -> int:
    at += 1
    if body.startswith("^", at):
        at += 1
    first = at
    while at < len(body):
        if body[at] == "\\":
            at += 2
        elif body[at] == "[" or body.startswith("&&", at):
            raise _Beyond
        elif body[at] == "]" and at > first:
            return at + 1
        else:
            at += 1
    raise _Beyond


def _count(body: str, at: int) -> tuple[int, bool, int]:
    """How often an atom stands at least, whether exactly once, and where its count ends."""
    least, exact = 1, True
    if at < len(body) and body[at] in "*+?":
        least, exact, at = int(body[at] == "+"), False, at + 1
    elif at < len(body) and body[at] == "{":
        counted = _COUNTED.match(body, at)
        if not counted:
            raise _Beyond
        least, exact, at = int(counted[1]), counted[0] == "{1}", counted.end()
    else:
        return least, exact, at
    if at < len(body) and body[at] in "?+":
        at += 1
    if at < len(body) and body[at] in "*+?{":
        raise _Beyond
    return least, exact, at


def rule_grams(pattern: str) -> list[list[str]] | None:
    """For each alternative the grams of its necessary texts; None where one has none."""
    grams = [part["grams"] for part in rule_parts(pattern)]
    return grams if all(grams) else None


def rule_parts(pattern: str) -> list[dict[str, object]]:
    """The alternatives of a pattern, each a pattern itself, with the grams and the longest of its
    necessary texts; a pattern that is not read is one part without any. A line matches
    the pattern if it matches one of the parts."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body, at, parts = pattern[len(flag) :], 0, []
    alternatives = necessary_texts(pattern)
    if alternatives is None:
        return [{"pattern": pattern, "grams": [], "text": ""}]
    for texts in alternatives:
        _, end = _sequence(body, at)
        grams = sorted({text[i : i + GRAM] for text in texts for i in range(len(text) - GRAM + 1)})
        parts.append({"pattern": flag + body[at:end], "grams": grams, "text": max(texts, key=len, default="")})
        at = end + 1
    return parts


def _line_grams(line: Column) -> Column:
    """Hashes of the distinct grams of a line; the line is taken apart once."""

    def runs(chars: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(chars, i + step) for step in range(GRAM)])
        none = F.array().cast("array<bigint>")
        return F.when(F.size(chars) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - GRAM), run))).otherwise(none)

    return let(F.split(F.lower(line), ""), runs)


def gram_pattern(grams: Sequence[str]) -> str:
    """A pattern that finds every place of any of the grams, also of overlapping ones: their
    first characters branch, then the second ones, and so on."""

    def branch(rests: list[str]) -> str:
        if not rests[0]:
            return ""
        heads = {rest[0]: [] for rest in rests}
        for rest in rests:
            heads[rest[0]].append(rest[1:])
        return "(?:" + "|".join(re.escape(head) + branch(below) for head, below in heads.items()) + ")"

    return f"(?=({branch(sorted(set(grams)))}))"


def _gram_hash(gram: Column) -> Column:
    return F.xxhash64(*[F.substring(gram, i + 1, 1) for i in range(GRAM)])


def _known_grams(line: Column, grams: Sequence[str]) -> Column:
    """As ``_line_grams``, only of the given grams, which are ASCII and in lower case."""
    if not grams:
        return F.array().cast("array<bigint>")
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(gram_pattern(grams)), 1)), _gram_hash)


def index_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(anchors, rest, members)``: the parts that can be indexed, in rows (gram, _gram, _part,
    pattern, languages, path_pattern), gram being the hash of _gram, the other parts, named by ``check_id``, and which parts a rule
    has: rows (_part, _rule, check_id, _copies).

    Of a rule that stands in the snapshot several times the findings count once if it can be
    indexed, else as often as it stands there; what has no name then finds nothing.
    """
    spark = rules.sparkSession
    parts_of = F.udf(rule_parts, "array<struct<pattern:string,grams:array<string>,text:string>>", useArrow=False)
    # Rules are control data: each is read once, by a small parser.
    read = rules.withColumns({"_parts": parts_of("pattern"), "_rule": F.xxhash64("check_id", "pattern", "languages", "path_pattern")}).select(
        "_rule", "check_id", "languages", "path_pattern", "_parts"
    )
    read = spark.createDataFrame(read.toArrow(), read.schema) if is_small(rules, INDEX_ROWS, INDEX_BYTES) else read
    plain = F.exists("_parts", lambda part: F.size(part["grams"]) == 0)
    each = read.select("_rule", "check_id", plain.alias("_plain"), "languages", "path_pattern", F.posexplode("_parts").alias("_no", "_p"))
    each = each.withColumn("_part", F.xxhash64("_p.pattern", "languages", "path_pattern"))
    copies = F.when(F.col("_plain"), F.count("*")).otherwise(1).cast("int").alias("_copies")
    members = each.groupBy("_part", "_rule", "check_id", "_plain", "_no").agg(copies).where("NOT _plain OR check_id IS NOT NULL")
    members = members.select("_part", "_rule", "check_id", "_copies").distinct()
    parts = each.groupBy("_part").agg(F.any_value(F.struct("_p", "languages", "path_pattern")).alias("_x")).select("_part", "_x._p.*", "_x.languages", "_x.path_pattern")
    grams = parts.select("_part", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("_shared"))
    rarest = grams.join(shared, "gram").groupBy("_part").agg(F.min(F.struct("_shared", "gram"))["gram"].alias("_gram"))
    anchors = rarest.select("_part", "_gram", _gram_hash(F.col("_gram")).alias("gram")).join(parts.select("_part", "pattern", "languages", "path_pattern"), "_part")
    rest = parts.where(F.size("grams") == 0).select(F.col("_part").cast("string").alias("check_id"), "pattern", "languages", "path_pattern", "text")
    return anchors, rest, members


def scan_indexed(targets: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """Findings (key, check_id, start_line, end_line) of regex rules, as ``scan_regex`` gives
    them, with one read of the content for any number of parts that can be indexed and the
    first batch of the others."""
    key = list(key)
    anchors, rest, members = index_rules(rules)
    batches = list(rule_batches(rest))
    carried = [name for name in ("ext", "path") if name in targets.columns and name not in key]
    lines = targets.select(*key, *carried, F.posexplode(F.split("content", "\n", -1)).alias("_line_no", "_line"))

    def tried(part: Row) -> Column:
        hit = F.col("_line").rlike(LINE_MODE + part["pattern"])
        held = holds_text("_line", part["pattern"])
        hit = hit if held is None else held & hit
        condition = applicable(part)
        return hit if condition is None else condition & hit

    # What a line asks for: the parts of its grams, and which parts of the rest match it.
    asks = lambda gram, hit: F.struct(gram.cast("bigint").alias("gram"), hit.cast("bigint").alias("hit"))
    null = F.lit(None)
    small = is_small(rules, INDEX_ROWS, INDEX_BYTES)
    known = [row["_gram"] for row in anchors.select("_gram").distinct().limit(PATTERN_GRAMS + 1).collect()] if small else None
    held = _line_grams(F.col("_line")) if known is None or len(known) > PATTERN_GRAMS else _known_grams(F.col("_line"), known)
    met = F.transform(held, lambda gram: asks(gram, null))
    if batches:
        plain = [F.when(tried(part), asks(null, F.lit(int(part["check_id"])))) for part in batches[0]]
        met = F.concat(met, F.array_compact(F.array(*plain)))
    asked = lines.select(*key, *carried, "_line_no", "_line", F.inline(met))
    if small:
        # Grams are made, looked up and tried in one stage; only findings get out.
        joined = asked.join(F.broadcast(anchors.drop("_gram")), "gram", "left")
    else:
        joined = skew_safe_join(asked, anchors.drop("_gram"), ["gram"], "left")
    fits = F.col("pattern").isNotNull() & in_scope(targets.columns) & F.regexp_like("_line", F.concat(F.lit(LINE_MODE), "pattern"))
    found = joined.where(F.col("hit").isNotNull() | F.coalesce(fits, F.lit(False)))
    line_no = (F.col("_line_no") + 1).cast("bigint")
    # A line meets a part once, by its one gram.
    hits = found.select(*key, F.coalesce("hit", "_part").alias("_part"), line_no.alias("start_line"))
    if len(batches) > 1:
        names = ["check_id", "pattern", "languages", "path_pattern"]
        more = [tuple(row[name] for name in names) for batch in batches[1:] for row in batch]
        others = scan_regex(targets, targets.sparkSession.createDataFrame(more, rest.select(*names).schema), key)
        hits = hits.unionByName(others.select(*key, F.col("check_id").cast("bigint").alias("_part"), "start_line"))
    if small:
        named = hits.join(F.broadcast(members), "_part")
    else:
        named = skew_safe_join(settle(hits, "hits"), members, ["_part"])
    # A rule of several parts may be met by several of them.
    once = named.select(*key, "check_id", "_rule", "_copies", "start_line").distinct()
    again = F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    return once.select(*key, "check_id", "start_line", F.col("start_line").alias("end_line"), again).drop("_copy")
