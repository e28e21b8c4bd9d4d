"""Apply text rules to targets: one finding per (target, rule, line).

Rules are control data: a snapshot is read in batches of checked size and each
batch becomes literals of the plan, so a scan is a projection over the targets
without a join and every pattern is compiled once per task. Literal passages can
be many; they are found by an equi-join on a token gram instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.operators.skew import skew_safe_join
from packsift.settings import RULE_BATCH_BYTES, RULE_BATCH_ROWS

# File extensions of the languages that rules can name.
LANGUAGE_EXTENSIONS = {
    "python": ["py", "pyi"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "yaml": ["yml", "yaml"],
    "json": ["json"],
}

GRAM = 4
_SEPARATORS = r"[^\p{L}\p{N}]+"
LINE_MODE = "(?d)"  # only \n ends a line
_TEXT_MODE = "(?dm)"


# -- rules ---------------------------------------------------------------------------


def rule_batches(
    rules: DataFrame, max_rows: int = RULE_BATCH_ROWS, max_bytes: int = RULE_BATCH_BYTES
) -> Iterator[list[Row]]:
    """Read rules in batches small enough to become literals of one plan step."""
    order = lambda rule: (rule["check_id"], rule["pattern"])
    if is_small(rules, max_rows, max_bytes):
        batches, parts = 1, [rules]
    else:
        totals = rules.agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern")).alias("b")).first()
        batches = max(ceil(totals["n"] / max_rows), ceil(totals["b"] / max_bytes))
        part = F.pmod(F.xxhash64("check_id", "pattern"), F.lit(batches))
        parts = [rules.where(part == number) for number in range(batches)]
    for part in parts:
        rows = sorted(part.collect(), key=order)
        if rows:
            yield rows


def is_small(rules: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether rules are within a bound; takes no more than the bound's rows, partition
    by partition, to the driver."""
    sizes = rules.select(F.octet_length("pattern")).limit(max_rows + 1).collect()
    return len(sizes) <= max_rows and sum(size for (size,) in sizes) <= max_bytes


def rule_extensions(languages: Sequence[str]) -> list[str]:
    return sorted({ext for name in languages for ext in LANGUAGE_EXTENSIONS.get(name, [name])})


def applicable(rule: Row) -> Column | None:
    """Condition under which a rule looks at a file; None when it looks at all."""
    checks = []
    if rule["languages"] is not None:
        checks.append(F.coalesce(F.col("ext").isin(rule_extensions(rule["languages"])), F.lit(False)))
    if rule["path_pattern"] is not None:
        checks.append(F.col("path").rlike(LINE_MODE + rule["path_pattern"]))
    return reduce(lambda a, b: a & b, checks) if checks else None


# -- regex rules ---------------------------------------------------------------------


def holds_text(column: str, pattern: str) -> Column | None:
    """Whether a text holds what every match of one of the pattern's alternatives holds, which is
    looked up much faster than matched; None where there is nothing to look up."""
    from packsift.operators.rule_index import rule_parts

    texts = {part["text"] for part in rule_parts(pattern)}
    if "" in texts:
        return None
    cased = any(text.upper() != text for text in texts)
    body = F.lower(column) if cased else F.col(column)
    found = lambda text: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in sorted(texts)])
    return let(body, found) if len(texts) > 1 and cased else found(body)


# Syntax that may look past the line or keep a match from being given up: on a whole text
# such a pattern can fail where it matches a line of it.
_LINE_ONLY = re.compile(r"\\[AzZG]|\(\?(?![:i)])|\(\?i[^)]|[*+?}]\+")


def scan_regex(targets: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """Findings (key, check_id, start_line, end_line) of regex rules.

    Whole texts are tested first, so only files with a match are split to lines. Where a
    rule's matches hold a fixed text, only what holds it is matched.
    """
    parts = []
    for batch in rule_batches(rules):

        def test(column: str, rule: Row, mode: str) -> Column:
            hit = F.col(column).rlike(mode + rule["pattern"])
            held = holds_text(column, rule["pattern"])
            hit = hit if held is None else held & hit
            condition = applicable(rule)
            return hit if condition is None else condition & hit

        text_lines = F.split("content", "\n", -1)
        if not any(_LINE_ONLY.search(rule["pattern"]) for rule in batch):
            # Part of the generator, not a filter: a filter would be pushed below
            # the step that spreads the texts over the cores.
            hit = reduce(lambda a, b: a | b, [test("content", rule, _TEXT_MODE) for rule in batch])
            text_lines = F.when(hit, text_lines)
        carried = [name for name in ("ext", "path") if name in targets.columns and name not in key]
        lines = targets.select(*key, *carried, F.posexplode(text_lines).alias("_line_no", "_line"))
        found = [test("_line", rule, LINE_MODE) for rule in batch]
        hits = F.array_compact(F.array(*[F.when(hit, F.lit(rule["check_id"])) for rule, hit in zip(batch, found)]))
        line_no = (F.col("_line_no") + 1).cast("bigint")
        parts.append(
            lines.where(reduce(lambda a, b: a | b, found))
            .select(*key, F.explode(hits).alias("check_id"), line_no.alias("start_line"))
            .withColumn("end_line", F.col("start_line"))
        )
    return reduce(DataFrame.unionByName, parts) if parts else _no_findings(targets, key)


# -- literal rules -------------------------------------------------------------------


def _tokens(text: Column) -> Column:
    return F.split(text, _SEPARATORS, -1)


def _grams(tokens: Column) -> Column:
    """Distinct hashes of every run of GRAM tokens."""

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - GRAM
        run = lambda i: F.xxhash64(*[F.get(hashes, i + step) for step in range(GRAM)])
        none = F.array().cast("array<bigint>")
        return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), run))).otherwise(none)

    # Each token is hashed once; a run is then a hash of four numbers.
    return let(F.transform(tokens, lambda token: F.xxhash64(token)), runs)


def literal_anchors(rules: DataFrame) -> DataFrame:
    """One gram per literal rule ``_rule`` that any text containing the passage must have.

    The first and last token may be cut by the passage's edge, so only inner
    tokens count. The gram shared by the fewest rules is taken. Rules too short
    for a gram are left out.
    """
    tokens = rules.select("_rule", _tokens(F.col("pattern")).alias("_t"))
    inner = tokens.where(F.size("_t") >= GRAM + 2).select("_rule", F.expr("slice(_t, 2, size(_t) - 2)").alias("_t"))
    grams = inner.select("_rule", F.explode(_grams(F.col("_t"))).alias("gram")).distinct()
    shared = grams.groupBy("gram").agg(F.count("*").alias("_shared"))
    return (
        grams.join(shared, "gram")
        .groupBy("_rule")
        .agg(F.min(F.struct("_shared", "gram")).alias("_best"))
        .select("_rule", F.col("_best.gram").alias("gram"))
    )


def in_scope(columns: Sequence[str]) -> Column:
    """Whether the file's extension and path are in the scope of the rule beside it."""
    listed = F.create_map(*[x for name, exts in LANGUAGE_EXTENSIONS.items() for x in (F.lit(name), F.array(*map(F.lit, exts)))])
    exts = F.flatten(F.transform("languages", lambda name: F.coalesce(F.get(F.array(listed[name]), 0), F.array(name))))
    scope = F.col("languages").isNull() | F.coalesce(F.array_contains(exts, F.col("ext")), F.lit(False))
    if "path" in columns:
        return scope & (F.col("path_pattern").isNull() | F.regexp_like("path", F.concat(F.lit(LINE_MODE), "path_pattern")))
    return scope & F.when(F.col("path_pattern").isNull(), True).otherwise(
        F.raise_error(F.lit("a rule asks for paths, the targets have none")).cast("boolean")
    )


def _literal_findings(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every line on which an occurrence of the passage starts, and the line it ends on."""
    starts = lambda lines, breaks, head, rest: F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.when(breaks == 0, F.contains(F.get(lines, i), head)).otherwise(
            F.endswith(F.get(lines, i), head) & F.startswith(F.array_join(F.slice(lines, i + 2, breaks), "\n"), rest)
        ),
    )
    cut = matches.withColumns(
        {
            "_breaks": F.size(F.split("pattern", "\n", -1)) - 1,
            "_head": F.substring_index("pattern", "\n", 1),
            "_rest": F.expr("substr(pattern, length(substring_index(pattern, '\\n', 1)) + 2)"),
        }
    )
    found = let(F.split("content", "\n", -1), lambda lines: starts(lines, F.col("_breaks"), F.col("_head"), F.col("_rest")))
    return cut.select(*key, "check_id", "_breaks", F.explode(found).alias("_at")).select(
        *key,
        "check_id",
        (F.col("_at") + 1).cast("bigint").alias("start_line"),
        (F.col("_at") + 1 + F.col("_breaks")).cast("bigint").alias("end_line"),
    )


def scan_literal(
    targets: DataFrame,
    rules: DataFrame,
    key: Sequence[str],
    broadcast_rows: int = 50_000,
    broadcast_bytes: int = 32 * 1024 * 1024,
) -> DataFrame:
    """Findings of literal rules, one per (target, rule, line on which it starts).

    Up to the size bound the anchored rules are broadcast and content stays in
    place. Beyond it, narrow (target, gram) rows meet the anchors in a salted
    join and content is joined back for the candidates.
    """
    key = list(key)
    carried = [name for name in ("ext", "path") if name in targets.columns and name not in key]
    rules = rules.select("check_id", "pattern", "languages", "path_pattern").withColumn(
        "_rule", F.xxhash64("check_id", "pattern", "languages", "path_pattern")
    )
    anchored = rules.join(literal_anchors(rules), "_rule")
    short = rules.where(F.size(_tokens(F.col("pattern"))) < GRAM + 2)
    grams = F.explode(_grams(_tokens(F.col("content")))).alias("gram")
    texts = targets.select(*key, *carried, "content")
    if is_small(rules, broadcast_rows, broadcast_bytes):
        # Generate and broadcast join run in one stage: only matching rows get out.
        candidates = targets.select(*key, *carried, "content", grams).join(F.broadcast(anchored), "gram")
    else:
        narrow = targets.select(*key, grams)
        pairs = skew_safe_join(narrow, anchored.select("gram", "_rule"), ["gram"])
        with_pattern = skew_safe_join(pairs.drop("gram"), rules, ["_rule"])
        candidates = skew_safe_join(with_pattern, texts, key)
    scope = in_scope(targets.columns)
    parts = [_literal_findings(candidates.where(scope), key)]
    for batch in rule_batches(short):
        passages = F.array(
            *[
                F.struct(
                    F.lit(r["check_id"]).alias("check_id"),
                    F.lit(r["pattern"]).alias("pattern"),
                    F.lit(r["languages"]).cast("array<string>").alias("languages"),
                    F.lit(r["path_pattern"]).cast("string").alias("path_pattern"),
                )
                for r in batch
            ]
        )
        found = F.filter(passages, lambda p: F.contains(F.col("content"), p["pattern"]))
        listed = targets.select(*key, *carried, "content", F.inline(found))
        parts.append(_literal_findings(listed.where(scope), key))
    return reduce(DataFrame.unionByName, parts)


# -- both kinds ----------------------------------------------------------------------


def _no_findings(targets: DataFrame, key: Sequence[str]) -> DataFrame:
    return targets.where(F.lit(False)).select(
        *key,
        F.lit("").alias("check_id"),
        F.lit(0).cast("bigint").alias("start_line"),
        F.lit(0).cast("bigint").alias("end_line"),
    )


def as_text(targets: DataFrame) -> DataFrame:
    """Binary content as text, with invalid bytes replaced. Identity was taken
    from the bytes, so replacement never merges two files."""
    if targets.schema["content"].dataType.simpleString() != "binary":
        return targets
    return targets.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def scan(targets: DataFrame, rules: DataFrame, key: Sequence[str]) -> DataFrame:
    """Findings of a whole snapshot on targets with columns key, ext, content
    (and path for path-scoped rules)."""
    from packsift.operators.rule_index import scan_indexed

    targets = as_text(targets)
    # One read tells which kinds there are, and how many rules of each.
    counted = {row["kind"]: row for row in rules.groupBy("kind").agg(F.count("*").alias("n"), F.min("check_id").alias("one")).collect()}
    parts = []
    for kind, row in counted.items():
        chosen = rules.where(F.col("kind") == kind)
        if kind == "regex":
            many = row["n"] > RULE_BATCH_ROWS
            parts.append(scan_indexed(targets, chosen, key) if many else scan_regex(targets, chosen, key))
        elif kind == "literal":
            parts.append(scan_literal(targets, chosen, key))
        else:
            raise ValueError(f"no scan for the kind of rule {row['one']!r}")
    return reduce(DataFrame.unionByName, parts) if parts else _no_findings(targets, key)


def is_scanned(rules: DataFrame) -> Column:
    """Whether at least one rule's languages cover the column ``ext``."""
    languages = rules.select(F.explode_outer(F.coalesce("languages", F.array(F.lit(None).cast("string")))).alias("l"))
    # One row: the distinct names of languages, and whether some rule names none.
    row = languages.agg(F.collect_set("l").alias("names"), F.bool_or(F.col("l").isNull()).alias("all")).first()
    if row["all"]:
        return F.lit(True)
    return F.coalesce(F.col("ext").isin(rule_extensions(sorted(row["names"]))), F.lit(False))


def scanned_targets(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Targets that at least one rule's languages cover.

    A target outside this set was not looked at; having no finding there does
    not make it clean.
    """
    return targets.where(is_scanned(rules))


def rules_reusable(rules: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Whether results depend on content alone, per snapshot.

    Needs at least one rule, and every rule plain: no paths, options, dependency
    formula or validators, product SAST, mode search or taint.
    """
    plain = (
        F.col("paths").isNull()
        & F.col("options").isNull()
        & F.col("dependency_formula").isNull()
        & F.col("validators").isNull()
        & F.coalesce(F.col("product") == "SAST", F.lit(False))
        & F.coalesce(F.col("mode").isin("search", "taint"), F.lit(False))
    )
    return rules.groupBy(*group).agg(
        F.count("*").alias("rules"),
        F.count_if(plain).alias("plain_rules"),
        ((F.count("*") > 0) & (F.count_if(plain) == F.count("*"))).alias("reusable"),
    )


def describe(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the rule's message and metadata and shorten check_id to rule_id."""
    details = rules.select(
        "check_id", "message", "severity", "evidence", "confidence", "execution_context"
    )
    # What is broadcast is what is measured.
    measured = details.select(F.concat_ws(" ", *details.columns).alias("pattern"))
    if is_small(measured, 50_000, 32 * 1024 * 1024):
        joined = findings.join(F.broadcast(details), "check_id")
    else:
        joined = skew_safe_join(findings, details, ["check_id"])
    return joined.withColumn("rule_id", F.substring_index("check_id", ".", -1)).drop("check_id")
