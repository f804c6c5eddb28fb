"""Text logs in, typed tables out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtally.sources.patterns import Pattern, get_pattern

# Marks a line that matched, and parts its fields. Neither is printable. An
# unmatched line comes back unchanged, so one that starts with the mark itself is
# told apart by comparing.
_HIT, _SEP = "\u0002", "\u0001"


def read_logs(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
              line_ids: bool = True) -> DataFrame:
    """Lines of one or more logs: ``value``, ``file`` and, for ordering, ``line_id``.

    Files are split and read in parallel. ``line_id`` rises within each split of
    a file, so (time, line_id) restores the order of equal times.
    """
    lines = (
        spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    return lines.withColumn("line_id", F.monotonically_increasing_id()) if line_ids else lines


def strip_nul(lines: DataFrame, value: str = "value") -> DataFrame:
    """Remove NUL bytes; the files themselves stay as they are."""
    return lines.withColumn(value, F.translate(value, "\u0000", ""))


def _typed(text: Column, sql_type: str) -> Column:
    text = F.nullif(text, F.lit(""))
    if sql_type == "string":
        return text
    if sql_type == "timestamp":
        return F.try_to_timestamp(text)
    return text.try_cast(sql_type)


def _whole_line(pattern: Pattern, value: str) -> Column:
    line = F.col(value)
    if pattern.repair:
        line = F.replace(line, F.lit(".-"), F.lit("."))
    return line


def _joined(pattern: Pattern, line: Column, fields: Sequence[str]) -> Column:
    """The line's fields joined in the given order; a line that does not match comes back as it is."""
    return F.regexp_replace(line, pattern.java, _HIT + _SEP.join(
        f"${pattern.groups[f]}" if f in pattern.groups else "" for f in fields))


def _each_group(pattern: Pattern, line: Column, fields: Sequence[str]) -> Column:
    """The same fields, one match per field: for a line that itself holds the separator.

    Inside a lambda, which is not compiled with the rest: so rare a case must
    not make the generated code too long for the JIT.
    """
    return F.flatten(F.transform(F.array(line), lambda text: F.array(*[
        F.regexp_extract(text, pattern.java, pattern.groups[f]) if f in pattern.groups else F.lit("")
        for f in fields])))


def _parts(hit: str, fields: Sequence[str], otherwise: Column) -> Column:
    parts = F.split(F.substr(hit, F.lit(2)), _SEP, -1)
    return F.when(F.size(parts) == len(fields), parts).otherwise(otherwise)


def _body(value: str) -> Column:
    """What follows the first bracket, its blanks removed: it tells most formats apart."""
    return F.ltrim(F.expr(f"substring(`{value}`, instr(`{value}`, ']') + 1, 32)"))


def _may_match(p: Pattern, value: str, body: Column) -> Column | None:
    """A cheap test that every matching line passes; None where there is none."""
    tests = [F.contains(F.col(value), F.lit(p.needs))] if p.needs else []
    if p.begins:
        # a body that starts with white space other than a blank is left to the regex
        odd = (body < "!") | (body > "~")
        tests.append(reduce(lambda a, b: a | b, [F.startswith(body, F.lit(b)) for b in p.begins], odd))
    return reduce(lambda a, b: a & b, tests) if tests else None


def parse(lines: DataFrame, pattern: str | Pattern, value: str = "value",
          keep: Iterable[str] | None = None) -> DataFrame:
    """Typed rows of the lines that match; a missing field is NULL.

    The expression runs once per line: the match is put through a generator,
    which keeps the optimizer from copying it into the filter and the fields.
    Other columns of ``lines`` (or those in ``keep``) pass through.
    """
    p = get_pattern(pattern) if isinstance(pattern, str) else pattern
    fields = list(p.groups)
    kept = [c for c in lines.columns if c != value] if keep is None else list(keep)
    kept = [c for c in kept if c not in fields]
    test = _may_match(p, value, _body(value))
    if test is not None:
        lines = lines.where(test)
    repaired = lines.select(*kept, _whole_line(p, value).alias("_line"))
    hits = repaired.select(
        *kept, "_line", F.explode(F.array(_joined(p, F.col("_line"), fields))).alias("_hit"),
    ).where(F.startswith("_hit", F.lit(_HIT)) & (F.col("_hit") != F.col("_line")))
    rows = hits.select(*kept, _parts("_hit", fields, _each_group(p, F.col("_line"), fields)).alias("_parts"))
    return rows.select(
        *[_typed(F.get(F.col("_parts"), F.lit(i)), p.type_of(f)).alias(f) for i, f in enumerate(fields)],
        *kept)


def scrape(lines: DataFrame, names: Sequence[str], value: str = "value") -> dict[str, DataFrame]:
    """One lazy typed table per pattern; each table reads the log when it is used."""
    return {name: parse(lines, name, value) for name in names}


def route(lines: DataFrame, names: Sequence[str], value: str = "value", rejects: str | None = None) -> DataFrame:
    """One pass over the log for several patterns: ``pattern`` and the fields of all of them.

    Patterns are not exclusive: a line gives one row per pattern it matches,
    with NULL in the fields that pattern does not have. A field whose type
    differs between the patterns is text. The body of a line decides which expressions it meets, so
    more formats cost little.

    With ``rejects`` a line that matches none gives a row of that pattern. ``failed`` then lists a row's fields whose
    text does not fit their type, and ``line`` holds the text of unmatched lines and of those with such fields.
    """
    patterns = [get_pattern(n) for n in names]
    fields = list(dict.fromkeys(f for p in patterns for f in p.groups))
    kept = [c for c in lines.columns if c != value and c not in fields]

    def tagged(p: Pattern) -> Column:
        found = _joined(p, _whole_line(p, value), fields)
        # the cheap test guards the regex: a CASE branch runs only when chosen
        test = _may_match(p, value, F.col("_body"))
        found = F.when(test, found) if test is not None else found
        return F.struct(F.lit(p.name).alias("pattern"), found.alias("_hit"))

    def is_hit(hit: Column) -> Column:
        return (F.startswith(hit, F.lit(_HIT)) & (hit != F.col(value))
                & (hit != F.replace(F.col(value), F.lit(".-"), F.lit("."))))

    # once per line for all patterns
    lines = lines.select(*kept, value, _body(value).alias("_body"))
    every = F.array(*[tagged(p) for p in patterns])
    if rejects is None:
        hits = lines.select(*kept, value, F.inline(every)).where(is_hit(F.col("_hit")))
    else:
        # through a generator, so that the tests above run once per line
        found = lines.select(*kept, value, F.explode(F.array(every)).alias("_every")).select(
            *kept, value, F.explode(F.array(F.filter("_every", lambda t: F.coalesce(is_hit(t["_hit"]), F.lit(False))))
                                    ).alias("_found"))
        none = F.array(F.struct(F.lit(rejects).alias("pattern"), F.lit(None).cast("string").alias("_hit")))
        hits = found.select(*kept, value, F.inline(F.when(F.size("_found") > 0, F.col("_found")).otherwise(none)))
    again = F.lit(None).cast("array<string>")
    for p in patterns:
        again = F.when(F.col("pattern") == p.name, _each_group(p, _whole_line(p, value), fields)).otherwise(again)
    rows = hits.select(*kept, *([value] if rejects else []), "pattern", _parts("_hit", fields, again).alias("_parts"))

    def sql_type(f: str) -> str:
        types = {p.type_of(f) for p in patterns if f in p.groups}
        return types.pop() if len(types) == 1 else "string"

    typed = rows.select(
        "pattern", *[_typed(F.get(F.col("_parts"), F.lit(i)), sql_type(f)).alias(f) for i, f in enumerate(fields)],
        *kept, *([F.col(value).alias("line"), "_parts"] if rejects else []))
    if rejects is None:
        return typed
    failed = F.array_compact(F.array(*[
        F.when((F.coalesce(F.get(F.col("_parts"), F.lit(i)), F.lit("")) != "") & F.col(f).isNull(), f)
        for i, f in enumerate(fields)]))
    marked = typed.withColumn("failed", failed).drop("_parts")
    whole = (F.col("pattern") != rejects) & (F.size("failed") == 0)
    return marked.withColumn("line", F.when(~whole, F.col("line")))


def routed_table(routed: DataFrame, name: str, names: Sequence[str]) -> DataFrame:
    """The typed table of one pattern out of the rows that ``route`` made for ``names``."""
    p = get_pattern(name)
    every = {f for n in names for f in get_pattern(n).groups}
    kept = [c for c in routed.columns if c != "pattern" and c not in every]
    types = dict(routed.dtypes)
    return routed.where(F.col("pattern") == name).select(
        *[(F.col(f) if types[f] == p.type_of(f) else _typed(F.col(f), p.type_of(f))).alias(f) for f in p.groups],
        *kept)


def scrape_once(lines: DataFrame, names: Sequence[str], path: str, value: str = "value") -> dict[str, DataFrame]:
    """Read the log once, store all patterns under ``path``, return the typed tables.

    For logs too large to scan once per pattern; each table then reads only the
    files of its own pattern, and of those only the columns in use.
    """
    routed = route(lines, names, value)
    routed.write.mode("overwrite").partitionBy("pattern").parquet(path)
    stored = lines.sparkSession.read.schema(routed.schema).parquet(path)
    return {name: routed_table(stored, name, names) for name in names}


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Node names and ids from a CSV with header."""
    return spark.read.csv(path, header=True, schema="name string, id int")


def file_stem(file: Column) -> Column:
    """File name without folders and without a ``.txt`` ending."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.regexp_replace(name, r"\.txt$", "")


def parse_testbed(lines: DataFrame, lookup: DataFrame, pattern: str = "testbed",
                  file: str = "file", value: str = "value") -> DataFrame:
    """Many node logs into one table, the node taken from each file's name.

    Rows with a missing field are dropped; a file the lookup does not name keeps
    its rows with a NULL node. Whether the lookup is broadcast is left to the
    planner, which knows its size.
    """
    p = get_pattern(pattern)
    rows = parse(strip_nul(lines, value), p, value).dropna("any", subset=list(p.groups))
    names = lookup.select(F.col("name").alias("_name"), F.col("id").cast("int").alias("node"))
    return rows.join(names, file_stem(F.col(file)) == F.col("_name"), "left").drop("_name")
