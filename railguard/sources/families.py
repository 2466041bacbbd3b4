"""Text exports of several instrument families in one read: headers found by scored rules.

A family says which names mark its header, how the column of every role is recognised
(unique exact name, else unique name with given parts and without others) and what a plain
number in its time column means. Every file goes to the first family that admits it.

A header stands among the first ``HEADER_LINES`` lines of its file; the line with most
markers wins, then the earlier one, then the earlier delimiter. Rows after it are data:
surplus fields drop a row, short rows are padded with NULL, quoted fields may hold the
delimiter. A quoted field does not go over a line end.

Lines are read split by split; only one row per file (its header) meets them again. It is
broadcast up to ``BROADCAST_FILES`` files and joined adaptively beyond.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from railguard.operators.contracts import enforce
from railguard.session import durable
from railguard.sources.exports import clock_seconds, delimiter_of, normalise_header, number, split_fields

#: Fixed value: lines of a file among which its header is looked for.
HEADER_LINES = 512
#: Headers are broadcast up to so many files (some hundred bytes each).
BROADCAST_FILES = 100_000
#: Share of numeric times below which a column holds clock text. Fixed value.
NUMERIC_SHARE = 0.95


def _has(name: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for part in parts:
        found = found & F.contains(name, F.lit(part))
    return found


@dataclass(frozen=True)
class Pick:
    """Rule for one role over normalised field names."""

    exact: tuple[str, ...]
    parts: tuple[tuple[str, ...], ...] = ()
    without: tuple[str, ...] = ()

    def place(self, fields: Column) -> Column:
        """1-based place of the first rule that fits exactly one field; NULL if none does."""

        def named(wanted: str) -> Callable[[Column], Column]:
            return lambda f: f == wanted

        def holding(parts: tuple[str, ...]) -> Callable[[Column], Column]:
            def test(f: Column) -> Column:
                fits = _has(f, parts)
                for part in self.without:
                    fits = fits & ~F.contains(f, F.lit(part))
                return fits

            return test

        hits = [F.transform(fields, t) for t in [*map(named, self.exact), *map(holding, self.parts)]]
        once = [
            F.when(F.size(F.filter(h, lambda x: x)) == 1, F.array_position(h, True).cast("int")) for h in hits
        ]
        return once[0] if len(once) == 1 else F.coalesce(*once)


@dataclass(frozen=True)
class Marker:
    """A field with one of the names or with one of the parts in its name."""

    names: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def shown(self, fields: Column) -> Column:
        def test(f: Column) -> Column:
            hit = f.isin(*self.names) if self.names else F.lit(False)
            for part in self.parts:
                hit = hit | F.contains(f, F.lit(part))
            return hit

        return F.exists(fields, test).cast("int")


@dataclass(frozen=True)
class Family:
    name: str
    markers: tuple[Marker, ...]
    #: Markers a header needs.
    needed: int
    roles: dict[str, Pick]
    #: Roles that may be missing.
    optional: tuple[str, ...] = ()
    #: Seconds of one unit of a numeric time; clock text only where it is allowed.
    time_unit: float = 3600.0
    clock: bool = False
    #: Text that a header line begins with and text that it holds.
    begins: str = ""
    holds: str = ""
    #: Exactly one admissible header line; its delimiter is then told by the line itself.
    single: bool = False
    delimiters: tuple[str, ...] = ("\t", ";", ",")
    #: Fields a header has at least.
    width: int = 1


# Names and parts of the families' columns.
_TEMPERATURE = Pick(
    ("tc", "t1c", "temperaturec", "temperature"), (("temp",),), ("set", "target", "chamber")
)
FAMILIES = (
    Family(
        "prefixed",
        markers=tuple(Marker((n,)) for n in ("timeh", "uv", "ia", "ahah", "cyccount")),
        needed=5,
        roles={
            "cycle": Pick(("cyccount",)), "time": Pick(("timeh",)), "current": Pick(("ia",)),
            "voltage": Pick(("uv",)), "cumulative": Pick(("ahah",)),
        },
        begins="~Time", holds="Cyc-Count", single=True,
    ),
    Family(
        "counter",
        markers=(
            Marker(("cyccount", "cyclecount")), Marker(("ia", "currenta")), Marker(("uv", "voltagev")),
            Marker(("timeh", "times")), Marker(("ahah",)),
        ),
        needed=5,
        roles={
            "cycle": Pick(("cyccount", "cyclecount")), "time": Pick(("timeh", "times")), "current": Pick(("ia", "currenta")),
            "voltage": Pick(("uv", "voltagev")), "cumulative": Pick(("ahah",)), "temperature": _TEMPERATURE,
        },
        optional=("temperature",),
    ),
    Family(
        "synonyms",
        markers=(
            Marker(parts=("cycle", "cyc")), Marker(("i", "ia"), ("current",)), Marker(("u", "uv"), ("voltage",)),
            Marker(parts=("time", "dauer")), Marker(parts=("ahcycdischarge", "ahcycledischarge")),
        ),
        needed=4,
        roles={
            "cycle": Pick(("cyclecount", "cyccount", "cycle", "cyclenumber"), (("cycle", "count"), ("cyc", "count"))),
            "time": Pick(
                ("times", "time", "testtimes", "programtimes", "progtime"), (("time",), ("dauer",)),
                ("date", "timestamp", "start"),
            ),
            "current": Pick(
                ("ia", "i", "currenta", "current", "ccur"), (("current",),),
                ("limit", "set", "target", "charge", "discharge", "capacity"),
            ),
            "voltage": Pick(
                ("uv", "u", "voltagev", "voltage", "cvol"), (("voltage",),), ("limit", "set", "target", "min", "max")
            ),
            "temperature": Pick(
                ("tc", "t1c", "temperaturec", "temperature", "csurftemp"), (("temp",),), ("set", "target", "chamber")
            ),
            "capacity": Pick(
                ("ahcycdischarge0", "ahcycledischarge0", "ahcycdischarge", "ahcycledischarge"),
                (("ah", "cyc", "discharge"), ("ah", "cycle", "discharge")),
            ),
        },
        optional=("temperature",), time_unit=1.0, clock=True, width=5,
    ),
)
#: A line without any of these parts in its normalised text is no family's header: each one
#: needs a cycle or a time.
_HINT = "cyc|time|dauer"

PREDICTION_ROLES = ("cycle", "time", "current", "voltage", "temperature")
LABEL_ROLES = ("cycle", "current", "cumulative", "capacity")
_ROLES = tuple(dict.fromkeys(PREDICTION_ROLES + LABEL_ROLES))


def quoted_fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line of delimited text; doubled quotes inside quotes stand for one."""
    plain = split_fields(line, delimiter)
    # With a delimiter put before it, every field is a match that is not empty.
    pattern = F.concat(delimiter, F.lit('((?:"(?:[^"]|"")*")(?='), delimiter, F.lit("|$)|[^"), delimiter, F.lit("]*)"))
    parts = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    bare = F.transform(
        parts,
        lambda x: F.trim(
            F.when(
                F.rlike(x, F.lit('^".*"$')), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))
            ).otherwise(x)
        ),
    )
    quoted = F.contains(line, F.lit('"')) & (delimiter != "whitespace")
    return F.when(quoted, bare).otherwise(plain)


def _place(lines: DataFrame) -> list[str]:
    return [c for c in ("block_start", "line") if c in lines.columns]


def _top_lines(lines: DataFrame) -> DataFrame:
    """Lines that may be headers: a hint in them, among the first lines of their file."""
    place = _place(lines)
    first = lines.filter(F.col("block_start") == 0) if "block_start" in place else lines
    tops = first.groupBy("file").agg(F.min("line").alias("_top"))
    # Regrouping the few candidates by place keeps the costly rules off every other line.
    hinted = (
        first.filter(F.rlike(normalise_header(F.col("value")), F.lit(_HINT)))
        .groupBy("file", *place)
        .agg(F.first("value").alias("value"))
    )
    near = hinted.join(tops, "file").filter(F.col("line") - F.col("_top") < HEADER_LINES)
    return near.withColumn("value", F.regexp_replace("value", "^﻿", "")).drop("_top")


def _of_family(families: tuple[Family, ...], value: Callable[[Family], Column]) -> Column:
    out = F.lit(None)
    for n, f in enumerate(families):
        out = F.when(F.col("family") == n, value(f)).otherwise(out)
    return out


def _candidates(lines: DataFrame, families: tuple[Family, ...]) -> DataFrame:
    """Every way to read a top line as a header: family, delimiter, fields and markers shown."""
    line = F.col("value")
    options = [
        F.struct(F.lit(n).alias("family"), F.lit(order).alias("order"), delimiter.alias("delimiter"))
        for n, f in enumerate(families)
        for order, delimiter in enumerate([delimiter_of(line)] if f.single else map(F.lit, f.delimiters))
    ]
    read = _top_lines(lines).select("*", F.inline(F.array(*options)))
    # A generator holds the fields, so that they are found once and not once per rule.
    fields = F.transform(quoted_fields(line, F.col("delimiter")), normalise_header)
    read = read.select("*", F.explode(F.array(fields)).alias("fields"))

    def score(f: Family) -> Column:
        return sum((m.shown(F.col("fields")) for m in f.markers[1:]), f.markers[0].shown(F.col("fields")))

    def fits(f: Family) -> Column:
        whole = (F.col("score") >= f.needed) & (F.size("fields") >= f.width)
        return whole & F.startswith(line, F.lit(f.begins)) & F.contains(line, F.lit(f.holds))

    return read.withColumn("score", _of_family(families, score)).filter(_of_family(families, fits))


def resolved_headers(lines: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """One row per file that a family admits: family, place of the header, delimiter, places of the roles."""
    place = _place(lines)
    found = _candidates(lines, families)
    rank = F.struct("score", *[-F.col(c) for c in place], -F.col("order"))
    chosen = F.struct(*place, "delimiter", "fields")
    best = found.groupBy("file", "family").agg(
        F.max_by(chosen, rank).alias("best"), F.count(F.lit(1)).alias("headers")
    ).select("file", "family", "headers", "best.*")

    def place_of(role: str) -> Column:
        none = F.lit(None).cast("int")
        return _of_family(families, lambda f: f.roles[role].place(F.col("fields")) if role in f.roles else none)

    best = best.withColumns({f"at_{r}": place_of(r) for r in _ROLES})

    def complete(f: Family) -> Column:
        whole = (F.col("headers") == 1) if f.single else F.lit(True)
        for role in f.roles:
            if role not in f.optional:
                whole = whole & F.col(f"at_{role}").isNotNull()
        return whole

    best = best.filter(_of_family(families, complete)).withColumn("width", F.size("fields"))
    kept = [c for c in best.columns if c not in ("file", "headers", "fields")]
    first = best.groupBy("file").agg(F.min_by(F.struct(*kept), "family").alias("_h")).select("file", "_h.*")
    named = F.element_at(F.array(*[F.lit(f.name) for f in families]), F.col("family") + 1)
    return first.withColumn("family", named)


def unresolved_files(lines: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """Files that no family admits."""
    return _without(lines, resolved_headers(lines, families))


def _without(lines: DataFrame, heads: DataFrame) -> DataFrame:
    return lines.select("file").distinct().join(heads.select("file"), "file", "left_anti")


def _meet(lines: DataFrame, per_file: DataFrame) -> DataFrame:
    few = per_file.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    return lines.join(F.broadcast(per_file) if few else per_file, "file")


def _project(lines: DataFrame, roles: tuple[str, ...], families: tuple[Family, ...], check: bool) -> DataFrame:
    place = _place(lines)
    # Headers are looked for once; the check, the count and the join read the small table.
    heads = durable(resolved_headers(lines, families))
    if check:
        enforce(_without(lines, heads), "a header of a known family in each file")
    heads = heads.select(
        "file", "family", "delimiter", "width", *[f"at_{r}" for r in roles],
        F.struct(*place).alias("_head"),
    )
    data = lines.filter(F.trim("value") != "")
    joined = _meet(data, heads).filter(F.struct(*place) > F.col("_head"))
    parts = joined.withColumn("_f", quoted_fields(F.col("value"), F.col("delimiter")))
    parts = parts.filter(F.size("_f") <= F.col("width"))
    keep = [c for c in lines.columns if c != "value"]
    return parts.select(
        *keep, "family", *[F.get("_f", F.col(f"at_{r}") - 1).alias(f"{r}_raw") for r in roles]
    )


def prediction_fields(
    lines: DataFrame, families: tuple[Family, ...] = FAMILIES, check: bool = True
) -> DataFrame:
    """Charge-side columns as text, for all families; no outcome column is projected."""
    return _project(lines, PREDICTION_ROLES, families, check)


def label_fields(
    lines: DataFrame, families: tuple[Family, ...] = FAMILIES, check: bool = True
) -> DataFrame:
    """Label-side columns as text; a family has a running counter or a capacity per cycle."""
    return _project(lines, LABEL_ROLES, families, check)


def with_seconds(
    fields: DataFrame, families: tuple[Family, ...] = FAMILIES, check: bool = True
) -> DataFrame:
    """``seconds`` in the family's unit; clock text where the family allows it.

    A file whose times are mostly not numeric in a family without clock text stops the read.
    """
    numeric = number("time_raw")
    share = fields.groupBy("file", "family").agg(F.avg(numeric.isNotNull().cast("double")).alias("_share"))
    clocks = F.col("family").isin(*[f.name for f in families if f.clock])
    if check:
        enforce(share.filter(~clocks & (F.col("_share") < NUMERIC_SHARE)), "numeric times")
    unit = F.lit(None).cast("double")
    for f in families:
        unit = F.when(F.col("family") == f.name, f.time_unit).otherwise(unit)
    joined = _meet(fields, share.drop("family"))
    value = F.when(clocks & (F.col("_share") < NUMERIC_SHARE), clock_seconds("time_raw")).otherwise(numeric * unit)
    return joined.withColumn("seconds", value).drop("_share")
