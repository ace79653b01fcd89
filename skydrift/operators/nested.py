"""Deeply nested JSON records as related flat tables.

Documents are parsed to VARIANT; ``infer`` gives their merged schema as a tree of ``Shape``s, with every kind of value that stands
at a place, JSON held as text included. ``shred`` walks that tree: the record is sought at whatever depth it stands, and each
collection at any level becomes a child table that carries its ancestors' keys and the ordinal of the item.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.tables import materialize

#: A step of a path: into the items of a collection.
ITEM = 0
_JSON = r"^\s*[\[{]"


@dataclass
class Shape:
    """What stands at one place of the documents: the kinds of values seen there ('OBJECT', 'ARRAY', 'TEXT' for JSON held as
    text, else the names of scalar types), the fields of objects, and the items of arrays."""

    kinds: set[str] = field(default_factory=set)
    fields: dict[str, Shape] = field(default_factory=dict)
    items: Shape | None = None

    def merge(self, other: Shape) -> None:
        self.kinds |= other.kinds
        for name, s in other.fields.items():
            self.fields.setdefault(name, Shape()).merge(s)
        if other.items:
            self.items = self.items or Shape()
            self.items.merge(other.items)

    def settle(self, step=ITEM) -> None:
        """Objects that stand in a field with arrays may be items: what they have in common with the items is merged, here and below.
        Names of their own may be those of a map's items."""
        if not self.plain(step) and self.items:
            self.items.merge(Shape(set(), {n: s for n, s in self.fields.items() if n in self.items.fields}))
        for name, s in self.fields.items():
            s.settle(name)
        if self.items:
            self.items.settle()

    def places(self, path: tuple = ()):
        """(path, shape) of all places, outer ones first. An object in a field that holds arrays too is an item or a map of items,
        so that its fields are no places of their own."""
        yield path, self
        if self.plain(path[-1] if path else ITEM):
            for name in sorted(self.fields):
                yield from self.fields[name].places((*path, name))
        if self.items:
            yield from self.items.places((*path, ITEM))

    def plain(self, step) -> bool:
        """Whether objects here, in a field (or among items), are just that, and no collections."""
        return step == ITEM or "ARRAY" not in self.kinds

    def at(self, path: tuple) -> Shape:
        return reduce(lambda s, step: s.items if step == ITEM else s.fields[step], path, self)


@dataclass(frozen=True)
class Level:
    """What is known of a collection beforehand: the name of its ordinal, its field, and fields that tell an item from a map of items."""

    name: str
    field: str
    marks: tuple[str, ...] = ()


def latest_complete(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Of each key the latest payload that is one complete JSON document, as VARIANT column ``doc``.

    A byte-order mark before the document is no part of it. Payloads that are null or cut off don't count; of two with the
    same time the greater text is taken. The table is written once, since its schema and its rows are read in turn.
    """
    text = F.ltrim(F.col(payload), F.lit("﻿"))
    doc = df.select(key, order, text.alias(payload)).where(F.try_parse_json(payload).isNotNull())
    last = doc.groupBy(key).agg(F.max(F.struct(order, payload)).alias("m"))
    return materialize(last.select(key, F.col(f"m.{order}").alias(order), F.try_parse_json(f"m.{payload}").alias("doc")))


def parse_schema(text: str) -> Shape:
    """The shape that the text of ``schema_of_variant_agg`` stands for."""
    tokens = re.findall(r"`(?:[^`]|``)*`|\w+\(\d+,\s*\d+\)|[<>:,]|[^<>:,\s]+", text)
    pos = 0

    def kind() -> Shape:
        nonlocal pos
        name = tokens[pos]
        pos += 1
        out = Shape({name.split("(")[0]})
        if pos < len(tokens) and tokens[pos] == "<":
            pos += 1
            while tokens[pos] != ">":
                if name == "ARRAY":
                    out.items = kind()
                    continue
                member = re.sub(r"^`|`$", "", tokens[pos]).replace("``", "`")
                pos += 2
                out.fields[member] = kind()
                if tokens[pos] == ",":
                    pos += 1
            pos += 1
        return out

    return kind()


# Expressions over VARIANT values are built as SQL text: with hundreds of places, building them as columns took longer than the jobs.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Names:
    """Fresh names of lambda variables."""

    n = 0

    @classmethod
    def next(cls) -> str:
        cls.n += 1
        return f"x{cls.n}"


def let(value: str, body) -> str:
    """``body`` of a name that is bound to a value, so that the value is computed once."""
    x = _Names.next()
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def member(v: str, name: str) -> str:
    """A member of an object as VARIANT; null if there is none."""
    if re.fullmatch(r"[^.\[]+", name):
        return f"try_variant_get({v}, {_quoted('$.' + name)}, 'variant')"
    if not re.search(r"['?]", name):
        return f"""try_variant_get({v}, {_quoted("$['" + name + "']")}, 'variant')"""
    return f"try_element_at(try_variant_get({v}, '$', 'map<string,variant>'), {_quoted(name)})"


def opened(v: str) -> str:
    """What a text that holds JSON holds; any other value as it is."""
    return let(v, lambda x: f"coalesce(CASE WHEN schema_of_variant({x}) = 'STRING' AND CAST({x} AS STRING) RLIKE {_quoted(_JSON)} THEN try_parse_json(CAST({x} AS STRING)) END, {x})")


def items(value: str, marks: set[str], text: bool = True) -> str:
    """A collection in any of its forms as array<struct<name, item>>.

    An array gives its items; an object with one of ``marks`` is a lone item; another object maps names to
    items; a text that holds JSON counts as what it holds. Anything else, null too, gives an empty array.
    """
    none = "CAST(NULL AS STRING)"
    lone = f"arrays_overlap(map_keys(m), array({', '.join(map(_quoted, sorted(marks)))}))" if marks else "false"

    def forms(v):
        members = let(f"try_variant_get({v}, '$', 'map<string,variant>')", lambda m: (
            f"CASE WHEN {lone.replace('map_keys(m)', f'map_keys({m})')} THEN array(named_struct('name', {none}, 'item', {v})) "
            f"ELSE transform(map_entries({m}), e -> named_struct('name', e.key, 'item', e.value)) END"))
        return (f"coalesce(transform(try_variant_get({v}, '$', 'array<variant>'), e -> named_struct('name', {none}, 'item', e)), {members}, "
                f"slice(array(named_struct('name', {none}, 'item', {v})), 1, 0))")

    return let(opened(value) if text else value, forms)


def _marks(shape: Shape, name, levels: list[Level]) -> set[str]:
    """Fields that tell a lone item: those of the items of arrays at this place, and those known beforehand."""
    return (set(shape.items.fields) if shape.items else set()) | {m for v in levels if v.field == name for m in v.marks}


def values_at(shape: Shape, places: dict[tuple, int], levels: list[Level], v: str = "doc", path: tuple = ()) -> str:
    """The values at the given places, of which one at least is at or below ``path``, as array<struct<place, v>>. Of places where all
    values but texts are known, only texts that may hold JSON."""
    parts = []
    if path in places:
        here = f"array(named_struct('place', {places[path]}, 'v', {v}))"
        held = f"{v} IS NOT NULL" if "VARIANT" in shape.kinds else f"try_variant_get({v}, '$', 'string') RLIKE {_quoted(_JSON)}"
        parts.append(f"CASE WHEN {held} THEN {here} ELSE slice({here}, 1, 0) END")
    text = "TEXT" in shape.kinds
    inner = [x for x in sorted(shape.fields) if shape.plain(path[-1] if path else ITEM) and any(p[:len(path) + 1] == (*path, x) for p in places)]
    if inner:
        def fields(w):
            return "concat(" + ", ".join(values_at(shape.fields[x], places, levels, member(w, x), (*path, x)) for x in inner) + ")"

        parts.append(let(opened(v), fields) if text else fields(v))
    if shape.items and any(p[:len(path) + 1] == (*path, ITEM) for p in places):
        x = _Names.next()
        below = values_at(shape.items, places, levels, f"{x}.item", (*path, ITEM))
        parts.append(f"flatten(transform({items(v, _marks(shape, path[-1] if path else None, levels), text)}, {x} -> {below}))")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _needed(path: tuple, marks: set[str], wanted: set[str] | None) -> bool:
    """Whether what stands at a place matters: all does where a record may be; below the marks of a record, what leads to a wanted table."""
    at = next((k for k, x in enumerate(path) if x in marks), None)
    if wanted is None or at is None:
        return True
    inside = ".".join(x for x in path[at:] if x != ITEM)
    return any(w == inside or w.startswith(inside + ".") for w in wanted)


def infer(df: DataFrame, doc: str, levels: list[Level] = (), marks: set[str] = frozenset(), wanted: set[str] | None = None) -> Shape:
    """The merged schema of a VARIANT column.

    Where values of several kinds stand, or texts that hold JSON, the schema of each kind is taken again, in one job for all
    such places of a depth. What comes to the driver has one entry per distinct field, however many documents there are.
    ``wanted``: below the ``marks`` of records only places on the way to these tables are looked at again.
    """
    text = df.agg(F.schema_of_variant_agg(doc)).first()[0]
    shape, done = parse_schema(text) if text else Shape(), set()
    while True:
        open_ = [(p, s) for p, s in shape.places() if p not in done and s.kinds & {"VARIANT", "STRING"} and _needed(p, marks, wanted)]
        if not open_:
            return shape
        done |= {p for p, _ in open_}
        found = values_at(shape, {p: n for n, (p, _) in enumerate(open_)}, levels)
        rows = df.select(F.col(doc).alias("doc")).select(F.expr(f"explode({found}) AS x")).select("x.place", "x.v", F.schema_of_variant("x.v").alias("s"))
        held = f"CASE WHEN s = 'STRING' AND CAST(v AS STRING) RLIKE {_quoted(_JSON)} THEN try_parse_json(CAST(v AS STRING)) END"
        rows = rows.withColumn("held", F.expr(held)).select(
            "place", F.col("held").isNotNull().alias("text"), F.coalesce("held", "v").alias("v"),
            F.regexp_extract(F.when(F.col("held").isNotNull(), F.schema_of_variant("held")).otherwise(F.col("s")), r"^\w+", 0).alias("kind"))
        merged = rows.groupBy("place", "text", "kind").agg(F.schema_of_variant_agg("v").alias("s")).collect()
        for path, s in open_:
            s.kinds.discard("VARIANT")
        for r in merged:
            s = open_[r["place"]][1]
            if r["kind"] != "VOID":
                s.merge(parse_schema(r["s"]))
            if r["text"]:
                s.kinds.add("TEXT")
        shape.settle()


def record_in(v: str, shape: Shape, marks: set[str], levels: list[Level], name=ITEM) -> str | None:
    """The record inside its wrappers: the first object that holds any of the marks, outer ones first. None if the shape has no such place."""
    def inside(w):
        found = []
        if here := marks & set(shape.fields):
            found.append(f"CASE WHEN {' OR '.join(member(w, m) + ' IS NOT NULL' for m in sorted(here))} THEN {w} END")
        if shape.plain(name):
            inner = [record_in(member(w, f), s, marks, levels, f) for f, s in sorted(shape.fields.items()) if f not in marks]
            found += [x for x in inner if x is not None]
        if shape.items:
            x = _Names.next()
            each = record_in(f"{x}.item", shape.items, marks, levels)
            if each is not None:
                found.append(f"try_element_at(filter(transform({items(w, _marks(shape, name, levels), False)}, {x} -> {each}), e -> e IS NOT NULL), 1)")
        return found

    if not inside("doc"):
        return None
    join = lambda w: f"coalesce({', '.join([*inside(w), 'CAST(NULL AS VARIANT)'])})"
    return let(opened(v), join) if "TEXT" in shape.kinds else join(v)


def record_shape(shape: Shape, marks: set[str]) -> Shape:
    """The merged shape of the records, wherever they stand; empty if there are none."""
    out, inner = Shape(), {f: record_shape(s, marks) for f, s in shape.fields.items() if f not in marks}
    if marks & set(shape.fields):
        out.merge(Shape(shape.kinds - {"ARRAY", "TEXT"}, {f: s for f, s in shape.fields.items() if f in marks or not inner[f].fields}))
    for s in inner.values():
        out.merge(s)
    if shape.items:
        out.merge(record_shape(shape.items, marks))
    out.settle()
    return out


def collections(shape: Shape, levels: list[Level], path: tuple = ()) -> list[tuple]:
    """Paths, through objects, of the outermost collections."""
    if path and ("ARRAY" in shape.kinds or path[-1] in {v.field for v in levels}):
        return [path]
    return [p for f in sorted(shape.fields) for p in collections(shape.fields[f], levels, (*path, f))]


def shred(records: DataFrame, key: str, marks: set[str], levels: list[Level] = (), wanted: set[str] | None = None, keep_empty: bool = False) -> dict[str, DataFrame]:
    """Flat tables of nested records: '' has one row per record, and each collection of the merged schema, at any level, is a table under
    its dotted path.

    A child table has its parent's keys, its own ordinal from 1 (``<field>_no``, or the name of its level), ``name`` (of a map's
    item) and ``doc``; items of a map are numbered in the order of their names. ``wanted``: only these collections, and those on the way to them. With ``keep_empty`` a parent without
    items gives one row with null ordinal and item. An array that is itself an item of an array stays in ``doc``.
    """
    wanted = None if wanted is None else wanted | {w[:k] for w in wanted for k, c in enumerate(w) if c == "."}
    shape = infer(records, "doc", levels, marks, wanted)
    record = record_in("doc", shape, marks, levels)
    whole = opened("doc") if "TEXT" in shape.kinds else "doc"
    tables = {"": records.select(key, F.expr(whole if record is None else f"coalesce({record}, {whole})").alias("doc"))}

    def below(parent: DataFrame, keys: list[str], node: Shape, prefix: str) -> None:
        for path in collections(node, levels):
            full = ".".join([*([prefix] if prefix else []), *path])
            if wanted is not None and full not in wanted:
                continue
            v, here = "doc", node
            for step in path:
                v, here = member(opened(v) if "TEXT" in here.kinds else v, step), here.fields[step]
            no = next((f"{x.name}_no" for x in levels if x.field == path[-1]), f"{path[-1]}_no")
            while no in keys:
                no += "_"
            explode = F.posexplode_outer if keep_empty else F.posexplode
            found = F.expr(items(v, _marks(here, path[-1], levels), "TEXT" in here.kinds))
            rows = parent.select(*keys, explode(found).alias("pos", "x"))
            tables[full] = rows.select(*keys, (F.col("pos") + 1).cast("int").alias(no), "x.name", F.col("x.item").alias("doc"))
            if here.items:
                below(tables[full], [*keys, no], here.items, full)

    below(tables[""], [key], record_shape(shape, marks) if record is not None else shape, "")
    for x in levels:  # what no document has is an empty table
        for parent in [p for p in ("", *[v.field for v in levels]) if p in tables]:
            keys = [c for c in tables[parent].columns if c not in ("name", "doc")]
            full = f"{parent}.{x.field}" if parent else x.field
            if x.field not in {t.split(".")[-1] for t in tables} and (wanted is None or full in wanted):
                tables[full] = tables[parent].select(*keys, F.lit(None).cast("int").alias(f"{x.name}_no"), F.lit(None).cast("string").alias("name"), "doc").where(F.lit(keep_empty))
                tables[full] = tables[full].withColumn("doc", F.lit(None).cast("variant"))
    return tables


def scalars(table: DataFrame, shape: Shape | None = None) -> DataFrame:
    """The keys of a table of ``shred`` and one column for each scalar of its documents, by dotted path; texts as they are, numbers as doubles,
    and what is sometimes a number and sometimes a text as text."""
    shape = shape or infer(table.where("doc is not null"), "doc")
    keys = [c for c in table.columns if c != "doc"]
    out = []
    for path, s in shape.places():
        kinds = s.kinds - {"OBJECT", "ARRAY", "TEXT", "VOID"}
        if path and kinds and ITEM not in path:
            kind = "double" if kinds <= {"BIGINT", "DOUBLE", "DECIMAL", "FLOAT"} else "boolean" if kinds == {"BOOLEAN"} else "string"
            v, here = "doc", shape
            for step in path:
                v, here = member(opened(v) if "TEXT" in here.kinds else v, step), here.fields[step]
            name = ".".join(path)
            while name in keys:
                name += "_"
            out.append(F.try_variant_get(F.expr(v), "$", kind).alias(name))
    return table.select(*keys, *out)


def number(doc: Column, path: str) -> Column:
    """A number that may be spelled as text; null where it is none."""
    return F.try_variant_get(doc, path, "string").try_cast("double")


LEVELS = [Level("signal", "signals", ("name", "morphology")), Level("channel", "target_channels", ("channel_index",))]


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """Reports ('report'), signals ('signal') and target channels ('channel') of the latest complete payload of each report.

    Signals without channels have one row with a null channel_no.
    """
    latest = latest_complete(reports, "report_id", "received_at", "payload")
    t = shred(latest, "report_id", {"signals", "plan_name", "contract"}, LEVELS, {"signals", "signals.target_channels"}, keep_empty=True)
    return {"report": t[""], "signal": t["signals"].where("signal_no is not null"), "channel": t["signals.target_channels"].where("signal_no is not null")}


def reports_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One flat row per report."""
    d = F.col("doc")
    return tables["report"].select(
        "report_id",
        F.try_variant_get(d, "$.plan_name", "string").alias("plan_name"),
        number(d, "$.rows").cast("bigint").alias("n_rows"),
        F.try_variant_get(d, "$.observation.obs_id", "string").alias("obs_id"),
        number(d, "$.contract.channelizer_fft").cast("bigint").alias("channelizer_fft"),
    )


def signals_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One flat row per signal, with its resolved values."""
    d, r = F.col("doc"), F.expr(opened(member("doc", "resolved")))
    return tables["signal"].select(
        "report_id", "signal_no",
        F.try_variant_get(d, "$.name", "string").alias("name"),
        F.try_variant_get(d, "$.morphology", "string").alias("morphology"),
        number(r, "$.start_s").alias("start_s"), number(r, "$.duration_s").alias("duration_s"),
        number(r, "$.start_freq_hz").alias("start_freq_hz"), number(r, "$.drift_hz_per_s").alias("drift_hz_per_s"),
        number(r, "$.snr_db").alias("snr_db"), number(r, "$.start_row").cast("bigint").alias("start_row"),
    )


def _channel() -> Column:
    """An item that names no channel (no channel_index, and no name in a map) is no target channel."""
    return F.coalesce(number(F.col("doc"), "$.channel_index"), F.col("name").try_cast("double")).cast("int")


def channels_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per target channel of a signal, repeats once; -1 for a signal without any."""
    named = tables["channel"].select("report_id", "signal_no", _channel().alias("channel_index"))
    return (named.groupBy("report_id", "signal_no").agg(F.collect_set("channel_index").alias("found"))
            .select("report_id", "signal_no", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit(-1)))).alias("channel_index")))


def channel_values_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per item of a signal's target channels, repeats too, with its ordinal and values; channel_index is null where it names none."""
    d = F.col("doc")
    names = ("baseband_hz", "amp_scale", "channel_rms", "realized_snr_db", "realized_local_psd_snr_db")
    return tables["channel"].where("channel_no is not null").select("report_id", "signal_no", "channel_no", _channel().alias("channel_index"),
                                                                   *[number(d, f"$.{n}").alias(n) for n in names])


def truth_table(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per signal of each report as truth: resolved values, else requested ones, else defaults; what a signal doesn't have itself is
    that of its first target channel."""
    first = F.expr(f"try_element_at(transform({items(member('doc', 'target_channels'), {'channel_index'})}, x -> x.item), 1)")
    t = tables["signal"].select("report_id", "signal_no", "doc", F.expr(opened(member("doc", "resolved"))).alias("res"), F.expr(opened(member("doc", "requested"))).alias("req"), first.alias("ch"))
    of = lambda name, *places: F.coalesce(*[number(F.col(p), f"$.{name}") for p in places])
    text = lambda name, *places: F.coalesce(*[F.try_variant_get(p, f"$.{name}", "string") for p in places])
    zero = F.lit(0.0)
    t = t.withColumns({"start": F.coalesce(of("start_s", "res", "req"), zero), "length": F.coalesce(of("duration_s", "res", "req"), zero)})
    return t.select(
        "report_id", "signal_no", F.coalesce(text("name", "doc", "req"), F.format_string("signal_%03d", "signal_no")).alias("signal_name"),
        F.col("start").alias("injected_start_s"), F.col("length").alias("injected_duration_s"), (F.col("start") + F.col("length")).alias("injected_end_s"),
        F.coalesce(of("start_freq_hz", "res", "req"), of("abs_freq_hz", "req"), zero).alias("injected_start_freq_hz"),
        F.coalesce(of("drift_hz_per_s", "res", "req"), zero).alias("injected_drift_hz_per_s"), F.coalesce(of("snr_db", "res", "req"), zero).alias("injected_snr_db"),
        of("realized_snr_db", "ch").alias("injected_realized_snr_db"), F.coalesce(text("snr_reference", "doc", "ch"), F.lit("coarse_channel")).alias("snr_reference"),
        *[of(n, "doc", "ch").alias(n) for n in ("requested_snr_db", "requested_local_psd_snr_db", "realized_local_psd_snr_db")],
        F.coalesce(of("freq_tolerance_hz", "req"), F.lit(120.0)).alias("freq_tolerance_hz"), F.coalesce(of("drift_tolerance_hz_per_s", "req"), F.lit(6.0)).alias("drift_tolerance_hz_per_s"),
        of("channel_index", "ch").cast("int").alias("target_channel_index"))
